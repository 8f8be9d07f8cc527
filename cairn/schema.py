"""Schemas shared by sources, operators and sinks."""

from __future__ import annotations

SEGMENTS = "array<struct<block:int,offset:bigint,len:bigint>>"
MANIFEST = "path string, abs string, kind string, mode int, mtime bigint, mtime_nanos int, size bigint, hash string, link_target string"
BLOCKS = "block int, offset bigint, clen bigint, rlen bigint, codec tinyint"
ENTRIES = f"path string, kind string, mode int, mtime bigint, mtime_nanos int, size bigint, hash binary, link_target string, segments {SEGMENTS}"
BENCH = "corpus string, tool string, raw_bytes bigint, packed_bytes bigint, compress_s double, decompress_s double"

DEFAULT_BLOCK_SIZE = 64 << 20
MIN_BLOCK_SIZE = 1 << 20
HEADER_LEN = 16
FOOTER_LEN = 64
#: Bytes of a file that are one cell, and so one segment, at most (a cell ends at 2 GiB).
MAX_PIECE = 1 << 30
