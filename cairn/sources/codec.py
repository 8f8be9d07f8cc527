"""Block encoding and decoding. Decoding is bounded: a block never yields more than its stated length."""

from __future__ import annotations

import io
import lzma

import zstandard

from cairn.functions.classify import CODECS

MAX_WINDOW = 1 << 27


def window_log_of(block_size: int) -> int:
    log = 10
    while log < 27 and (1 << log) < block_size:
        log += 1
    return log


def encode(codec: int, level: int, block_size: int, raw: bytes) -> bytes:
    if codec == 0:
        return raw
    if codec == 1:
        params = zstandard.ZstdCompressionParameters.from_level(level, window_log=window_log_of(block_size))
        return zstandard.ZstdCompressor(compression_params=params).compress(raw)
    if codec == 2:
        return lzma.compress(raw, preset=min(9, max(0, level)))
    raise ValueError(f"unknown codec {codec}")


def decode(codec: int, data: bytes, rlen: int) -> bytes:
    if codec == 0:
        raw = data
    elif codec == 1:
        with zstandard.ZstdDecompressor(max_window_size=MAX_WINDOW).stream_reader(io.BytesIO(data)) as r:
            raw = r.read(rlen + 1)
    elif codec == 2:
        try:
            raw = lzma.LZMADecompressor().decompress(data, max_length=rlen + 1)
        except lzma.LZMAError as e:
            raise ValueError(f"corrupt block: {e}") from e
    else:
        raise ValueError(f"unknown codec {codec}; known: {CODECS}")
    if len(raw) != rlen:
        raise ValueError("block decoded to the wrong size; archive is corrupt")
    return raw
