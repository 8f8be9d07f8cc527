"""The container: header, solid blocks, compressed index, footer; its Spark sources and its Spark sink.

    container_index    one row per entry, without reading a block (option "paths": JSON list of selectors)
    container_blocks   one row per block, decoded; a partition is a block, or some small ones (options "blocks": JSON
                       list of ids; "paths")
    container_files    one row per segment of a file, cut from its block in the task that decodes it, with the file's
                       entry; only blocks that the selected files touch are read, each once
    container          the sink: rows (block, codec, level, offset, size, content), each block whole in one partition and
                       in order, become part files in a staging folder; commit joins them to one file and renames it

Layout (little-endian): header 16 bytes = magic, version u16, zeros; blocks back to back; index = zstd 19 over a
bincode record; footer 64 bytes = index offset, stored length, raw length (u64 each), hash of the raw index (32 bytes),
version u16, two zeros, magic. Magic and hash are parameters, so that containers of the same layout from elsewhere can
be read: pass their magic and "blake3". Lengths are held against the file's size before anything is allocated.
Paths need not be unique. Driver and executors must share the folder of the container.
"""

from __future__ import annotations

import json
import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from cairn import __version__
from cairn.functions.classify import lane_codec
from cairn.operators.pack import assign_blocks, attach_segments, block_table, first_copies, order, survivors
from cairn.operators.reports import dedup_counts, kind_counts, kind_rank
from cairn.schema import BLOCKS, DEFAULT_BLOCK_SIZE, ENTRIES, FOOTER_LEN, HEADER_LEN, MAX_PIECE, MIN_BLOCK_SIZE
from cairn.session import checkpoint
from cairn.sources.blake3 import blake3_many
from cairn.sources.codec import decode, encode
from cairn.sources.filetree import HASHES

MAGIC = b"CARN"
VERSION = 1
KINDS = ("file", "dir", "symlink")


class CorruptContainer(ValueError):
    pass


def entry_bytes(e: dict) -> bytes:
    """An entry's part of the index record."""
    text = lambda s: struct.pack("<Q", len(b := s.encode())) + b
    out = [text(e["path"]), struct.pack("<IIqIQ", KINDS.index(e["kind"]), e["mode"], e["mtime"], e["mtime_nanos"], e["size"])]
    out.append(b"\0" if e["hash"] is None else b"\1" + bytes(e["hash"]))
    out.append(b"\0" if e["link_target"] is None else b"\1" + text(e["link_target"]))
    out.append(struct.pack("<Q", len(e["segments"])) + b"".join(struct.pack("<IQQ", *s) for s in e["segments"]))
    return b"".join(out)


@dataclass
class Index:
    blocks: list[tuple[int, int, int, int]] = field(default_factory=list)  # offset, clen, rlen, codec
    entries: list[dict] = field(default_factory=list)
    created_by: str = f"cairn {__version__}"

    def head(self, n: int | None = None) -> bytes:
        count = struct.pack("<Q", len(self.entries) if n is None else n)
        return struct.pack("<Q", len(self.blocks)) + b"".join(struct.pack("<QQQB", *b) for b in self.blocks) + count

    def tail(self) -> bytes:
        return struct.pack("<Q", len(b := self.created_by.encode())) + b

    def to_bytes(self) -> bytes:
        return b"".join([self.head(), *map(entry_bytes, self.entries), self.tail()])

    @classmethod
    def from_bytes(cls, raw: bytes) -> Index:
        at = 0

        def take(fmt: str) -> tuple:
            nonlocal at
            got = struct.unpack_from(fmt, raw, at)
            at += struct.calcsize(fmt)
            return got

        def text() -> str:
            nonlocal at
            (n,) = take("<Q")
            if n > len(raw) - at:
                raise CorruptContainer("a string is longer than the index")
            at += n
            return raw[at - n : at].decode()

        def count(least: int) -> int:
            (n,) = take("<Q")
            if n * least > len(raw) - at:
                raise CorruptContainer("a list is longer than the index")
            return n

        try:
            blocks = [take("<QQQB") for _ in range(count(25))]
            entries = []
            for _ in range(count(46)):
                path = text()
                kind, mode, mtime, nanos, size = take("<IIqIQ")
                hashed = take("<32s")[0] if take("<B")[0] else None
                link = text() if take("<B")[0] else None
                segments = [take("<IQQ") for _ in range(count(20))]
                entries.append({"path": path, "kind": KINDS[kind], "mode": mode, "mtime": mtime, "mtime_nanos": nanos, "size": size, "hash": hashed, "link_target": link, "segments": segments})
            return cls(blocks, entries, text())
        except (struct.error, IndexError, UnicodeDecodeError) as e:
            raise CorruptContainer(f"the index can't be read: {e}") from e


def header(magic: bytes = MAGIC) -> bytes:
    return struct.pack("<4sH10x", magic, VERSION)


def footer(offset: int, clen: int, rlen: int, hashed: bytes, magic: bytes = MAGIC) -> bytes:
    return struct.pack("<QQQ32sH2x4s", offset, clen, rlen, hashed, VERSION, magic)


def read_footer(f, magic: bytes = MAGIC) -> tuple[int, int, int, bytes]:
    size = f.seek(0, os.SEEK_END)
    if size < HEADER_LEN + FOOTER_LEN:
        raise CorruptContainer("the file is too short")
    f.seek(0)
    got, version = struct.unpack("<4sH10x", f.read(HEADER_LEN))
    if got != magic:
        raise CorruptContainer("wrong magic")
    if version > VERSION:
        raise CorruptContainer(f"format v{version}; known up to v{VERSION}")
    f.seek(size - FOOTER_LEN)
    offset, clen, rlen, hashed, _, tail = struct.unpack("<QQQ32sH2x4s", f.read(FOOTER_LEN))
    if tail != magic:
        raise CorruptContainer("wrong magic at the end; truncated?")
    if offset < HEADER_LEN or offset + clen > size - FOOTER_LEN:
        raise CorruptContainer("the index lies outside the file")
    return offset, clen, rlen, hashed


def read_index(path: str, magic: bytes = MAGIC, hash_name: str = "sha256") -> Index:
    """Two seeks; no block is read. Checks the index's length, then its hash."""
    with open(path, "rb") as f:
        offset, clen, rlen, hashed = read_footer(f, magic)
        f.seek(offset)
        packed = f.read(clen)
    try:
        raw = zstandard.ZstdDecompressor().stream_reader(packed).read(rlen + 1)
    except zstandard.ZstdError as e:
        raise CorruptContainer(f"the index can't be decoded: {e}") from e
    if len(raw) != rlen:
        raise CorruptContainer("the index decoded to the wrong size")
    if HASHES[hash_name](raw).digest() != hashed:
        raise CorruptContainer("the index failed its checksum")
    return Index.from_bytes(raw)


def matches_path(path: str, patterns: list[str]) -> bool:
    """Plain-Python form of matches_any()."""
    return any(q and (path == q or path.startswith(q + "/")) for q in (p.rstrip("/") for p in patterns))


class _Source:
    """Options that all sources have: path, magic, hash, paths (selectors)."""

    def __init__(self, options: dict):
        self.at = options["path"], options.get("magic", MAGIC.decode()).encode(), options.get("hash", "sha256")
        self.paths = json.loads(options["paths"]) if "paths" in options else None
        self.only = json.loads(options["blocks"]) if "blocks" in options else None
        self.last = options.get("last", "false") == "true"

    def entries(self, index: Index) -> Iterator[dict]:
        """With their place in the index as entry_id."""
        for i, e in enumerate(index.entries):
            if self.paths is None or matches_path(e["path"], self.paths):
                yield e | {"entry_id": i}

    def block(self, info: tuple) -> bytes:
        offset, clen, rlen, codec = info
        with open(self.at[0], "rb") as f:
            if offset + clen > os.path.getsize(self.at[0]):
                raise CorruptContainer("a block lies outside the file")
            f.seek(offset)
            return decode(codec, f.read(clen), rlen)


class ContainerIndex(DataSource):
    @classmethod
    def name(cls) -> str:
        return "container_index"

    def schema(self) -> str:
        return ENTRIES + ", entry_id bigint"

    def reader(self, schema) -> DataSourceReader:
        return _IndexReader(self.options)


class _IndexReader(_Source, DataSourceReader):
    def read(self, partition):
        for e in self.entries(read_index(*self.at)):
            yield tuple(e.values())


class ContainerBlocks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "container_blocks"

    def schema(self) -> str:
        return BLOCKS + ", raw binary"

    def reader(self, schema) -> DataSourceReader:
        return _BlockReader(self.options)


@dataclass
class _Block:
    """A block, and of the files that are wanted from it (entry, segment's number, offset, length); or no block, and
    the wanted files without segments."""

    block: int
    info: tuple = ()
    wanted: list[tuple] = field(default_factory=list)


@dataclass
class _Blocks(InputPartition):
    """One block, or several small ones of PART_BYTES together."""

    blocks: list[_Block]


PART_BYTES = 4 << 20


def _partitions(blocks: list[_Block]) -> list[InputPartition]:
    parts, held = [[]], 0
    for b in blocks:
        rlen = b.info[2] if b.info else 0
        if parts[-1] and held + rlen > PART_BYTES:
            parts.append([])
            held = 0
        parts[-1].append(b)
        held += rlen
    return [_Blocks(p) for p in parts]


class _BlockReader(_Source, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        index = read_index(*self.at)
        wanted = range(len(index.blocks)) if self.only is None else self.only
        if self.paths is not None:
            touched = {s[0] for e in self.entries(index) for s in e["segments"]}
            wanted = [b for b in wanted if b in touched]
        if bad := [b for b in wanted if not 0 <= b < len(index.blocks)]:
            raise CorruptContainer(f"no block {bad[0]}")
        return _partitions([_Block(b, index.blocks[b]) for b in wanted])

    def read(self, partition: _Blocks):
        for b in partition.blocks:
            yield b.block, *b.info, self.block(b.info)


class ContainerFiles(DataSource):
    """Option "last": of files with one path only that which is last in storage order."""

    @classmethod
    def name(cls) -> str:
        return "container_files"

    def schema(self) -> str:
        return ENTRIES + ", entry_id bigint, pos int, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _FileReader(self.options)


class _FileReader(_Source, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        index = read_index(*self.at)
        files = [e for e in self.entries(index) if e["kind"] == "file"]
        if self.last:
            place = lambda e: (*(e["segments"][0][:2] if e["segments"] else (1 << 32, 0)), e["entry_id"])
            files = list({e["path"]: e for e in sorted(files, key=place)}.values())
        parts, none = {}, _Block(-1)
        for e in files:
            for pos, (block, offset, length) in enumerate(e["segments"]):
                if not 0 <= block < len(index.blocks):
                    raise CorruptContainer(f"no block {block}")
                parts.setdefault(block, _Block(block, index.blocks[block])).wanted.append((e, pos, offset, length))
            if not e["segments"]:
                none.wanted.append((e, 0, 0, 0))
        return _partitions([none, *(parts[b] for b in sorted(parts))])

    def read(self, partition: _Blocks):
        for b in partition.blocks:
            raw = self.block(b.info) if b.info else b""
            for e, pos, offset, length in b.wanted:
                if offset + length > len(raw):
                    raise CorruptContainer("segment out of range")
                yield (*e.values(), pos, raw[offset : offset + length])


SOURCES = (ContainerIndex, ContainerBlocks, ContainerFiles)


def load(spark: SparkSession, source: type[DataSource], path: str, magic: bytes = MAGIC, hash_name: str = "sha256", **more: object) -> DataFrame:
    """One of the sources; more options as they are, lists as JSON, None left out."""
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).option("path", path).option("magic", magic.decode()).option("hash", hash_name)
    for k, v in more.items():
        if v is not None:
            reader = reader.option(k, json.dumps(v) if isinstance(v, list) else str(v).lower())
    return reader.load()


def block_frame(path: str, spark: SparkSession, magic: bytes = MAGIC, hash_name: str = "sha256") -> DataFrame:
    return spark.createDataFrame([(i, *b) for i, b in enumerate(read_index(path, magic, hash_name).blocks)], BLOCKS)


def digest(content: Column, hash_name: str) -> Column:
    """The hash of each cell, as bytes."""
    if hash_name == "sha256":
        return F.unhex(F.sha2(content, 256))

    @F.arrow_udf("binary")
    def many(col: pa.Array) -> pa.Array:
        found = iter(blake3_many([x.as_py() for x in col if x.is_valid]))
        return pa.array([next(found) if x.is_valid else None for x in col], pa.binary())

    return many(content)


# --- blocks as rows
def encode_blocks(members: DataFrame, block_size: int, codec: int, level: int, fast_lane: bool = True) -> DataFrame:
    """block, codec, rlen, clen, data from (block, lane, offset, size, content): one shuffle of contents, by block."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, c, raw_len, data in _encoded(it, block_size):
            cols = [pa.array([x], t) for x, t in ((block, pa.int32()), (c, pa.int8()), (raw_len, pa.int64()), (len(data), pa.int64()), (data, pa.binary()))]
            yield pa.RecordBatch.from_arrays(cols, names=["block", "codec", "rlen", "clen", "data"])

    rows = _by_block(members, codec, level, fast_lane)
    return rows.mapInArrow(work, "block int, codec tinyint, rlen bigint, clen bigint, data binary")


def _by_block(members: DataFrame, codec: int, level: int, fast_lane: bool, parts: int | None = None) -> DataFrame:
    c, lv = lane_codec(F.col("lane"), codec, level) if fast_lane else (F.lit(codec), F.lit(level))
    rows = members.select("block", c.cast("int").alias("codec"), lv.cast("int").alias("level"), "offset", "size", "content")
    rows = rows.repartition(parts, "block") if parts else rows.repartition("block")
    return rows.sortWithinPartitions("block", "offset")


def _encoded(it: Iterator[pa.RecordBatch], block_size: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(block, codec, raw length, encoded bytes) of rows in order of block and offset; one raw block is held."""
    now, held, used = None, [], 0

    def close() -> tuple[int, int, int, bytes]:
        raw = b"".join(held)
        return now[0], now[1], len(raw), encode(now[1], now[2], block_size, raw)

    for batch in it:
        cols = [batch.column(c) for c in ("block", "codec", "level", "offset", "size", "content")]
        for row in zip(*(c.to_pylist() for c in cols[:5]), cols[5], strict=True):
            block, codec, level, offset, size, content = row
            if now is not None and now[0] != block:
                yield close()
                held, used = [], 0
            now, data = (block, codec, level), content.as_py()
            if offset != used or len(data) != size:
                raise OSError(f"block {block}: a file is not as long as it was")
            held.append(data)
            used += size
    if now is not None:
        yield close()


def decode_blocks(encoded: DataFrame) -> DataFrame:
    """block, raw: decoded block by block in Arrow batches."""

    @F.arrow_udf("binary")
    def dec(codec: pa.Array, data: pa.Array, rlen: pa.Array) -> pa.Array:
        return pa.array([decode(c, d.as_py(), n) for c, d, n in zip(codec.to_pylist(), data, rlen.to_pylist(), strict=True)], pa.binary())

    return encoded.select("block", dec("codec", "data", "rlen").alias("raw"))


# --- the sink
@dataclass
class _Part(WriterCommitMessage):
    path: str
    blocks: list[tuple[int, int, int, int, int]]  # block, offset in the part, clen, rlen, codec


class ContainerSink(DataSource):
    """Options: path, staging, block_size, magic, hash, index (JSON list of [file of index bytes, entries])."""

    @classmethod
    def name(cls) -> str:
        return "container"

    def schema(self) -> str:
        return "block int, codec int, level int, offset bigint, size bigint, content binary"

    def writer(self, schema, overwrite) -> DataSourceArrowWriter:
        return _ContainerWriter(dict(self.options))


class _ContainerWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.o = options

    def write(self, iterator) -> WriterCommitMessage:
        path, blocks, at = os.path.join(self.o["staging"], f"blocks-{uuid.uuid4().hex}"), [], 0
        with open(path, "wb") as f:
            for block, codec, rlen, data in _encoded(iterator, int(self.o["block_size"])):
                f.write(data)
                blocks.append((block, at, len(data), rlen, codec))
                at += len(data)
            f.flush()
            os.fsync(f.fileno())
        return _Part(path, blocks)

    def commit(self, messages) -> None:
        """Parts of failed or repeated attempts are not among the messages; they go with the staging folder."""
        found = sorted((*b, m.path) for m in messages if m is not None for b in m.blocks)
        if [b[0] for b in found] != list(range(len(found))):
            raise CorruptContainer("blocks are missing or double")
        index, at, copies = Index(), HEADER_LEN, []
        for _, start, clen, rlen, codec, path in found:
            index.blocks.append((at, clen, rlen, codec))
            copies.append((path, start, at, clen))
            at += clen
        magic, target = self.o["magic"].encode(), os.path.join(self.o["staging"], "whole")
        with open(target, "wb") as f:
            f.write(header(magic))
            f.truncate(at)
        with ThreadPoolExecutor(8) as pool:
            list(pool.map(lambda c: _copy(target, *c), copies))
        chunks = json.loads(self.o["index"])
        with open(target, "r+b") as f:
            f.seek(at)
            hasher, rlen = HASHES[self.o["hash"]](), 0
            with zstandard.ZstdCompressor(level=19).stream_writer(f, closefd=False) as z:

                def put(data: bytes) -> None:
                    nonlocal rlen
                    hasher.update(data)
                    z.write(data)
                    rlen += len(data)

                put(index.head(sum(n for _, n in chunks)))
                for path, _ in chunks:
                    with open(path, "rb") as part:
                        while data := part.read(1 << 20):
                            put(data)
                put(index.tail())
            f.write(footer(at, f.tell() - at, rlen, hasher.digest(), magic))
            f.flush()
            os.fsync(f.fileno())
        os.replace(target, self.o["path"])

    def abort(self, messages) -> None:
        shutil.rmtree(self.o["staging"], ignore_errors=True)


def _copy(target: str, source: str, start: int, at: int, n: int) -> None:
    """Bytes of one file to a place in another, within the kernel where it can."""
    with open(source, "rb") as a, open(target, "r+b") as b:
        while n:
            try:
                done = os.copy_file_range(a.fileno(), b.fileno(), min(n, 1 << 30), start, at)
            except OSError:
                done = os.pwrite(b.fileno(), os.pread(a.fileno(), min(n, 1 << 23), start), at)
            if not done:
                raise CorruptContainer(f"{source} is too short")
            start, at, n = start + done, at + done, n - done


@dataclass
class WriteOptions:
    codec: int = 1
    level: int = 12
    block_size: int = DEFAULT_BLOCK_SIZE
    dedup: bool = True
    fast_lane: bool = True
    follow_symlinks: bool = False
    magic: bytes = MAGIC
    hash_name: str = "sha256"
    check_block_size: bool = True
    max_piece: int = MAX_PIECE


#: Stored files up to which their places (some 50 bytes each) are broadcast to the contents instead of shuffling these.
BROADCAST_ROWS = 500_000


def _index_chunks(rows: DataFrame, staging: str) -> list[list]:
    """Index bytes of entries in index order, a file for each range of the order; [file, entries] of each."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, pid, path = 0, None, os.path.join(staging, f"index-{uuid.uuid4().hex}")
        with open(path, "wb") as f:
            for batch in it:
                for e in batch.to_pylist():
                    pid = e["pid"]
                    f.write(entry_bytes(e | {"segments": [tuple(s.values()) for s in e["segments"]]}))
                    n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([path]), pa.array([n], pa.int64())], names=["pid", "path", "n"])

    place = [kind_rank(), F.col("path"), *order()]
    in_order = rows.repartitionByRange(*place).sortWithinPartitions(*place).withColumn("pid", F.spark_partition_id())
    got = in_order.mapInArrow(work, "pid int, path string, n bigint").collect()  # one row a range
    return [[r.path, r.n] for r in sorted(got, key=lambda r: r.pid)]


def write_container(manifest: DataFrame, path: str, o: WriteOptions | None = None) -> dict:
    """Write a manifest (with walk_id and content) as one container; returns the write statistics.

    A file is one row, or rows (piece 0, 1, ...) of max_piece bytes at most, and then has its hash. Metadata is planned
    first; contents are read once more, shuffled once by block, and encoded by the sink's tasks. No content passes the
    driver. The file appears by an atomic rename, or not at all.
    """
    o = o or WriteOptions()
    if o.check_block_size and o.block_size < MIN_BLOCK_SIZE:
        raise ValueError(f"block size must be at least {MIN_BLOCK_SIZE}")
    spark = manifest.sparkSession
    if "piece" not in manifest.columns:
        manifest = manifest.withColumn("piece", F.lit(0))
    given = F.unhex("hash") if "hash" in manifest.columns else F.lit(None).cast("binary")
    content = manifest.filter("kind = 'file'").select("walk_id", "piece", "content")
    names = ("walk_id", "path", "kind", "mode", "mtime", "mtime_nanos", "size", "link_target")
    hashed = F.when(F.col("kind") == "file", F.coalesce(given, digest(F.col("content"), o.hash_name)))
    meta = checkpoint(manifest.filter("piece = 0").select(*names, hashed.alias("hash")))
    files = checkpoint(first_copies(meta.filter("kind = 'file'"), o.dedup))
    assigned = checkpoint(assign_blocks(survivors(files, o.dedup, o.max_piece), o.block_size, o.fast_lane))
    listed = attach_segments(files, assigned, o.dedup)
    others = meta.filter("kind <> 'file'").withColumns({"lane": F.lit(0), **{c: F.lit("") for c in ("ext", "dir", "name")}})
    others = others.withColumn("segments", F.array().cast(listed.schema["segments"].dataType))
    columns = [*names, "hash", "segments", "lane", "ext", "dir", "name"]
    stored = assigned.agg(F.count("*").alias("n"), (F.max("block") + 1).alias("blocks")).first()
    places = assigned.select("walk_id", "piece", "lane", "block", "offset", "size")
    members = content.join(F.broadcast(places) if stored.n <= BROADCAST_ROWS else places, ["walk_id", "piece"])
    parts = max(1, min(stored.blocks or 1, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)))
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    os.makedirs(staging)
    try:
        chunks = _index_chunks(listed.select(*columns).unionByName(others.select(*columns)), staging)
        spark.dataSource.register(ContainerSink)
        options = {"path": path, "staging": staging, "block_size": str(o.block_size), "magic": o.magic.decode(), "hash": o.hash_name, "index": json.dumps(chunks)}
        _by_block(members, o.codec, o.level, o.fast_lane, parts).write.format("container").mode("append").options(**options).save()
    finally:
        shutil.rmtree(staging, ignore_errors=True)
    counts = kind_counts(meta).crossJoin(dedup_counts(files)).first()  # one row each
    return {
        **{c: counts[c] for c in ("files", "dirs", "symlinks", "deduped_files", "deduped_bytes")}, "input_bytes": counts["bytes"], "blocks": stored.blocks or 0, "archive_bytes": os.path.getsize(path),
    }


# --- reading
def contents(spark: SparkSession, path: str, paths: list[str] | None = None, magic: bytes = MAGIC, hash_name: str = "sha256", last: bool = False) -> DataFrame:
    """Selected files with their bytes. Only blocks that they touch are decoded, each once, and cut in the task that
    decodes them; only files of several segments are shuffled. For files that fit in a cell."""
    rows = load(spark, ContainerFiles, path, magic, hash_name, paths=paths, last=last)
    entry = [c for c in rows.columns if c not in ("pos", "content")]
    several = rows.filter(F.size("segments") > 1)
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("pos", "content"))), F.lit(bytearray()), lambda a, x: F.concat(a, x["content"]))
    whole = several.groupBy("entry_id").agg(*[F.first(c).alias(c) for c in entry if c != "entry_id"], joined.alias("content"))
    return rows.filter(F.size("segments") <= 1).select(*entry, "content").unionByName(whole.select(*entry, "content"))


def _long_ok(rows: DataFrame, hash_name: str) -> DataFrame:
    """entry_id, ok of files of several segments, hashed piece by piece."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stored, hasher = None, None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([stored is None or hasher.digest() == stored])], names=["entry_id", "ok"])
        for batch in it:
            for i, h, data in zip(batch.column("entry_id").to_pylist(), batch.column("hash").to_pylist(), batch.column("content"), strict=True):
                if i != now:
                    if now is not None:
                        yield row()
                    now, stored, hasher = i, h, HASHES[hash_name]()
                hasher.update(data.as_py())
        if now is not None:
            yield row()

    in_order = rows.select("entry_id", "pos", "hash", "content").repartition("entry_id").sortWithinPartitions("entry_id", "pos")
    return in_order.mapInArrow(work, "entry_id bigint, ok boolean")


def verify(spark: SparkSession, path: str, magic: bytes = MAGIC, hash_name: str = "sha256") -> DataFrame:
    """path, ok for every file in storage order: decoded, hashed again and compared; a null stored hash passes."""
    rows = load(spark, ContainerFiles, path, magic, hash_name)
    first = F.get("segments", F.lit(0))
    place = [first["block"].alias("block"), first["offset"].alias("offset")]
    same = F.col("hash").isNull() | (F.col("hash") == digest(F.col("content"), hash_name))
    short = rows.filter(F.size("segments") <= 1).select("path", "entry_id", *place, same.alias("ok"))
    several = rows.filter(F.size("segments") > 1)
    told = several.filter("pos = 0").select("path", "entry_id", *place)
    every = short.unionByName(told.join(_long_ok(several, hash_name), "entry_id").select(*short.columns))
    return every.orderBy(F.asc_nulls_last("block"), "offset", "entry_id").select("path", "ok")
