"""Bench results: measured codecs, and the JSON sink and source of results."""

from __future__ import annotations

import time
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.classify import PRESETS
from cairn.schema import BENCH


def measure(files: DataFrame, corpus: str, block_size: int = 1 << 20) -> DataFrame:
    """A result for zip -9 (zlib, file by file) and for each preset (blocks of about block_size), over files with
    contents: each task packs and unpacks what it has; seconds are summed over tasks. One pass over the contents."""
    from cairn.sources.codec import decode, encode

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, list[float]] = {}

        def run(tool: str, raw: bytes, pack, unpack) -> None:
            a = time.perf_counter()
            data = pack(raw)
            c = time.perf_counter()
            if unpack(data) != raw:
                raise ValueError(f"{tool} does not give back its input")
            now = len(raw), len(data), c - a, time.perf_counter() - c
            rows[tool] = [x + y for x, y in zip(rows.get(tool, [0, 0, 0.0, 0.0]), now, strict=True)]

        def block(held: list[bytes]) -> None:
            raw = b"".join(held)
            for name, (codec, level) in PRESETS.items():
                run(name, raw, lambda r, c=codec, lv=level: encode(c, lv, block_size, r), lambda d, c=codec: decode(c, d, len(raw)))

        held, used = [], 0
        for batch in it:
            for content in batch.column("content"):
                data = content.as_py()
                run("zip -9", data, lambda r: zlib.compress(r, 9), zlib.decompress)
                held.append(data)
                used += len(data)
                if used >= block_size:
                    block(held)
                    held, used = [], 0
        if held:
            block(held)
        cols = list(zip(*((t, *v) for t, v in rows.items()), strict=True)) or [[]] * 5
        types = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = ["tool", "raw_bytes", "packed_bytes", "compress_s", "decompress_s"]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=names)

    schema = BENCH.removeprefix("corpus string, ")
    found = files.select("content").mapInArrow(work, schema)
    total = [F.sum(c).cast(t).alias(c) for c, t in (x.split() for x in schema.split(", ")[1:])]
    return found.groupBy("tool").agg(*total).select(F.lit(corpus).alias("corpus"), "tool", *[c.split()[0] for c in schema.split(", ")[1:]])


def write_results(results: DataFrame, path: str) -> None:
    results.select(*[c.split()[0] for c in BENCH.split(", ")]).write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BENCH).json(path)
