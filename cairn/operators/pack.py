"""Whole-file dedup and solid-block packing. Only metadata moves; contents never take part.

Files have a walk_id, which is unique and breaks ties of the pack order; paths need not be unique.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.classify import sort_key
from cairn.operators.order import ranged
from cairn.schema import MAX_PIECE, SEGMENTS
from cairn.session import checkpoint

#: Rows of a range of the pack order, which one task holds as numbers.
PART_ROWS = 200_000


def with_sort_key(files: DataFrame) -> DataFrame:
    lane, ext, directory, name = sort_key(F.col("path"))
    return files.withColumns({"lane": lane, "ext": ext, "dir": directory, "name": name})


def order() -> list[Column]:
    return [F.col(c) for c in ("lane", "ext", "dir", "name", "walk_id")]


def first_copies(files: DataFrame, dedup: bool = True) -> DataFrame:
    """Adds first_id: the walk_id of the first file of that hash in pack order; its own without dedup.

    The first one is a map-side combined minimum by hash, so no task holds all copies of a common file. Files that have
    their first_id already stay as they are: who needs it more than once checkpoints it.
    """
    if "first_id" in files.columns:
        return files
    files = with_sort_key(files)
    if not dedup:
        return files.withColumn("first_id", F.col("walk_id"))
    first = files.groupBy("hash").agg(F.min_by("walk_id", F.struct(*order())).alias("first_id"))
    return files.join(first, "hash").select(*files.columns, "first_id")


def is_copy() -> Column:
    return F.col("walk_id") != F.col("first_id")


def survivors(files: DataFrame, dedup: bool = True, max_piece: int = MAX_PIECE) -> DataFrame:
    """The files whose bytes are stored, non-empty and first of their kind, in pieces of max_piece bytes at most."""
    kept = first_copies(files, dedup).filter(~is_copy() & (F.col("size") > 0))
    last = F.floor((F.col("size") - 1) / max_piece).cast("int")
    pieces = kept.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    return pieces.withColumn("size", F.least(F.lit(max_piece), F.col("size") - F.col("piece").cast("bigint") * max_piece).cast("bigint"))


def assign_blocks(kept: DataFrame, cap: int, fast_lane: bool = True, part_rows: int | None = None) -> DataFrame:
    """path, walk_id, piece, lane, size, block, offset: next-fit over the pack order, a new block wherever
    used + size > cap or the lane changes. The lane stays in the order without fast_lane but no longer starts blocks.

    What a range of the order makes of the rows depends on what precedes it only through the carried (lane, used), and
    only until its own first block start. Pass one lists what follows from each possible first start (starts that lead
    to the same are one row, as chains of blocks soon run together); the driver chains these, one look-up a range;
    pass two assigns blocks.
    """
    columns = ("path", "walk_id", "piece", "lane", "ext", "dir", "name", "size")
    rows = checkpoint(kept.select(*columns).withColumn("pack_lane", F.col("lane") if fast_lane else F.lit(0)))
    parts = max(1, -(-rows.count() // (part_rows or PART_ROWS)))
    place = [*order(), F.col("piece")]
    if parts == 1:  # nothing precedes the one range, so there is nothing to chain
        in_order, entry = rows.repartition(1).sortWithinPartitions(*place).withColumn("pid", F.lit(0)), {0: _START}
    else:
        in_order = ranged(rows, place, parts).withColumn("pid", F.spark_partition_id())
        entry = _chain(in_order.mapInArrow(lambda it: _summary(it, cap), SUMMARY).orderBy("pid", "reach").collect(), cap)
    out = ["path", "walk_id", "piece", "lane", "size"]

    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for f in it:
            if not len(f):
                continue
            lane, used, block = state or entry[f.column("pid")[0].as_py()]
            blocks, offsets = [], []
            for ln, s in zip(f.column("pack_lane").to_pylist(), f.column("size").to_pylist(), strict=True):
                if ln != lane or used + s > cap:
                    block, used, lane = block + 1, 0, ln
                blocks.append(block)
                offsets.append(used)
                used += s
            state = (lane, used, block)
            yield pa.RecordBatch.from_arrays([*map(f.column, out), pa.array(blocks, pa.int32()), pa.array(offsets, pa.int64())], names=[*out, "block", "offset"])

    return in_order.mapInArrow(assign, "path string, walk_id bigint, piece int, lane int, size bigint, block int, offset bigint")


SUMMARY = "pid int, reach bigint, blocks bigint, out_used bigint, first_lane int, last_lane int, total bigint"
_ALWAYS = (1 << 63) - 1
#: (lane, used, last block) before the first file.
_START = (-1, 0, -1)


def _summary(it: Iterator[pa.RecordBatch], cap: int) -> Iterator[pa.RecordBatch]:
    """Of one range, a row for each run of first starts with the same outcome: blocks started, bytes used of the last.

    reach: the bytes up to and with the last file of the run, so a carried `used` starts a block within the run, or
    before it, where used + reach > cap; or always, where the run has a change of lane.
    """
    got = [f.select(["pid", "pack_lane", "size"]) for f in it if len(f)]
    if not got:
        return
    pid = got[0].column("pid")[0].as_py()
    lane, size = (np.concatenate([f.column(c).to_numpy() for f in got]) for c in ("pack_lane", "size"))
    del got
    n, upto = len(size), np.cumsum(size)
    change = np.append(np.flatnonzero(lane[1:] != lane[:-1]) + 1, n)
    # the start after a block that starts at i: the first file that does not fit, or the next lane; itself always fits
    nxt = np.searchsorted(upto, upto - size + cap, "right")
    nxt = np.minimum(np.maximum(nxt, np.arange(n) + 1), change[np.searchsorted(change, np.arange(n), "right")])
    count, used = [0] * (n + 1), [0] * (n + 1)
    step, total = nxt.tolist(), int(upto[-1])
    before = (upto - size).tolist()
    for i in range(n - 1, -1, -1):
        j = step[i]
        count[i], used[i] = (count[j] + 1, used[j]) if j < n else (1, total - before[i])
    ends = min(int(change[0]), int(np.searchsorted(upto, cap, "right")))  # no first start is later
    rows = []
    for i in range(min(ends, n - 1) + 1):
        reach = _ALWAYS if i == change[0] else int(upto[i])
        if rows and rows[-1][2:4] == (count[i], used[i]):
            rows[-1] = (pid, reach, *rows[-1][2:])
        else:
            rows.append((pid, reach, count[i], used[i], int(lane[0]), int(lane[-1]), total))
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SUMMARY.split(", ")])


def _chain(summaries: list, cap: int) -> dict[int, tuple[int, int, int]]:
    """(lane, used, last block) on entry to each range."""
    entry: dict[int, tuple[int, int, int]] = {}
    lane, used, block = _START
    by: dict[int, list] = {}
    for r in summaries:
        by.setdefault(r.pid, []).append(r)
    for pid, runs in sorted(by.items()):
        entry[pid] = (lane, used, block)
        hit = runs[0] if runs[0].first_lane != lane else next((r for r in runs if r.reach > cap - used), None)
        if hit is None:
            used += runs[0].total
        else:
            lane, used, block = hit.last_lane, hit.out_used, block + hit.blocks
    return entry


def block_table(assigned: DataFrame) -> DataFrame:
    """One row per block: lane, files (or pieces of files), rlen."""
    return assigned.groupBy("block").agg(
        F.min("lane").alias("lane"), F.count("*").alias("files"), F.sum("size").cast("bigint").alias("rlen")
    )


def attach_segments(files: DataFrame, assigned: DataFrame, dedup: bool = True) -> DataFrame:
    """Every file with its segments: its own, its first copy's, or none where it is empty."""
    piece = F.struct("piece", F.col("block").cast("int").alias("block"), "offset", F.col("size").alias("len"))
    of = assigned.groupBy("walk_id").agg(F.array_sort(F.collect_list(piece)).alias("s"))  # one piece, or size / max_piece
    of = of.select(F.col("walk_id").alias("first_id"), F.transform("s", lambda x: x.dropFields("piece")).cast(SEGMENTS).alias("segments"))
    none = F.array().cast(SEGMENTS)
    return first_copies(files, dedup).join(of, "first_id", "left").withColumn("segments", F.coalesce("segments", none))


def pack_scalar(items: list[tuple[int, int]], cap: int) -> list[tuple[int, int]]:
    """(block, offset) of (lane, size) items in order: the model that tests hold the plans against."""
    out, lane, used, block = [], None, 0, -1
    for ln, s in items:
        if ln != lane or used + s > cap:
            lane, used, block = ln, 0, block + 1
        out.append((block, used))
        used += s
    return out
