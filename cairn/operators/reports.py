"""Counts, listings and ratios over manifests, entries and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.classify import codec_name
from cairn.functions.format import human, octal_mode, ratio
from cairn.functions.paths import ancestors
from cairn.operators.order import changes
from cairn.operators.pack import is_copy


def kind_rank() -> Column:
    """Index order: directories, files, links."""
    return F.when(F.col("kind") == "dir", 0).when(F.col("kind") == "file", 1).otherwise(2)


def long(c):
    return c.cast("bigint")


def kind_counts(entries: DataFrame) -> DataFrame:
    n = lambda k: F.count_if(F.col("kind") == k).alias(k + "s")
    size = F.when(F.col("kind") == "file", F.col("size")).otherwise(0)
    return entries.agg(n("file"), n("dir"), n("symlink"), long(F.coalesce(F.sum(size), F.lit(0))).alias("bytes"))


def dedup_counts(files: DataFrame) -> DataFrame:
    again = is_copy()
    return files.agg(F.count_if(again).alias("deduped_files"), long(F.coalesce(F.sum(F.when(again, F.col("size"))), F.lit(0))).alias("deduped_bytes"))


def by_codec(blocks: DataFrame) -> DataFrame:
    """Blocks by codec name; both lanes merge where they share a codec. Ordered by name."""
    named = blocks.withColumn("codec_name", codec_name(F.col("codec")))
    out = named.groupBy("codec_name").agg(F.count("*").alias("blocks"), long(F.sum("rlen")).alias("rlen"), long(F.sum("clen")).alias("clen"))
    return out.withColumn("ratio", ratio(F.col("clen"), F.col("rlen"))).orderBy("codec_name")


def listing(entries: DataFrame) -> DataFrame:
    """One formatted line per entry: kind, mode, size, first block, path, link target."""
    kind = F.when(F.col("kind") == "dir", "d").when(F.col("kind") == "symlink", "l").otherwise("-")
    block = F.coalesce(F.get("segments", F.lit(0))["block"].cast("string"), F.lit("-"))
    link = F.when(F.col("link_target").isNull(), "").otherwise(F.concat(F.lit(" -> "), "link_target"))
    size = human(F.col("size"))
    padded = F.when(F.length(size) < 10, F.lpad(size, 10, " ")).otherwise(size)
    at = F.when(F.length(block) < 5, F.rpad(block, 5, " ")).otherwise(block)
    line = F.concat(kind, octal_mode(F.col("mode")), F.lit(" "), padded, F.lit(" blk:"), at, F.lit(" "), "path", link)
    return entries.select("path", line.alias("line"))


def cache_decodes(reads: DataFrame, order: list[str]) -> DataFrame:
    """Blocks decoded by a reader that keeps one decoded block, over reads in the given order."""
    counts = changes(reads, order, "block").select(F.col("n").alias("n_reads"), F.col("changes").alias("decodes"))
    return counts.crossJoin(reads.agg(F.countDistinct("block").alias("n_blocks")))  # one row each


def dir_tree(entries: DataFrame) -> DataFrame:
    """Distinct ancestor directories of all paths."""
    return entries.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()


def bench_ratio(results: DataFrame) -> DataFrame:
    return results.withColumn("ratio", ratio(F.col("packed_bytes"), F.col("raw_bytes")))


def bench_vs(results: DataFrame, baseline: str = "zip -9") -> DataFrame:
    """Every tool against its corpus's baseline row; corpora without one give no rows."""
    w = Window.partitionBy("corpus").orderBy("packed_bytes", "compress_s")
    base = results.filter(F.col("tool") == baseline).withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    base = base.select("corpus", F.col("packed_bytes").alias("b"), F.col("decompress_s").alias("d"))
    saved = F.when(F.col("b") == 0, 0.0).otherwise((1 - F.col("packed_bytes") / F.col("b")) * 100)
    speed = F.when(F.col("decompress_s") == 0, 0.0).otherwise(F.col("d") / F.col("decompress_s"))
    return results.join(base, "corpus").select("corpus", "tool", saved.alias("saved_pct"), speed.alias("extract_speedup"))


def islands(cells: DataFrame, group: list[str], at: str, value: str) -> DataFrame:
    """Runs of equal values along `at`: the difference of two row numbers names each run."""
    rn = F.row_number().over(Window.partitionBy(*group).orderBy(at)) - F.row_number().over(Window.partitionBy(*group, value).orderBy(at))
    runs = cells.withColumn("run", rn).groupBy(*group, value, "run")
    return runs.agg(F.min(at).alias("start"), F.count("*").alias("length")).drop("run")
