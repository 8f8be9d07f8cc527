"""Whole orders over rows that no single task could sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import checkpoint


def ranged(rows: DataFrame, order: list[Column | str], parts: int | None = None) -> DataFrame:
    """The rows in ranges of the order, each sorted, checkpointed so that later passes see the same partitions."""
    spread = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    return checkpoint(spread.sortWithinPartitions(*order))


def with_rank(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Adds the 1-based place of each row: its place in its range and the sizes of the ranges before (one number a
    range reaches the driver)."""
    r = ranged(rows, order)
    sizes = {x.p: x.n for x in r.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    before, base = [], 0
    for p in range(max(sizes, default=0) + 1):
        before.append(base)
        base += sizes.get(p, 0)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    start = F.get(F.array(*[F.lit(b).cast("bigint") for b in before]), F.spark_partition_id())
    return r.withColumn(name, start + within + 1)


def changes(rows: DataFrame, order: list[str], value: str) -> DataFrame:
    """n, changes: the rows, and how often the value differs from that of the row before (the first row counts).

    Rows are compared within ranges of the order; then one row a range has its first and last value compared.
    """
    place = F.struct(*order)
    w = Window.partitionBy("_p").orderBy(*order)
    inner = ranged(rows.select(*order, value) if value not in order else rows.select(*order), order).withColumn("_p", F.spark_partition_id())
    inner = inner.withColumn("_c", F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(0)))
    per = inner.groupBy("_p").agg(F.count("*").alias("n"), F.sum("_c").alias("c"), F.min_by(value, place).alias("first"), F.max_by(value, place).alias("last"))
    edge = F.coalesce((F.lag("last").over(Window.orderBy("_p")) != F.col("first")).cast("int"), F.lit(1))
    per = per.withColumn("c", F.col("c") + edge)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return per.agg(total("n").alias("n"), total("c").alias("changes"))
