"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

Rows without a doc_id, and rows that share one, are documents of their own throughout: no stage looks a row up by its
doc_id. Operators carry the columns of documents along; where rows must be found again, they have a number of their own.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import fm_decontam, importance, minhash, radix_dedup
from cairn.llm.entry import RANKS, TOKENIZER
from cairn.llm.packing import pack
from cairn.session import checkpoint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _changed(rows: DataFrame, text: Column) -> DataFrame:
    """The columns of documents from `more`, with another text; n_chars follows where the text is another."""
    same = F.coalesce(F.col("more.text"), F.lit("")) == F.col("text")
    new = {"text": F.when(same, F.col("more.text")).otherwise(F.col("text")), "n_chars": F.when(same, F.col("more.n_chars")).otherwise(F.length("text").cast("bigint"))}
    return rows.withColumn("text", text).select(*[new.get(c, F.col(f"more.{c}")).alias(c) for c in COLUMNS])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws."""
    scored = importance.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=COLUMNS)
    return scored.filter("kept").select("more.*")


#: doc_ids that are null or repeated, up to which these (8 bytes each) are broadcast.
BROADCAST_IDS = 1_000_000


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents with a number `row` of their own: their doc_id, or where that is null or repeated a number below all
    doc_ids. Only the latter documents are checkpointed, so that they keep their numbers."""
    ids = checkpoint(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("doc_id is null or n > 1").select(F.col("doc_id").alias("odd")))
    n = ids.count()
    if n == 0:
        return docs.withColumn("row", F.col("doc_id"))
    odd = F.broadcast(ids) if n <= BROADCAST_IDS else ids
    same = F.col("doc_id").eqNullSafe(F.col("odd"))
    least = docs.agg(F.min("doc_id")).first()[0]
    below = F.lit(min(0, least or 0)) - 1 - F.monotonically_increasing_id()
    some = checkpoint(docs.join(odd, same, "left_semi").withColumn("row", below))
    return docs.join(odd, same, "left_anti").withColumn("row", F.col("doc_id")).unionByName(some)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id, without one only where none has any."""
    rows = _numbered(docs.select(*COLUMNS))
    found = minhash.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"))
    groups = found.select(F.col("doc_id").alias("row"), "component_id").join(rows.select("row", "doc_id"), "row")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    kept = groups.groupBy("component_id").agg(F.min_by("row", first).alias("row")).select("row")
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated passages; a character that lost some of its bytes goes whole."""
    whole = F.arrow_udf(_decoded, "string")
    return _changed(radix_dedup.remove_repeats(docs, COLUMNS), whole("kept"))


def _decoded(kept: pa.Array) -> pa.Array:
    return pa.array([b.as_py().decode("utf-8", "ignore") for b in kept], pa.string())


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans that occur in the benchmark."""
    found = fm_decontam.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), COLUMNS)
    return _changed(found, _cut("more.text", "spans"))


def _cut(text: str, spans: str) -> Column:
    """The text outside the spans (bytes, in order), which begin and end between characters."""
    data = F.encode(text, "UTF-8")
    part = lambda a, b: F.substring(data, (a + 1).cast("int"), (b - a).cast("int"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(bytearray()).alias("out"))
    step = lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], part(acc["at"], s["start"])).alias("out"))
    done = lambda acc: F.decode(F.concat(acc["out"], part(acc["at"], F.octet_length(data).cast("bigint"))), "UTF-8")
    return F.when(F.size(spans) == 0, F.coalesce(F.col(text), F.lit(""))).otherwise(F.aggregate(spans, start, step, done))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts in sequences of 1024 tokens."""
    return pack(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [("quality classifier", quality), ("MinHash near-dedup", near_dedup), ("suffix-array dedup", substring_dedup), ("benchmark decontamination", decontaminate), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpoint(docs)
    return docs
