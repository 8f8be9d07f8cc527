"""Quality classifier by importance resampling.

Two bag models over hashed token unigrams and bigrams: raw, counted over all documents, and target, counted over a
sample of documents labelled good. A document's log weight is the mean over its n-grams of log(target / raw), times PER:
that of a stretch of PER n-grams like it, so its length does not count, and the noise is of the weights' order. Sampling
without replacement in proportion to the weights is a top-k of log weight + Gumbel noise.

A few words that the target hardly has vanish in the mean over a whole document. So there is a second log weight, by
models of single words in finer buckets: the sum over its words of what log(target / raw) is below FLOOR. A document is
kept if it is drawn by both. Each k is such that of the labelled good documents of a part of the sample, which was not
trained on, half of LOSS at most go. A third part is used for nothing, so that figures can be taken on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import SPACES, U, batches, carrying, constants, ngrams, plan_bytes, raw, word_hashes
from cairn.session import checkpoint

#: Hash buckets (log 2) of the n-grams and of the single words, the bound on labelled rows that are used, and the share
#: of good ones that may go.
BITS, WORD_BITS, LABELLED, LOSS = 16, 20, 20_000, 0.005
#: N-grams of the stretch that a document's mean stands for.
PER = 64
#: Log ratio of a word from which it counts against a document: 4.5 times rarer in the target than in the raw texts.
FLOOR = -1.5
ALL = (1 << BITS) + (1 << WORD_BITS)
#: Counts travel in slices of so many buckets, and so many tasks' slices are added up by one task at a time; bytes of
#: input (as Catalyst estimates them) that a task is taken to count.
SLICE, FAN, TASK_BYTES = 1 << 12, 32, 16 << 20

_WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_lo:_hi] = True
_PUNCT = ~_WORD & ~SPACES


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each token, words and punctuation apart and in their case, and of each two in a row."""
    b, offsets = raw(col)
    parts = [word_hashes(b, offsets, table, lower=False) for table in (_WORD, _PUNCT)]
    row, start, h = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 3))
    order = np.argsort(start, kind="stable")
    row, h = row[order], h[order]
    row2, h2 = ngrams(row, h, 2, 5)
    bucket = (np.concatenate([h, h2]) >> U(64 - BITS)).astype(np.int64)
    return np.concatenate([row, row2]), bucket


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each word, A-Z as a-z; their buckets follow those of features()."""
    row, _, _, h = word_hashes(*raw(col), _WORD)
    return row, (h >> U(64 - WORD_BITS)).astype(np.int64) + (1 << BITS)


def _slices(node: int, counts: np.ndarray) -> pa.RecordBatch:
    """Rows (slice, node, data) of counts (2, buckets): the places of those that are not zero, and both counts."""
    rows = []
    for k in range(0, counts.shape[1], SLICE):
        part = counts[:, k : k + SLICE]
        at = np.flatnonzero(part[0])
        if len(at):
            rows.append((k // SLICE, at.astype(np.uint16).tobytes() + part[:, at].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([node] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["slice", "node", "data"])


def _add(counts: np.ndarray, data: memoryview) -> None:
    n = len(data) // 18
    at = np.frombuffer(data, np.uint16, n)
    counts[:, at] += np.frombuffer(data, np.int64, 2 * n, 2 * n).reshape(2, n)


def _counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, ALL), np.int64)
    for batch, col in batches(it, "text", 1 << 19):
        good = np.array(batch.column("good").fill_null(False))
        for row, bucket in (features(col), words(col)):
            np.add.at(counts[0], bucket, 1)
            np.add.at(counts[1], bucket[good[row]], 1)
    yield _slices(TaskContext.get().partitionId(), counts)


def _merged(key: tuple, rows: pa.Table) -> pa.Table:
    counts = np.zeros((2, SLICE), np.int64)
    for chunk in rows.column("data").chunks:
        for x in chunk:
            _add(counts, memoryview(x.as_buffer()))
    out = pa.Table.from_batches([_slices(key[1].as_py(), counts)])
    return out.set_column(0, "slice", pa.array([key[0].as_py()] * len(out), pa.int32()))


def count_tree(docs: DataFrame, tasks: int) -> np.ndarray:
    """(2, ALL) counts over all documents and over the good ones: each task's slices, merged FAN at a time."""
    schema = "slice int, node int, data binary"
    rows = docs.mapInArrow(_counts, schema)
    while True:
        tasks = -(-tasks // FAN)
        rows = rows.withColumn("node", F.pmod("node", F.lit(tasks))).groupBy("slice", "node").applyInArrow(_merged, schema)
        if tasks == 1:
            break
    counts = np.zeros((2, ALL), np.int64)
    for r in rows.select("slice", "data").collect():  # ALL buckets at most, 18 bytes each
        _add(counts[:, r.slice * SLICE : (r.slice + 1) * SLICE], memoryview(r.data))
    return counts


def _weights(n_raw: np.ndarray, n_target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log ratios of the n-gram buckets; of the word buckets, what is below FLOOR."""
    share = lambda c: np.log((c + 1) / (c.sum() + len(c)))
    grams, rest = slice(0, 1 << BITS), slice(1 << BITS, ALL)
    expected = n_raw[rest] * (n_target[rest].sum() / max(1, n_raw[rest].sum()))
    return share(n_target[grams]) - share(n_raw[grams]), np.minimum(0, np.log((n_target[rest] + 1) / (expected + 1)) - FLOOR).astype(np.float32)


def labelled_sample(labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """doc_id, good, part of at most `limit` labelled documents, those of the least hash: half of them to train on, a
    quarter to choose k by, a quarter for figures."""
    luck = F.xxhash64("doc_id", F.lit(17))
    one = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").alias("q"), F.col("toxic").alias("t"))
    one = one.filter("doc_id is not null and q is not null").groupBy("doc_id").agg(((F.min("q") == 1) & (F.coalesce(F.max("t"), F.lit(0)) == 0)).alias("good"))
    part = F.get(F.array(*[F.lit(p) for p in ("train", "train", "choose", "figures")]), F.pmod(F.xxhash64("doc_id", F.lit(18)), F.lit(4)).cast("int"))
    return one.orderBy(luck, "doc_id").limit(limit).withColumn("part", part)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Standard Gumbel noise that depends on the document and the seed alone."""
    u = (F.shiftrightunsigned(F.xxhash64(F.coalesce(doc_id, F.lit(-1)), F.lit(seed)), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def score(docs: DataFrame, labels: DataFrame, seed: int = 1, carry: list[str] | None = None) -> DataFrame:
    """doc_id, log_ratio, word_ratio, key and word_key (these with noise), kept: one row per input row, and with `carry`
    its columns of these names in the struct `more`.

    Null or empty text: both ratios 0. A doc_id that repeats gets the same noise in each row. Without any labelled good
    document all are kept. Ties at the threshold are all kept. Labels that repeat or disagree count as the worst of
    them. Other columns take no part.
    """
    spark = docs.sparkSession
    sample = [(r.doc_id, r.good, r.part) for r in labelled_sample(labels).collect()]  # LABELLED rows at most
    known = F.broadcast(spark.createDataFrame(sample, "doc_id bigint, good boolean, part string"))
    d, more = carrying(docs, carry)
    trained = d.select("doc_id", "text").join(known.filter("part = 'train'").select("doc_id", "good"), "doc_id", "left")
    n_raw, n_target = count_tree(trained, max(1, plan_bytes(docs) // TASK_BYTES))
    weights = spark.sparkContext.broadcast(_weights(n_raw, n_target))  # 5 MB

    def weigh(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, rare = weights.value
        for batch, col in batches(it, "text", 1 << 19):
            row, bucket = features(col)
            n = np.bincount(row, minlength=len(col))
            mean = np.bincount(row, grams[bucket], minlength=len(col)) / np.maximum(1, n) * PER
            row, bucket = words(col)
            low = np.bincount(row, rare[bucket - (1 << BITS)], minlength=len(col))
            cols = [batch.column("doc_id"), pa.array(mean.astype(np.float64)), pa.array(low.astype(np.float64))]
            yield pa.RecordBatch.from_arrays([*cols, *([batch.column("more")] if carry else [])], names=["doc_id", "log_ratio", "word_ratio", *(["more"] if carry else [])])

    keyed = d.mapInArrow(weigh, "doc_id bigint, log_ratio double, word_ratio double" + more)
    keyed = keyed.withColumn("key", F.col("log_ratio") + gumbel(F.col("doc_id"), seed)).withColumn("word_key", F.col("word_ratio") + gumbel(F.col("doc_id"), seed + 1))
    keyed = checkpoint(keyed)
    least = [F.percentile(k, F.lit(LOSS / 2)).alias(k) for k in ("key", "word_key")]
    chosen = keyed.select("doc_id", "key", "word_key").join(known.filter("part = 'choose' and good").select("doc_id"), "doc_id").agg(*least).first()
    if n_target.sum() == 0 or chosen["key"] is None:
        return keyed.withColumn("kept", F.lit(True))
    # the k-th largest keys, where k is the number of keys that are no smaller
    return keyed.withColumn("kept", (F.col("key") >= F.lit(chosen["key"])) & (F.col("word_key") >= F.lit(chosen["word_key"])))


def figures(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """label (good, toxic, low quality), documents, kept, over the part of the sample that nothing else has used."""
    toxic = labels.filter("toxic = 1").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(True).alias("toxic")).distinct()
    part = labelled_sample(labels).filter("part = 'figures'").join(toxic, "doc_id", "left")
    name = F.when(F.col("good"), "good").when(F.col("toxic"), "toxic").otherwise("low quality")
    return scored.select("doc_id", "kept").join(part.select("doc_id", name.alias("label")), "doc_id").groupBy("label").agg(F.count("*").alias("documents"), F.count_if("kept").alias("kept"))
