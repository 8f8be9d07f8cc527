"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter: row r of the table holds one bit for each language, so looking an n-gram up (the AND of
HASHES rows) gives all languages that contain it at once. For a text, the n-grams found are counted by language, what
false positives would give is taken off, and the largest count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import U, batches, constants, mix, raw

#: Rows of the table (log 2), hashes, the bound on training documents a language (in expectation), the least share of
#: its rate in the language where it is most frequent that an n-gram needs to count as contained, and its least count.
BITS, HASHES, SAMPLE, SHARE, LEAST = 20, 3, 2_000, 0.3, 2

_LETTER = regex.compile(r"\p{L}")
_C = constants(31, HASHES)
_KEEP = np.full(256, 0x20, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def grams(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, n-gram) of every four bytes of letters (and a space at either end) of the lower-cased texts."""
    texts = pa.array([f" {t.lower()} " for t in col.to_pylist()], pa.large_string())
    b, offsets = raw(texts)
    x = _KEEP[b]
    if len(x) < 4:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    w = x.astype(np.uint32)
    g = w[:-3] << np.uint32(24) | w[1:-2] << np.uint32(16) | w[2:-1] << np.uint32(8) | w[3:]
    inner = (x[1:-2] != 0x20) & (x[2:-1] != 0x20)
    row = np.repeat(np.arange(len(col)), np.diff(offsets))
    at = np.flatnonzero(inner & (row[:-3] == row[3:]))
    return row[at], g[at]


def _rows(g: np.ndarray) -> list[np.ndarray]:
    x = g.astype(U) + U(1)
    return [(mix(x * c) >> U(64 - BITS)).astype(np.int64) for c in _C]


class Filters:
    """The table for the languages in `langs`: (1 << BITS) rows of one bit a language, 64 to a word."""

    def __init__(self, langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        self.table = np.zeros((1 << BITS, max(1, -(-len(langs) // 64))), U)
        best: dict[int, float] = {}
        rate = {}
        for lang in langs:
            g, n = counts[lang]
            rate[lang] = n / max(1, n.sum())
            for k, r in zip(g.tolist(), rate[lang].tolist(), strict=True):
                if r > best.get(k, 0.0):
                    best[k] = r
        for i, lang in enumerate(langs):
            g, n = counts[lang]
            top = np.array([best[k] for k in g.tolist()])
            for at in _rows(g[(n >= LEAST) & (rate[lang] >= SHARE * top)]):
                self.table[at, i // 64] |= U(1 << i % 64)
        full = [((self.table[:, i // 64] >> U(i % 64)) & U(1)).mean() for i in range(len(langs))]
        self.false = np.minimum(np.array(full) ** HASHES, 0.99)

    def predict(self, col: pa.Array) -> tuple[list[str], np.ndarray]:
        row, g = grams(col)
        hit = self.table[(at := _rows(g))[0]]
        for a in at[1:]:
            hit = hit & self.table[a]
        total = np.bincount(row, minlength=len(col))
        found = np.stack([np.bincount(row, (hit[:, i // 64] >> U(i % 64)) & U(1), minlength=len(col)) for i in range(len(self.langs))])
        real = np.maximum(0.0, (found - total * self.false[:, None]) / (1 - self.false[:, None]))
        win = real.argmax(axis=0)
        score = real.max(axis=0) / np.maximum(real.sum(axis=0), 1e-300)
        return [self.langs[i] for i in win], np.where(real.sum(axis=0) > 0, score, 0.0)


def _partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, col in batches(it, "text", 1 << 20):
        lang = batch.column("lang").to_pylist()
        row, g = grams(col)
        for name in sorted(set(lang)):
            of = np.array([x == name for x in lang])
            v, n = np.unique(g[of[row]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(v), pa.string()), pa.array(v.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def train(docs: DataFrame) -> Filters | None:
    """From text and lang of rows that are not held out; a sample of about SAMPLE whole documents a language."""
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    d = d.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    many = {r.lang: r.n for r in d.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not many:
        return None
    share = F.try_element_at(F.create_map(*[F.lit(x) for k, n in sorted(many.items()) for x in (k, min(1.0, SAMPLE / n))]), F.col("lang"))
    luck = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1_000_000)) / 1e6
    counts = d.filter(luck < share).mapInArrow(_partial, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = counts.filter(F.col("n") >= LEAST).orderBy("lang", "gram").toPandas()  # bounded by the sample
    langs = sorted(many)
    return Filters(langs, {k: ((f := got[got.lang == k]).gram.to_numpy().astype(np.uint32), f.n.to_numpy()) for k in langs})


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per input row, by its text alone.

    Null text and text without letters: und, score 0. Text whose n-grams no language has: the first language, score 0.
    Without any training row all are und. Rows that repeat a doc_id are predicted each; a null doc_id is not held out.
    """
    filters = train(docs)
    table = docs.sparkSession.sparkContext.broadcast(filters)  # 8 MB a 64 languages

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, col in batches(it, "text", 1 << 20):
            lang, score = (["und"] * len(col), np.zeros(len(col))) if table.value is None else table.value.predict(col)
            for i, text in enumerate(col):
                if not _LETTER.search(text.as_py()):
                    lang[i], score[i] = "und", 0.0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return d.mapInArrow(work, "doc_id bigint, held_out boolean, lang_pred string, score double")


def is_held_out(doc_id: int) -> bool:
    return crc32(str(doc_id).encode()) % 5 == 0
