"""Byte-level helpers on Arrow columns and numpy arrays, used inside mapInArrow / applyInArrow functions.

Texts are handled as their UTF-8 bytes, whole, in pieces of a quarter of a megabyte, so memory does not follow the
length of a text times the width of an array element.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
PIECE = 1 << 18
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (xor-shift-multiply)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def constants(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit constants."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed * 0xD1B54A32D192ED03 % (1 << 64))) | U(1)


_BYTE = constants(7, 256)
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse for i < n, modulo 2 ** 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(19, int(n).bit_length())
        _POWERS[:] = [np.concatenate([np.ones(1, U), np.cumprod(np.full(size, b, U), dtype=U)]) for b in (_BASE, _INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


def text_column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    """The column as one string array without nulls."""
    col = batch.column(name)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    if not pa.types.is_large_string(col.type) and not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary() if pa.types.is_binary(col.type) else pa.large_string())
    return col.fill_null(b"" if pa.types.is_large_binary(col.type) else "") if col.null_count else col


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large string or binary array; row i is bytes[offsets[i]:offsets[i + 1]]."""
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer row stands alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_hashes(b: np.ndarray, offsets: np.ndarray, word: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, hash) of the maximal runs of word bytes within each row of b.

    `word` is a 256-entry table; starts and ends count from b[0]. Works through the bytes in pieces that end between
    words, so that only the results are held for all of them.
    """
    out, at, end = [], int(offsets[0]), int(offsets[-1])
    edge = np.unique(offsets)
    while at < end:
        to = min(at + PIECE, end)
        while to < end and word[b[to - 1]] and word[b[to]] and not _is_edge(edge, to):  # not within a word
            step = b[to : to + PIECE]
            gap = np.flatnonzero(~word[step])
            stop = to + (int(gap[0]) if len(gap) else len(step))
            nxt = edge[np.searchsorted(edge, to + 1)]
            to = min(stop, int(nxt), end)
        x = b[at:to]
        w = word[x]
        inner = edge[np.searchsorted(edge, at) : np.searchsorted(edge, to)] - at
        first = w.copy()
        first[1:] &= ~w[:-1]
        first[inner] = w[inner]
        last = w.copy()
        last[:-1] &= ~w[1:]
        before = inner[inner > 0] - 1
        last[before] = w[before]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = powers(len(x) + 1)
        total = np.zeros(len(x) + 1, U)
        np.cumsum(_BYTE[LOWER[x] if lower else x] * up[: len(x)], out=total[1:])
        h = mix((total[e] - total[s]) * down[s] + (e - s).astype(U))
        out.append((s + at, e + at, h))
        at = to
    s, e, h = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, U if i == 2 else np.int64) for i in range(3))
    return np.searchsorted(offsets, s, "right") - 1, s, e, h


def _is_edge(edge: np.ndarray, at: int) -> bool:
    i = int(np.searchsorted(edge, at))
    return i < len(edge) and int(edge[i]) == at


def ngrams(row: np.ndarray, h: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every n consecutive words of one row."""
    if len(h) < n:
        return row[:0], h[:0]
    c, m = constants(seed, n), len(h) - n + 1
    total = h[:m] * c[0]
    for i in range(1, n):
        total += h[i : i + m] * c[i]
    same = row[:m] == row[n - 1 :]
    return row[:m][same], mix(total[same])


def starts_of(row: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)


def i64(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def batches(it: Iterator[pa.RecordBatch], column: str, limit: int = 4 * PIECE) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The batches cut into slices of about `limit` bytes of text, each with its text column.

    Arrow's pool keeps what was freed; after each batch it gives that back, as workers share an executor's memory.
    """
    for batch in it:
        col = text_column(batch, column)
        _, offsets = raw(col)
        for lo, hi in slices(offsets, limit):
            yield batch.slice(lo, hi - lo), col.slice(lo, hi - lo)
        del batch, col, offsets
        pa.default_memory_pool().release_unused()


def doc_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text only, null text as empty: other columns, whatever their names, take no part."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def carrying(docs: DataFrame, carry: list[str] | None) -> tuple[DataFrame, str]:
    """doc_texts() with the columns named in `carry` in a struct `more`; the end of a schema that has it."""
    if not carry:
        return doc_texts(docs), ""
    d = docs.select(F.struct(*[F.col(c) for c in carry]).alias("more"), "doc_id", "text")
    d = d.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "more")
    return d, f", more {d.schema['more'].dataType.simpleString()}"


def plan_bytes(df: DataFrame) -> int:
    """Size of a DataFrame with a text column, for choosing how many parts to deal it into: Catalyst's estimate from
    the files, or where it has none the bytes of the texts."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 50:
        return size
    return df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]


def parts_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
