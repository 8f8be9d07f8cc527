"""Exact-substring dedup by a depth-limited radix sort of suffixes.

A byte goes when a string of WINDOW bytes that covers it also starts earlier (smaller doc_id, or earlier in the same
document). Suffixes are ordered only through WINDOW bytes, by passes over groups of their own bytes, the leading ones
first; a suffix leaves as soon as its group is a single one, and what is equal through the last byte is exactly the
repeated windows. Every comparison is of bytes; hashes only choose where things go and which need not go anywhere.

1. Each window has a core: of its KMER-byte strings the one with the least hash, a choice that depends on the window
   alone, so equal windows have equal cores at equal places. Neighbouring windows share a core; they are a run, and travel
   as one string. Buckets of documents send the hashes of their cores; those that no one else has leave.
2. The remaining runs are sent with all their bytes, each distinct one once a bucket, and dealt by their cores. The task
   sorts them: by the bytes of the core, the leading digits; then runs that share a core by all their bytes, so that equal
   runs become one; then, where different runs are left, each window of theirs by its 100 bytes, eight at a time.
3. A core that very many different runs share (a common line, with other text around) would be one task's. Its runs are
   not sorted but sent again, cut into ranges of windows that share 93 bytes, and dealt by these; where even that is
   common, window by window, where each group is of one value. So the next digits split what the first left together.
4. Buckets are told which of their windows start earlier elsewhere, a bit each, and drop the bytes that these cover.

Documents are shuffled once, into buckets; all passes read that shuffle. A group of the sort holds at most HOT different
strings of each of its cores, and one record a bucket of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import U, constants, mix, plan_bytes, raw, text_column

WINDOW, KMER = 100, 37
#: Places of the core within a window; a run has at most so many windows, a bit each in an answer.
SPAN = WINDOW - KMER + 1
#: Windows whose cores' places lie in one range of so many places are dealt together, at each level of splitting.
WIDTHS = (SPAN, 8, 1)
CHUNK = 1 << 18
#: Bytes of input (as Catalyst estimates them) to a bucket of documents and to a task of the sort, the least number of
#: each, and how many different strings with one core are sorted by one task.
BUCKET_BYTES, DIGIT_BYTES, LEAST_PARTS, HOT = 2 << 20, 4 << 20, 32, 1 << 14

_T = constants(21, 256)
_C = constants(22, 17)
_LOW = U((1 << 20) - 1)
I64 = np.int64


def _words(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number, the first byte leading."""
    return np.ndarray((max(0, len(b) - 7),), ">u8", np.ascontiguousarray(b), 0, (1,))


def _hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the KMER bytes from each position: of eight, 16 and 32, and of 32 twice, shifted."""
    h = _words(b).astype(U) * _C[0]
    h ^= h >> U(31)
    for n in (8, 16):
        h = h[:-n] * _C[n] + h[n:]
        h ^= h >> U(29)
    more = KMER - 32
    return (h[:-more] * _C[8] + h[more:]) * _C[1]


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = 1
    while 2 * n <= w:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (w - n)], x[w - n :]) if w > n else x


def runs(b: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """For pieces of the rows' bytes: (first window start, windows, start of the core, hash of the core) of each run.

    Starts count from b[0]; windows lie within one row; runs come in order of their starts.
    """
    long = np.diff(offsets) >= WINDOW
    ends, begins = offsets[1:][long], offsets[:-1][long]
    at, end_all = int(offsets[0]), int(offsets[-1])
    while at < end_all:
        stop = min(at + CHUNK, end_all)
        x = b[at : min(stop + WINDOW - 1, end_all)]
        m = min(len(x) - WINDOW + 1, stop - at)
        lo, hi = int(np.searchsorted(ends, at, "right")), int(np.searchsorted(begins, stop))
        if m > 0 and lo < hi:
            valid = np.zeros(m + 1, np.int32)
            np.add.at(valid, np.clip(begins[lo:hi] - at, 0, m), 1)
            np.add.at(valid, np.clip(ends[lo:hi] - WINDOW + 1 - at, 0, m), -1)
            p = np.flatnonzero(np.cumsum(valid[:m]))
            if len(p):
                h = _hashes(x)
                core = _sliding_min((h & ~_LOW) | np.arange(len(h), dtype=U), SPAN)[:m] & _LOW
                c = core[p]
                new = np.ones(len(p), bool)
                new[1:] = (c[1:] != c[:-1]) | (p[1:] != p[:-1] + 1)
                first = np.flatnonzero(new)
                q = c[first].astype(I64)
                yield p[first] + at, np.diff(np.append(first, len(p))), q + at, mix(h[q])
        at = stop


# --- blobs: one row for each two tasks that have something to tell each other
def _blobs(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(distinct keys, for each the bytes of its part of every column, one column after another)."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    at = np.append(np.flatnonzero(np.append(True, k[1:] != k[:-1])), len(k)) if len(k) else np.zeros(1, int)
    cols = [c[order] for c in columns]
    return k[at[:-1]], [b"".join(c[s:e].tobytes() for c in cols) for s, e in zip(at[:-1], at[1:], strict=True)]


def _answer(bucket: np.ndarray, kind: str, *columns: np.ndarray) -> pa.Table:
    to, data = _blobs(bucket, *columns)
    return pa.table({"bucket": pa.array(to, pa.int32()), "kind": pa.array([kind] * len(data), pa.string()), "data": pa.array(data, pa.binary())})


def _told(table: pa.Table, kind: str) -> list[memoryview]:
    return [memoryview(d.as_buffer()) for k, d in zip(table.column("kind"), table.column("data"), strict=True) if k.as_py() == kind]


ROWS, TOLD, DIGIT = "digit int, bucket int, data binary", "bucket int, kind string, data binary", "digit"


def _digit(h: np.ndarray, digits: int) -> np.ndarray:
    return (((h >> U(32)) * U(digits)) >> U(32)).astype(np.int32)


def _within(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    i = np.searchsorted(known, x)
    i[i == len(known)] = 0
    return known[i] == x


class _Bucket:
    """The documents of a bucket in order."""

    def __init__(self, docs: pa.Table):
        order = pc.sort_indices(docs.select(["doc_id", "tie", "text"]), [(c, "ascending") for c in ("doc_id", "tie", "text")])
        self.table = docs.take(order)
        self.b, self.offsets = raw(text_column(self.table, "text"))
        self.ids, self.ties = self.table.column("doc_id").to_numpy(), self.table.column("tie").to_numpy()

    def runs(self, keep: int) -> tuple[np.ndarray, ...]:
        """(core, high, low, hash) of each run: the core's start, its place in the first window and in the last."""
        got = list(runs(self.b, self.offsets)) if len(self.ids) else []
        start, count, core, h = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, U if i == 3 else I64) for i in range(4))
        return core, core - start, core - start - count + 1, h & U(keep)

    def repeated(self, keep: int, told: pa.Table) -> tuple[np.ndarray, ...]:
        """The runs whose cores other runs have, here or, as was told, elsewhere."""
        found = self.runs(keep)
        known = [np.frombuffer(d, U) for d in _told(told, "core")]
        value, n = np.unique(found[3], return_counts=True)
        some = _within(found[3], value[n > 1])
        if known:
            some |= _within(found[3], np.sort(np.concatenate(known)))
        return tuple(x[some] for x in found)

    def cut(self, told: pa.Table, level: int) -> tuple[np.ndarray, ...]:
        """The records that were to be split as those for each range of places, with hashes of what a range shares."""
        width = WIDTHS[level]
        got = [np.frombuffer(d, np.uint8) for d in _told(told, f"split{level - 1}")]
        core = np.concatenate([g[: len(g) // 6 * 4].view(np.uint32) for g in got]).astype(I64)
        high, low = (np.concatenate([g[len(g) // 6 * k : len(g) // 6 * (k + 1)] for g in got]).astype(I64) for k in (4, 5))
        n = high // width - low // width + 1
        at = np.repeat(low // width, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        core, high, low = np.repeat(core, n), np.minimum(np.repeat(high, n), at * width + width - 1), np.maximum(np.repeat(low, n), at * width)
        h, weight = np.zeros(len(core), U), constants(23, WINDOW)
        for s in range(0, len(core), 1 << 14):
            begin = core[s : s + (1 << 14)] - at[s : s + (1 << 14)] * width
            for k in range(WINDOW + 1 - width):
                h[s : s + (1 << 14)] += _T[self.b[begin + k]] * weight[k]
        order = np.lexsort((high, core))
        return core[order], high[order], low[order], mix(h + at.astype(U) * _C[9])[order]


def _cores(digits: int, keep: int):
    def find(key: tuple, docs: pa.Table) -> pa.Table:
        h = np.unique(_Bucket(docs).runs(keep)[3])
        to, data = _blobs(_digit(h, digits), h)
        return pa.table({"digit": pa.array(to, pa.int32()), "bucket": pa.array([key[0].as_py()] * len(to), pa.int32()), "data": pa.array(data, pa.binary())})

    def repeated(key: tuple, rows: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), U) for chunk in rows.column("data").chunks for x in chunk]
        bucket, h = np.repeat(rows.column("bucket").to_numpy(), [len(p) for p in parts]), np.concatenate(parts)
        value, n = np.unique(h, return_counts=True)
        several = _within(h, value[n > 1])
        return _answer(bucket[several], "core", h[several])

    return find, repeated


def _msd(data: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For strings of `data`, of one length within a group, a number that those equal to each other have in common;
    -1 for one that is equal to no other of its group. Digits are eight bytes; single ones leave after each."""
    every = _words(data)
    out = np.full(len(start), -1, I64)
    alive = np.argsort(group, kind="stable")
    now = group[alive]
    for at in range(-8, int(length.max(initial=0)), 8):
        if at < 0:  # the group is a digit too
            word = np.zeros(len(alive), U)
        else:
            short = np.clip(at + 8 - length[alive], 0, 8)
            word = every[start[alive] + np.where(short < 8, at, 0)].astype(U)
            part = short > 0
            word[part] = np.where(short[part] == 8, U(0), word[part] >> (U(8) * np.minimum(short[part], 7).astype(U)))
            order = np.lexsort((word, now))
            alive, now, word = alive[order], now[order], word[order]
        new = np.append(True, (now[1:] != now[:-1]) | (word[1:] != word[:-1]))[: len(alive)]
        size = np.diff(np.append(np.flatnonzero(new), len(alive)))
        many = np.repeat(size > 1, size)
        alive, now = alive[many], (np.cumsum(new) - 1)[many]
        if not len(alive):
            return out
    out[alive] = now
    return out


def _later(group: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Which members of groups (-1: none) are not the first of theirs in the order of these columns."""
    member = np.flatnonzero(group >= 0)
    by = np.lexsort((*(o[member] for o in order[::-1]), group[member]))
    g = group[member][by]
    out = np.zeros(len(group), bool)
    out[member[by]] = np.append(False, g[1:] == g[:-1])[: len(g)]
    return out


def _send(level: int, digits: int, keep: int):
    def work(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        to, blobs = [], []
        if len(docs) and (level == 0 or _told(told, f"split{level - 1}")):
            bucket = _Bucket(docs)
            core, high, low, h = bucket.cut(told, level) if level else bucket.repeated(keep, told)
            begin, end, data = (core - high).tolist(), (core + WINDOW - low).tolist(), memoryview(bucket.b)
            seen: dict[tuple, int] = {}
            here = np.array([seen.setdefault((bytes(data[s:e]), p), i) for i, (s, e, p) in enumerate(zip(begin, end, high.tolist(), strict=True))], I64)
            del seen
            again = here != np.arange(len(here))
            digit = np.where(again, digits + key[0].as_py(), _digit(mix(h), digits))  # what the bucket itself repeats: to itself
            row = np.searchsorted(bucket.offsets, core, "right") - 1
            columns = [core.astype(np.uint32), bucket.ids[row], bucket.ties[row], high.astype(np.uint8), low.astype(np.uint8)]
            order = np.argsort(digit, kind="stable")
            at = np.append(np.flatnonzero(np.append(True, digit[order][1:] != digit[order][:-1])), len(order)) if len(order) else np.zeros(1, int)
            for s, e in zip(at[:-1], at[1:], strict=True):
                part = order[s:e]
                to.append(int(digit[part[0]]))
                strings = [data[begin[i] : end[i]] for i in part.tolist()] if to[-1] < digits else []
                blobs.append(b"".join([np.uint32(len(part)).tobytes(), *(c[part].tobytes() for c in columns), *strings]))
        return pa.table({"digit": pa.array(to, pa.int32()), "bucket": pa.array([key[0].as_py()] * len(to), pa.int32()), "data": pa.array(blobs, pa.binary())})

    return work


def _records(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """(bucket, core, doc_id, tie, high, low) of each record, and the strings, one after another."""
    cols: list[list[np.ndarray]] = [[] for _ in range(5)]
    strings, n = [], []
    for x in (x for chunk in rows.column("data").chunks for x in chunk):
        data = x.as_buffer()
        k = int(np.frombuffer(data, np.uint32, 1)[0])
        at = 4
        for c, t in zip(cols, (np.uint32, I64, np.int32, np.uint8, np.uint8), strict=True):
            c.append(np.frombuffer(data, t, k, at))
            at += k * np.dtype(t).itemsize
        strings.append(np.frombuffer(data, np.uint8, offset=at) if at < len(data) else np.zeros(0, np.uint8))
        n.append(k)
    core, doc, tie, high, low = (np.concatenate(c) for c in cols)
    return np.repeat(rows.column("bucket").to_numpy(), n), core, doc, tie, high.astype(I64), low.astype(I64), np.concatenate([*strings, np.zeros(8, np.uint8)])


def _sort(level: int, digits: int, hot: int):
    width = WIDTHS[level]

    def work(key: tuple, rows: pa.Table) -> pa.Table:
        bucket, core, doc, tie, high, low, data = _records(rows)
        begin, count = core - high.astype(np.uint32), high - low + 1
        whole = ~U(0) >> (U(64) - count.astype(U))
        if key[0].as_py() >= digits:
            return _answer(bucket, "mask", whole, begin)
        mask, size, place = np.zeros(len(core), U), WINDOW - 1 + count, low // width * width
        start = np.cumsum(size) - size
        group = _msd(data, start + high - place, np.full(len(core), WINDOW + 1 - width), place)
        member = np.flatnonzero(group >= 0)
        equal = np.full(len(core), -1, I64)
        equal[member] = _msd(data, start[member], size[member], (group[member] * SPAN + high[member]) * SPAN + low[member])
        again = _later(equal, doc, tie, core)
        mask[again] = whole[again]
        one = np.flatnonzero((group >= 0) & ~again)  # of equal ones the first
        n = np.bincount(group[one], minlength=1)
        large = (n > hot) & (width > 1)
        split = one[large[group[one]]]
        left = one[(n > 1)[group[one]] & ~large[group[one]]]
        left = left[np.argsort(group[left], kind="stable")]
        upto = np.cumsum(count[left])
        done = 0
        while done < len(left):  # some groups at a time, each whole
            stop = min(int(np.searchsorted(upto, (upto[done - 1] if done else 0) + (1 << 18))), len(left) - 1)
            stop = int(np.searchsorted(group[left], group[left[stop]], "right"))
            some = left[done:stop]
            of = np.repeat(some, count[some])
            i = np.arange(len(of)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
            same = _msd(data, start[of] + i, np.full(len(of), WINDOW), group[of])
            late = _later(same, doc[of], tie[of], core[of])
            np.bitwise_or.at(mask, of[late], U(1) << i[late].astype(U))
            done = stop
        some = np.flatnonzero(mask)
        told = _answer(bucket[some], "mask", mask[some], begin[some])
        return pa.concat_tables([told, _answer(bucket[split], f"split{level}", core[split], high[split].astype(np.uint8), low[split].astype(np.uint8))])

    return work


def _covered(n: int, told: pa.Table) -> np.ndarray:
    """Which of a bucket's n bytes lie in a window that starts earlier somewhere."""
    begins = np.zeros(n + 1, bool)
    for d in _told(told, "mask"):
        k = len(d) // 12
        r, i = np.nonzero(np.unpackbits(np.frombuffer(d, np.uint8, 8 * k).reshape(-1, 8), axis=1, bitorder="little"))
        begins[np.frombuffer(d, np.uint32, k, 8 * k)[r] + i] = True
    total = np.cumsum(begins, dtype=np.int32)
    out = total[:-1] > 0
    out[WINDOW:] = total[WINDOW:-1] > total[: -1 - WINDOW]
    return out


def _remove(more: bool):
    def work(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        bucket = _Bucket(docs)
        gone = _covered(len(bucket.b), told)
        kept, spans, b = [], [], bucket.b
        for lo, hi in zip(bucket.offsets[:-1].tolist(), bucket.offsets[1:].tolist(), strict=True):
            c = gone[lo:hi]
            if not c.any():
                kept.append(b[lo:hi].tobytes())
                spans.append([])
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[False], c, [False]]).astype(np.int8)))
            spans.append([{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)])
            kept.append(b[lo:hi][~c].tobytes())
        out = {
            "doc_id": pa.array(bucket.ids, pa.int64()), "n_bytes": pa.array(np.diff(bucket.offsets), pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.binary()),
        }
        if more:
            struct = pa.concat_arrays(bucket.table.column("more").chunks) if len(bucket.ids) else pa.array([], bucket.table.column("more").type)
            out["more"] = pa.StructArray.from_arrays(struct.flatten(), fields=[f.with_nullable(True) for f in struct.type])
        return pa.table(out)

    return work


_LEAST = -(1 << 63)


def remove_repeats(docs: DataFrame, carry: list[str] | None = None, hot: int = HOT, hash_bits: int = 64) -> DataFrame:
    """doc_id, n_bytes, spans (removed, start to end in bytes), kept (the remaining bytes): one row per input row, and
    with `carry` its columns of these names in the struct `more`.

    Null text is empty, and a text of fewer than 100 bytes loses nothing. Rows that repeat a doc_id come in order of a
    hash of their texts; of equal rows one counts as first. A null doc_id is before all others. Other columns take no
    part. Results do not depend on `hot` (different strings with one core that a task sorts) and `hash_bits` (of the
    hashes by which cores are found again); tests make both small.
    """
    size, keep = plan_bytes(docs), (1 << hash_bits) - 1
    buckets, digits = max(LEAST_PARTS, size // BUCKET_BYTES), max(LEAST_PARTS, size // DIGIT_BYTES)
    more = [F.struct(*[F.col(c) for c in carry]).alias("more")] if carry else []
    d = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LEAST)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)
    tie = F.xxhash64("text").cast("string")
    d = d.withColumn("tie", F.hash(tie)).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(buckets)).cast("int"))
    d = d.repartition(buckets, "bucket")  # the one shuffle of the texts; every pass reads it again
    by = lambda x: x.groupBy("bucket")
    hold = lambda x: x.repartition(buckets, "bucket")  # noqa: E731  (answers are made once, and read by several passes)
    find, repeated = _cores(digits, keep)
    told = hold(by(d).applyInArrow(find, ROWS).groupBy(DIGIT).applyInArrow(repeated, TOLD))
    masks = None
    for level in range(len(WIDTHS)):
        sent = by(d).cogroup(by(told)).applyInArrow(_send(level, digits, keep), ROWS)
        told = hold(sent.groupBy(DIGIT).applyInArrow(_sort(level, digits, hot), TOLD))
        masks = told if masks is None else masks.unionByName(told)
    out = "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    out += f", more {d.schema['more'].dataType.simpleString()}" if carry else ""
    return by(d).cogroup(by(masks)).applyInArrow(_remove(bool(carry)), out).withColumn("doc_id", F.nullif("doc_id", F.lit(_LEAST)))
