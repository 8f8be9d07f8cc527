"""Benchmark decontamination with an FM-index per training shard.

Words of documents and benchmark become symbols (words that the benchmark lacks can't be in an occurrence and separate).
Each shard of documents gets its own index, once: suffix order, the symbols before the suffixes in a wavelet matrix for
rank queries, and sampled suffix positions. All test phrases go through its backward search, block by block; what they
match is located by walking to the next sampled position, and the words covered are merged into removal spans.

A block is a bounded number of benchmark words, sent out by broadcast; a benchmark of any size is a list of blocks, and a
task holds one at a time. The driver holds one at a time too, as rows of words come to it that tasks have made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import U, batches, carrying, raw, starts_of, word_hashes

WINDOW = 10
#: Bytes of text to a shard, every how many positions are sampled, words of a block of the benchmark, and of the pieces
#: in which long items come.
SHARD_BYTES, SAMPLED, BLOCK_WORDS, PIECE_WORDS = 4 << 20, 8, 1 << 20, 1 << 16

_WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_lo:_hi] = True


class Wavelet:
    """Rank queries over symbols below 2 ** levels."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, x = levels, symbols
        self.ones, self.zeros = [], []
        for level in range(levels - 1, -1, -1):
            bit = (x >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(x) - int(bit.sum()))
            x = np.concatenate([x[bit == 0], x[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of each symbol come before each place."""
        lo, hi = np.zeros_like(at), at
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((symbol >> level) & 1) == 1
            l1, h1 = self.ones[k][lo], self.ones[k][hi]
            lo, hi = np.where(one, self.zeros[k] + l1, lo - l1), np.where(one, self.zeros[k] + h1, hi - h1)
        return hi - lo


class FMIndex:
    """Over symbols 1 .. size of several runs; 0 in `symbols` ends each run. Matches never cross a 0."""

    def __init__(self, symbols: np.ndarray, size: int):
        n = len(symbols)
        ends = symbols == 0
        n_ends = int(ends.sum())
        rank = np.where(ends, np.cumsum(ends) - 1, symbols + n_ends).astype(np.int64)
        step = 1
        while True:  # by doubling; each end is a rank of its own, so nothing is compared beyond it
            nxt = np.zeros(n, np.int64)
            nxt[:-step] = rank[step:] + 1
            key = rank * (n + size + 2) + nxt
            order = np.argsort(key, kind="stable")
            new = np.append(False, key[order][1:] != key[order][:-1])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            if rank[order[-1]] == n - 1 or step >= n:
                break
            step *= 2
            if step >= n:
                break
        before = symbols[order - 1]  # a run's first symbol has the 0 of the run before (or of the last) before it
        self.wavelet = Wavelet(before, max(1, int(size).bit_length()))
        self.before = before
        self.least = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size + 1))])
        first = np.append(True, ends[:-1])
        sampled = first | (np.arange(n) % SAMPLED == 0)
        self.sampled, self.place = sampled[order], order
        self.n = n

    def count(self, flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of the phrases flat[start : start + length], from their last symbols on."""
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), self.n, np.int64)
        for j in range(int(length.max(initial=0))):
            go = np.flatnonzero((length > j) & (lo < hi))
            c = flat[start[go] + length[go] - 1 - j]
            if j == 0:
                lo[go], hi[go] = self.least[c], self.least[c + 1]
            else:
                lo[go], hi[go] = self.least[c] + self.wavelet.rank(c, lo[go]), self.least[c] + self.wavelet.rank(c, hi[go])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        at, row, steps = np.full(len(rows), -1, np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            done = self.sampled[row[left]]
            stop = left[done]
            at[stop] = self.place[row[stop]] + steps[stop]
            left = left[~done]
            c = self.before[row[left]]
            row[left] = self.least[c] + self.wavelet.rank(c, row[left])
            steps[left] += 1
        return at


def _place(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """1 + the place of each hash among the sorted words, 0 where it is none of them."""
    if not len(words):
        return np.zeros(len(h), np.int64)
    i = np.searchsorted(words, h)
    i[i == len(words)] = 0
    return np.where(words[i] == h, i + 1, 0)


class Phrases:
    """A block: the words of items, or of pieces of items, and the windows among them: ten words in a row, or all of an
    item of fewer."""

    def __init__(self, items: list[int | None], hashes: list[np.ndarray]):
        flat = np.concatenate([*hashes, np.zeros(0, U)])
        self.words = np.unique(flat)
        self.flat = _place(flat, self.words).astype(np.int32)
        size = np.array([len(h) for h in hashes], np.int64)
        n = np.maximum(1, size - WINDOW + 1)
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        self.start = (np.repeat(np.cumsum(size) - size, n) + within).astype(np.int32)
        self.length = np.repeat(np.minimum(size, WINDOW), n).astype(np.int8)
        self.item, self.items = np.repeat(np.arange(len(items), dtype=np.int32), n), items

    def search(self, index: FMIndex, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the indexed symbols, words, number of the item) of every occurrence."""
        flat = np.append(0, _place(self.words, alphabet))[self.flat]
        absent = np.append(0, np.cumsum(flat == 0))
        start, length = self.start.astype(np.int64), self.length.astype(np.int64)
        some = np.flatnonzero(absent[start + length] == absent[start])
        start, length, item = start[some], length[some], self.item[some]
        lo, hi = index.count(flat, start, length)
        n = hi - lo
        rows = np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
        return index.locate(rows), np.repeat(length, n), np.repeat(item, n)


def _item_words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_id and word hashes (as bytes) of items that have words; pieces of a long item overlap by a window less one."""
    for batch, col in batches(it, "text"):
        row, _, _, h = word_hashes(*raw(col), _WORD)
        at = np.append(starts_of(row), len(row))
        ids, found = batch.column("item_id").to_pylist(), []
        for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            last = max(s + 1, e - WINDOW + 1)
            found += [(ids[int(row[s])], h[k : min(e, k + PIECE_WORDS + WINDOW - 1)].tobytes()) for k in range(s, last, PIECE_WORDS)]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], names=["item_id", "words"])


def _blocks(benchmark: DataFrame, block_words: int) -> tuple[list[Broadcast], int]:
    """The blocks, and the words of the shortest window."""
    b = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sc = benchmark.sparkSession.sparkContext
    blocks, items, hashes, held, least = [], [], [], 0, WINDOW
    for r in b.mapInArrow(_item_words, "item_id bigint, words binary").toLocalIterator(prefetchPartitions=True):
        items.append(r.item_id)
        hashes.append(np.frombuffer(r.words, U))
        held += len(hashes[-1])
        least = min(least, len(hashes[-1]))
        if held >= block_words:
            blocks.append(sc.broadcast(Phrases(items, hashes)))
            items, hashes, held = [], [], 0
    if items:
        blocks.append(sc.broadcast(Phrases(items, hashes)))
    return blocks, least


def _each(blocks: list[Broadcast]) -> Iterator[tuple[int, Phrases]]:
    """A worker reads a block from its executor's copy; of several it keeps none in memory."""
    for k, b in enumerate(blocks):
        yield k, b.value
        if len(blocks) > 1 and hasattr(b, "_value"):
            del b._value


def _shard_hits(row: np.ndarray, h: np.ndarray, blocks: list[Broadcast], least: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """(first word, words of every occurrence; of each block its number, first words and items of its occurrences)."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    known = np.zeros(len(h), bool)
    for _, p in _each(blocks):
        known |= _place(h, p.words) > 0
    known = np.flatnonzero(known)
    if not len(known):
        return none
    # runs of known words of one text; those shorter than any phrase can't hold one
    new = np.append(True, (known[1:] != known[:-1] + 1) | (row[known[1:]] != row[known[:-1]]))
    size = np.diff(np.append(np.flatnonzero(new), len(known)))
    keep = size >= least
    if not keep.any():
        return none
    at, size = known[np.repeat(keep, size)], size[keep]
    alphabet = np.unique(h[at])
    symbols, source = np.zeros((size + 1).sum(), np.int64), np.zeros((size + 1).sum(), np.int64)
    put = np.arange(len(at)) + np.repeat(np.arange(len(size)), size)
    symbols[put], source[put] = _place(h[at], alphabet), at
    index = FMIndex(symbols, len(alphabet))
    first, words, items = [], [], []
    for k, p in _each(blocks):
        place, length, item = p.search(index, alphabet)
        first.append(source[place])
        words.append(length)
        items.append((k, first[-1], item))
    return np.concatenate(first), np.concatenate(words), items


OUT = "doc_id bigint, n_words bigint, n_hit bigint, items array<bigint>, spans array<struct<start:bigint,end:bigint,first:bigint,last:bigint>>"


def find(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, items, spans (bytes start to end, words first to last, merged): one row per input row, and
    with `carry` its columns of these names in the struct `more`.

    Null or empty text has no words. Items with null or wordless text have no window; items that repeat count once by
    item_id. Rows that repeat a doc_id, or have none, are searched each. Other columns take no part.
    """
    blocks, least = _blocks(benchmark, block_words)

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, col in batches(it, "text", SHARD_BYTES):
            b, offsets = raw(col)
            row, start, end, h = word_hashes(b, offsets, _WORD)
            first, length, items = _shard_hits(row, h, blocks, least)
            change = np.zeros(len(row) + 1, np.int64)
            np.add.at(change, first, 1)
            np.add.at(change, first + length, -1)
            hit = np.cumsum(change[:-1]) > 0
            n_words, n_hit = np.bincount(row, minlength=len(col)), np.bincount(row[hit], minlength=len(col))
            items_of: dict[int, set] = {}
            for k, where, item in items:
                if len(where):
                    ids = blocks[k].value.items
                    for r, i in np.unique(np.stack([row[where], item]), axis=1).T.tolist():
                        items_of.setdefault(r, set()).add(ids[i])
                    if len(blocks) > 1 and hasattr(blocks[k], "_value"):
                        del blocks[k]._value
            spans: dict[int, list] = {}
            at = np.flatnonzero(hit)
            if len(at):
                new = np.append(True, (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]]))
                s, e = at[new], at[np.append(new[1:], True)]
                begins = starts_of(row)
                begin = begins[np.searchsorted(begins, s, "right") - 1]
                for r, x, y, f, g in zip(row[s].tolist(), (start[s] - offsets[row[s]]).tolist(), (end[e] - offsets[row[e]]).tolist(), (s - begin).tolist(), (e - begin).tolist(), strict=True):
                    spans.setdefault(r, []).append({"start": x, "end": y, "first": f, "last": g})
            cols = [
                batch.column("doc_id"), pa.array(n_words), pa.array(n_hit),
                pa.array([sorted(items_of.get(i, ()), key=lambda x: (x is None, x)) for i in range(len(col))], pa.list_(pa.int64())),
                pa.array([spans.get(i, []) for i in range(len(col))], pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "end", "first", "last")]))),
            ]
            yield pa.RecordBatch.from_arrays([*cols, *([batch.column("more")] if carry else [])], names=["doc_id", "n_words", "n_hit", "items", "spans", *(["more"] if carry else [])])

    d, more = carrying(docs, carry)
    return d.mapInArrow(work, OUT + more)
