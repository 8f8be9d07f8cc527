"""Harmonic packing of token sequences.

Class j takes pieces of floor(1024 / j) tokens, j to a bin: a bin is full after a fixed number of pieces, whichever they
are, so workers fill bins without knowing of each other and nothing is shuffled. A document gives whole bins of class 1
first, then the largest class that its rest fills, and so on down to class LAST; what is left, shorter than that class's
pieces, goes one after another into a bin for short ends and is cut where the bin ends. When a worker is done, its unfilled bins
are laid out again end to end, and the last, unfilled sequence is split into powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cairn.llm.common import batches, doc_texts

CAPACITY, LAST = 1024, 16
SIZES = [0, *(CAPACITY // j for j in range(1, LAST + 1))]
END = 0
#: Characters whose class the two engines' Unicode tables could see differently; such texts take the slower one.
UNUSUAL = "[\x00-\x08\x0b-\x1f\x7f-\xa0ɐ-\U0010ffff]"


class Ids:
    """Token ids of texts: those of a tokenizers file, also for the strings of its special tokens in a text. With the
    same vocabulary as ranks beside it, texts of common characters without such strings take the faster engine, whose
    ids are the same."""

    def __init__(self, path: str, ranks: str | None, pattern: str | None, special: tuple[str, ...] = ()):
        self.path, self.slow, self.fast = path, None, None
        self.unusual = re.compile("|".join([UNUSUAL, *map(re.escape, special)]))
        if ranks:
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not self.unusual.search(text):
            ids = self.fast.encode_ordinary(text)
        else:
            if self.slow is None:  # takes room, and few texts need it
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            ids = self.slow.encode(text, add_special_tokens=False).ids
        return np.array([*ids, END], "<u4")


def special_tokens(path: str) -> tuple[str, ...]:
    """Strings of the tokens that a tokenizers file adds to its vocabulary."""
    with open(path, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f)["added_tokens"])


_LOADED: dict[tuple, Ids] = {}


def load(*key) -> Ids:
    """Once per Python worker."""
    if key not in _LOADED:
        _LOADED[key] = Ids(*key)
    return _LOADED[key]


class Packer:
    """Bins of one worker. A piece is (doc_id, start, ids, doc_tokens); rows come out as bins close."""

    def __init__(self, worker: int):
        self.next, self.rows = worker << 33, []
        self.open: list[list[tuple]] = [[] for _ in range(LAST + 2)]
        self.ends = 0  # tokens in the bin for short ends

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), crc32(ids.tobytes()), total, self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        n = at = 0
        total = len(ids)
        for j in range(1, LAST + 1):
            size = SIZES[j]
            n = (total - at) // size if j == 1 else int(total - at >= size)
            for _ in range(n):
                bin_ = self.open[j]
                bin_.append((doc, at, ids[at : at + size], total))
                at += size
                if len(bin_) == j:
                    self.close(bin_)
                    self.open[j] = []
        while at < total:
            take = min(total - at, CAPACITY - self.ends)
            self.open[-1].append((doc, at, ids[at : at + take], total))
            at += take
            self.ends += take
            if self.ends == CAPACITY:
                self.close(self.open[-1])
                self.open[-1], self.ends = [], 0

    def finish(self) -> None:
        pieces = [p for bin_ in self.open for p in bin_]
        left = sum(len(p[2]) for p in pieces)
        limits = [CAPACITY] * (left // CAPACITY) + [1 << i for i in range(10, -1, -1) if left % CAPACITY >> i & 1]
        i = used = 0
        for limit in limits:
            now, room = [], limit
            while room:
                doc, start, ids, total = pieces[i]
                part = ids[used : used + room]
                now.append((doc, start + used, part, total))
                room -= len(part)
                used += len(part)
                if used == len(ids):
                    i, used = i + 1, 0
            self.close(now)
        self.open = []


SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, path: str, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text is empty and gives the end token alone. Rows that repeat a doc_id (or have none) are packed each for
    itself. Sequence ids are unique but not consecutive: the worker's number is in the upper bits.
    """
    key = path, ranks, pattern, special_tokens(path)

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = load(*key), Packer(TaskContext.get().partitionId())

        def rows() -> pa.RecordBatch:
            cols = list(zip(*packer.rows, strict=True)) or [[]] * 7
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch, col in batches(it, "text", 1 << 20):
            for doc, text in zip(batch.column("doc_id").to_pylist(), col.to_pylist(), strict=True):
                packer.add(doc, encode(text))
            yield rows()
        packer.finish()
        yield rows()

    return doc_texts(docs).mapInArrow(work, SCHEMA)
