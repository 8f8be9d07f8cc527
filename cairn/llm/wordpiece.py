"""Token counts by a linear longest-match automaton.

The vocabulary is a trie. A failure link leads from a node to the node that stands for what is left of it once the
longest-match tokens that can no longer grow are taken off its front; how many these are is stored with the link, so a
word's number of pieces comes out in one pass over its bytes, without backtracking and without building a piece.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cairn.llm.common import batches, doc_texts

#: Words whose counts a worker keeps; a full table starts anew.
REMEMBERED = 500_000


class Automaton:
    """Counts greedy longest-match pieces of byte strings. `inner` has the tokens that may follow another within a
    word, without their marker; by default the same as `tokens`."""

    def __init__(self, tokens: Iterable[bytes], inner: Iterable[bytes] | None = None):
        self.next: list[dict[int, int]] = [{}]
        ends: set[int] = set()
        self._insert(0, tokens, ends)
        self.inner = 0
        if inner is not None:
            self.next.append({})
            self.inner = 1 if len(self.next) == 2 else len(self.next) - 1
            self._insert(self.inner, inner, ends)
        n = len(self.next)
        self.fail, self.pops = [-1] * n, [0] * n
        queue = deque({0, self.inner})
        roots = set(queue)
        while queue:
            u = queue.popleft()
            for c, v in self.next[u].items():
                queue.append(v)
                if v in ends:
                    self.fail[v], self.pops[v] = self.inner, 1
                    continue
                z, popped = self.fail[u], self.pops[u]
                while z >= 0 and c not in self.next[z]:
                    popped += self.pops[z]
                    z = self.fail[z]
                if z >= 0 and u not in roots:
                    self.fail[v], self.pops[v] = self.next[z][c], popped

    def _insert(self, root: int, tokens: Iterable[bytes], ends: set[int]) -> None:
        for token in tokens:
            at = root
            for c in token:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                at = to
            if at != root:
                ends.add(at)

    def count(self, word: bytes) -> int:
        """Pieces of one word; 1 (the unknown token) where the vocabulary can't spell it; 0 for an empty one."""
        at, n = 0, 0
        nxt, fail, pops = self.next, self.fail, self.pops
        for c in word:
            while (to := nxt[at].get(c)) is None:
                if fail[at] < 0:
                    return 1
                n += pops[at]
                at = fail[at]
            at = to
        while at != self.inner and at != 0:
            if fail[at] < 0:
                return 1
            n += pops[at]
            at = fail[at]
        return n


def greedy(tokens: set[bytes], word: bytes, inner: set[bytes] | None = None) -> int:
    """The definition: take the longest token again and again."""
    at = n = 0
    while at < len(word):
        known = tokens if at == 0 or inner is None else inner
        step = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in known), 0)
        if not step:
            return 1
        at, n = at + step, n + 1
    return n


def vocabulary(path: str) -> list[bytes]:
    """Byte strings of a ranks file."""
    return [base64.b64decode(line.split()[0]) for line in open(path, "rb") if line.strip()]


_LOADED: dict[tuple, tuple] = {}


def count_tokens(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_words, n_tokens per input row: words by the pattern, pieces by greedy longest match over the vocabulary
    at `path`. Null or empty text has none of either; rows that repeat a doc_id, or have none, are counted each."""

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, pattern) not in _LOADED:
            _LOADED[path, pattern] = Automaton(vocabulary(path)), regex.compile(pattern), {}
        automaton, find, known = _LOADED[path, pattern]
        for batch, col in batches(it, "text", 1 << 20):
            words, tokens = np.zeros(len(col), np.int64), np.zeros(len(col), np.int64)
            for i, text in enumerate(col):
                found = find.findall(text.as_py())
                try:
                    tokens[i] = sum(map(known.__getitem__, found))
                except KeyError:
                    if len(known) > REMEMBERED:
                        known.clear()
                    for w in set(found):  # not set - keys(), which goes through all of the keys
                        if w not in known:
                            known[w] = automaton.count(w.encode())
                    tokens[i] = sum(map(known.__getitem__, found))
                words[i] = len(found)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(tokens)], names=["doc_id", "n_words", "n_tokens"])

    return doc_texts(docs).mapInArrow(work, "doc_id bigint, n_words bigint, n_tokens bigint")
