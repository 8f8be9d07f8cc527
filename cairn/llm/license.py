"""License scan by conditional compression.

At most k = DIFFER * t of a template's t words may be missing, so of any k + 1 different words of it a notice has one:
these are its signs. Around each sign word of a document lies a block, of the template's length and k words more to
either side, over line ends. Blocks that have enough of a template's words are compressed with each such template as a
raw dictionary, and ranked by what that saves; in this order the exact differences in wording confirm them. A version or
a word that tells licenses apart ("lesser", "by-nc") must be the same. A notice with differences must also save SAVES of
its own size.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import batches

# Notices and the names of what they grant.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work. Public domain.",
    "proprietary": "All rights reserved.",
}
#: The differences allowed, as a share of the template's words; the share of its size a template must save; and words too
#: frequent to be signs while a template has others.
DIFFER, SAVES = 0.2, 0.2
COMMON = frozenset("a all and any are as at be by for from has have in is it its may not of on or that the their these this to under use was which will with without work".split())

# Words that tell one license from its relatives, beside all words with a digit.
VARIANTS = frozenset("lesser library affero free documentation mozilla apache mit bsd isc eclipse boost by nc sa nd by-nc by-sa by-nd by-nc-sa by-nc-nd not no".split())

_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
_VERSION = re.compile(r"v?(\d+(?:\.\d+)*?)(?:\.0)*")


def plain(word: str) -> str:
    """Lower-cased; of a version number without what says nothing: v2.0 and 2 are the same."""
    w = word.lower()
    m = _VERSION.fullmatch(w)
    return m[1] if m else w


def words(text: str) -> list[str]:
    return [plain(w) for w in _WORD.findall(text)]


def variants(some: list[str]) -> list[str]:
    return [w for w in some if w in VARIANTS or any(c.isdigit() for c in w)]


def align(block: list[str], template: list[str]) -> tuple[int, int, int, int]:
    """(words of the template missing, words that it has not, first, end) of the stretch of the block that becomes the
    template by the fewest insertions and deletions; of such stretches that with most of the template's words, then the first."""
    n = len(block)
    cost, start = [0] * (n + 1), list(range(n + 1))
    for i, word in enumerate(template, 1):
        c, s = [i], [0]
        for j in range(1, n + 1):
            if block[j - 1] == word:
                c.append(cost[j - 1])
                s.append(start[j - 1])
            else:
                least, begin = min((cost[j], start[j]), (c[j - 1], s[j - 1]))
                c.append(least + 1)
                s.append(begin)
        cost, start = c, s
    end = min(range(n + 1), key=lambda j: (cost[j], start[j] - j, j))
    length = end - start[end]
    same = (len(template) + length - cost[end]) // 2
    return len(template) - same, length - same, start[end], end


def signs(template: list[str]) -> list[str]:
    """Different words of a template of which every notice of it has one."""
    return sorted(set(template), key=lambda w: (w in COMMON, -len(w), w))[: int(DIFFER * len(template)) + 1]


class Scanner:
    def __init__(self, templates: dict[str, str]):
        plain_zstd = dict(level=19, write_content_size=False)
        self.alone = zstandard.ZstdCompressor(**plain_zstd)
        self.each = []
        self.places = defaultdict(list)  # sign word: (template, place in it)
        for name, text in templates.items():
            template = words(text)
            known = zstandard.ZstdCompressionDict(" ".join(template).encode() * 2, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            for w in signs(template):
                self.places[w] += [(len(self.each), i) for i, x in enumerate(template) if x == w]
            self.each.append((name, template, Counter(template), variants(template), zstandard.ZstdCompressor(dict_data=known, **plain_zstd)))

    def saved(self, k: int, some: list[str]) -> float:
        """Share of the compressed size of these words that template k saves as a dictionary."""
        data = " ".join(some).encode()
        return 1 - len(self.each[k][4].compress(data)) / len(self.alone.compress(data))

    def rank(self, mine: list[str], windows: set[tuple[int, int]]) -> list[tuple[float, int, int, int]]:
        """(-saved, template, first, end) of the blocks for these (template, start) that have enough of its words."""
        found = set()
        for k, start in windows:
            _, template, bag, _, _ = self.each[k]
            slack = int(DIFFER * len(template))
            lo, hi = max(0, start - slack), start + len(template) + slack
            if (bag & Counter(mine[lo:hi])).total() >= len(template) - slack:
                found.add((k, lo, hi))
        return sorted((-self.saved(k, mine[lo:hi]), k, lo, hi) for k, lo, hi in found)

    def confirm(self, mine: list[str], ranked: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int, float, int, int]]:
        """(first, end, template, saved, missing, extra) of notices, none of which overlap."""
        out, taken = [], set()
        for _, k, lo, hi in ranked:
            _, template, _, told_apart, _ = self.each[k]
            slack, before = int(DIFFER * len(template)), None
            while True:  # around what was found, until no more of the notice lies outside
                missing, extra, first, stop = align(mine[lo:hi], template)
                first, stop = lo + first, lo + stop
                if (first, stop) == before or missing + extra > slack:
                    break
                before, lo, hi = (first, stop), max(0, first - 2 * slack), stop + 2 * slack
            if missing + extra > slack or variants(mine[first:stop]) != told_apart:
                continue
            if not taken.isdisjoint(range(first, stop)):
                continue
            saved = self.saved(k, mine[first:stop])
            if missing + extra == 0 or saved >= SAVES:
                taken.update(range(first, stop))
                out.append((first, stop, k, saved, missing, extra))
        return sorted(out)

    def notices(self, text: str) -> list[tuple[int, str, float, int, int, int]]:
        """(line, license, share saved, words of the template missing from the notice, words of the notice that it has
        not, place of the notice's first word in its line) of all notices."""
        seen, mine, at = {}, [], array("q")
        for m in _WORD.finditer(text):
            w = m.group()
            mine.append(seen.get(w) or seen.setdefault(w, plain(w)))
            at.append(m.start())
        if self.places.keys().isdisjoint(seen.values()):
            return []
        windows = {(k, q - p) for q, w in enumerate(mine) if w in self.places for k, p in self.places[w]}
        out = []
        for first, _, k, saved, missing, extra in self.confirm(mine, self.rank(mine, windows)):
            begin = text.rfind("\n", 0, at[first]) + 1
            out.append((text.count("\n", 0, begin), self.each[k][0], saved, missing, extra, first - bisect_left(at, begin)))
        return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, block (number of the line where it begins), license, saved, missing, extra, first_word: a row per notice.

    Documents without notices, with null or empty text give no rows; rows that repeat a doc_id give theirs each. Of
    notices that overlap the one whose block saves most counts. Documents without a sign word are skipped.
    """
    chosen = templates or TEMPLATES
    # a sign may stand in the text in a longer form (v2.0 for 2), which holds it; lower-cased once, then plain searches
    some = sorted({w for t in chosen.values() for w in signs(words(t))})
    any_sign = F.exists(F.array(F.lower("text")), lambda t: reduce(or_, (t.contains(F.lit(w)) for w in some), F.lit(False)))
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(any_sign)

    def work(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen)
        for batch, col in batches(it, "text"):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), col.to_pylist(), strict=True):
                rows += [(doc, *hit) for hit in scanner.notices(text)]
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "block", "license", "saved", "missing", "extra", "first_word"])

    return d.mapInArrow(work, "doc_id bigint, block bigint, license string, saved double, missing bigint, extra bigint, first_word bigint")
