"""MinHash near-dedup with tensored banding.

2 * GROUPS small collections of ROWS minhashes each, GROUPS on a left and GROUPS on a right side, give
GROUPS * GROUPS tables: the key of table (i, j) joins left collection i with right collection j. So 100 tables of four
minhashes each take 40 minhashes instead of 400. At a similarity of 0.75 a pair shares some left collection with
probability 1 - (1 - 0.75 ** 2) ** 10 = 0.9997, and some table with 0.9995.

A document enters the cells of its left collections that another document shares too; that it shares a right collection
with another member, so some table's cell, is seen inside the task, which also compares the minhash bytes. No pair is
emitted as a row: a task reports a spanning forest of its candidates.

Documents with one and the same shingle set form a class, and its smallest doc_id stands for it, before any table is
built. The components of the candidates are groups; the members of a group are compared on their full sets, by counting
common shingles (a product of incidence matrices), and each task reports a spanning forest of the true links.

Cells and groups of more than a block are gone through in two rounds, as only who is connected counts. First all members
meet a few leaders, in tasks of a block of members each. Those whom the leaders connect need not meet one another; the
others meet all, dealt as pairs of blocks. So a group of very many copies of one text costs as much as its size, and only
those who are near no leader are paired with everyone. No pair goes unseen but those connected already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import SPACES, U, batches, constants, doc_texts, i64, mix, ngrams, parts_of, raw, starts_of, text_column, word_hashes
from cairn.llm.components import connected_components
from cairn.session import checkpoint

WORDS, SIMILARITY = 5, 75
GROUPS, ROWS = 10, 2
HASHES = 2 * GROUPS * ROWS
#: Pairs whose 40 one-byte minhashes agree in fewer places are no candidates: at 0.75 that has a chance of 4.7e-11.
LEAST_AGREE = 11
#: Documents, and bytes of hashes, of a block; members up to which cells and groups are gone through many at once.
BLOCK, BLOCK_BYTES, SMALL = 512, 1 << 22, 16
#: Members that all others of a cell or group of several blocks meet first.
LEADERS = 4

_A = constants(11, HASHES)
_B = constants(12, HASHES)
_NOT_SPACE = ~SPACES


def shingles(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash), distinct and in order, of the word shingles of each text; a shorter text is one shingle."""
    b, offsets = raw(col)
    row, _, _, h = word_hashes(b, offsets, _NOT_SPACE)
    r, g = ngrams(row, h, WORDS, 3)
    n = np.bincount(row, minlength=len(col)) if len(col) else np.zeros(0, int)
    short = (n > 0) & (n < WORDS)
    if short.any():
        pick = short[row]
        sr, sh = row[pick], h[pick]
        at = starts_of(sr)
        place = np.arange(len(sr)) - np.repeat(at, np.diff(np.append(at, len(sr))))
        g = np.concatenate([g, mix(np.add.reduceat(sh * constants(4, WORDS)[place], at) + n[sr[at]].astype(U))])
        r = np.concatenate([r, sr[at]])
    order = np.lexsort((g, r))
    r, g = r[order], g[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (g[1:] != g[:-1])
    return r[new], g[new]


def _signatures(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_shingles, fingerprint of the set (two longs), one byte of each minhash and four of each right
    collection's hash, the left collections' hashes."""
    for batch, col in batches(it, "text", 1 << 19):
        n = len(col)
        r, g = shingles(col)
        size = np.bincount(r, minlength=n)
        at = starts_of(r)
        has = r[at]
        f1, f2 = np.zeros(n, U), np.zeros(n, U)
        low = np.zeros((n, HASHES), U)
        if len(r):
            f1[has], f2[has] = np.add.reduceat(mix(g ^ U(0x5555)), at), np.add.reduceat(mix(g * U(0x2545F4914F6CDD1D)), at)
            for k in range(HASHES):
                x = g * _A[k] + _B[k]
                x ^= x >> U(32)
                low[has, k] = np.minimum.reduceat(x * _A[k - 1], at)
        keys = mix((low.reshape(n, 2 * GROUPS, ROWS) * constants(13, ROWS)).sum(axis=2, dtype=U) + constants(14, 2 * GROUPS))
        byte = (mix(low) & U(0xFF)).astype(np.uint8)
        listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * GROUPS), pa.array(i64(keys[:, :GROUPS]).ravel()))
        packed = np.concatenate([byte, (keys[:, GROUPS:] & U(0xFFFFFFFF)).astype("<u4").view(np.uint8)], axis=1)
        sig = pa.array([packed[i].tobytes() for i in range(n)], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(i64(f1)), pa.array(i64(f2)), sig, listed],
            names=["doc_id", "n_shingles", "f1", "f2", "sig", "sides"],
        )


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (an index of the same component each) after joining a[k] with b[k]."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _runs(start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places within each of the runs that begin at `start`, of n places."""
    size = np.diff(np.append(start, n))
    last = np.repeat(start + size, size)
    at, out = np.arange(n), []
    for d in range(1, int(size.max(initial=1))):
        at = at[at + d < last[at]]
        out.append((at, at + d))
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(2))


def _whole_groups(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by (key, i, j) as tables of whole groups, with where each group begins."""

    def cut(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(parts)
        new = np.zeros(len(table), bool)
        new[:1] = True
        for c in ("key", "i", "j"):
            new[1:] |= np.diff(table.column(c).to_numpy()) != 0
        return table, np.flatnonzero(new)

    held: list[pa.RecordBatch] = []
    for batch in it:
        if not len(batch):
            continue
        first = [batch.column(c)[0].as_py() for c in ("key", "i", "j")]
        if held and first != [held[-1].column(c)[-1].as_py() for c in ("key", "i", "j")]:
            yield cut(held)
            held = []
        last = int(cut([batch])[1][-1])  # the last group may go on
        if last:
            yield cut([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield cut(held)


def _forest(it: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(a, b) of (ids, labels)."""
    for ids, label in it:
        low = ids[label]
        other = low != ids
        yield pa.RecordBatch.from_arrays([pa.array(ids[other], pa.int64()), pa.array(low[other], pa.int64())], names=["a", "b"])
        pa.default_memory_pool().release_unused()


def _fits(n: np.ndarray, sig: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a pair that shares a left collection is a candidate."""
    ok = np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * SIMILARITY
    ok &= (right[a] == right[b]).any(axis=1)
    return ok & ((sig[a] == sig[b]).sum(axis=1) >= LEAST_AGREE)


def _meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the candidates of each cell (or pair of its blocks)."""

    def work() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for table, start in _whole_groups(it):
            ids, n = table.column("id").to_numpy(), table.column("n_shingles").to_numpy()
            data = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(ids), HASHES + 4 * GROUPS)
            sig, right = data[:, :HASHES], np.ascontiguousarray(data[:, HASHES:]).view("<u4")
            label = np.arange(len(ids))
            size = np.diff(np.append(start, len(ids)))
            few = np.repeat(size <= SMALL, size)
            place = np.flatnonzero(few)
            if len(place):
                begins = np.searchsorted(place, start[size <= SMALL])
                a, b = _runs(begins, len(place))
                for k in range(0, len(a), 1 << 16):
                    x, y = place[a[k : k + (1 << 16)]], place[b[k : k + (1 << 16)]]
                    ok = _fits(n, sig, right, x, y)
                    label = _merge(label, x[ok], y[ok])
            for s, m in zip(start[size > SMALL], size[size > SMALL], strict=True):
                left, front = np.arange(s, s + m), []
                while len(left):  # each against those not reached yet
                    if not front:
                        front, left = [int(left[0])], left[1:]
                    x = front.pop()
                    ok = _fits(n, sig, right, np.full(len(left), x), left)
                    label[left[ok]] = label[x]
                    front += left[ok].tolist()
                    left = left[~ok]
            yield ids, label

    return _forest(work())


def _common(row: np.ndarray, g: np.ndarray, n: int) -> np.ndarray:
    """Common shingles of every pair of n rows, as a matrix; common shingles of many rows by a matrix product."""
    out = np.zeros((n, n), np.float32)
    order = np.lexsort((row, g))
    row, g = row[order], g[order]
    start = starts_of(g)
    size = np.diff(np.append(start, len(g)))
    rare = np.repeat(size <= SMALL, size)
    a, b = _runs(starts_of(g[rare]), int(rare.sum()))
    if len(a):
        out += np.bincount(row[rare][a] * n + row[rare][b], minlength=n * n).reshape(n, n).astype(np.float32)
        out += out.T.copy()
    column = np.repeat(np.cumsum(size > SMALL) - 1, size)[~rare]
    rows = row[~rare]
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        lo, hi = np.searchsorted(column, (k, k + 2048))
        x = np.zeros((n, 2048), np.float32)
        x[rows[lo:hi], column[lo:hi] - k] = 1
        out += x @ x.T
    return out


def _link(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the pairs with 100 * |A and B| >= 75 * |A or B|, of each group (or pair of its blocks)."""

    def similar(inter: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (inter > 0) & (100 * inter >= SIMILARITY * (x + y - inter))

    def work() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for table, start in _whole_groups(it):
            ids, text = table.column("id").to_numpy(), text_column(table, "text")
            label = np.arange(len(ids))
            size = np.diff(np.append(start, len(ids)))
            group = np.repeat(np.arange(len(start)), size)
            offsets = raw(text)[1]
            length = np.add.reduceat(np.diff(offsets), start)
            lo = 0
            while lo < len(start):  # small groups many at once, up to a megabyte of text
                hi, total = lo + 1, length[lo]
                while size[lo] <= SMALL and hi < len(start) and size[hi] <= SMALL and total + length[hi] <= 1 << 20:
                    total += length[hi]
                    hi += 1
                s = int(start[lo])
                e = int(start[hi]) if hi < len(start) else len(ids)
                r, g = shingles(text.slice(s, e - s))
                have = np.bincount(r, minlength=e - s)
                if size[lo] <= SMALL:
                    own = mix(g ^ mix(group[s + r].astype(U)))
                    order = np.lexsort((r, own))
                    a, b = _runs(starts_of(own[order]), len(own))
                    pair, inter = np.unique(r[order][a] * (e - s) + r[order][b], return_counts=True)
                    a, b = pair // (e - s), pair % (e - s)
                    ok = similar(inter, have[a], have[b])
                else:
                    inter = _common(r, g, e - s).astype(np.int64)
                    a, b = np.nonzero(np.triu(similar(inter, have[:, None], have[None, :]), 1))
                    ok = np.ones(len(a), bool)
                label = _merge(label, a[ok] + s, b[ok] + s)
                lo = hi
            yield ids, label

    return _forest(work())


def _star(it: Iterator[pa.RecordBatch], near) -> Iterator[pa.RecordBatch]:
    """key, id, mask: which leaders (rows with a rank) of its cell or group each member is near; near(table, start, end,
    leader) says it for rows start to end."""
    for table, start in _whole_groups(it):
        rank, ids, key = (table.column(c).to_numpy() for c in ("rank", "id", "key"))
        mask = np.zeros(len(ids), np.int64)
        for s, e in zip(start, np.append(start[1:], len(ids)), strict=True):
            for k in s + np.flatnonzero(rank[s:e] >= 0):
                mask[s:e] |= near(table, s, e, k).astype(np.int64) << rank[k]
        member = rank < 0
        yield pa.RecordBatch.from_arrays([pa.array(x[member], pa.int64()) for x in (key, ids, mask)], names=["key", "id", "mask"])
        pa.default_memory_pool().release_unused()


def _star_cells(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def near(table: pa.Table, s: int, e: int, k: int) -> np.ndarray:
        n = table.column("n_shingles").to_numpy()[s:e]
        data = np.frombuffer(b"".join(table.column("sig").slice(s, e - s).to_pylist()), np.uint8).reshape(e - s, HASHES + 4 * GROUPS)
        right = np.ascontiguousarray(data[:, HASHES:]).view("<u4")
        return _fits(n, data[:, :HASHES], right, np.full(e - s, k - s), np.arange(e - s))

    return _star(it, near)


def _star_groups(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: dict[tuple, tuple] = {}

    def near(table: pa.Table, s: int, e: int, k: int) -> np.ndarray:
        if (id(table), s) not in kept:
            kept.clear()
            kept[id(table), s] = shingles(text_column(table, "text").slice(s, e - s))
        r, g = kept[id(table), s]
        have, own = np.bincount(r, minlength=e - s), g[r == k - s]
        place = np.searchsorted(own, g)
        place[place == len(own)] = 0
        inter = np.bincount(r[own[place] == g], minlength=e - s) if len(own) else np.zeros(e - s, np.int64)
        return (inter > 0) & (100 * inter >= SIMILARITY * (have + len(own) - inter))

    return _star(it, near)


def _blocks(n: Column) -> Column:
    return F.ceil(n).cast("int").alias("blocks")


def _block_of(blocks: str) -> Column:
    return F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")


def _each(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _connected(members: DataFrame, size: DataFrame, facts: DataFrame, star, compare, parts: int) -> DataFrame:
    """(a, b): a spanning forest, for each key of the members (key, id), of the pairs that `compare` finds near, with
    what `facts` has by id. `size` (key, blocks) has the keys to look at."""
    edges = "a bigint, b bigint"

    def dealt(rows: DataFrame, more: list[str]) -> DataFrame:
        d = rows.join(facts, "id").select("key", "i", "j", *more, *facts.columns)
        return d.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "id")

    size = checkpoint(size)
    whole = members.join(size.filter("blocks = 1").select("key"), "key").select("key", "id", F.lit(0).alias("i"), F.lit(0).alias("j"))
    if size.filter("blocks > 1").isEmpty():
        return dealt(whole, []).mapInArrow(compare, edges).distinct()
    large = checkpoint(members.join(size.filter("blocks > 1"), "key").select("key", "id", "blocks"))
    by_luck = [F.min_by("id", F.xxhash64("id", F.lit(k))) for k in range(1, LEADERS)]
    lead = large.groupBy("key").agg(F.array_distinct(F.array(F.min("id"), *by_luck)).alias("lead"), F.first("blocks").alias("blocks"))
    lead = checkpoint(lead)
    everywhere = lead.select("key", _each("blocks").alias("i"), "lead").select("key", "i", F.posexplode("lead").alias("rank", "id"))
    rows = large.select("key", _block_of("blocks").alias("i"), F.lit(-1).alias("rank"), "id").unionByName(everywhere)
    met = checkpoint(dealt(rows.withColumn("j", F.lit(0)), ["rank"]).mapInArrow(star, "key bigint, id bigint, mask bigint"))
    bit = lambda k: F.shiftright("mask", k).bitwiseAND(F.lit(1))
    many = F.array(*[F.sum(bit(k)) for k in range(LEADERS)])
    per = met.groupBy("key").agg(F.collect_set("mask").alias("masks"), many.alias("n"))  # 2 ** LEADERS masks at most
    # leaders that members have in common with the one that has most of them
    first = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.array_position("n", F.array_max("n")) - 1).cast("int"))
    widen = F.aggregate(F.flatten(F.array_repeat("masks", LEADERS)), first, lambda a, m: F.when(a.bitwiseAND(m) != 0, a.bitwiseOR(m)).otherwise(a))
    out = met.join(per.select("key", widen.alias("main")), "key").withColumn("left", F.col("mask").bitwiseAND(F.col("main")) == 0)
    rest = out.groupBy("key").agg(_blocks(F.count("*") / BLOCK).alias("all_blocks"), _blocks(F.count_if("left") / BLOCK).alias("left_blocks"))
    out = checkpoint(out.join(rest.filter("left_blocks > 0"), "key").select("key", "id", "left", "all_blocks", "left_blocks"))
    those = out.filter("left").select("key", "id", _block_of("left_blocks").alias("i"), _each("all_blocks").alias("j"))
    all_ = out.select("key", "id", _each("left_blocks").alias("i"), _block_of("all_blocks").alias("j"))
    stars = met.join(lead.select("key", "lead"), "key").select("id", F.posexplode("lead").alias("k", "b"), "mask")
    stars = stars.filter((F.call_function("shiftright", "mask", "k").bitwiseAND(F.lit(1)) == 1) & (F.col("id") != F.col("b"))).select(F.col("id").alias("a"), "b")
    pairs = whole.unionByName(those).unionByName(all_)
    return dealt(pairs, []).mapInArrow(compare, edges).unionByName(stars).distinct()


def _candidates(classes: DataFrame, parts: int) -> DataFrame:
    """(a, b): a spanning forest of the pairs that share a table's cell and agree in size and minhashes."""
    spots = classes.select("id", F.explode("sides").alias("key"))
    full = spots.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", _blocks(F.col("n") / BLOCK))
    return _connected(spots, full, classes.select("id", "n_shingles", "sig"), _star_cells, _meet, parts)


def _confirmed(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, parts: int) -> DataFrame:
    """(a, b): a spanning forest of the true links within the components of the candidates."""
    group = checkpoint(connected_components(pairs).select("id", F.col("component").alias("key")))
    per = group.join(sigs.groupBy("id").agg(F.sum("n_shingles").alias("n")), "id").groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    size = per.select("key", _blocks(F.greatest(F.col("m") / BLOCK, F.col("n") * 8 / BLOCK_BYTES)))
    # the one shuffle of the texts: those of groups, a small part, go on
    own = checkpoint(texts.select(F.col("doc_id").alias("id"), "text").join(group.select("id"), "id", "left_semi"))
    return _connected(group, size, own, _star_groups, _link, parts)


SIGNED = "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, sig binary, sides array<bigint>"


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Null, empty or wordless text: an empty set, linked with nothing. Rows that repeat a doc_id are one document (of
    different texts under one doc_id each takes part, and the doc_id's component joins theirs). A null doc_id links
    with nothing and has component_id null and kept true. Other columns take no part.
    """
    texts = doc_texts(docs).filter("doc_id is not null")
    signed = checkpoint(texts.mapInArrow(_signatures, SIGNED))
    members = signed.select("doc_id", "n_shingles", "f1", "f2")
    full = signed.filter("n_shingles > 0")
    # of equal sets (which have equal minhashes) one goes on
    classes = full.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"), F.first("sig").alias("sig"), F.first("sides").alias("sides"))
    classes = checkpoint(classes)
    sigs = classes.select("id", "n_shingles", "sig")
    same = members.filter("n_shingles > 0").join(classes.filter("n > 1").select("n_shingles", "f1", "f2", "id"), ["n_shingles", "f1", "f2"])
    same = same.select(F.col("doc_id").alias("b"), F.col("id").alias("a"))
    parts = max(parts_of(docs), 64)
    links = checkpoint(_confirmed(checkpoint(_candidates(classes, parts)), sigs, texts, parts))
    component = checkpoint(connected_components(links))
    final = same.join(component.select(F.col("id").alias("a"), "component"), "a", "left")
    final = final.select(F.col("b").alias("id"), F.coalesce("component", "a").alias("component")).unionByName(component)
    final = final.groupBy("id").agg(F.min("component").alias("component"))
    out = members.join(final, members.doc_id == final.id, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    nameless = doc_texts(docs).filter("doc_id is null").mapInArrow(_signatures, SIGNED)
    return out.unionByName(nameless.select("doc_id", "n_shingles", F.lit(None).cast("bigint").alias("component_id"), F.lit(True).alias("kept")))
