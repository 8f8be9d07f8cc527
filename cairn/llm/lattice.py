"""Embedding near-dedup by lattice hashing, without loss.

A table projects the unit vectors to eight random directions, shifts them, and decodes the result to the nearest point
of the E8 lattice: that is the vector's cell. It is also entered, as a probe, at the PROBES neighbouring lattice points
(of 240) that are next nearest. Two vectors meet in a table if they share a cell, or one's cell is a probe of the
other. Vectors that meet are compared by their cosine in double precision. With TABLES = 8 a pair at a cosine of 0.95
meets with probability 0.996 (one table: 0.5), pairs above it more surely, unrelated ones in a table with about 0.001.
The links of pairs that meet in no table are found by comparing blocks of vectors, each with each; a block has at most about
REST components and keys, and there are SPREAD blocks at least. The keys of two vectors tell whether they have met.

Equal vectors form a class first. A cell that more than BLOCK vectors enter is dealt out as pairs of blocks, so no task
holds more than two blocks, and no pair is ever emitted as a row: a task counts a vector's links (each pair at the first place
where it meets, or among the rest) and reports a spanning forest of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import U, constants, i64, mix, parts_of
from cairn.llm.components import connected_components
from cairn.session import checkpoint

COSINE, TABLES, PROBES, SCALE, BLOCK = 0.95, 8, 2, 0.85, 4096
REST, SPREAD, TILE, PAIRS = 1 << 20, 8, 1024, 1 << 15
SEED = 8


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two places of +-1, or eight of +-1/2 with an even number of minus signs."""
    two = [[a if k == i else b if k == j else 0.0 for k in range(8)] for i, j in combinations(range(8), 2) for a, b in product((1, -1), repeat=2)]
    half = [s for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array([*two, *half], float)


NEAR = minimal_vectors()


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: where rounding gives an odd one, the worst place is rounded the other way."""
    f = np.rint(x)
    off = x - f
    odd = np.flatnonzero(f.sum(axis=1).astype(np.int64) & 1)
    k = np.abs(off[odd]).argmax(axis=1)
    f[odd, k] += np.where(off[odd, k] >= 0, 1.0, -1.0)
    return f


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of the even integer points and the same shifted by one half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _key(points: np.ndarray, table: int) -> np.ndarray:
    twice = np.rint(points * 2).astype(np.int64).view(U)
    return mix((twice * constants(41, 8)).sum(axis=-1, dtype=U) + U(table + 1) * U(0x9E3779B1))


def cells(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(home keys, n by TABLES; probe keys, n by TABLES by PROBES) of unit vectors."""
    n, dim = unit.shape
    rng = np.random.default_rng([SEED, dim])
    home, probe = np.zeros((n, TABLES), U), np.zeros((n, TABLES, PROBES), U)
    for t in range(TABLES):
        x = unit @ (rng.normal(size=(dim, 8)) * SCALE) + rng.random(8) * 2
        at = decode(x)
        gain = (x - at) @ NEAR.T
        order = np.argsort(-gain, axis=1, kind="stable")[:, :PROBES]
        home[:, t] = _key(at, t)
        probe[:, t] = _key(at[:, None, :] + NEAR[order], t)
    return home, probe


def _vectors(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def _scaled(v: np.ndarray) -> np.ndarray:
    """Times a power of two, which rounds nothing, so that no square overflows."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def _unit(v: np.ndarray) -> np.ndarray:
    v = _scaled(v)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _enter(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        size = np.diff(batch.column("v").offsets.to_numpy())
        for d in np.unique(size):
            part = batch.filter(pa.array(size == d))
            home, probe = cells(_unit(_vectors(part.column("v"))))
            keys = np.concatenate([home, probe.reshape(len(part), -1)], axis=1)
            offs = pa.array(np.arange(len(part) + 1, dtype=np.int32) * keys.shape[1])
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n"), part.column("v"), pa.ListArray.from_arrays(offs, pa.array(i64(keys).ravel()))], names=["id", "n", "v", "keys"])


def _first_meeting(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether vectors with these keys meet, key of the first cell where they do); homes before probes in a table."""
    hx, hy = x[:, :TABLES], y[:, :TABLES]
    px, py = x[:, TABLES:].reshape(-1, TABLES, PROBES), y[:, TABLES:].reshape(-1, TABLES, PROBES)
    in_y, in_x = (px == hy[:, :, None]).any(axis=2), (py == hx[:, :, None]).any(axis=2)
    meets = (hx == hy) | in_y | in_x
    t = meets.argmax(axis=1)
    r = np.arange(len(t))
    # where neither shares the home, it is y's cell if x probes it, else x's
    return meets[r, t], np.where(hx[r, t] == hy[r, t], hx[r, t], np.where(in_y[r, t] & (~in_x[r, t] | (hy[r, t] < hx[r, t])), hy[r, t], hx[r, t]))


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row in double precision, by one division, so that a cosine of 0.95 between vectors of whole numbers is 0.95."""
    xy, xx, yy = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for p, q in zip(x.T, y.T, strict=True):
        xy += p * q
        xx += p * p
        yy += q * q
    return xy / np.sqrt(xx * yy)


def _links(v: np.ndarray, left: np.ndarray, right: np.ndarray, home: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (left, right) with a cosine of COSINE at least, at most PAIRS at a time; where left is right, each once.
    With `home` only those of which one is at home.

    Products of floats leave out only what is below COSINE by more than they can be wrong (rounding the components and D
    products and sums: (D + 2) / 2^24 of at most 1); those nearer to it than that are summed in double precision.
    """
    v, unit = _scaled(v), _unit(v).astype(np.float32)
    wrong = (v.shape[1] + 8) * 2.0**-22
    for s in range(0, len(left), TILE):
        rows = left[s : s + TILE]
        for u in range(s if left is right else 0, len(right), TILE):
            cols = right[u : u + TILE]
            g = (unit[rows] @ unit[cols].T).ravel()
            near = np.flatnonzero(g >= COSINE - wrong)
            for p in range(0, len(near), PAIRS):
                at = near[p : p + PAIRS]
                a, b = rows[at // len(cols)], cols[at % len(cols)]
                ok = a < b if left is right else np.ones(len(at), bool)
                if home is not None:
                    ok &= home[a] | home[b]
                close = np.flatnonzero(ok & (g[at] < COSINE + wrong))
                ok[close] = _cosine(v[a[close]], v[b[close]]) >= COSINE
                if ok.any():
                    yield a[ok], b[ok]


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the trees of a and b. Each place of root holds the first place of its tree, before and after."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, up := root[root]):
            root[:] = up


def _cell(key: int | None, i: int, j: int, ids: np.ndarray, n: np.ndarray, v: np.ndarray, keys: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(links of each vector that are counted here, smallest id it is connected with by these) within one pair of
    blocks: of a cell, or without a key those of pairs that meet in none. Rows are in order of ids."""
    home = None if key is None else (keys[:, :TABLES] == key).any(axis=1)
    left = np.flatnonzero(block == i)
    links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for a, b in _links(v, left, left if i == j else np.flatnonzero(block == j), home):
        met, where = _first_meeting(keys[a], keys[b])
        mine = ~met if key is None else met & (where == key)
        a, b = a[mine], b[mine]
        np.add.at(links, a, n[b])
        np.add.at(links, b, n[a])
        _unite(root, a, b)
    return links, ids[root]


def _compare(it: Iterator[pa.RecordBatch], rest: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, i, j, id): one group of at most two blocks at a time."""
    held: list[pa.RecordBatch] = []

    def run(table: pa.Table) -> pa.RecordBatch:
        order = {c: table.column(c).to_numpy() for c in ("key", "i", "j", "block", "id", "n")}
        size = np.diff(pa.concat_arrays(table.column("v").chunks).offsets.to_numpy())
        new = np.flatnonzero(np.append(True, (np.diff(order["key"]) != 0) | (np.diff(order["i"]) != 0) | (np.diff(order["j"]) != 0)))
        out = []
        for s, e in zip(new, np.append(new[1:], len(table)), strict=True):
            for d in np.unique(size[s:e]):  # vectors of different lengths are not compared
                at = s + np.flatnonzero(size[s:e] == d)
                if len(at) < 2:
                    continue
                part = table.take(pa.array(at))
                keys = _longs(part.column("keys"))
                key = None if rest else np.array([order["key"][s]]).view(U)[0]
                links, low = _cell(key, order["i"][s], order["j"][s], order["id"][at], order["n"][at], _vectors(part.column("v")), keys, order["block"][at])
                some = (links > 0) | (low < order["id"][at])
                out.append((order["id"][at][some], links[some], low[some]))
        cols = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "links", "low"])

    for batch in it:
        if not len(batch):
            continue
        k = [batch.column(c).to_numpy() for c in ("key", "i", "j")]
        same = np.ones(len(batch), bool)
        for c in k:
            same &= c == c[-1]
        cut = len(batch) - int(same[::-1].argmin()) if not same.all() else 0  # the last group may go on
        if cut or (held and any(held[-1].column(c)[-1].as_py() != x[0] for c, x in zip(("key", "i", "j"), k, strict=True))):
            yield run(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield run(pa.Table.from_batches(held))


def _longs(col: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays(col.chunks).flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat).view(U).reshape(-1, TABLES * (1 + PROBES))


def _met(spots: DataFrame, entered: DataFrame, parts: int, rest: bool = False) -> DataFrame:
    """(id, links, low) of spots (id, key, blocks): each key's vectors are dealt into so many blocks, all pairs of which are compared."""
    dealt = spots.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.select("id", "key", "block", other.alias("other"))
    dealt = dealt.select("id", "key", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rich = dealt.join(entered, "id").select("key", "i", "j", "block", "id", "n", "v", "keys")
    rich = rich.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    return rich.mapInArrow(lambda it: _compare(it, rest), "id bigint, links bigint, low bigint")


def near_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; nor do vectors of
    different lengths. Rows that repeat a vec_id are vectors each (their copies link). A null vec_id links with
    nothing and has component_id null and kept true. Other columns take no part.
    """
    # floats travel as they are, in half the room; cosines are of doubles either way
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    v = F.col("embedding").cast(kind)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))
    fine = (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    fine = F.coalesce(fine & F.col("vec_id").isNotNull(), F.lit(False))
    rows = rows.withColumn("fine", fine).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    classes = rows.filter("fine").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("v").alias("v"))
    entered = checkpoint(classes.select("id", "n", "v").mapInArrow(_enter, f"id bigint, n bigint, v {kind}, keys array<bigint>"))
    spots = entered.select("id", F.posexplode("keys").alias("pos", "key")).select("id", "key", (F.col("pos") < TABLES).alias("home"))
    spots = spots.groupBy("key", "id").agg(F.max("home").alias("home"))
    full = spots.groupBy("key").agg(F.count("*").alias("n"), F.max("home").alias("any_home")).filter("n > 1 and any_home")
    spots = spots.join(full.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "key")
    size = entered.agg(F.sum(F.size("v") + F.size("keys"))).first()[0] or 0
    all_of_them = entered.select("id", F.lit(0).cast("bigint").alias("key"), F.lit(max(SPREAD, -(-size // REST))).alias("blocks")).distinct()
    parts = max(parts_of(vectors), 64)
    found = checkpoint(_met(spots, entered, parts).unionByName(_met(all_of_them, entered, parts, rest=True)))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    component = connected_components(found.filter("low < id").select(F.col("id").alias("a"), F.col("low").alias("b")))
    facts = classes.select("h1", "h2", "id", "n").join(links, "id", "left").join(component, "id", "left")
    facts = facts.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = rows.filter("fine").join(facts, ["h1", "h2"]).select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.filter("not fine").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
