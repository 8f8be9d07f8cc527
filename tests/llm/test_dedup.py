import re
from hashlib import sha256
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import lattice, minhash, radix_dedup
from cairn.llm.components import connected_components
from cairn.llm.entry import op3_embedding_dedup, op5_substring_dedup

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_truth(rows):
    """By comparing all pairs."""
    s = [(i, shingle_set(t)) for i, t in rows if i is not None]
    links = [(i, j) for x, (i, a) in enumerate(s) for j, b in s[:x] if a and b and 100 * len(a & b) >= 75 * len(a | b)]
    return components({i for i, _ in s}, links)


def removed_truth(rows):
    """(kept bytes) per row in order of (doc_id, text)."""
    seen, out = set(), []
    for i, x in sorted(((i if i is not None else -(1 << 63)), (t or "").encode()) for i, t in rows):
        cover = bytearray(len(x))
        for p in range(len(x) - 99):
            w = x[p : p + 100]
            if w in seen:
                cover[p : p + 100] = b"\1" * 100
            seen.add(w)
        out.append((i, len(x), bytes(c for c, m in zip(x, cover, strict=True) if not m)))
    return out


def test_minhash_documents(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    truth = near_truth(rows)
    assert {i: r.component_id for i, r in got.items()} == truth
    assert all(r.n_shingles == len(shingle_set(t)) for i, t in rows for r in [got[i]])
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_minhash_odd(odd, odd_rows, none):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows)
    truth = near_truth([r for r in odd_rows if r[0] != 9]) | {9: 9}
    assert all(r.component_id == truth[r.doc_id] for r in got if r.doc_id is not None)
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert {r.n_shingles for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert minhash.near_duplicates(none).count() == 0


def test_minhash_group(spark):
    """One original and many edited copies, which reach each other through it and each other."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        w = list(base)
        for k in rng.integers(0, 200, rng.integers(1, 9)):
            w[k] = f"e{i}_{k}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == near_truth(rows)


def test_minhash_least_agreement():
    """The expected loss over 1e9 links at the threshold is below one."""
    p = minhash.SIMILARITY / 100
    lost = sum(comb(minhash.HASHES, k) * p**k * (1 - p) ** (minhash.HASHES - k) for k in range(minhash.LEAST_AGREE))
    assert lost * 1e9 < 1


def test_minhash_siblings(spark, monkeypatch):
    """A large group whose members are just below the threshold to each other; each has one true partner."""
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(400)]

    def edited(words, n, tag):
        w = list(words)
        for k in rng.choice(len(w) // 5, n, replace=False):
            w[5 * k + 2] = f"{tag}_{k}"
        return w

    rows = []
    for i in range(300):
        one = edited(base, 8, f"s{i}")
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(edited(one, 11, f"p{i}")))]
    truth = near_truth(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()} == truth
    monkeypatch.setattr(minhash, "BLOCK", 70)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()} == truth


def test_minhash_large_groups(spark, monkeypatch):
    """Groups of several blocks: copies of one text, of two texts that only some copies connect, and long ones."""
    rng = np.random.default_rng(11)

    def edited(words, n, tag):
        w = list(words)
        for k in rng.choice(len(w), n, replace=False):
            w[k] = f"{tag}_{k}"
        return " ".join(w)

    base = [f"w{i}" for i in range(150)]
    other = [f"v{i}" if i < 5 else x for i, x in enumerate(base)]  # each of its copies is near some of the first
    rows = [(i, edited(base, int(rng.integers(0, 4)), f"a{i}")) for i in range(90)]
    rows += [(100 + i, edited(other, int(rng.integers(0, 5)), f"b{i}")) for i in range(90)]
    rows += [(200 + i, edited([f"z{k % 40}" for k in range(160)], int(rng.integers(0, 9)), f"c{i}")) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    truth = near_truth(rows)
    monkeypatch.setattr(minhash, "BLOCK", 25)
    seen = []
    star = minhash._connected
    monkeypatch.setattr(minhash, "_connected", lambda m, size, *a: seen.append(size.filter("blocks > 1").count()) or star(m, size, *a))
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()} == truth
    assert len(seen) == 2 and all(seen) and len(set(truth.values())) < 100


def test_substrings_documents(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in op5_substring_dedup(spark, "/root/testdata/sf0.001").collect()}
    for i, n, kept in removed_truth(rows):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (n, n - len(kept), sha256(kept).hexdigest())
        assert (r.n_spans > 0) == (r.n_removed > 0)


def test_substrings_odd(odd, odd_rows, none):
    got = radix_dedup.remove_repeats(odd).collect()
    found = sorted((r.doc_id if r.doc_id is not None else -(1 << 63), r.n_bytes, bytes(r.kept)) for r in got)
    assert found == sorted(removed_truth(odd_rows))
    assert radix_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize(("hot", "hash_bits"), [(1 << 14, 6), (2, 64), (1, 5), (0, 64)])
def test_substrings_whatever_the_plan(spark, odd, odd_rows, hot, hash_bits):
    """Few-bit hashes, so that different cores meet, and a bound on a task's strings that sends most of them on to the
    next digits, leave the result as it is."""
    rng = np.random.default_rng(9)
    letters = np.frombuffer(b"abcd", np.uint8)
    text = lambda n: letters[rng.integers(0, 4, n)].tobytes().decode()
    line, passage = text(70), text(300)
    rows = [(i, text(int(rng.integers(0, 200))) + line + text(int(rng.integers(1, 120)))) for i in range(60)]
    rows += [(i, text(150) + passage[int(rng.integers(0, 40)) : 300 - int(rng.integers(0, 40))] + text(90)) for i in range(60, 90)]
    rows += [(i, passage) for i in range(90, 95)] + [(95, line * 9), (96, text(400)), (97, "z" * 350), (None, passage[50:250])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for some, frame in ((rows, df), (odd_rows, odd)) if hot == 1 else ((rows, df),):
        got = radix_dedup.remove_repeats(frame, hot=hot, hash_bits=hash_bits).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -(1 << 63), r.n_bytes, bytes(r.kept)) for r in got) == sorted(removed_truth(some))
        assert all(r.n_bytes == len(r.kept) + sum(s.end - s.start for s in r.spans) for r in got)


def test_substrings_carry(spark, odd):
    got = radix_dedup.remove_repeats(odd, ["lang", "kind", "doc_id", "text"]).collect()
    assert sorted(map(str, odd.select("lang", "kind", "doc_id", "text").collect())) == sorted(str(r.more) for r in got)
    assert all(r.more.doc_id == r.doc_id and len((r.more.text or "").encode()) == r.n_bytes for r in got)


def test_substrings_pieces(spark):
    """Repeats across the pieces in which long texts are hashed, at every distance from their borders."""
    rng = np.random.default_rng(5)
    letters = np.frombuffer(b"abcdefgh", np.uint8)
    text = lambda n: letters[rng.integers(0, 8, n)].tobytes().decode()
    a, c = text(700_000), text(150)
    rows = [(1, a), (2, text(60) + a[262_000:262_400] + text(40)), (3, a[:99]), (4, a[:100]), (5, c + "z" + c), (6, c[:99] + "y" + c[50:]), (7, "ab" * 300)]
    got = {r.doc_id: bytes(r.kept) for r in radix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: k for i, _, k in removed_truth(rows)}


def vector_truth(vectors):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(unit)
    m = np.stack([unit[i] for i in ids])
    g = m @ m.T >= 0.95
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(g), strict=True) if a > b]
    comp = components([i for i, _ in vectors], links)
    n = dict(zip(ids, (g.sum(axis=1) - 1).tolist(), strict=True))
    return {i: (n.get(i, 0), comp[i]) for i, _ in vectors}


def test_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in op3_embedding_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert got == vector_truth(rows)


def test_vectors_recall_and_groups(spark, monkeypatch):
    """Pairs just above the threshold are found in at least 0.97 of cases, with cells dealt out in small blocks too."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        x = rng.normal(size=64)
        x /= np.linalg.norm(x)
        z = rng.normal(size=64)
        z -= z @ x * x
        z /= np.linalg.norm(z)
        rows += [(2 * i, x.tolist()), (2 * i + 1, (0.951 * x + np.sqrt(1 - 0.951**2) * z).tolist())]
    center = rng.normal(size=64)
    rows += [(1000 + i, (center + rng.normal(size=64) * 0.02).tolist()) for i in range(150)]
    truth = vector_truth(rows)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(lattice, "BLOCK", 40)
    got = {r.vec_id: r.n_links for r in lattice.near_vectors(df).collect()}
    assert sum(got.values()) >= 0.97 * sum(n for n, _ in truth.values())
    assert all(got[i] <= truth[i][0] for i in got)
    assert all(got[i] == truth[i][0] for i in range(1000, 1150))


def test_vectors_lose_no_link(spark, monkeypatch):
    """Pairs just above the threshold in many numbers: all are found, those that share no cell too."""
    rng = np.random.default_rng(1)
    x, z = rng.normal(size=(2, 4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.9501 * x + np.sqrt(1 - 0.9501**2) * z
    rows = [(2 * i + k, v.tolist()) for i in range(4000) for k, v in enumerate((x[i], y[i]))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    truth = vector_truth(rows)
    home, probe = lattice.cells(np.concatenate([x, y]))
    hx, hy, px, py = home[:4000, :, None], home[4000:, :, None], probe[:4000], probe[4000:]
    meet = ((hx == hy) | (px == hy) | (py == hx)).any(axis=(1, 2))
    assert 3900 < meet.sum() < 4000
    monkeypatch.setattr(lattice, "REST", 64_000, raising=False)
    assert {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_vectors(df).collect()} == truth


def test_vectors_middle(spark):
    """Vectors that only a third one with a higher vec_id connects; of two links both must count."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(200):
        x, z = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
        rows += [(3 * i + k, (np.cos(t) * x + np.sin(t) * z).tolist()) for k, t in enumerate((-0.2, 0.2, 0.0))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert got == vector_truth(rows) and all(got[3 * i + 1] == (1, 3 * i) for i in range(200))


def test_vectors_at_the_threshold(spark):
    """A cosine of 0.95 in double precision is a link, whatever the length of the vectors; a little less is none."""
    pairs = [([1, 0, 0, 0, 0], [19, 6, 1, 1, 1]), ([-6, -6, -3, 0, 0], [-75, -153, -57, 6, 9]), ([-6, -5, -4, -2, 0], [-78, -133, -89, -25, 9]), ([-6, -3, -2, 0, 0], [-94, -95, -41, 3, 7])]
    rows = [(2 * k + i, [0.0] * (5 * k) + [float(c) for c in v] + [0.0] * (15 - 5 * k)) for k, pair in enumerate(pairs) for i, v in enumerate(pair)]
    more = [(100, [1.0, 0.0, 0.0, 0.0, 0.0]), (101, [19.0, 6.0, 1.0, 1.0, 1.0 + 1e-12]), (102, [5e150, 0.0, 0.0, 0.0, 0.0]), (103, [1e-160, 0.0, 0.0, 0.0, 0.0])]
    got = {r.vec_id: r.n_links for r in lattice.near_vectors(spark.createDataFrame(rows + more, "vec_id bigint, embedding array<double>")).collect()}
    assert got == {i: {100: 2, 101: 0, 102: 2, 103: 2}.get(i, 1) for i, _ in rows + more}
    got = lattice.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert {r.n_links for r in got} == {1} and all(r.component_id == r.vec_id // 2 * 2 for r in got)


def test_vectors_odd(spark):
    nan, inf = float("nan"), float("inf")
    a, b = [1.0] + [0.0] * 7, [1.0, 1e-9] + [0.0] * 6
    rows = [(1, a), (2, a), (2, a), (3, b), (4, None), (5, []), (6, [0.0] * 8), (7, [nan] * 8), (8, [inf] + a[1:]), (9, [None] + a[1:]), (10, a[:4]), (None, a), (11, [1e200] + a[1:]), (12, [-1.0] + a[1:])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").select("*", *[F.lit(1).alias(c) for c in ("id", "n", "v", "key", "keys", "h1", "label")])
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id) for r in lattice.near_vectors(df).collect())
    want = [(0, 0, None), (1, 4, 1), (2, 4, 1), (2, 4, 1), (3, 4, 1), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 0, 10), (11, 4, 1), (12, 0, 12)]
    assert got == want
    assert lattice.near_vectors(df.limit(0)).count() == 0


def test_lattice_points():
    assert lattice.NEAR.shape == (240, 8) and np.allclose((lattice.NEAR**2).sum(axis=1), 2)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 8)) * 2
    at = lattice.decode(x)
    other = at[:, None, :] + lattice.NEAR
    assert (((x - at) ** 2).sum(axis=1)[:, None] <= ((x[:, None, :] - other) ** 2).sum(axis=2) + 1e-9).all()


@pytest.mark.parametrize("edges", [[], [(3, 3)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(9, 4), (4, 9), (7, 9), (2, 1)]])
def test_components(spark, edges):
    got = dict(connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == components({x for e in edges for x in e}, edges)
