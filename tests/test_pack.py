import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import order, pack

FILES = "walk_id bigint, path string, size bigint, hash string"


@pytest.mark.parametrize("part_rows", [1_000, 37])
@pytest.mark.parametrize("fast_lane", [True, False])
def test_against_scalar(spark, part_rows, fast_lane):
    rng = random.Random(5)
    exts = ["txt", "jpg", "rs", "gz", ""]
    for cap in (10, 64, 500, 100_000):
        rows = [(i, f"d{rng.randrange(5)}/f{i // 3}.{rng.choice(exts)}", rng.choice([1, 3, 9, 10, 11, 40, 64, 65]), f"h{i}") for i in range(400)]
        df = pack.survivors(spark.createDataFrame(rows, FILES))
        got = {r.walk_id: (r.block, r.offset) for r in pack.assign_blocks(df, cap, fast_lane, part_rows).collect()}
        ordered = df.orderBy(*pack.order()).collect()
        want = pack.pack_scalar([(r.lane if fast_lane else 0, r["size"]) for r in ordered], cap)
        assert got == {r.walk_id: w for r, w in zip(ordered, want, strict=True)}


def test_empty_and_copies(spark):
    rows = [(0, "a.txt", 0, "e"), (1, "b.txt", 0, "e"), (2, "c.txt", 5, "x"), (3, "d.jpg", 5, "x")]
    files = spark.createDataFrame(rows, FILES)
    a = pack.assign_blocks(pack.survivors(files), 100)
    seg = {r.path: [tuple(s) for s in r.segments] for r in pack.attach_segments(files, a).collect()}
    assert seg == {"a.txt": [], "b.txt": [], "c.txt": [(0, 0, 5)], "d.jpg": [(0, 0, 5)]}
    none = spark.createDataFrame([], FILES)
    assert pack.assign_blocks(pack.survivors(none), 100).count() == 0


def test_one_path_many_files(spark):
    """Files that share a path keep their own bytes and places, in walk order."""
    files = spark.createDataFrame([(7, "x/a", 3, "p"), (5, "x/a", 4, "q"), (6, "x/a", 4, "q")], FILES)
    seg = {r.walk_id: [tuple(s) for s in r.segments] for r in pack.attach_segments(files, pack.assign_blocks(pack.survivors(files), 100)).collect()}
    assert seg == {5: [(0, 0, 4)], 6: [(0, 0, 4)], 7: [(0, 4, 3)]}


def test_pieces(spark):
    """A file above max_piece has a segment for each piece, in order; a copy inherits them."""
    files = spark.createDataFrame([(1, "a", 25, "p"), (2, "b", 4, "q"), (3, "c", 25, "p")], FILES)
    a = pack.assign_blocks(pack.survivors(files, max_piece=10), 10)
    seg = {r.walk_id: [tuple(s) for s in r.segments] for r in pack.attach_segments(files, a).collect()}
    assert seg == {1: [(0, 0, 10), (1, 0, 10), (2, 0, 5)], 2: [(2, 5, 4)], 3: [(0, 0, 10), (1, 0, 10), (2, 0, 5)]}


def test_copy_counts(spark):
    from cairn.operators.reports import dedup_counts

    files = spark.createDataFrame([(i, f"copy{i}.bin", 200_000, "h") for i in range(5)], FILES)
    assert tuple(dedup_counts(pack.first_copies(files)).first()) == (4, 800_000)


def test_ranks_and_changes(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(4)) for i in rng.sample(range(10_000), 999)]
    df = spark.createDataFrame(rows, "k bigint, v bigint").repartition(7)
    got = sorted((r.place, r.k) for r in order.with_rank(df, [F.desc("k")], "place").collect())
    assert got == [(i + 1, k) for i, (k, _) in enumerate(sorted(rows, reverse=True))]
    v = [x for _, x in sorted(rows)]
    assert tuple(order.changes(df, ["k"], "v").first()) == (999, 1 + sum(a != b for a, b in zip(v, v[1:], strict=False)))
    assert tuple(order.changes(df.limit(0), ["k"], "v").first()) == (0, 0)
