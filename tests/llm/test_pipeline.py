import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as p
from cairn.llm import fm_decontam
from test_dedup import near_truth, removed_truth
from test_text import check_packing

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    """Every stage against a plain version of it on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for k, (name, stage) in enumerate(p.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        if k == 4:
            assert check_packing(sorted(before.items()), out.collect()) < 0.01
            break
        assert out.columns == p.COLUMNS, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.count() == len(after) > 0
        if k == 0:
            known = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            clean = [i for i, r in known.items() if r.quality == 1 and not r.toxic]
            assert sum(i in after for i in clean) >= 0.95 * len(clean)
        if k == 1:
            truth = near_truth(before.items())
            assert set(after) == {i for i, c in truth.items() if i == c}
        if k == 2:
            assert after == {i: kept.decode("utf-8", "ignore") for i, _, kept in removed_truth(before.items())}
        if k == 3:
            left = fm_decontam.find(docs, bench)
            hit = {r.doc_id: r.n_hit for r in fm_decontam.find(spark.createDataFrame(list(before.items()), "doc_id bigint, text string"), bench).collect()}
            assert all(before[i] == after[i] for i in after if not hit[i])
            words = lambda t: len(re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower()))
            assert all(words(after[i]) == words(before[i]) - hit[i] for i in after)
            assert left.agg(F.sum("n_words")).first()[0] > 0


def order_of(spark, rows):
    """As remove_repeats orders rows of one doc_id, by a hash of the text."""
    df = spark.createDataFrame([(i, r.doc_id, r.text or "") for i, r in enumerate(rows)], "k int, doc_id bigint, text string")
    tie = df.select("k", F.hash(F.xxhash64("text").cast("string")).alias("h")).collect()
    h = {r.k: r.h for r in tie}
    return sorted(range(len(rows)), key=lambda k: (rows[k].doc_id is not None, rows[k].doc_id or 0, h[k], rows[k].text or ""))


def test_every_row_counts(spark, odd, tmp_path):
    """Null doc_ids, and different texts under one doc_id, through all stages, each against a plain version of it."""
    words = [f"w{i * 7919 % 1000}" for i in range(400)]
    text = lambda a, b: " ".join(words[a:b])
    more = [(None, text(0, 60)), (None, text(100, 160)), (None, text(100, 159)), (50, text(200, 260)), (50, text(300, 360)), (50, text(300, 361)), (51, text(0, 60) + " z"), (52, text(200, 260))]
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(2).collect()]
    more += [(None, f"before {bench[0]} after"), (53, f"one {bench[0]} two"), (53, f"three {bench[1]} four"), (54, None), (None, "")]
    extra = spark.createDataFrame([(i, t, f"l{k}", "s", 7) for k, (i, t) in enumerate(more)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = odd.select(*p.COLUMNS).unionByName(extra)
    for k, (name, stage) in enumerate(p.STAGES):
        before = docs.collect()
        out = stage(spark, docs, SF)
        if k == 4:
            assert check_packing([(r.doc_id, r.text) for r in before], out.collect(), False) < 0.01
            assert sorted((r.doc_id or 0) for r in out.filter("start = 0").collect()) == sorted((r.doc_id or 0) for r in before)
            break
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = docs.collect()
        assert docs.columns == p.COLUMNS
        key = lambda r: tuple((x is not None, x) for x in r)
        plain = lambda rows: sorted(map(key, rows))
        if k == 0:
            left = Counter(map(key, after))
            left.subtract(Counter(map(key, before)))
            assert max(left.values()) == 0 and after
            docs = spark.createDataFrame(before, docs.schema)  # all go on to the other stages, whatever the labels say
        if k == 1:
            group = near_truth([(i, r.text) for i, r in enumerate(before) if r.doc_id != 9]) | {i: i for i, r in enumerate(before) if r.doc_id == 9}
            first = {}
            for i, r in enumerate(before):
                first[group[i]] = min(first.get(group[i], (True, 1 << 62)), (r.doc_id is None, r.doc_id or 0))
            assert sorted(first.values()) == sorted((r.doc_id is None, r.doc_id or 0) for r in after)
            assert not Counter(map(key, after)) - Counter(map(key, before))
        if k == 2:
            at = order_of(spark, before)
            kept = [x for *_, x in removed_truth([(n, before[i].text) for n, i in enumerate(at)])]
            want = []
            for i, x in zip(at, kept, strict=True):
                r, new = before[i], x.decode("utf-8", "ignore")
                same = new == (r.text or "")
                want.append((r.doc_id, r.text if same else new, r.lang, r.source, r.n_chars if same else len(new)))
            assert plain(after) == plain(want)
        if k == 3:
            assert [(r.doc_id, r.lang) for r in sorted(after, key=key)] and len(after) == len(before)
            assert Counter((r.doc_id, r.lang) for r in after) == Counter((r.doc_id, r.lang) for r in before)
            cut = {r.text for r in after if r.doc_id == 53}
            assert cut == {"one  two", "three  four"} or all("one" in t or "three" in t for t in cut) and len(cut) == 2
            hits = {r.n_hit for r in fm_decontam.find(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert hits == {0}
    none = odd.select(*p.COLUMNS).limit(0)
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, none, SF).count() == 0


def test_run(spark):
    assert p.run(spark, SF).count() > 0
