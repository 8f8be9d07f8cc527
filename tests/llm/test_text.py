import re
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm import fm_decontam, importance, langid, license, maglev, packing, wordpiece
from cairn.llm.common import ngrams, raw, word_hashes
from cairn.llm.entry import op4_sharding, op6_packing, op7_token_counts, op9_decontamination

SF = "/root/testdata/sf0.001"
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def ids_of(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [0] for e in t.encode_batch(texts, add_special_tokens=False)]


def check_packing(rows, pieces, unique=True):
    """Every id in one piece, pieces gapless in sequences of at most 1024, little padding."""
    ids = ids_of([t or "" for _, t in rows])
    if unique:
        by = defaultdict(list)
        for p in pieces:
            by[p.doc_id].append(p)
        for (doc, _), x in zip(rows, ids, strict=True):
            at = 0
            for p in sorted(by[doc], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(x)
                assert p.ids_crc32 == crc32(np.array(x[at : at + p.length], "<u4").tobytes())
                at += p.length
            assert at == len(x)
    assert sum(p.length for p in pieces) == sum(map(len, ids))
    seq = defaultdict(list)
    for p in pieces:
        seq[p.sequence_id].append(p)
    padding = 0
    for s in seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding / max(1, sum(map(len, ids)))


def test_packing(spark, docs, odd, odd_rows, none):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert check_packing(rows, op6_packing(spark, SF).collect()) < 0.01
    path, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert check_packing(odd_rows, packing.pack(odd, path, ranks, public_tokenizers.PATTERN).collect(), False) < 0.01
    assert check_packing(odd_rows, packing.pack(odd, path).collect(), False) < 0.01
    assert packing.pack(none, path).count() == 0


@settings(deadline=None)
@given(st.text(max_size=60) | st.sampled_from(["<|endoftext|> x", "a\x85b", "\x1c\x1d a", "don't  stop\n\n x", "é ǅ ɐ 漢"]))
def test_both_engines(text):
    assert engine()(text).tolist() == ids_of([text])[0]


def engine():
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.load(path, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, packing.special_tokens(path))


def test_engines_on_all_usual_characters():
    """Each character that the faster engine is given, beside letters, digits, spaces, quotes, line ends and itself."""
    encode = engine()
    usual = [chr(i) for i in range(0x250) if not encode.unusual.search(chr(i))]
    texts = [f"a{c}b {c}{c}{c} {c}1'{c}s\n{c} \t{c}' {c}\n\n  {c}A{d}{c}" for i, c in enumerate(usual) for d in (usual[i - 7], usual[i // 2])]
    assert len(usual) > 500 and not any(encode.unusual.search(t) for t in texts)
    assert [encode(t).tolist() for t in texts] == ids_of(texts)


def test_special_tokens():
    """Their strings in a text are the tokens, as the tokenizer has it by default."""
    assert packing.special_tokens(public_tokenizers.path("byte_bpe_50k.json")) == ("<|endoftext|>",)
    assert engine()("a <|endoftext|> b").tolist() == [64, 220, 50256, 275, 0]


@settings(deadline=None)
@given(st.lists(st.integers(1, 3000), max_size=40))
def test_packer(lengths):
    p = packing.Packer(1)
    for i, n in enumerate(lengths):
        p.add(i, np.arange(n, dtype="<u4"))
    p.finish()
    assert sum(r[2] for r in p.rows) == sum(lengths)
    seq = defaultdict(int)
    for r in p.rows:
        seq[r[5]] += r[2]
    assert max(seq.values(), default=0) <= 1024


def test_token_counts(spark, docs, odd, none):
    import regex

    vocabulary = set(wordpiece.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    known = {}

    def truth(text):
        words = [w.encode() for w in regex.findall(public_tokenizers.PATTERN, text or "")]
        return len(words), sum(known[w] if w in known else known.setdefault(w, wordpiece.greedy(vocabulary, w)) for w in words)

    got = {r.doc_id: (r.n_words, r.n_tokens) for r in op7_token_counts(spark, SF).collect()}
    assert got == {r.doc_id: truth(r.text) for r in docs.collect()}
    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    kept = odd.filter("doc_id is null or doc_id not in (9, 13)")
    found = sorted((r.doc_id or 0, r.n_words, r.n_tokens) for r in wordpiece.count_tokens(kept, *args).collect())
    assert found == sorted((r.doc_id or 0, *truth(r.text)) for r in kept.collect())
    assert wordpiece.count_tokens(odd, *args).count() == odd.count() and wordpiece.count_tokens(none, *args).count() == 0


word = st.text("abc", min_size=1, max_size=5).map(str.encode)


@settings(deadline=None)
@given(st.sets(word, max_size=12), st.none() | st.sets(word, max_size=12), st.text("abc", max_size=14).map(str.encode))
def test_automaton(tokens, inner, w):
    assert wordpiece.Automaton(tokens, inner).count(w) == wordpiece.greedy(tokens, w, inner)


def hits_truth(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(i)
    sizes = {len(w) for w in windows}
    out = []
    for doc, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[x]
        out.append((doc, len(w), len(hit), len(found), sha256(",".join(sorted(map(str, found))).encode()).hexdigest()))
    return out


ITEMS = [(1, "lorem ipsum dolor"), (2, "Two words"), (3, None), (4, ""), (5, "!!"), (6, "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod"), (7, "漢字 ÉÀ"), (8, "two words"), (9, "labore lorem"), (10, "ab ab ab")]


@pytest.mark.parametrize("block_words", [1 << 20, 12, 1])
def test_decontamination(spark, docs, odd, odd_rows, none, block_words):
    if block_words > 1000:
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
        got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in op9_decontamination(spark, SF).collect())
        assert got == sorted(hits_truth(rows, items)) and any(r[2] for r in got)
    extra = [(20, "ab ab ab ab x ab ab ab"), (21, "ab ab"), (22, "lorem ipsum dolor lorem ipsum dolor")]
    more = odd.select("doc_id", "text", "kind").unionByName(spark.createDataFrame([(*r, "") for r in extra], "doc_id bigint, text string, kind string"))
    bench = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id bigint, text string, doc_id string")
    found = fm_decontam.find(more, bench, block_words=block_words).collect()
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, len(r["items"]), sha256(",".join(sorted(map(str, r["items"]))).encode()).hexdigest()) for r in found)
    assert got == sorted((d or 0, *x) for d, *x in hits_truth(odd_rows + extra, ITEMS))
    texts = dict(odd_rows + extra)
    for r in found:
        if r.doc_id in (4, 20, 22):
            cut = " ".join(texts[r.doc_id].encode()[s.start : s.end].decode() for s in r.spans)
            assert len(re.findall(r"\w+", cut)) == r.n_hit == sum(s.last - s.first + 1 for s in r.spans)
    assert len(fm_decontam._blocks(bench, block_words)[0]) == {1 << 20: 1, 12: 2, 1: 7}[block_words]
    assert fm_decontam.find(none, bench).count() == 0
    assert {r.n_hit for r in fm_decontam.find(odd, bench.limit(0)).collect()} == {0}


@settings(deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.integers(1, 3), min_size=1, max_size=4))
def test_fm_index(symbols, phrase):
    s = np.array([*symbols, 0], np.int64)
    index = fm_decontam.FMIndex(s, 3)
    lo, hi = index.count(np.array(phrase), np.array([0]), np.array([len(phrase)]))
    want = [i for i in range(len(s)) if s[i : i + len(phrase)].tolist() == phrase]
    assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


def test_long_items(spark, monkeypatch):
    """An item that comes in pieces has all its windows."""
    rng = np.random.default_rng(8)
    item = [f"w{i}" for i in rng.integers(0, 500, 200)]
    rows = [(i, " ".join(["x", *item[k : k + n], "y"])) for i, (k, n) in enumerate(zip(rng.integers(0, 180, 60).tolist(), rng.integers(8, 30, 60).tolist(), strict=True))]
    items = [(1, " ".join(item)), (2, " ".join(item[:9])), (3, " ".join(item[20:50]))]
    monkeypatch.setattr(fm_decontam, "PIECE_WORDS", 7)
    got = list(fm_decontam._item_words(iter([pa.RecordBatch.from_pylist([{"item_id": i, "text": t} for i, t in items])])))[0].to_pylist()
    blocks = [fm_decontam.Phrases([r["item_id"] for r in got], [np.frombuffer(r["words"], np.uint64) for r in got])]
    assert len(got) == 28 + 1 + 3 and len(blocks[0].start) == 191 + 1 + 21
    df, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    found = sorted((r.doc_id, r.n_words, r.n_hit, len(r["items"]), sha256(",".join(sorted(map(str, r["items"]))).encode()).hexdigest()) for r in fm_decontam.find(df, bench, block_words=40).collect())
    assert found == sorted(hits_truth(rows, items)) and any(r[2] for r in found)


def test_language_filters(docs):
    """The filters against plain sets: no n-gram of a language is missing, the others appear about as often as is
    taken off, and the corrected counts come near the plain ones."""
    docs = docs.sparkSession.read.parquet("/root/testdata/sf0.01/documents.parquet")

    def plain(text):
        b = [c if 97 <= c <= 122 or c >= 128 else 32 for c in f" {text.lower()} ".encode()]
        return [bytes(b[i : i + 4]) for i in range(len(b) - 3) if b[i + 1] != 32 and b[i + 2] != 32]

    rows = [r for r in docs.collect() if r.lang is not None]
    count = defaultdict(lambda: defaultdict(int))
    for r in rows:
        if not langid.is_held_out(r.doc_id):
            for g in plain(r.text):
                count[r.lang][g] += 1
    total = {k: sum(n for n in c.values() if n >= langid.LEAST) for k, c in count.items()}
    rate = {k: {g: n / total[k] for g, n in c.items() if n >= langid.LEAST} for k, c in count.items()}
    top = defaultdict(float)
    for c in rate.values():
        for g, x in c.items():
            top[g] = max(top[g], x)
    sets = {k: {g for g, x in c.items() if x >= langid.SHARE * top[g]} for k, c in rate.items()}
    filters = langid.train(docs)
    assert filters.langs == sorted(sets)
    agree, n_out = 0, 0
    for r in rows:
        if not langid.is_held_out(r.doc_id):
            continue
        grams = plain(r.text)
        row, g = langid.grams(pa.array([r.text], pa.large_string()))
        assert [bytes(x) for x in g.astype(">u4").view(np.uint8).reshape(-1, 4)] == grams and not row.any()
        hit = filters.table[(at := langid._rows(g))[0]]
        for a in at[1:]:
            hit = hit & filters.table[a]
        real = []
        for i, lang in enumerate(filters.langs):
            inside = np.array([x in sets[lang] for x in grams], bool)
            bit = (hit[:, 0] >> np.uint64(i) & np.uint64(1)).astype(bool)
            assert bit[inside].all()
            real.append(inside.sum())
            assert bit[~inside].sum() <= 2 * filters.false[i] * (~inside).sum() + 6 * np.sqrt(len(grams)) * filters.false[i] + 12
        if grams and max(real) > 0:
            n_out += 1
            agree += filters.predict(pa.array([r.text], pa.large_string()))[0][0] in [k for k, v in zip(filters.langs, real, strict=True) if v == max(real)]
    assert n_out > 100 and agree >= 0.99 * n_out


@pytest.mark.parametrize(("text", "letters"), [("½ ② ²", False), ("٣ 五", True), ("ª", True), ("12-3_4", False), ("́̂", False), ("ʰ", True)])
def test_language_letters(text, letters):
    assert bool(langid._LETTER.search(text)) == letters == any(c.isalpha() for c in text)


def test_language(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.identify(docs).collect()
    out = [r for r in got if r.held_out]
    assert {r.doc_id for r in out} == {i for i in lang if langid.is_held_out(i)}
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in langid.identify(odd).collect()} == {"und"}
    both = docs.select("doc_id", "text", "lang").unionByName(odd.select((F.col("doc_id") + 100_000).alias("doc_id"), "text", "lang"))
    pred = {r.doc_id: r for r in langid.identify(both).collect() if r.doc_id is None or r.doc_id > 100_000}
    assert all(pred[100_000 + i].lang_pred == "und" and pred[100_000 + i].score == 0 for i in (1, 2, 3, 10))
    assert pred[100_004].lang_pred in set(lang.values())
    assert langid.identify(none).count() == 0


def test_quality(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in importance.score(docs, labels).collect()}
    known = labels.collect()
    clean = [r.doc_id for r in known if r.quality == 1 and not r.toxic]
    bad = [r.doc_id for r in known if r.quality == 0]
    assert sum(got[i].kept for i in clean) >= 0.98 * len(clean)
    assert sum(not got[i].kept for i in bad) >= 0.75 * len(bad)
    rows = importance.score(odd, labels).collect()
    assert len(rows) == odd.count() and all(r.log_ratio == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert all(r.kept for r in importance.score(odd, labels.limit(0)).collect())
    nulls = spark.createDataFrame([(None, 1, 0), (4, None, None), (4, 1, None), (4, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert importance.score(odd, nulls).count() == odd.count()
    assert importance.score(none, labels).count() == 0


def test_quality_by_definition(spark, docs):
    """Ratios, keys and what is kept, from tokens, counts and quantiles made in plain Python."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    sample = {r.doc_id: r for r in importance.labelled_sample(labels).collect()}
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    hashes = {}

    def number(token):
        if token not in hashes:
            hashes[token] = word_hashes(*raw(pa.array([token], pa.large_binary())), np.ones(256, bool), lower=False)[3][0]
        return hashes[token]

    def bag(text):
        token = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff \t-\r]+", text.encode())
        pairs = [ngrams(np.zeros(2, int), np.array([number(a), number(b)]), 2, 5)[1][0] for a, b in zip(token, token[1:], strict=False)]
        plain = [t.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))) for t in token if t[:1].isalnum() or t[0] >= 128]
        return [int(h) >> 64 - importance.BITS for h in [*map(number, token), *pairs]], [int(number(w)) >> 64 - importance.WORD_BITS for w in plain]

    bags = {i: bag(t) for i, t in rows}
    trained = {i for i, r in sample.items() if r.part == "train" and r.good}
    count = [[defaultdict(int), defaultdict(int)] for _ in range(2)]  # n-grams and words, in all and in good ones
    for i, both in bags.items():
        for k in range(2):
            for x in both[k]:
                count[k][0][x] += 1
                count[k][1][x] += i in trained
    total = [[sum(c.values()) for c in cs] for cs in count]
    share = lambda c, x: np.log((count[0][c][x] + 1) / (total[0][c] + (1 << importance.BITS)))
    low = lambda x: min(0, np.log((count[1][1][x] + 1) / (count[1][0][x] * total[1][1] / total[1][0] + 1)) - importance.FLOOR)
    noise = {r.doc_id: (r.a, r.b) for r in docs.select("doc_id", importance.gumbel(F.col("doc_id"), 1).alias("a"), importance.gumbel(F.col("doc_id"), 2).alias("b")).collect()}
    want = {}
    for i, (grams, words) in bags.items():
        ratio = importance.PER * sum(share(1, x) - share(0, x) for x in grams) / max(1, len(grams)), sum(map(low, words))
        want[i] = *ratio, ratio[0] + noise[i][0], ratio[1] + noise[i][1]
    held = [want[i] for i, r in sample.items() if r.part == "choose" and r.good and i in want]
    least = [np.quantile([w[k] for w in held], importance.LOSS / 2) for k in (2, 3)]
    got = importance.score(docs, labels).collect()
    assert len(got) == len(want) and len(held) > 10
    for r in got:
        w = want[r.doc_id]
        assert np.allclose([r.log_ratio, r.word_ratio, r.key, r.word_key], w, atol=2e-4)
        assert r.kept == (w[2] >= least[0] - 2e-4 and w[3] >= least[1] - 2e-4)
    assert {r.kept for r in got} == {True, False}


def test_quality_counts_in_a_tree(spark, docs, monkeypatch):
    """The same counts whatever the number of tasks, and of tasks whose counts are merged at a time."""
    d = docs.select("doc_id", "text", (F.col("doc_id") % 3 == 0).alias("good"))
    one = importance.count_tree(d.coalesce(1), 1)
    monkeypatch.setattr(importance, "FAN", 3)
    many = importance.count_tree(d.repartition(11), 11)
    assert (one == many).all() and one[0].sum() > 50_000 and 0 < one[1].sum() < one[0].sum()


def test_quality_on_unused_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = importance.score(docs, labels, carry=["lang", "text"])
    assert scored.filter("more.text is null").count() == 0 and scored.count() == docs.count()
    share = {r.label: r.kept / r.documents for r in importance.figures(scored, labels).collect()}
    assert share["good"] >= 0.98 and share["low quality"] <= 0.05 and share["toxic"] <= 0.35


def test_quality_words(spark):
    """A word that only bad documents have counts against each that has it, at its plain log ratio below FLOOR."""
    rows = [(i, f"plain words of every day {'Blah' if i % 4 == 0 else 'fine'} number{i}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(4000)], "doc_id bigint, quality int, toxic int")
    got = importance.score(docs, labels).collect()
    n = sum(r.good and r.part == "train" for r in importance.labelled_sample(labels).collect())
    want = np.log(1 / (1000 * n / 4000 + 1)) - importance.FLOOR
    assert all(abs(r.word_ratio - (want if r.doc_id % 4 == 0 else 0)) < 1e-4 for r in got)
    assert sum(r.kept for r in got if r.doc_id % 4) >= 0.98 * 3000
    assert sum(r.kept for r in got if r.doc_id % 4 == 0) <= 0.25 * 1000


def test_licenses(spark, odd, none):
    near = "This work is licensed under the GNU General Public License, version"
    rows = [(1, "abc\nReleased under the MIT License.\nx"), (2, near + " 2."), (3, "no licence talk here at all, only words"), (4, "text before. Licensed under CC BY-NC 4.0. and after"), (5, None), (6, "ALL RIGHTS RESERVED"), (6, "ALL RIGHTS RESERVED")]
    rows += [(7, near + " 3.0"), (8, near + " 31"), (9, near.replace("GNU", "GNU Affero") + " 3"), (10, near.replace("work", "library").replace("GNU", "GNU Lesser") + " 3"), (11, "This is licensed under the GNU General Public License, v3."), (12, near.replace("GNU", "GNU Lesser") + " 3"), (13, "Licensed under CC 4.0."), (14, "Licensed under CC BY-SA 4.0.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.block, r.license, r.missing, r.extra) for r in license.scan(df).collect())
    assert got == [(1, 1, "MIT", 0, 0), (4, 0, "CC-BY-NC-4.0", 0, 0), (6, 0, "proprietary", 0, 0), (6, 0, "proprietary", 0, 0), (7, 0, "GPL-3.0", 0, 0), (10, 0, "LGPL-3.0", 0, 0), (11, 0, "GPL-3.0", 2, 0)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    notices = {license.TEMPLATES[k]: k for k in ("MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0", "proprietary")}
    want = sorted((r.doc_id, i, k) for r in docs.collect() for i, line in enumerate(r.text.split("\n")) for n, k in notices.items() if line.endswith(n))
    assert sorted((r.doc_id, r.block, r.license) for r in license.scan(docs).collect()) == want and want
    assert license.scan(odd).count() == 0 and license.scan(none).count() == 0


def test_licenses_wrapped(spark):
    """Notices over several lines, and templates of the caller without a word that notices commonly use."""
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the\n#   following conditions are met."
    rows = [(1, "x\nsee: Licensed under the Apache License,\nVersion 2.0."), (2, bsd), (3, "All\nrights\n\nreserved")]
    got = license.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.block, r.license, r.missing, r.extra, r.first_word) for r in got) == [(1, 1, "Apache-2.0", 0, 0, 1), (2, 0, "BSD-3-Clause", 0, 0, 0), (3, 0, "proprietary", 0, 0, 0)]
    mit = {"text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"}
    df = spark.createDataFrame([(1, "a\nPermission is hereby granted,\nfree of charge, to any person obtaining a copy of the software"), (2, "a person")], "doc_id bigint, text string")
    assert [(r.doc_id, r.block, r.license, r.missing) for r in license.scan(df, mit).collect()] == [(1, 1, "text", 1)]


def test_licenses_long_line(spark):
    """A near notice counts at the end of a long line as it does alone; a line has all its notices."""
    near = "Licensed under Apache License, version 2."
    prose = " ".join(f"{w}{i * i}" for i in range(20) for w in ("ordinary", "prose", "before"))[:884]
    rows = [(1, near), (2, prose + " " + near), (3, "Released under the MIT License. " + prose + " All rights reserved. Licensed under CC BY 4.0.")]
    got = license.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.license, r.missing) for r in got) == [(1, "Apache-2.0", 1), (2, "Apache-2.0", 1), (3, "CC-BY-4.0", 0), (3, "MIT", 0), (3, "proprietary", 0)]
    assert len({round(r.saved, 9) for r in got if r.doc_id < 3}) == 1


def test_licenses_by_all_windows():
    """The same notices as from every window of every template, without sign words."""
    rng = np.random.default_rng(4)
    scanner, found = license.Scanner(license.TEMPLATES), 0
    some = [license.words(t) for t in license.TEMPLATES.values()]
    for _ in range(150):
        mine = []
        for k in rng.integers(0, len(some), 4):
            t = [w for w in some[k] if rng.random() > 0.07]
            for _ in range(int(rng.integers(0, 3))):
                t.insert(int(rng.integers(0, len(t) + 1)), str(rng.choice(["the", "extra", "license", "under", "all"])))
            mine += [*t, *map(str, rng.choice(["prose", "of", "every", "day", "rights", "work"], int(rng.integers(0, 5))))]
        every = {(k, s) for k, t in enumerate(some) for s in range(-len(t), len(mine))}
        want = [(first, scanner.each[k][0], missing, extra) for first, _, k, _, missing, extra in scanner.confirm(mine, scanner.rank(mine, every))]
        got = scanner.notices(" ".join(mine))
        assert [(n[5], n[1], n[3], n[4]) for n in got] == want
        found += len(got)
    assert found > 200


def test_alignment():
    """Against all stretches, by the length of their longest common subsequence with the template."""
    rng = np.random.default_rng(6)

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for j, y in enumerate(b):
                row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        return row[-1]

    for _ in range(200):
        block, template = (rng.integers(0, 4, n).tolist() for n in (int(rng.integers(1, 9)), 5))
        missing, extra, first, stop = license.align(block, template)
        cost = {(s, e): 5 + e - s - 2 * common(block[s:e], template) for s in range(len(block)) for e in range(s, len(block) + 1)}
        assert missing + extra == min(cost.values()) == cost[first, stop] if stop > first else missing == 5


def test_sharding(spark, odd, none):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.execute(maglev.oracle()).fetchall())
    df = op4_sharding(spark, SF)
    assert sorted(tuple(r) for r in df.select("doc_id", "slot", "shard").collect()) == want
    assert "Python" not in df._jdf.queryExecution().toString()
    owner = maglev.table(maglev.names())
    count = np.bincount(owner)
    assert count.max() - count.min() <= 1
    fewer = maglev.table(maglev.names()[:-1])
    assert np.mean([a != b for a, b in zip(owner, fewer, strict=True)]) < 0.1
    got = maglev.place(odd, "doc_id", maglev.names())
    assert got.count() == odd.count() and got.columns[-2:] == ["slot", "shard"] and "bucket" in got.columns
    assert maglev.place(none, "doc_id", maglev.names()).count() == 0
    for shards, slots in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            maglev.table(shards, slots)
