import pytest
from pyspark.sql import functions as F

from cairn.functions import classify, paths
from cairn.functions.format import human
from cairn.operators import pack
from cairn.sources import blake3
from cairn.sources.container import matches_path
from cairn.sources.filetree import PathError, check_path

#: Paths by the rule that refuses them; None for safe ones.
REASONS = {
    None: ["one.md", "two/levels/deep.csv", "dot..dot/..x", "é:byte/rule", "trailing.", " "],
    "empty": [""],
    "absolute": ["/top", "\\top", "//top"],
    "drive": ["E:files", "q:/x", "n:"],
    "parent": ["..", "up/..", "../sibling", "deep/../../x"],
    "component": [".", "a//b", "b/", "./c", "c/./d"],
    "backslash": ["w\\in", "dir/w\\in/x"],
}
EXT = {"q/PIC.WebP": "webp", "q/data.tar.zst": "zst", ".bashrc": None, "etc/.cache": None, "LICENSE": None, "stop.": None, "..hid.den": "den", "....": None, "y.Ü": "Ü"}
#: Names by the kind of format; containers of files are compressed like sources.
FAST = {"images": ["trip/DSC_9.JPE", "logo.avif"], "video": ["talk.webm", "cam.3gp", "module.ts"], "audio": ["song.opus"], "streams": ["dump.sql.zst", "logs.7z"], "fonts": ["face.woff2"], "own": ["old.cairn"]}
SLOW = {"sources": ["lib/parse.go", "Rakefile"], "containers": ["setup.msi", "tool.zip", "app.jar", "mod.whl", "disk.iso", "os.dmg", "net.deb", "net.rpm", "phone.apk", "text.docx", "novel.epub", "inst.pkg"]}
#: In pack order: lane, extension, directory, name; a directory's dot comes after its end.
SORTED = ["z/none", "a/x.csv", "a/y.csv", "a.b/x.csv", "b/a.csv", "a/a.py", "c/one.gif", "a/two.mp3"]


def apply(spark, items, f):
    df = spark.createDataFrame([(x,) for x in items], "x string")
    return dict(df.select("x", f(F.col("x")).alias("y")).collect())


def test_paths(spark):
    want = {p: reason for reason, some in REASONS.items() for p in some}
    assert apply(spark, want, paths.invalid_reason) == want
    assert apply(spark, want, paths.join_depth_ok) == {p: r is None for p, r in want.items()}
    for p, reason in want.items():
        if reason is None:
            check_path(p)
        else:
            with pytest.raises(PathError):
                check_path(p)


def test_extensions_and_lanes(spark):
    assert apply(spark, EXT, paths.extension) == EXT
    want = {p: lane for lane, kinds in ((1, FAST), (0, SLOW)) for some in kinds.values() for p in some}
    assert apply(spark, want, classify.lane) == want


def test_sort_order(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(reversed(SORTED))], "walk_id bigint, path string")
    assert [r.path for r in pack.with_sort_key(df).orderBy(*pack.order()).collect()] == SORTED


def test_selectors(spark):
    m = lambda p: lambda x: paths.matches(x, F.lit(p))
    stored = ["doc/guide/intro.md", "doc/guide", "doc", "docs/other.md", "do"]
    for p in ("doc/guide", "doc/guide/", "doc/guide///"):
        assert apply(spark, stored, m(p)) == {x: x.startswith("doc/guide") for x in stored}
    assert apply(spark, stored, m("doc/guide/intro.md"))["doc/guide/intro.md"]
    assert not any(apply(spark, stored, m("/")).values()) and not any(apply(spark, stored, m("")).values())
    assert all(matches_path(x, [p]) == ok for p in ("doc/", "docs", "/", "do") for x, ok in apply(spark, stored, m(p)).items())


def test_resolve_and_human(spark):
    assert classify.resolve() == (1, 12) and classify.resolve("max") == (2, 9) and classify.resolve(codec="NONE") == (0, 0)
    with pytest.raises(ValueError):
        classify.resolve("fast", "zstd")
    with pytest.raises(ValueError):
        classify.resolve(codec="brotli")
    rows = spark.createDataFrame([("max", None, None), ("max", "xz", None), (None, "LZMA", None), (None, None, 5), ("x", None, None)], "p string, c string, l int")
    codec, level = classify.resolved(F.col("p"), F.col("c"), F.col("l"))
    assert [tuple(r) for r in rows.select(codec, level).collect()] == [(2, 9), (None, None), (2, 6), (1, 5), (None, None)]
    df = spark.createDataFrame([(n,) for n in (0, 1023, 1024, 1280, 1 << 50, 1 << 62)], "n bigint")
    assert [r[0] for r in df.select(human(F.col("n"))).collect()] == ["0 B", "1023 B", "1.0 KB", "1.2 KB", "1.0 PB", "4096.0 PB"]
    assert df.select(human(F.col("n"), "TB")).collect()[-1][0] == "4194304.0 TB"


def test_blake3(monkeypatch):
    # Published digests of nothing, of "abc", and of the bytes 0, 1, ... 250 repeated.
    known = {b"": "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", b"abc": "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"}
    ramp = bytes(i % 251 for i in range(50_000))
    known |= {ramp[:1]: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213", ramp[:1025]: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"}
    assert {d: blake3.blake3(d).hex() for d in known} == known
    lengths = [0, 1, 64, 65, 1023, 1024, 1025, 2048, 3073, 16_384, 16_385, 32_768, 50_000]
    whole = [blake3.blake3(ramp[:n]) for n in lengths]
    assert blake3.blake3_many([ramp[:n] for n in lengths]) == whole and len(set(whole)) == len(lengths)
    monkeypatch.setattr(blake3, "PART", 1 << 14)  # the same digests part by part
    for n, d in zip(lengths, whole, strict=True):
        h = blake3.Blake3()
        for at in range(0, n, 777):
            h.update(ramp[at : min(n, at + 777)])
        assert h.digest() == d
