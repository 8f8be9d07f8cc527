import io
import json
import os

import pytest
from pyspark.sql import functions as F

from cairn import cli
from cairn.sources import container as c
from cairn.sources.extract import ExtractOptions, cat, entries_of, extract
from cairn.sources.filetree import FileTree, PathError, raw_size


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("in") / "tree"
    (root / "lib/inner").mkdir(parents=True)
    (root / "media").mkdir()
    code = b"def twice(x):\n    return x + x\n\n" * 200
    files = {"lib/twice.py": code, "lib/inner/again.py": code, "lib/one.py": b"import two\n" * 50, "NOTES": b"notes!\n", "nothing.txt": b"", "media/still.webp": b"\xab" * 40_000}
    for name, data in files.items():
        (root / name).write_bytes(data)
    os.symlink("lib/twice.py", root / "link.py")
    os.utime(root / "NOTES", ns=(10**18 + 123_456_789,) * 2)
    return root, files


def manifest(spark, root):
    spark.dataSource.register(FileTree)
    return spark.read.format("filetree").option("paths", json.dumps([str(root)])).option("content", "true").load()


VARIANTS = {
    "zstd": (c.WriteOptions(), [6957, 40_000], (1, 6400)),
    "xz": (c.WriteOptions(2, 6), [6957, 40_000], (1, 6400)),
    "tiny": (c.WriteOptions(block_size=4096, check_block_size=False), [557, 6400, 40_000], (1, 6400)),
    "plain": (c.WriteOptions(dedup=False, fast_lane=False), [53_357], (0, 0)),
    "blake3": (c.WriteOptions(hash_name="blake3"), [6957, 40_000], (1, 6400)),
}


@pytest.mark.parametrize("name", VARIANTS)
def test_roundtrip(spark, tree, tmp_path, name):
    root, files = tree
    o, rlens, dedup = VARIANTS[name]
    at = str(tmp_path / "a.cairn")
    stats = c.write_container(manifest(spark, root), at, o)
    assert (stats["files"], stats["dirs"], stats["symlinks"], stats["input_bytes"]) == (6, 4, 1, 53_357)
    assert (stats["deduped_files"], stats["deduped_bytes"]) == dedup
    index = c.read_index(at, hash_name=o.hash_name)
    assert [b[2] for b in index.blocks] == rlens
    assert [e["kind"] for e in index.entries] == ["dir"] * 4 + ["file"] * 6 + ["symlink"]
    kind = c.MAGIC, o.hash_name
    out, plain = tmp_path / "out", ExtractOptions(hash_name=o.hash_name)
    assert extract(spark, at, str(out), o=plain) == {"dirs": 4, "files": 6, "symlinks": 1, "bytes": 53_357}
    for f, data in files.items():
        assert (out / "tree" / f).read_bytes() == data
    assert os.readlink(out / "tree/link.py") == "lib/twice.py"
    assert os.stat(out / "tree/NOTES").st_mtime_ns == 10**18 + 123_456_789
    with pytest.raises(FileExistsError):
        extract(spark, at, str(out), o=ExtractOptions(overwrite=False, hash_name=o.hash_name))
    assert extract(spark, at, str(tmp_path / "some"), ["tree/lib/", "nowhere"], plain)["files"] == 3
    with pytest.raises(LookupError):
        extract(spark, at, str(out), ["tree/li"], plain)
    assert [r.ok for r in c.verify(spark, at, *kind).collect()] == [True] * 6
    assert cat(spark, at, "tree/NOTES", *kind) == b"notes!\n"


@pytest.mark.parametrize("hash_name", ["sha256", "blake3"])
def test_inputs_of_one_name(spark, tmp_path, hash_name):
    """Two inputs of one base name: entries with one path keep their own bytes; on extraction the later one stays."""
    for side, text in (("x", b"left" * 100), ("y", b"right" * 90)):
        (tmp_path / side / "t/sub").mkdir(parents=True)
        (tmp_path / side / "t/a.txt").write_bytes(text)
        (tmp_path / side / "t/sub/only.txt").write_bytes(side.encode())
    spark.dataSource.register(FileTree)
    m = spark.read.format("filetree").option("paths", json.dumps([str(tmp_path / s / "t") for s in "xy"])).option("content", "true").load()
    at = str(tmp_path / "a.cairn")
    stats = c.write_container(m, at, c.WriteOptions(hash_name=hash_name))
    assert (stats["files"], stats["dirs"], stats["input_bytes"], stats["deduped_files"]) == (4, 4, 852, 0)
    got = sorted((r.path, bytes(r.content)) for r in c.contents(spark, at, hash_name=hash_name).collect())
    assert got == [("t/a.txt", b"left" * 100), ("t/a.txt", b"right" * 90), ("t/sub/only.txt", b"x"), ("t/sub/only.txt", b"y")]
    assert [r.ok for r in c.verify(spark, at, hash_name=hash_name).collect()] == [True] * 4
    extract(spark, at, str(tmp_path / "out"), o=ExtractOptions(hash_name=hash_name))
    assert (tmp_path / "out/t/a.txt").read_bytes() == b"right" * 90 and (tmp_path / "out/t/sub/only.txt").read_bytes() == b"y"
    assert cat(spark, at, "t/a.txt", hash_name=hash_name) == b"left" * 100


@pytest.mark.parametrize("hash_name", ["sha256", "blake3"])
def test_long_files_in_pieces(spark, tmp_path, hash_name):
    """Files above max_piece come as several rows and several segments, and go back together."""
    rng = __import__("random").Random(3)
    (tmp_path / "t").mkdir()
    files = {"big.bin": rng.randbytes(45_000), "copy.bin": None, "even.bin": rng.randbytes(20_000), "small.bin": b"s" * 10}
    files["copy.bin"] = files["big.bin"]
    for n, d in files.items():
        (tmp_path / "t" / n).write_bytes(d)
    spark.dataSource.register(FileTree)
    read = lambda **o: spark.read.format("filetree").options(paths=json.dumps([str(tmp_path / "t")]), content="true", maxPiece="10000", **o).load()
    assert read().filter("kind = 'file'").count() == 5 + 5 + 2 + 1
    at = str(tmp_path / "a.cairn")
    stats = c.write_container(read(hash=hash_name), at, c.WriteOptions(block_size=10_000, max_piece=10_000, check_block_size=False, hash_name=hash_name))
    assert (stats["files"], stats["deduped_files"], stats["blocks"]) == (4, 1, 8)
    assert {e["path"]: len(e["segments"]) for e in c.read_index(at, hash_name=hash_name).entries if e["kind"] == "file"} == {"t/big.bin": 5, "t/copy.bin": 5, "t/even.bin": 2, "t/small.bin": 1}
    assert {r.path: bytes(r.content) for r in c.contents(spark, at, hash_name=hash_name).collect()} == {f"t/{n}": d for n, d in files.items()}
    assert [r.ok for r in c.verify(spark, at, hash_name=hash_name).collect()] == [True] * 4
    extract(spark, at, str(tmp_path / "out"), o=ExtractOptions(hash_name=hash_name))
    assert all((tmp_path / "out/t" / n).read_bytes() == d for n, d in files.items())
    assert cat(spark, at, "t/even.bin", hash_name=hash_name) == files["even.bin"]
    with pytest.raises(Exception, match="checksum mismatch"):
        flipped = open(at, "rb").read()
        open(at, "wb").write(flipped[:60] + bytes([flipped[60] ^ 1]) + flipped[61:])
        c.write_container(read(hash=hash_name), at, c.WriteOptions(0, 0, block_size=10_000, max_piece=10_000, check_block_size=False, hash_name=hash_name, fast_lane=False))
        stored = open(at, "rb").read()
        open(at, "wb").write(stored[:60] + bytes([stored[60] ^ 1]) + stored[61:])
        assert sorted(r.path for r in c.verify(spark, at, hash_name=hash_name).collect() if not r.ok) == ["t/big.bin", "t/copy.bin"]
        extract(spark, at, str(tmp_path / "bad"), o=ExtractOptions(hash_name=hash_name))
    assert not list((tmp_path / "bad/t").glob("*ig.bin"))


def test_walk_in_tasks(spark, tree):
    """The same rows in the same order, however few entries the driver lists itself."""
    spark.dataSource.register(FileTree)
    read = lambda n: [r.path for r in spark.read.format("filetree").options(paths=json.dumps([str(tree[0])]), listed=str(n)).load().orderBy("walk_id").collect()]
    whole = read(10**6)
    assert whole[0] == "tree" and len(whole) == 11 and all(read(n) == whole for n in (1, 2, 6))
    assert tuple(raw_size(spark, [str(tree[0])]).first()) == (6, 53_357)


def test_selectors_reach_the_sources(spark, tree, tmp_path):
    at = str(tmp_path / "a.cairn")
    c.write_container(manifest(spark, tree[0]), at, c.WriteOptions(block_size=4096, check_block_size=False))
    blocks = c.load(spark, c.ContainerBlocks, at, paths=["tree/lib"])
    assert blocks.count() == 2 and c.load(spark, c.ContainerBlocks, at).count() == 3
    with open(at, "r+b") as f:  # what is not selected is not read
        f.seek(c.read_index(at).blocks[2][0])
        f.write(b"~" * 8)
    assert c.load(spark, c.ContainerFiles, at, paths=["tree/lib/inner/"]).count() == 1
    assert {r.path for r in entries_of(spark, at, selectors=["tree/lib"]).collect()} == {"tree/lib", "tree/lib/inner", "tree/lib/inner/again.py", "tree/lib/one.py", "tree/lib/twice.py"}


def test_sink_failures(spark, tree, tmp_path):
    """A file that changes its length leaves neither an archive nor staging files."""
    m = manifest(spark, tree[0]).withColumn("size", F.col("size") + 1).withColumn("hash", F.sha2("content", 256))
    with pytest.raises(Exception, match="not as long as it was"):
        c.write_container(m, str(tmp_path / "a.cairn"))
    assert not list(tmp_path.iterdir())
    stats = c.write_container(manifest(spark, tree[0]).filter("kind = 'dir'"), str(tmp_path / "e.cairn"))
    assert (stats["files"], stats["dirs"], stats["blocks"]) == (0, 4, 0) and c.verify(spark, str(tmp_path / "e.cairn")).count() == 0


def test_corruption(spark, tree, tmp_path):
    at = str(tmp_path / "a.cairn")
    c.write_container(manifest(spark, tree[0]), at, c.WriteOptions(0, 0))
    good = open(at, "rb").read()

    def attempt(data):
        bad = str(tmp_path / "bad.cairn")
        open(bad, "wb").write(data)
        return bad

    for data in (b"", good[:70], b"XXXX" + good[4:], good[:4] + b"\x09" + good[5:], good[:-1] + b"?", good[:-40] + bytes([good[-40] ^ 1]) + good[-39:], good[:-64] + b"\xff" * 8 + good[-56:]):
        with pytest.raises(c.CorruptContainer):
            c.read_index(attempt(data))
    flipped = attempt(good[:20] + bytes([good[20] ^ 1]) + good[21:])  # in a stored block: decodes, fails its hash
    assert [r.path for r in c.verify(spark, flipped).collect() if not r.ok]
    with pytest.raises(Exception, match="checksum mismatch"):
        extract(spark, flipped, str(tmp_path / "x"))


def test_index_and_footer():
    e = {"path": "a/é", "kind": "symlink", "mode": 0o120777, "mtime": -5, "mtime_nanos": 7, "size": 0, "hash": None, "link_target": "b", "segments": []}
    f = e | {"path": "f", "kind": "file", "hash": bytes(range(32)), "link_target": None, "segments": [(0, 1, 2), (3, 4, 5)]}
    i = c.Index([(16, 5, 9, 1)], [e, f])
    assert c.Index.from_bytes(i.to_bytes()) == i
    raw = c.header() + c.footer(16, 0, 789, b"\7" * 32)
    assert c.read_footer(io.BytesIO(raw)) == (16, 0, 789, b"\7" * 32)
    with pytest.raises(c.CorruptContainer):
        c.Index.from_bytes(i.to_bytes()[:-3])


def test_cli(spark, tree, tmp_path, monkeypatch):
    at = str(tmp_path / "a.cairn")
    out = io.StringIO()
    assert cli.run(["create", at, str(tree[0]), "--preset", "fast"], spark, out) == 0
    assert cli.run(["list", "-l", at], spark, out) == 0
    assert cli.run(["info", at], spark, out) == 0
    assert cli.run(["verify", at], spark, out) == 0
    assert cli.run(["extract", at, "-C", str(tmp_path / "o")], spark, out) == 0
    text = out.getvalue()
    assert "6 files verified" in text and " -> lib/twice.py" in text and "zstd: 2 blocks" in text
    assert "x smaller)" in text and "/s\n" in text and "dedup: 1 files, 6.2 KB" in text
    other = str(tmp_path / "b.cairn")
    kind = ["-q", "--magic", "ELSE", "--hash", "blake3"]
    assert cli.run([*kind, "create", other, str(tree[0])], spark, out) == 0
    assert cli.run([*kind, "verify", other], spark, out) == 0 and cli.run([*kind, "extract", other, "-C", str(tmp_path / "p")], spark, out) == 0
    assert cli.run(["verify", other], spark, out) == 1
    raw = io.BytesIO()
    assert cli.run([*kind, "cat", other, "tree/NOTES"], spark, raw) == 0 and raw.getvalue() == b"notes!\n"
    assert cli.run(["verify", str(tmp_path / "missing")], spark, out) == 1
    assert cli.run(["create", at, str(tree[0]), "--preset", "fast", "--codec", "xz"], spark, out) == 1


def test_bad_inputs():
    from cairn.sources.filetree import walk

    for p in (".", "..", "/"):
        with pytest.raises(PathError):
            list(walk([p]))
