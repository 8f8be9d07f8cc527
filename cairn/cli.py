"""Command line: create, extract, list, info, verify, cat. `python -m cairn.cli VERB ...`"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import functions as F

from cairn import __version__
from cairn.functions.classify import resolve
from cairn.functions.format import human_text
from cairn.operators.reports import by_codec, kind_counts, listing
from cairn.session import local_session
from cairn.sources.container import MAGIC, WriteOptions, block_frame, verify, write_container
from cairn.sources.extract import ExtractOptions, cat, entries_of, extract
from cairn.sources.filetree import HASHES, FileTree


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("cairn")
    p.add_argument("-q", "--quiet", action="store_true", help="no progress")
    p.add_argument("--magic", default=MAGIC.decode(), help="four characters at both ends of an archive")
    p.add_argument("--hash", choices=sorted(HASHES), default="sha256")
    p.add_argument("--version", action="version", version=__version__)
    verbs = p.add_subparsers(dest="verb", required=True)
    yes = lambda s: s.lower() in ("true", "1", "yes")
    c = verbs.add_parser("create", aliases=["c"])
    c.add_argument("archive")
    c.add_argument("inputs", nargs="+")
    c.add_argument("--codec")
    c.add_argument("-l", "--level", type=int)
    c.add_argument("--preset")
    c.add_argument("--block-size", type=int, default=64, help="MiB")
    c.add_argument("--dedup", type=yes, default=True)
    c.add_argument("--fast-lane", type=yes, default=True)
    c.add_argument("--follow-symlinks", action="store_true")
    x = verbs.add_parser("extract", aliases=["x"])
    x.add_argument("archive")
    x.add_argument("paths", nargs="*")
    x.add_argument("-C", "--dir", default=".")
    for flag in ("verify", "overwrite", "metadata"):
        x.add_argument(f"--no-{flag}", dest=flag, action="store_false")
    ls = verbs.add_parser("list", aliases=["l"])
    ls.add_argument("archive")
    ls.add_argument("-l", "--long", action="store_true")
    for verb in ("info", "verify"):
        verbs.add_parser(verb).add_argument("archive")
    k = verbs.add_parser("cat")
    k.add_argument("archive")
    k.add_argument("path")
    return p


def run(argv: list[str], spark=None, out=None) -> int:
    a = parser().parse_args(argv)
    out = out or sys.stdout
    kind = a.magic.encode(), a.hash
    if len(kind[0]) != 4:
        parser().error("the magic has four bytes")
    say = lambda s: print(s, file=out)
    note = lambda s: None if a.quiet else print(s, file=sys.stderr)
    try:
        spark = spark or local_session()
        began = time.monotonic()
        rate = lambda n: f"{human_text(n / max(time.monotonic() - began, 0.001))}/s"
        if a.verb in ("create", "c"):
            codec, level = resolve(a.preset, a.codec, a.level)
            spark.dataSource.register(FileTree)
            reader = spark.read.format("filetree").option("paths", json.dumps(a.inputs)).option("content", "true").option("hash", a.hash)
            manifest = reader.option("followSymlinks", str(a.follow_symlinks).lower()).load()
            note(f"writing {a.archive}")
            s = write_container(manifest, a.archive, WriteOptions(codec, level, a.block_size << 20, a.dedup, a.fast_lane, a.follow_symlinks, *kind))
            share = s["archive_bytes"] / s["input_bytes"] if s["input_bytes"] else 0.0
            smaller = s["input_bytes"] / s["archive_bytes"]
            say(f"{s['files']} files, {s['dirs']} dirs, {s['symlinks']} links; {human_text(s['input_bytes'])} -> {human_text(s['archive_bytes'])} ({share:.1%}, {smaller:.2f}x smaller), {s['blocks']} blocks, {rate(s['input_bytes'])}")
            if s["deduped_files"]:
                say(f"dedup: {s['deduped_files']} files, {human_text(s['deduped_bytes'])}")
        elif a.verb in ("extract", "x"):
            note(f"extracting {a.archive}")
            s = extract(spark, a.archive, a.dir, a.paths or None, ExtractOptions(a.verify, a.overwrite, a.metadata, *kind))
            say(f"{s['files']} files, {s['dirs']} dirs, {s['symlinks']} links, {human_text(s['bytes'])}, {rate(s['bytes'])}")
        elif a.verb in ("list", "l"):
            rows = entries_of(spark, a.archive, *kind).orderBy("entry_id")
            for r in (listing(rows).select("line") if a.long else rows.select("path")).toLocalIterator():
                say(r[0])
        elif a.verb == "info":
            n, blocks = kind_counts(entries_of(spark, a.archive, *kind)).first(), block_frame(a.archive, spark, *kind)
            total = blocks.agg(F.coalesce(F.sum("rlen"), F.lit(0)).alias("r"), F.coalesce(F.sum("clen"), F.lit(0)).alias("c")).first()
            say(f"contents: {n.files} files, {n.dirs} dirs, {n.symlinks} links, {human_text(n.bytes)}")
            if n.bytes > total.r:
                say(f"dedup: saves {human_text(n.bytes - total.r)} ({(n.bytes - total.r) / n.bytes:.1%})")
            say(f"blocks: {human_text(total.r)} -> {human_text(total.c)} ({total.c / total.r if total.r else 0:.1%}); archive {human_text(os.path.getsize(a.archive))}")
            for r in by_codec(blocks).collect():
                say(f"  {r.codec_name}: {r.blocks} blocks, {human_text(r.rlen)} -> {human_text(r.clen)} ({r.ratio:.1%})")
        elif a.verb == "verify":
            note(f"verifying {a.archive}")
            checked = verify(spark, a.archive, *kind).persist()
            bad = checked.filter(~F.col("ok")).limit(10).collect()
            if bad:
                raise ValueError(f"checksum mismatch: {', '.join(r.path for r in bad)}")
            say(f"{checked.count()} files verified")
        else:
            data = cat(spark, a.archive, a.path, *kind)
            getattr(out, "buffer", out).write(data)
        return 0
    except Exception as e:
        print(f"cairn: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
