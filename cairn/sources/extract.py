"""The tree sink: directories, then files, then symlinks, then directory times, each in parallel.

For destinations that driver and executors share. A file is checked before it appears under its name; a link is never
followed on writing; of two entries with one path the later in storage order stays.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cairn.operators.reports import kind_counts
from cairn.sources.container import MAGIC, ContainerFiles, ContainerIndex, load
from cairn.sources.filetree import HASHES, check_path


@dataclass
class ExtractOptions:
    verify: bool = True
    overwrite: bool = True
    metadata: bool = True
    magic: bytes = MAGIC
    hash_name: str = "sha256"


def entries_of(spark: SparkSession, path: str, magic: bytes = MAGIC, hash_name: str = "sha256", selectors: list[str] | None = None) -> DataFrame:
    """All entries, or those that any selector matches."""
    return load(spark, ContainerIndex, path, magic, hash_name, paths=selectors)


def target(dest: str, rel: str) -> str:
    path = os.path.join(dest, check_path(rel))
    at = dest
    for part in rel.split("/")[:-1]:
        at = os.path.join(at, part)
        if os.path.islink(at):
            raise PermissionError(f"{at} is a link")
    return path


def _files(dest: str, o: ExtractOptions):
    """Writer of files whose segments come one after another: beside the target first, then in its place."""

    def write(rows: Iterable[Row]) -> None:
        f = part = hasher = now = None

        def close() -> None:
            f.close()
            try:
                if hasher and hasher.digest() != bytes(now.hash):
                    raise ValueError(f"checksum mismatch: {now.path}")
                if o.metadata:
                    os.chmod(part, now.mode & 0o7777)
                    os.utime(part, ns=(ns := now.mtime * 10**9 + now.mtime_nanos, ns))
                os.replace(part, target(dest, now.path))
            except BaseException:
                os.unlink(part)
                raise

        for r in rows:
            if now is None or r.entry_id != now.entry_id:
                if now is not None:
                    close()
                now, at = r, target(dest, r.path)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                part = f"{os.path.dirname(at)}/.{uuid.uuid4().hex}.part"
                fd = os.open(part, os.O_WRONLY | os.O_CREAT | os.O_EXCL | os.O_NOFOLLOW, 0o666)
                f = os.fdopen(fd, "wb")
                hasher = HASHES[o.hash_name]() if o.verify and r.hash is not None else None
            f.write(r.content)
            if hasher:
                hasher.update(r.content)
        if now is not None:
            close()

    return write


def conflicts(entries: DataFrame, dest: str) -> DataFrame:
    """The files and links among the entries in whose place something is already."""
    there = F.udf(lambda rel: os.path.lexists(target(dest, rel)), "boolean")
    return entries.filter("kind <> 'dir'").filter(there("path"))


def extract(spark: SparkSession, path: str, dest: str, selectors: list[str] | None = None, o: ExtractOptions | None = None) -> dict:
    """It is an error if selectors are given and none of them matches anything."""
    o = o or ExtractOptions()
    chosen = entries_of(spark, path, o.magic, o.hash_name, selectors)
    stats = kind_counts(chosen).first()
    if selectors is not None and stats.files + stats.dirs + stats.symlinks == 0:
        raise LookupError(f"nothing matches {selectors}")
    os.makedirs(dest, exist_ok=True)
    dest = os.path.realpath(dest)
    others = chosen.filter("kind <> 'file'").groupBy("kind", "path").agg(F.max_by(F.struct("mtime", "mtime_nanos", "link_target"), "entry_id").alias("e")).select("kind", "path", "e.*")

    if not o.overwrite:  # nothing is written if anything is there
        if found := conflicts(chosen, dest).limit(1).collect():
            raise FileExistsError(f"{found[0].path} exists")

    def make_dirs(rows: Iterable[Row]) -> None:
        for r in rows:
            os.makedirs(target(dest, r.path), exist_ok=True)

    def make_links(rows: Iterable[Row]) -> None:
        for r in rows:
            at = target(dest, r.path)
            os.makedirs(os.path.dirname(at), exist_ok=True)
            part = f"{os.path.dirname(at)}/.{uuid.uuid4().hex}.part"
            os.symlink(r.link_target, part)
            os.replace(part, at)

    def set_times(rows: Iterable[Row]) -> None:
        for r in rows:
            os.utime(target(dest, r.path), ns=(ns := r.mtime * 10**9 + r.mtime_nanos, ns))

    others.filter("kind = 'dir'").foreachPartition(make_dirs)
    rows = load(spark, ContainerFiles, path, o.magic, o.hash_name, paths=selectors, last=True)
    rows = rows.select("entry_id", "path", "mode", "mtime", "mtime_nanos", "hash", "pos", "content", F.size("segments").alias("n"))
    rows.filter("n <= 1").foreachPartition(_files(dest, o))
    rows.filter("n > 1").repartition("entry_id").sortWithinPartitions("entry_id", "pos").foreachPartition(_files(dest, o))
    others.filter("kind = 'symlink'").foreachPartition(make_links)
    if o.metadata:
        others.filter("kind = 'dir'").foreachPartition(set_times)
    return {"dirs": stats.dirs, "files": stats.files, "symlinks": stats.symlinks, "bytes": stats.bytes}


def cat(spark: SparkSession, path: str, name: str, magic: bytes = MAGIC, hash_name: str = "sha256") -> bytes:
    """Bytes of the first file of that path, unchecked."""
    rows = load(spark, ContainerFiles, path, magic, hash_name, paths=[name]).filter(F.col("path") == name)
    first = rows.agg(F.min("entry_id")).first()[0]
    if first is None:
        raise LookupError(f"no file {name!r}")
    return b"".join(bytes(r.content) for r in rows.filter(F.col("entry_id") == first).orderBy("pos").toLocalIterator())
