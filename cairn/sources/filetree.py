"""The file-tree source: every file, directory and symlink below the inputs.

    spark.dataSource.register(FileTree)
    spark.read.format("filetree").option("paths", json.dumps([...])).option("content", "true").load()

Inputs must be visible to driver and executors (a local or shared folder). Unlike binaryFile it keeps empty and
hidden files, directories, symlinks, modes and nanoseconds. Sockets, pipes and devices are skipped; any error aborts,
unless option "ignoreErrors" is true. The driver lists the upper levels of large trees, tasks walk the rest.

With content a file is one row, or one row a piece of `maxPiece` bytes (the first has piece 0), so no cell outgrows
that; option "hash" (sha256, blake3) adds the hash of the whole file. walk_id ascends in walk order.
"""

from __future__ import annotations

import json
import os
import stat
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairn.schema import MANIFEST, MAX_PIECE
from cairn.sources.blake3 import Blake3

HASHES = {"sha256": sha256, "blake3": Blake3}


class PathError(ValueError):
    pass


def check_path(path: str) -> str:
    """Plain-Python form of invalid_reason() for sources and sinks."""
    raw = path.encode("utf-8", "surrogateescape")
    if not raw:
        raise PathError("empty path")
    if raw[:1] in (b"/", b"\\") or raw[1:2] == b":":
        raise PathError(f"absolute path: {path!r}")
    for part in path.split("/"):
        if part in ("", ".", "..") or "\\" in part:
            raise PathError(f"unsafe component in {path!r}")
    return path


@dataclass
class _Node:
    """An entry below an input; `below` is None where it is no directory, or one that was not listed yet."""

    path: str
    rel: str
    row: dict | None = None
    below: list[_Node] | None = None


@dataclass
class Walker:
    follow: bool = False
    ignore_errors: bool = False

    def look(self, node: _Node) -> bool:
        """Fill in the entry's row; False for what is no file, directory or link."""
        try:
            st = os.stat(node.path) if self.follow else os.lstat(node.path)
        except OSError:
            if self.ignore_errors:
                return False
            raise
        kind = "dir" if stat.S_ISDIR(st.st_mode) else "symlink" if stat.S_ISLNK(st.st_mode) else "file" if stat.S_ISREG(st.st_mode) else None
        if kind:
            node.row = {
                "path": check_path(node.rel.encode("utf-8", "surrogateescape").decode("utf-8", "replace")), "abs": node.path, "kind": kind, "mode": st.st_mode,
                "mtime": st.st_mtime_ns // 10**9, "mtime_nanos": st.st_mtime_ns % 10**9, "size": st.st_size if kind == "file" else 0,
                "hash": None, "link_target": os.readlink(node.path) if kind == "symlink" else None,
            }
        return kind is not None

    def children(self, node: _Node) -> list[_Node]:
        try:
            names = sorted(os.listdir(node.path))
        except OSError:
            if self.ignore_errors:
                return []
            raise
        found = [_Node(os.path.join(node.path, n), f"{node.rel}/{n}") for n in names]
        return [n for n in found if self.look(n)]

    def below(self, node: _Node) -> Iterator[dict]:
        """All rows below a directory, in walk order."""
        for child in self.children(node):
            yield child.row
            if child.row["kind"] == "dir":
                yield from self.below(child)

    def roots(self, inputs: list[str]) -> list[_Node]:
        found = []
        for given in inputs:
            name = os.path.basename(os.path.normpath(given))
            if name in ("", ".", ".."):
                raise PathError(f"input {given!r} has no name of its own")
            found.append(_Node(os.path.abspath(given), name))
        return [n for n in found if self.look(n)]


def walk(inputs: list[str], follow: bool = False) -> Iterator[dict]:
    """Manifest rows in walk order: names sorted within each directory, each input relative to its own parent."""
    w = Walker(follow)
    for node in w.roots(inputs):
        yield node.row
        if node.row["kind"] == "dir":
            yield from w.below(node)


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return MANIFEST + ", walk_id bigint" + (", piece int, content binary" if self.options.get("content") == "true" else "")

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


@dataclass
class _Slice(InputPartition):
    """Rows, and directories that the task walks itself, in walk order."""

    number: int
    items: list[tuple[dict, bool]] = field(default_factory=list)


class _TreeReader(DataSourceReader):
    """The driver lists breadth first up to LISTED entries; a partition has a bounded number of bytes and rows, or one
    directory that was not listed."""

    BYTES, FILES, LISTED = 64 << 20, 10_000, 200_000

    def __init__(self, options: dict):
        flag = lambda name: options.get(name, options.get(name.lower(), "false")) == "true"
        self.inputs = json.loads(options["paths"])
        self.walker = Walker(flag("followSymlinks"), flag("ignoreErrors"))
        self.content = flag("content")
        self.hash_name = options.get("hash")
        self.piece = int(options.get("maxPiece", options.get("maxpiece", MAX_PIECE)))
        self.listed = int(options.get("listed", self.LISTED))

    def partitions(self) -> list[InputPartition]:
        roots = self.walker.roots(self.inputs)
        queue, n = deque(r for r in roots if r.row["kind"] == "dir"), len(roots)
        while queue and n < self.listed:
            node = queue.popleft()
            node.below = self.walker.children(node)
            n += len(node.below)
            queue.extend(c for c in node.below if c.row["kind"] == "dir")

        def flat(nodes: list[_Node]) -> Iterator[tuple[dict, bool]]:
            for node in nodes:
                yield node.row, node.row["kind"] == "dir" and node.below is None
                yield from flat(node.below or [])

        slices, held = [_Slice(0)], 0
        for row, unlisted in flat(roots):
            now = slices[-1].items
            if now and (unlisted or now[-1][1] or held + row["size"] > self.BYTES or len(now) >= self.FILES):
                slices.append(_Slice(len(slices)))
                held = 0
            slices[-1].items.append((row, unlisted))
            held += row["size"]
        return slices

    def read(self, partition: _Slice):
        i = partition.number << 33
        for row, unlisted in partition.items:
            rows = [row]
            if unlisted:
                node = _Node(row["abs"], row["path"], row)
                rows = (r for part in ([row], self.walker.below(node)) for r in part)
            for r in rows:
                yield from self._with_content(r, i) if self.content else [(*r.values(), i)]
                i += 1

    def _with_content(self, row: dict, walk_id: int) -> Iterator[tuple]:
        if row["kind"] != "file":
            yield (*row.values(), walk_id, 0, None)
            return
        with open(row["abs"], "rb") as f:
            if self.hash_name and row["size"] > self.piece:
                hasher = HASHES[self.hash_name]()
                while data := f.read(1 << 20):
                    hasher.update(data)
                row = row | {"hash": hasher.hexdigest()}
                f.seek(0)
            done = piece = 0
            while piece == 0 or done < row["size"]:
                data = f.read(min(self.piece, row["size"] - done))
                if self.hash_name and row["size"] <= self.piece:
                    row = row | {"hash": HASHES[self.hash_name](data).hexdigest()}
                done += len(data)
                if not data and done < row["size"] or done == row["size"] and f.read(1):
                    raise OSError(f"{row['abs']} changed size while it was read")
                yield (*row.values(), walk_id, piece, data)
                piece += 1


def raw_size(spark: SparkSession, paths: list[str]) -> DataFrame:
    """files, raw_bytes of regular files below the paths; what can't be read is left out, links are not followed."""
    spark.dataSource.register(FileTree)
    tree = spark.read.format("filetree").option("paths", json.dumps(paths)).option("ignoreErrors", "true").load()
    size = F.coalesce(F.sum("size"), F.lit(0)).cast("bigint")
    return tree.filter("kind = 'file'").agg(F.count("*").alias("files"), size.alias("raw_bytes"))
