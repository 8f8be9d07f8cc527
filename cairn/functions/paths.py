"""Path expressions: extension, sort key, safety reasons and selector matching, all as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; lower() would change É as well."""
    return F.translate(c, UPPER, LOWER)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Everything before the last slash; the empty string where there is none."""
    return F.when(F.instr(path, "/") > 0, F.left(path, F.length(path) - F.length(basename(path)) - 1)).otherwise("")


def extension(path: Column) -> Column:
    """ASCII-lower-cased text after the last dot of the name without its leading dots; null if there is none."""
    name = F.ltrim(basename(path), F.lit("."))
    return F.when(F.instr(name, ".") > 0, F.nullif(ascii_lower(F.substring_index(name, ".", -1)), F.lit("")))


def invalid_reason(path: Column) -> Column:
    """Why a stored path may not be used, in checking order; null if it is safe."""
    component = lambda x: (
        F.when(x == "..", "parent").when((x == "") | (x == "."), "component").when(F.instr(x, "\\") > 0, "backslash")
    )
    by_part = F.filter(F.transform(F.split(path, "/"), component), lambda x: x.isNotNull())
    return (
        F.when(path == "", "empty")
        .when(path.startswith("/") | path.startswith("\\"), "absolute")
        .when(F.substring(F.encode(path, "UTF-8"), 2, 1) == F.lit(bytearray(b":")), "drive")
        .otherwise(F.get(by_part, F.lit(0)))
    )


def join_depth_ok(path: Column) -> Column:
    """Safe path whose component depth never falls below the destination."""
    step = lambda acc, x: F.when((acc < 0) | (x == "..") & (acc == 0), F.lit(-1)).when(x == "..", acc - 1).otherwise(acc + 1)
    return invalid_reason(path).isNull() & (F.aggregate(F.split(path, "/"), F.lit(0), step) >= 0)


def matches(path: Column, pattern: Column) -> Column:
    """The pattern without trailing slashes names the path or one of its ancestors; an empty pattern matches nothing."""
    p = F.rtrim(pattern, F.lit("/"))
    return (p != "") & ((path == p) | F.startswith(path, F.concat(p, F.lit("/"))))


def matches_any(path: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (matches(path, F.lit(p)) for p in patterns), F.lit(False))


def ancestors(path: Column) -> Column:
    """All proper ancestor directories, nearest last."""
    parts = F.split(path, "/")
    prefix = lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), prefix)).otherwise(F.array().cast("array<string>"))
