"""Lanes, codecs, levels and presets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.paths import basename, dirname, extension

COMPRESS, FAST = 0, 1

# Extensions of formats that are compressed already.
PRECOMPRESSED = (
    "jpg jpeg jpe jxl png gif webp heic heif avif jp2 "
    "mp4 m4v mov mkv webm avi wmv flv mpg mpeg m2ts ts 3gp "
    "mp3 aac m4a ogg oga opus flac wma ape "
    "gz tgz bz2 xz zst lz4 lzma br 7z rar "
    "woff woff2"
).split()
#: The container's own extension counts as compressed too.
OWN_EXTENSION = "cairn"

# Codec ids, names and accepted aliases; presets; default levels.
CODECS = {0: "store", 1: "zstd", 2: "xz"}
ALIASES = {"store": 0, "none": 0, "zstd": 1, "xz": 2, "lzma": 2, "lzma2": 2}
PRESETS = {"fast": (1, 3), "balanced": (1, 12), "max": (2, 9)}
DEFAULT_LEVEL = {0: 0, 1: 12, 2: 6}


def lane(path: Column) -> Column:
    return F.when(extension(path).isin(*PRECOMPRESSED, OWN_EXTENSION), FAST).otherwise(COMPRESS)


def sort_key(path: Column) -> list[Column]:
    """Pack order. Strings compare as UTF-8 bytes; dir before name is not the same as the whole path."""
    return [lane(path), F.coalesce(extension(path), F.lit("")), dirname(path), basename(path)]


def codec_id(name: Column) -> Column:
    """Id of a codec name or alias; null if unknown."""
    from cairn.functions.paths import ascii_lower

    table = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.try_element_at(table, ascii_lower(name))


def codec_name(codec: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in CODECS.items() for x in kv]), codec.cast("int"))


def lane_codec(lane_: Column, codec: int, level: int) -> tuple[Column, Column]:
    """The fast lane always gets zstd level 1; the other lane what the user asked for."""
    return F.when(lane_ == FAST, 1).otherwise(codec), F.when(lane_ == FAST, 1).otherwise(level)


def window_log(block_size: Column) -> Column:
    """Smallest log of at least 10 whose power of two holds the block, at most 27; integer steps, no float logarithm."""
    expr = F.lit(27)
    for log in range(26, 9, -1):
        expr = F.when(block_size <= (1 << log), log).otherwise(expr)
    return expr


def resolved(preset: Column, codec: Column, level: Column) -> tuple[Column, Column]:
    """Codec id and level of choices in rows, as resolve() has them; null where that refuses them."""
    names = F.create_map(*[F.lit(x) for name, (c, _) in PRESETS.items() for x in (name, c)])
    levels = F.create_map(*[F.lit(x) for name, (_, lv) in PRESETS.items() for x in (name, lv)])
    default = F.create_map(*[F.lit(x) for kv in DEFAULT_LEVEL.items() for x in kv])
    own = codec_id(F.coalesce(codec, F.lit("zstd")))
    alone = codec.isNull() & level.isNull()
    by_name = F.when(alone, F.try_element_at(names, preset)), F.when(alone, F.try_element_at(levels, preset))
    by_codec = own, F.when(own.isNotNull(), F.coalesce(level, F.try_element_at(default, own)))
    return tuple(F.when(preset.isNotNull(), a).otherwise(b) for a, b in zip(by_name, by_codec, strict=True))


def resolve(preset: str | None = None, codec: str | None = None, level: int | None = None) -> tuple[int, int]:
    """(codec id, level) from command-line choices."""
    if preset is not None:
        if codec is not None or level is not None:
            raise ValueError("a preset excludes codec and level")
        if preset not in PRESETS:
            raise ValueError(f"unknown preset {preset!r}")
        return PRESETS[preset]
    key = (codec or "zstd").translate({i: i + 32 for i in range(65, 91)})
    if key not in ALIASES:
        raise ValueError(f"unknown codec {codec!r}")
    return ALIASES[key], DEFAULT_LEVEL[ALIASES[key]] if level is None else level
