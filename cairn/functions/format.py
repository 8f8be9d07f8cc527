"""Report formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
UNITS = ["KB", "MB", "GB", "TB", "PB"]


def human(n: Column, top: str = "PB") -> Column:
    """1024-based size: plain bytes, else one decimal rounded half to even; the largest unit takes the rest."""
    units = UNITS[: UNITS.index(top) + 1]
    expr = None
    for i in range(len(units) - 1, -1, -1):
        text = F.format_string(f"%.1f {units[i]}", F.bround(n / F.lit(float(1024 ** (i + 1))), 1))
        expr = text if expr is None else F.when(n < 1024 ** (i + 2), text).otherwise(expr)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(expr)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def octal_mode(mode: Column) -> Column:
    return F.conv(mode.bitwiseAND(511).cast("string"), 10, 8)


def human_text(n: float) -> str:
    """Plain-Python form of human(), for messages."""
    n = int(n)
    if n < 1024:
        return f"{n} B"
    i = min(len(UNITS), (n.bit_length() - 1) // 10)
    return f"{n / 1024**i:.1f} {UNITS[i - 1]}"
