"""Scalar functions whose Spark forms differ from the declared semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The units that timestamps are truncated to.
TRUNC_UNITS = (
    "microseconds", "milliseconds", "second", "minute", "hour", "day", "week", "month", "quarter", "year", "decade", "century", "millennium",
)
# Fixed values end.


def date_trunc(unit: str, at: Column, zoned: bool = False) -> Column:
    """Truncation that keeps the kind of timestamp. Centuries and millennia begin in their first year, 2001."""
    if unit not in TRUNC_UNITS:
        raise ValueError(f"{unit!r} is not a unit of date_trunc")
    kind = "timestamp" if zoned else "timestamp_ntz"
    if unit in ("decade", "century", "millennium"):
        y = F.year(at)
        size = {"decade": 10, "century": 100, "millennium": 1000}[unit]
        first = F.floor(y / size) * size if unit == "decade" else F.floor((y - 1) / size) * size + 1
        return F.when(at.isNotNull(), F.make_date(first.cast("int"), F.lit(1), F.lit(1)).cast(kind))
    return F.date_trunc(unit.removesuffix("s") if unit.endswith("seconds") else unit, at).cast(kind)


def div(left: Column, right: Column, scale: int = 6) -> Column:
    """Exact division rounded half away from zero to `scale` places; division by zero fails."""
    if not 0 <= scale <= 12:
        raise ValueError("a scale is 0 to 12")
    return F.round(left.cast(f"decimal(38,{scale + 4})") / right.cast("decimal(38,6)"), scale).cast(f"decimal(38,{scale})")
