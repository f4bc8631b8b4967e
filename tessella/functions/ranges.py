"""Time ranges as structs: bounds, whether each is inclusive or infinite, and whether the range is empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def time_range(lower: Column, upper: Column, bounds: str = "[)") -> Column:
    """The range between two timestamps; a null bound is infinite (and then never inclusive).

    A range whose bounds are equal but not both inclusive is empty; bounds the wrong way round fail, as a range cannot be so.
    """
    if bounds not in ("[)", "[]", "(]", "()"):
        raise ValueError(f"bounds are [), [], (] or (): {bounds!r}")
    low, high = lower.cast("timestamp_ntz"), upper.cast("timestamp_ntz")
    empty = F.coalesce(low == high, F.lit(False)) & F.lit(bounds != "[]")
    wrong = F.raise_error(F.lit("a range's lower bound is above its upper bound")).cast("boolean")
    return F.struct(
        F.when(~empty, low).alias("lower"),
        F.when(~empty, high).alias("upper"),
        (F.lit(bounds[0] == "[") & low.isNotNull() & ~empty).alias("lower_inc"),
        (F.lit(bounds[1] == "]") & high.isNotNull() & ~empty).alias("upper_inc"),
        low.isNull().alias("lower_inf"),
        high.isNull().alias("upper_inf"),
        F.when(low > high, wrong).otherwise(empty).alias("empty"),
    )


def _starts_by_end(a: Column, b: Column) -> Column:
    """a starts before b ends, or where it ends if both hold that point."""
    touch = (a["lower"] == b["upper"]) & a["lower_inc"] & b["upper_inc"]
    return a["lower_inf"] | b["upper_inf"] | (a["lower"] < b["upper"]) | touch


def overlaps(a: Column, b: Column) -> Column:
    return ~a["empty"] & ~b["empty"] & _starts_by_end(a, b) & _starts_by_end(b, a)


def contains(a: Column, b: Column) -> Column:
    """Every point of b is in a. The empty range is in every range."""
    low = a["lower_inf"] | (~b["lower_inf"] & ((a["lower"] < b["lower"]) | ((a["lower"] == b["lower"]) & (a["lower_inc"] | ~b["lower_inc"]))))
    high = a["upper_inf"] | (~b["upper_inf"] & ((a["upper"] > b["upper"]) | ((a["upper"] == b["upper"]) & (a["upper_inc"] | ~b["upper_inc"]))))
    return b["empty"] | (~a["empty"] & low & high)
