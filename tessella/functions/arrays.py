"""Containment of arrays as sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values: list, element: str) -> Column:
    return F.array(*[F.lit(v).cast(element) for v in values]).cast(f"array<{element}>")


def contains(array: Column, values: Column) -> Column:
    """Every value is an element; no values are in every array."""
    return F.when(array.isNotNull(), F.size(F.array_except(values, array)) == 0)


def contained_by(array: Column, values: Column) -> Column:
    return F.when(array.isNotNull(), F.size(F.array_except(array, values)) == 0)


def overlaps(array: Column, values: Column) -> Column:
    return F.when(array.isNotNull(), F.coalesce(F.arrays_overlap(array, values), F.lit(False)))
