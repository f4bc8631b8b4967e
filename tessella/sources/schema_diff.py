"""How stored tables differ from their declarations, and the statements that a table format with DDL would need to follow."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as S

from ..model import Catalog, Table


@dataclass(frozen=True)
class Change:
    """`kind`: add, drop, retype, loosen (nulls become allowed) or tighten (nulls become forbidden)."""

    table: str
    kind: str
    column: str
    detail: str = ""

    @property
    def statement(self) -> str:
        at = f"ALTER TABLE {self.table}"
        return {
            "add": f"{at} ADD COLUMN {self.column} {self.detail}",
            "drop": f"{at} DROP COLUMN {self.column}",
            "retype": f"{at} ALTER COLUMN {self.column} TYPE {self.detail}",
            "loosen": f"{at} ALTER COLUMN {self.column} DROP NOT NULL",
            "tighten": f"{at} ALTER COLUMN {self.column} SET NOT NULL",
        }[self.kind]


def diff(table: Table, stored: DataFrame | S.StructType, *, nulls: bool = False) -> list[Change]:
    """Stored columns against declared ones, in declared order, then those that no declaration names.

    Derived columns (`source`) are not stored. Parquet holds all columns as nullable, so nullability is compared only on request.
    """
    fields = {f.name: f for f in (stored.schema if isinstance(stored, DataFrame) else stored)}
    out = []
    for c in table.columns:
        if c.source:
            continue
        kind = c.type.spark if isinstance(c.type.spark, S.DataType) else S._parse_datatype_string(c.type.spark)
        f = fields.pop(c.name, None)
        if f is None:
            out.append(Change(table.name, "add", c.name, kind.simpleString()))
            continue
        if f.dataType.simpleString() != kind.simpleString():
            out.append(Change(table.name, "retype", c.name, kind.simpleString()))
        if nulls and f.nullable != c.nullable:
            out.append(Change(table.name, "loosen" if c.nullable else "tighten", c.name))
    return out + [Change(table.name, "drop", n) for n in fields]


def drift(catalog: Catalog, names: list[str] | None = None) -> list[Change]:
    """All changes between the catalog's declarations and what its sources hold."""
    return [x for n in (names or catalog.tables) for x in diff(catalog.table(n), catalog.stored(n))]
