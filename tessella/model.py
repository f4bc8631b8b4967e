"""Models: tables with columns, keys, relations and constraints, checked together; and the catalog that reads them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import DeclarationError
from .types import Type, of_spark, parse


def snake(name: str) -> str:
    """`OrderCount` -> `order_count`; the alias of a declared output."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


@dataclass(frozen=True)
class Column:
    """A column. `source` is an SQL expression over the stored columns, for derived columns; `default` a value or an SQL expression in `Sql`."""

    name: str
    type: Type | str
    nullable: bool = False
    default: Any = None
    generated: str | None = None
    immutable: bool = False
    version: bool = False
    identity: bool = False
    inc_when: str | None = None
    source: str | None = None
    comment: str = ""

    def __post_init__(self):
        object.__setattr__(self, "type", parse(self.type))


@dataclass(frozen=True)
class Sql:
    """An SQL expression as a default."""

    text: str


@dataclass(frozen=True)
class Relation:
    """`one`: `columns` here refer to `target_columns`. `many`: the target's `target_columns` refer to `columns` here.

    `link` names a linking table with `(columns here, columns there)`; then the relation is many to many.
    """

    name: str
    kind: str
    target: str
    columns: tuple[str, ...]
    target_columns: tuple[str, ...]
    link: str | None = None
    link_columns: tuple[tuple[str, ...], tuple[str, ...]] = ((), ())


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    target: str
    target_columns: tuple[str, ...]
    on_delete: str = "restrict"
    name: str = ""


@dataclass(frozen=True)
class Unique:
    """`columns` may be SQL expressions; `where` makes it partial; across soft-deleted rows only if it says so."""

    columns: tuple[str, ...]
    where: str | None = None
    across_deleted: bool = False
    nulls_distinct: bool = True
    name: str = ""


@dataclass(frozen=True)
class Check:
    expression: str
    name: str = ""


@dataclass(frozen=True)
class Exclude:
    """No two rows with equal `equal` columns may have overlapping ranges `[lower, upper)`."""

    equal: tuple[str, ...]
    lower: str
    upper: str
    where: str | None = None
    name: str = ""


@dataclass(frozen=True)
class Arc:
    """An exclusive reference: exactly one of the variants' columns is set. `variants`: name -> (column, target table)."""

    name: str
    variants: dict[str, tuple[str, str]]
    required: bool = True


@dataclass(frozen=True)
class AnyRef:
    """A `(type, id)` pair that may refer to any table; no key guards it, which `acknowledged` must say."""

    name: str
    type_column: str
    id_column: str
    acknowledged: bool = False


@dataclass(frozen=True)
class Index:
    """Kept as metadata; Spark has no indexes, and file statistics and partitioning take their place."""

    keys: tuple[str, ...]
    method: str = "btree"
    where: str | None = None
    include: tuple[str, ...] = ()


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    relations: tuple[Relation, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    uniques: tuple[Unique, ...] = ()
    checks: tuple[Check, ...] = ()
    excludes: tuple[Exclude, ...] = ()
    arcs: tuple[Arc, ...] = ()
    any_refs: tuple[AnyRef, ...] = ()
    indexes: tuple[Index, ...] = ()
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    soft_delete: str | None = None
    shard_key: str | None = None
    partition_by: tuple[str, ...] = ()
    probes: tuple[str, ...] = ()
    comment: str = ""

    @cached_property
    def by_name(self) -> dict[str, Column]:
        return {c.name: c for c in self.columns}

    def column(self, name: str) -> Column:
        if name not in self.by_name:
            raise DeclarationError(f"{self.name} has no column {name}")
        return self.by_name[name]

    def relation(self, name: str) -> Relation:
        for r in self.relations:
            if r.name == name:
                return r
        raise DeclarationError(f"{self.name} has no relation {name}")

    def problems(self, tables: dict[str, Table]) -> list[str]:
        """Everything wrong with the declaration."""
        out = []
        names = [c.name for c in self.columns]
        out += [f"{self.name}.{n} is declared twice" for n in sorted({n for n in names if names.count(n) > 1})]
        known = set(names)

        def needs(columns, what: str) -> None:
            out.extend(f"{self.name}: {what} names the unknown column {c}" for c in columns if c not in known)

        needs(self.primary_key, "the primary key")
        needs(self.partition_by, "the partitioning")
        needs([self.soft_delete] if self.soft_delete else [], "soft delete")
        needs([self.shard_key] if self.shard_key else [], "the shard key")
        out += [f"{self.name}.{c.name}: a version column is an integer" for c in self.columns if c.version and not c.type.is_("int4", "int8")]
        if sum(c.version for c in self.columns) > 1:
            out.append(f"{self.name} has two version columns")
        if self.soft_delete in known and not self.by_name[self.soft_delete].nullable:
            out.append(f"{self.name}.{self.soft_delete}: soft delete needs a nullable column")
        for fk in self.foreign_keys:
            needs(fk.columns, f"the foreign key to {fk.target}")
            if fk.target not in tables:
                out.append(f"{self.name}: a foreign key refers to the unknown table {fk.target}")
            elif len(fk.columns) != len(fk.target_columns):
                out.append(f"{self.name}: the foreign key to {fk.target} pairs {len(fk.columns)} with {len(fk.target_columns)} columns")
            else:
                out += [f"{fk.target} has no column {c}" for c in fk.target_columns if c not in tables[fk.target].by_name]
        for r in self.relations:
            if r.kind not in ("one", "many"):
                out.append(f"{self.name}.{r.name}: a relation is to one or to many")
            if r.target not in tables:
                out.append(f"{self.name}.{r.name} refers to the unknown table {r.target}")
                continue
            needs(r.columns, f"the relation {r.name}")
            out += [f"{self.name}.{r.name}: {r.target} has no column {c}" for c in r.target_columns if c not in tables[r.target].by_name]
            if r.link and r.link not in tables:
                out.append(f"{self.name}.{r.name}: unknown linking table {r.link}")
        for a in self.arcs:
            needs([c for c, _ in a.variants.values()], f"the arc {a.name}")
            if len(a.variants) < 2:
                out.append(f"{self.name}.{a.name}: an arc has two variants or more")
            out += [f"{self.name}.{a.name}: {c} must be nullable" for c, _ in a.variants.values() if c in known and not self.by_name[c].nullable]
        for x in self.any_refs:
            needs([x.type_column, x.id_column], f"the reference {x.name}")
            if not x.acknowledged:
                out.append(f"{self.name}.{x.name}: no key guards a reference to any table; acknowledge it")
        for n, labels in self.enums.items():
            needs([n], "an enum")
            if len(set(labels)) != len(labels) or not labels:
                out.append(f"{self.name}.{n}: an enum's labels are distinct and not empty")
        return out


class Catalog:
    """The checked tables and where their rows come from.

    Each source is a DataFrame, a path of Parquet files, or a function of the session. All reads go through `base` (every row)
    or `live` (without soft-deleted rows), so that no builder can forget either the derived columns or the deletions.
    """

    def __init__(self, spark: SparkSession, tables: list[Table], sources: dict[str, DataFrame | str | Callable[[SparkSession], DataFrame]]):
        self.spark = spark
        self.tables = {t.name: t for t in tables}
        problems = [f"the table {n} is declared twice" for n in sorted({t.name for t in tables if [x.name for x in tables].count(t.name) > 1})]
        for t in tables:
            problems += t.problems(self.tables)
        if problems:
            raise DeclarationError(problems)
        self.sources = sources

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise DeclarationError(f"no table {name}")
        return self.tables[name]

    def stored(self, name: str) -> DataFrame:
        source = self.sources[name]
        if isinstance(source, str):
            return self.spark.read.parquet(source)
        return source(self.spark) if callable(source) and not isinstance(source, DataFrame) else source

    def base(self, name: str) -> DataFrame:
        """Every row, with the declared columns in their order and types."""
        table, stored = self.table(name), self.stored(name)
        kinds = dict(stored.dtypes)
        out = []
        for c in table.columns:
            x = F.expr(c.source) if c.source else F.col(c.name)
            if c.source or kinds.get(c.name) != c.type.spark.simpleString():
                x = x.cast(c.type.spark)
            out.append(x.alias(c.name))
        return stored.select(*out)

    def live(self, name: str) -> DataFrame:
        deleted = self.table(name).soft_delete
        return self.base(name).where(F.col(deleted).isNull()) if deleted else self.base(name)

    def read(self, name: str, across_deleted: bool = False) -> DataFrame:
        return self.base(name) if across_deleted else self.live(name)

    def order_value(self, table: str, column: str, at: SparkColumn) -> SparkColumn:
        """What a column sorts by: an enum by the place of its label."""
        labels = self.table(table).enums.get(column)
        if not labels:
            return at
        place = F.lit(None).cast("int")
        for i, label in reversed(list(enumerate(labels))):
            place = F.when(at == label, F.lit(i)).otherwise(place)
        return place


def introspect(name: str, df: DataFrame, primary_key: tuple[str, ...] = ()) -> Table:
    """A table as its data declares itself."""
    return Table(name, tuple(Column(f.name, of_spark(f.dataType), f.nullable) for f in df.schema), primary_key)
