"""Writes as functions from a table's state to its next state. Parquet is immutable: a write gives a new state and its affected rows.

`Store` keeps versions of the states in directories and moves a pointer, so that a reader sees one version or the other.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import predicates as P
from ..errors import Conflict, ConstraintViolation, DeclarationError, NothingAssigned, PagedWrite, StaleWrite, UnfilteredWrite
from ..model import Catalog, Column, Sql, Table
from ..sources.tables import checkpointed
from .query import Query


@dataclass(frozen=True)
class Written:
    """The table's next state, and the rows that the write touched as they are after it (before it, for deletions)."""

    state: DataFrame
    affected: DataFrame

    def count(self) -> int:
        return self.affected.count()


def _value(c: Column, v: Any) -> SparkColumn:
    if isinstance(v, SparkColumn):
        return v.cast(c.type.spark)
    if isinstance(v, Sql):
        return F.expr(v.text).cast(c.type.spark)
    if v is None:
        if not c.nullable:
            raise ConstraintViolation("not_null", c.name, 1)
        return F.lit(None).cast(c.type.spark)
    return P.value_of(c.type, v, c.name).cast(c.type.spark) if not c.type.array else F.array(*map(F.lit, v)).cast(c.type.spark)


def now() -> Sql:
    return Sql("current_timestamp()")


def new_uuid() -> Sql:
    """A random UUID for each row, as a default."""
    return Sql("uuid()")


def plus(column: str, n: Any) -> SparkColumn:
    """Adds to a column's own value."""
    return F.col(column) + F.lit(n)


def plus_when(table: Table, column: str) -> SparkColumn:
    """One more where the column's declared guard holds."""
    guard = table.column(column).inc_when
    if not guard:
        raise DeclarationError(f"{table.name}.{column} declares no guarded increment")
    return F.col(column) + F.when(F.expr(guard), 1).otherwise(0)


def _generated(table: Table, df: DataFrame) -> DataFrame:
    for c in table.columns:
        if c.generated:
            df = df.withColumn(c.name, F.expr(c.generated).cast(c.type.spark))
    return df.select(*[c.name for c in table.columns])


def _next_identity(table: Table, state: DataFrame, rows: DataFrame, given: set[str], skip: int = 0) -> DataFrame:
    """Numbers identity columns after the largest, `skip` further. Rows are numbered in their partitions, and the partitions' counts added up."""
    for c in table.columns:
        if c.identity and c.name not in given:
            last = state.agg(F.coalesce(F.max(c.name), F.lit(0)).alias("last")).first()["last"] + skip
            held = checkpointed(rows.drop(c.name).withColumns({"part__": F.spark_partition_id(), "row__": F.monotonically_increasing_id()}))
            counts = held.groupBy("part__").agg(F.count(F.lit(1)).alias("n__"), F.min("row__").alias("least__"))  # a row a partition
            ahead = F.coalesce(F.sum("n__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            rows = held.join(counts.withColumn("ahead__", ahead), "part__")
            number = F.col("row__") - F.col("least__") + F.col("ahead__") + F.lit(last + 1)
            rows = rows.withColumn(c.name, number.cast(c.type.spark)).drop("part__", "row__", "n__", "least__", "ahead__")
    return rows


def insert(catalog: Catalog, name: str, *rows: dict[str, Any]) -> Written:
    """Rows of assigned columns; the others take their defaults. A zero or empty value that is assigned is written."""
    table, state = catalog.table(name), catalog.base(name)
    parts = []
    for number, row in enumerate(rows):
        if not row:
            raise NothingAssigned(f"an insert into {name} assigns nothing")
        for k in row:
            if table.column(k).generated:
                raise DeclarationError(f"{name}.{k} is generated")
        made = catalog.spark.range(1)
        for c in table.columns:
            if c.name in row:
                made = made.withColumn(c.name, _value(c, row[c.name]))
            elif c.default is not None:
                made = made.withColumn(c.name, _value(c, c.default))
            elif c.nullable or c.generated or c.identity:
                made = made.withColumn(c.name, F.lit(None).cast(c.type.spark))
            else:
                raise ConstraintViolation("not_null", f"{name}.{c.name}", 1)
        made = _next_identity(table, state, made, set(row), number)
        parts.append(_generated(table, made.drop("id") if "id" not in table.by_name else made))
    added = reduce(lambda a, b: a.unionByName(b), parts)
    return Written(state.unionByName(added), added)


def insert_all(catalog: Catalog, name: str, rows: DataFrame) -> Written:
    """A bulk load: columns that `rows` lacks take their defaults."""
    table, state = catalog.table(name), catalog.base(name)
    unknown = [c for c in rows.columns if c not in table.by_name]
    if unknown or not rows.columns:
        raise DeclarationError(f"{name} has no column {', '.join(unknown)}") if unknown else NothingAssigned(name)
    out = []
    for c in table.columns:
        if c.name in rows.columns:
            out.append(F.col(c.name).cast(c.type.spark).alias(c.name))
        else:
            out.append((_value(c, c.default) if c.default is not None else F.lit(None).cast(c.type.spark)).alias(c.name))
    added = _generated(table, _next_identity(table, state, rows.select(*out), set(rows.columns)))
    return Written(state.unionByName(added), added)


def insert_per(catalog: Catalog, name: str, source: Query, keys: dict[str, str], **fixed: Any) -> Written:
    """One row for each row that a query selects: `keys` maps columns here to columns there."""
    table = catalog.table(name)
    picked = source.df().select(*[F.col(b).alias(a) for a, b in keys.items()], *[_value(table.column(k), v).alias(k) for k, v in fixed.items()])
    return insert_all(catalog, name, picked)


def _assigned(table: Table, changes: dict[str, Any]) -> dict[str, SparkColumn]:
    if not changes:
        raise NothingAssigned(f"an update of {table.name} assigns nothing")
    for k in changes:
        c = table.column(k)
        if c.immutable or c.generated or k in table.primary_key:
            raise DeclarationError(f"{table.name}.{k} cannot be changed")
    return {k: _value(table.column(k), v) for k, v in changes.items()}


def _changed(table: Table, state: DataFrame, hit: SparkColumn, changes: dict[str, SparkColumn]) -> DataFrame:
    """Rows that `hit` holds for take the changes, and their version grows; one pass, no shuffle."""
    bump = {c.name: F.col(c.name) + 1 for c in table.columns if c.version}
    every = bump | changes
    marked = state.withColumn("hit__", F.coalesce(hit, F.lit(False)))
    out = [F.when(F.col("hit__"), every[c.name]).otherwise(F.col(c.name)).cast(c.type.spark).alias(c.name) if c.name in every else F.col(c.name) for c in table.columns]
    changed = marked.select(*out, "hit__")
    for c in table.columns:
        if c.generated:
            changed = changed.withColumn(c.name, F.expr(c.generated).cast(c.type.spark))
    return changed


def update_all(q: Query, **changes: Any) -> Written:
    """A set-based update of all live rows that the predicates keep."""
    _settable(q)
    table, state = q.table, q.catalog.base(q.name)
    out = _changed(table, state, _condition(q), _assigned(table, changes))
    columns = [c.name for c in table.columns]
    return Written(out.select(*columns), out.where("hit__").select(*columns))


def _settable(q: Query) -> None:
    if not q.preds and not q.filters:
        raise UnfilteredWrite(f"a write of all of {q.name} needs a predicate")
    if q.filters:
        raise DeclarationError("a set-based write takes predicates of its own table; use Exists for related rows")
    if q.offset_ or q.limit_ != 1000 or q.after_ is not None:
        raise PagedWrite(f"a write of {q.name} cannot be paged")


def _condition(q: Query) -> SparkColumn:
    hit = P.And(*q.preds).to_column(F.col)
    deleted = q.table.soft_delete
    return hit & F.col(deleted).isNull() if deleted and not q.deleted else hit


def delete_all(q: Query) -> Written:
    """Marks the rows where the table has soft delete, else removes them."""
    if q.table.soft_delete:
        _settable(q)
        table, state = q.table, q.catalog.base(q.name)
        kind = table.column(table.soft_delete).type
        out = _changed(table, state, _condition(q), {table.soft_delete: F.current_timestamp().cast(kind.spark)})
        columns = [c.name for c in table.columns]
        return Written(out.select(*columns), out.where("hit__").select(*columns))
    return hard_delete_all(q)


def hard_delete_all(q: Query) -> Written:
    _settable(q)
    state = q.catalog.base(q.name)
    hit = F.coalesce(_condition(q), F.lit(False))
    return Written(state.where(~hit), state.where(hit))


def restore_all(q: Query) -> Written:
    """Takes the deletion mark off."""
    table = q.table
    if not table.soft_delete:
        raise DeclarationError(f"{q.name} has no soft delete")
    _settable(q)
    state = q.catalog.base(q.name)
    none = F.lit(None).cast(table.column(table.soft_delete).type.spark)
    out = _changed(table, state, P.And(*q.preds).to_column(F.col) & F.col(table.soft_delete).isNotNull(), {table.soft_delete: none})
    columns = [c.name for c in table.columns]
    return Written(out.select(*columns), out.where("hit__").select(*columns))


def _key_condition(table: Table, key: dict[str, Any]) -> SparkColumn:
    if set(key) != set(table.primary_key):
        raise DeclarationError(f"{table.name} has the key {table.primary_key}")
    return reduce(lambda a, b: a & b, [F.col(k) == P.value_of(table.column(k).type, v, k) for k, v in key.items()])


def update(catalog: Catalog, name: str, key: dict[str, Any], *, version: int | None = None, **changes: Any) -> Written:
    """Changes one row by key. With a version, the row must still have it."""
    table, state = catalog.table(name), catalog.base(name)
    hit = _key_condition(table, key)
    versions = [c.name for c in table.columns if c.version]
    if version is not None:
        if not versions:
            raise DeclarationError(f"{name} has no version column")
        hit = hit & (F.col(versions[0]) == version)
    out = _changed(table, state, hit, _assigned(table, changes))
    columns = [c.name for c in table.columns]
    done = Written(out.select(*columns), out.where("hit__").select(*columns))
    if version is not None and done.affected.isEmpty():
        raise StaleWrite(f"{name} {key} doesn't have version {version}")
    return done


def delete(catalog: Catalog, name: str, key: dict[str, Any]) -> Written:
    table, state = catalog.table(name), catalog.base(name)
    hit = _key_condition(table, key)
    if table.soft_delete:
        out = _changed(table, state, hit & F.col(table.soft_delete).isNull(), {table.soft_delete: F.current_timestamp().cast(table.column(table.soft_delete).type.spark)})
        columns = [c.name for c in table.columns]
        return Written(out.select(*columns), out.where("hit__").select(*columns))
    return Written(state.where(~F.coalesce(hit, F.lit(False))), state.where(hit))


def take(q: Query, **changes: Any) -> Written:
    """Changes exactly the rows that a query selects, order, offset and limit included, and gives them back."""
    table, state = q.table, q.catalog.base(q.name)
    keys = list(table.primary_key)
    picked = q.df().select(*keys).withColumn("picked__", F.lit(True))
    marked = state.join(picked, keys, "left")
    out = _changed(table, marked, F.col("picked__"), _assigned(table, changes))
    columns = [c.name for c in table.columns]
    return Written(out.select(*columns), out.where("hit__").select(*columns))


def delete_batch(q: Query) -> Written:
    """Removes exactly the rows that a query selects."""
    keys = list(q.table.primary_key)
    state = q.catalog.base(q.name)
    picked = q.df().select(*keys)
    return Written(state.join(picked, keys, "left_anti").select(*state.columns), state.join(picked, keys, "left_semi").select(*state.columns))


def upsert(
    catalog: Catalog,
    name: str,
    rows: DataFrame,
    key: tuple[str, ...],
    *,
    accumulate: tuple[str, ...] = (),
    when: Callable[[Callable[[str], SparkColumn], Callable[[str], SparkColumn]], SparkColumn] | None = None,
) -> Written:
    """Inserts rows, or updates the assigned columns of those whose unique key exists.

    `key` names a unique key's columns or expressions. `accumulate` adds to the old value. `when` gets the old and the new row and says which
    updates happen. `rows` must hold each key once. Only columns of `rows` change; new rows take defaults for the rest.
    """
    table, state = catalog.table(name), catalog.base(name)
    if tuple(key) != tuple(table.primary_key) and tuple(key) not in {u.columns for u in table.uniques}:
        raise DeclarationError(f"{name} has no unique key {key}")
    assigned = [c for c in rows.columns]
    twice = rows.groupBy(*[F.expr(k).alias(f"k{i}") for i, k in enumerate(key)]).count().where("count > 1")
    if not twice.isEmpty():
        raise Conflict(f"the rows for {name} hold a key twice")
    old = state.select(*[F.col(c).alias(f"old__{c}") for c in state.columns], *[F.expr(k).alias(f"old_k{i}") for i, k in enumerate(key)], F.lit(True).alias("old__"))
    filled = insert_all(catalog, name, rows).affected
    new = filled.select(*[F.col(c).alias(f"new__{c}") for c in filled.columns], *[F.expr(k).alias(f"new_k{i}") for i, k in enumerate(key)], F.lit(True).alias("new__"))
    joined = old.join(new, [F.col(f"old_k{i}") == F.col(f"new_k{i}") for i in range(len(key))], "full")
    both = F.col("old__").isNotNull() & F.col("new__").isNotNull()
    if when is not None:
        both = both & F.coalesce(when(lambda c: F.col(f"old__{c}"), lambda c: F.col(f"new__{c}")), F.lit(False))
    fresh = F.col("old__").isNull()
    versions = {c.name for c in table.columns if c.version}
    out = []
    for c in table.columns:
        was, is_ = F.col(f"old__{c.name}"), F.col(f"new__{c.name}")
        if c.name in accumulate:
            changed = was + is_
        elif c.name in assigned and c.name not in key and not c.immutable:
            changed = is_
        elif c.name in versions:
            changed = was + 1
        else:
            changed = was
        out.append(F.when(fresh, is_).when(both, changed).otherwise(was).cast(c.type.spark).alias(c.name))
    result = joined.select(*out, (fresh | both).alias("hit__"))
    for c in table.columns:
        if c.generated:
            result = result.withColumn(c.name, F.when(F.col("hit__"), F.expr(c.generated).cast(c.type.spark)).otherwise(F.col(c.name)))
    columns = [c.name for c in table.columns]
    return Written(result.select(*columns), result.where("hit__").select(*columns))


def insert_if_absent(catalog: Catalog, name: str, rows: DataFrame, key: tuple[str, ...], *, strict: bool = False) -> Written:
    """Inserts the rows whose key is new. `strict` makes an existing key an error."""
    state = catalog.base(name)
    new = insert_all(catalog, name, rows).affected
    on = state.select(*[F.expr(k).alias(f"k{i}") for i, k in enumerate(key)])
    keyed = new.select("*", *[F.expr(k).alias(f"own{i}") for i, k in enumerate(key)])
    absent = keyed.join(on, [keyed[f"own{i}"] == on[f"k{i}"] for i in range(len(key))], "left_anti").select(*new.columns)
    if strict and absent.count() < new.count():
        raise Conflict(f"{name} has rows with these keys")
    return Written(state.unionByName(absent), absent)


def tally(q: Query, relation: str, column: str, children: DataFrame, fixed: int | None = None) -> Written:
    """Adds to each row's column the number of its rows among `children`, which another write has touched."""
    table = q.table
    r = table.relation(relation)
    counts = children.groupBy(*r.target_columns).agg((F.count(F.lit(1)) if fixed is None else F.lit(fixed)).alias("tally__"))
    state = q.catalog.base(q.name)
    counts = counts.withColumnsRenamed({c: f"of__{c}" for c in r.target_columns})
    joined = state.join(counts, [state[a] == counts[f"of__{b}"] for a, b in zip(r.columns, r.target_columns)], "left")
    out = _changed(table, joined, F.col("tally__").isNotNull(), {column: F.col(column) + F.col("tally__")})
    columns = [c.name for c in table.columns]
    return Written(out.select(*columns), out.where("hit__").select(*columns))


# constraints
def check(catalog: Catalog, name: str, state: DataFrame | None = None) -> None:
    """Raises the first declared constraint that the state breaks."""
    table = catalog.table(name)
    state = catalog.base(name) if state is None else state

    def broken(kind: str, what: str, bad: DataFrame) -> None:
        if n := bad.count():
            raise ConstraintViolation(kind, what, n)

    live = state.where(F.col(table.soft_delete).isNull()) if table.soft_delete else state
    for c in table.columns:
        if not c.nullable:
            broken("not_null", f"{name}.{c.name}", state.where(F.col(c.name).isNull()))
    keys = [(u.columns, u.where, u.across_deleted, u.nulls_distinct, u.name) for u in table.uniques]
    if table.primary_key:
        keys.append((table.primary_key, None, True, True, f"{name}_pkey"))
    for columns, where, across, distinct, label in keys:
        rows = state if across else live
        rows = rows.where(where) if where else rows
        keyed = rows.select(*[F.expr(k).alias(f"k{i}") for i, k in enumerate(columns)])
        if distinct:
            keyed = keyed.dropna()
        broken("unique", label or f"{name}({', '.join(columns)})", keyed.groupBy(*keyed.columns).count().where("count > 1"))
    for x in table.checks:
        broken("check", x.name or x.expression, state.where(~F.expr(x.expression)))
    for a in table.arcs:
        n = reduce(lambda p, q: p + q, [F.col(c).isNotNull().cast("int") for c, _ in a.variants.values()])
        broken("check", f"{name}.{a.name}", state.where(n != 1 if a.required else n > 1))
    for fk in table.foreign_keys:
        target = catalog.base(fk.target).select(*[F.col(c).alias(f"fk__{c}") for c in fk.target_columns])
        rows = state.dropna(subset=list(fk.columns))
        on = [rows[a] == target[f"fk__{b}"] for a, b in zip(fk.columns, fk.target_columns)]
        broken("foreign_key", fk.name or f"{name}({', '.join(fk.columns)})", rows.join(target, on, "left_anti"))
    for x in table.excludes:
        broken("exclusion", x.name or f"{name} excludes", overlapping(state.where(x.where) if x.where else state, x.equal, x.lower, x.upper))


def overlapping(rows: DataFrame, equal: tuple[str, ...], lower: str, upper: str, *, block_days: int = 30) -> DataFrame:
    """Rows whose range `[lower, upper)` overlaps that of a row before it, by start, end and the other columns, with the same keys.

    The running largest end of the rows before tells it: no pairs are made. Rows are cut into blocks of time by their start; each block
    starts from the largest end of the blocks before, so neither one key nor a table without keys is one task's work.
    """
    first, far = (F.to_timestamp_ntz(F.lit(x)) for x in ("0001-01-01 00:00:00", "9999-12-31 00:00:00"))
    start = F.coalesce(F.col(lower).cast("timestamp_ntz"), first)
    kept = rows.where(F.coalesce(F.col(lower) < F.col(upper), F.lit(True)))
    kept = kept.withColumns({"end__": F.coalesce(F.col(upper).cast("timestamp_ntz"), far), "block__": F.floor(F.date_diff(start, F.lit("1970-01-01").cast("date")) / block_days)})
    blocks = kept.groupBy(*equal, "block__").agg(F.max("end__").alias("most__"))
    before = Window.partitionBy(*equal).orderBy("block__").rowsBetween(Window.unboundedPreceding, -1)  # over a row a block
    names = [f"of__{i}" for i in range(len(equal) + 1)]
    carried = blocks.select(*[F.col(c).alias(n) for c, n in zip((*equal, "block__"), names)], F.max("most__").over(before).alias("carried__"))
    on = [kept[c].eqNullSafe(carried[n]) for c, n in zip((*equal, "block__"), names)]
    others = [c for c, kind in rows.dtypes if c not in (*equal, lower, upper) and not kind.startswith(("map", "variant"))]
    inside = Window.partitionBy(*equal, "block__").orderBy(F.col(lower).asc_nulls_first(), F.col(upper).asc_nulls_last(), *others)
    ended = F.greatest(F.max("end__").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("carried__"))
    found = kept.join(carried, on).drop(*names).withColumn("ended__", ended)
    return found.where(start < F.col("ended__")).select(*rows.columns)


def cascade(catalog: Catalog, name: str, removed: DataFrame) -> dict[str, DataFrame]:
    """The next states of all tables whose foreign keys follow the removal of rows: cascade, set_null, or restrict."""
    out: dict[str, DataFrame] = {}
    for t in catalog.tables.values():
        for fk in t.foreign_keys:
            if fk.target != name:
                continue
            state = out.get(t.name, catalog.base(t.name))
            gone = removed.select(*[F.col(c).alias(f"gone__{c}") for c in fk.target_columns]).distinct()
            on = [state[a] == gone[f"gone__{b}"] for a, b in zip(fk.columns, fk.target_columns)]
            hit = state.join(gone, on, "left_semi")
            if fk.on_delete == "cascade":
                out[t.name] = state.join(gone, on, "left_anti")
                if t.name != name:
                    out |= cascade(catalog, t.name, hit)
            elif fk.on_delete == "set_null":
                marked = state.join(gone.withColumn("hit__", F.lit(True)), on, "left")
                out[t.name] = marked.select(*[F.when(F.col("hit__").isNull(), F.col(c)).alias(c) if c in fk.columns else F.col(c) for c in state.columns])
            elif n := hit.count():
                raise ConstraintViolation("foreign_key", fk.name or f"{t.name}({', '.join(fk.columns)})", n)
    return out


def write_order(catalog: Catalog, names: list[str]) -> list[str]:
    """Tables so that each comes after those that it refers to; a cycle is an error."""
    out: list[str] = []
    held: set[str] = set()

    def visit(n: str) -> None:
        if n in out:
            return
        if n in held:
            raise DeclarationError(f"foreign keys go round through {n}")
        held.add(n)
        for fk in catalog.table(n).foreign_keys:
            if fk.target in names and fk.target != n:
                visit(fk.target)
        out.append(n)

    for n in names:
        visit(n)
    return out


class Store:
    """Versions of tables under a folder. `commit` writes all new states and then the pointer that makes them current."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def pointer(self) -> dict[str, str]:
        try:
            row = self.spark.read.json(f"{self.folder}/current").orderBy(F.col("version").desc()).first()
        except Exception as e:  # no commit yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return {}
        return {x["name"]: x["path"] for x in row["tables"]}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.pointer()[name])

    def commit(self, states: dict[str, DataFrame], version: int) -> None:
        """`version` is the writer's own next number: the largest one is current."""
        paths = self.pointer()
        for name, state in states.items():
            path = f"{self.folder}/{name}/{version}-{uuid.uuid4().hex}"
            state.write.parquet(path)
            paths[name] = path
        made = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("path")) for n, p in paths.items()])
        self.spark.range(1).select(F.lit(version).alias("version"), made.alias("tables")).coalesce(1).write.mode("append").json(f"{self.folder}/current")
