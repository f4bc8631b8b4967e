"""Bounded traversal of a self-referring table: descendants and ancestors, with a guard against cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DeclarationError, QueryError
from ..model import Catalog, Relation
from ..sources.tables import checkpointed

#: A level is broadcast up to so many rows; a larger one and the table are shuffled.
BROADCAST_ROWS = 20_000


def self_relation(catalog: Catalog, table: str) -> Relation:
    """The one relation to one that refers to the table itself."""
    found = [r for r in catalog.table(table).relations if r.kind == "one" and r.target == table and not r.link]
    if len(found) != 1:
        raise DeclarationError(f"{table} has {len(found)} references to itself; a traversal needs exactly one")
    if len(found[0].columns) != 1:
        raise DeclarationError(f"{table} refers to itself by several columns")
    return found[0]


def _walk(catalog: Catalog, table: str, roots: list, max_depth: int, down: bool) -> DataFrame:
    if max_depth <= 0:
        raise QueryError("a traversal needs a depth of 1 or more")
    r = self_relation(catalog, table)
    (parent,), (key,) = r.columns, r.target_columns
    rows = catalog.live(table)  # deleted rows end a path, as start and as step
    columns = rows.columns
    level = rows.where(F.col(key).isin(list(roots))).select(*columns, F.lit(1).alias("depth"), F.array(key).alias("path"))
    level = checkpointed(level)
    out = level
    steps = rows.select(*[F.col(c).alias(f"next__{c}") for c in columns])
    for depth in range(2, max_depth + 1):
        # Spark takes a checkpoint for as large as its plan might have been, and would broadcast the table in its place
        if level.count() <= BROADCAST_ROWS:
            level, table_ = F.broadcast(level), steps
        else:
            table_ = steps.hint("merge")
        on = steps[f"next__{parent}"] == level[key] if down else steps[f"next__{key}"] == level[parent]
        level = level.join(table_, on).where(~F.array_contains("path", F.col(f"next__{key}")))
        level = level.select(
            *[F.col(f"next__{c}").alias(c) for c in columns], F.lit(depth).alias("depth"), F.array_append("path", F.col(f"next__{key}")).alias("path")
        )
        level = checkpointed(level)  # each level is computed once, from the one before
        if level.isEmpty():
            break
        out = out.unionAll(level)
    return out


def descend(catalog: Catalog, table: str, roots: list, max_depth: int) -> DataFrame:
    """The roots, at depth 1, and all below them down to `max_depth`; `path` holds the keys from the root."""
    return _walk(catalog, table, roots, max_depth, True)


def ascend(catalog: Catalog, table: str, roots: list, max_depth: int) -> DataFrame:
    """The roots and their ancestors."""
    return _walk(catalog, table, roots, max_depth, False)
