"""The first rows of each group: top-N per parent, distinct on, and round-robin turns.

All three number rows in a window; Spark prunes each task's groups to the wanted rows before it shuffles them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QueryError
from .query import Query

_ROW = "topn__row"


def _numbered(q: Query, df: DataFrame, keys: list) -> DataFrame:
    return df.withColumn(_ROW, F.row_number().over(Window.partitionBy(*keys).orderBy(*q.sort_columns())))


def top_n_per_parent(q: Query, foreign_key: str, n: int, parents: list | None = None) -> DataFrame:
    """The first `n` rows of each parent in the query's order, with `turn` from 1. The query's own limit does not apply."""
    if n < 1:
        raise QueryError("top-N needs an N of 1 or more")
    if not q.effective_order:
        raise QueryError("top-N needs an order")
    q.table.column(foreign_key)
    df = q.matching()
    if parents is not None:
        df = df.where(q[foreign_key].in_(parents).to_column(F.col))
    rows = _numbered(q, df.where(F.col(foreign_key).isNotNull()), [foreign_key]).where(F.col(_ROW) <= n)
    return rows.select(*[c.name for c in q.table.columns], F.col(_ROW).cast("long").alias("turn"))


def distinct_on(q: Query, n: int) -> DataFrame:
    """The first row, in the query's order, of each combination of its first `n` order terms; then order and paging."""
    order = q.order_terms
    if not 1 <= n <= len(order):
        raise QueryError("distinct on takes 1 to all of the query's order terms")
    rows = _numbered(q, q.matching(), [t.name for t in order[:n]]).where(F.col(_ROW) == 1).drop(_ROW)
    rows = rows.orderBy(*q.sort_columns())
    if q.offset_:
        rows = rows.offset(q.offset_)
    return rows if q.limit_ is None else rows.limit(q.limit_)


def turns(q: Query, group: str, groups: Query, start=None, n_groups: int = 100, per_group: int | None = None) -> DataFrame:
    """Round robin: the first rows of each group, then their second rows, and so on, with `turn`.

    `groups` chooses the groups; at most `n_groups` of them take part, from `start` on and round again from the first.
    The query's limit bounds the result. A null group is a group.
    """
    if n_groups < 1:
        raise QueryError("turns need a group or more")
    found = groups.matching().select(F.col(group).alias("turn__group")).distinct()
    key = F.col("turn__group")
    before = F.lit(False) if start is None else F.coalesce(key < F.lit(start), F.lit(False))
    chosen = found.orderBy(before.asc(), key.asc_nulls_last()).limit(n_groups)
    rows = q.matching()
    rows = rows.join(chosen, rows[group].eqNullSafe(chosen["turn__group"]), "left_semi")
    rows = _numbered(q, rows, [group])
    # turn t of a group has at least t - 1 rows before it, so later turns than the limit's last row can't be in the result
    last = [n for n in (per_group, None if q.limit_ is None else q.limit_ + (q.offset_ or 0)) if n is not None]
    if last:
        rows = rows.where(F.col(_ROW) <= min(last))
    rows = rows.select(*[c.name for c in q.table.columns], F.col(_ROW).cast("long").alias("turn"))
    rows = rows.orderBy("turn", *q.sort_columns())
    if q.offset_:
        rows = rows.offset(q.offset_)
    return rows if q.limit_ is None else rows.limit(q.limit_)
