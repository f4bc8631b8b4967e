"""Single-table reads with dynamic predicates, deterministic order, and offset or keyset paging."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any as AnyValue

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .. import predicates as P
from ..errors import QueryError, Refused
from ..model import Catalog, Table
from .ordering import Term, terms

DEFAULT_LIMIT = 1000
MAX_ORDER_TERMS = 4


@dataclass(frozen=True)
class Query:
    """An immutable read of a table. Each method returns a narrowed or reordered copy.

    Without an order rows come by primary key; without a limit there are at most 1,000; counts and existence ignore both.
    """

    catalog: Catalog
    name: str
    preds: tuple[P.Pred, ...] = ()
    order_terms: tuple[Term, ...] = ()
    unordered_: bool = False
    limit_: int | None = DEFAULT_LIMIT
    offset_: int = 0
    after_: tuple | None = None
    columns: tuple[str, ...] | None = None
    deleted: bool = False
    filters: tuple[Callable[[DataFrame], DataFrame], ...] = ()

    @property
    def table(self) -> Table:
        return self.catalog.table(self.name)

    def __getitem__(self, column: str) -> P.Handle:
        return P.Handle(self.table, column)

    def __getattr__(self, name: str):
        """`q.o_orderstatus_eq(v)`: a column's predicate, ANDed."""
        if name.startswith("_"):
            raise AttributeError(name)
        for op in sorted(P.APPLIES, key=len, reverse=True):
            op = op.rstrip("_")
            column = name.removesuffix(f"_{op}")
            if column != name and column in self.table.by_name:
                handle = self[column]
                method = getattr(handle, op, None) or getattr(handle, f"{op}_")
                return lambda *args: self.where(method(*args))
        raise AttributeError(name)

    # predicates
    def where(self, *preds: P.Pred) -> Query:
        return replace(self, preds=self.preds + P.checked(preds))

    def where_if(self, condition: bool, pred: Callable[[], P.Pred] | P.Pred) -> Query:
        return self.where(pred() if callable(pred) else pred) if condition else self

    def when_set(self, value: AnyValue, pred: Callable[[AnyValue], P.Pred]) -> Query:
        return self if value is None else self.where(pred(value))

    def any(self, *preds: P.Pred) -> Query:
        return self.where(P.Any(*preds))

    def not_(self, pred: P.Pred) -> Query:
        return self.where(P.Not(pred))

    def not_any(self, *preds: P.Pred) -> Query:
        return self.where(P.NotAny(*preds))

    def any_of(self, *groups: P.And) -> Query:
        return self.where(P.AnyOf(*groups))

    def not_any_of(self, *groups: P.And) -> Query:
        return self.where(P.NotAnyOf(*groups))

    # order and paging
    def order(self, *given: Term) -> Query:
        found = self.order_terms + terms(given)
        if len(found) > MAX_ORDER_TERMS:
            raise QueryError(f"at most {MAX_ORDER_TERMS} sort terms")
        for t in given:
            self.table.column(t.name)
        return replace(self, order_terms=found)

    def unordered(self) -> Query:
        """Without the default order; an order that was asked for stays."""
        return replace(self, unordered_=True)

    def limit(self, n: int | None) -> Query:
        if n is not None and n < 0:
            raise QueryError("a limit is 0 or more")
        return replace(self, limit_=n)

    def offset(self, n: int) -> Query:
        if n < 0:
            raise QueryError("an offset is 0 or more")
        return replace(self, offset_=n)

    def after(self, row: Row | dict) -> Query:
        """The rows that come after `row` in the query's order: a page by key."""
        values = row.asDict() if isinstance(row, Row) else dict(row)
        return replace(self, after_=tuple(sorted(values.items(), key=lambda kv: kv[0])))

    def project(self, *columns: str) -> Query:
        for c in columns:
            self.table.column(c)
        return replace(self, columns=tuple(columns))

    def with_deleted(self) -> Query:
        return replace(self, deleted=True)

    def through(self, narrow: Callable[[DataFrame], DataFrame]) -> Query:
        """A semi- or anti-join that a probe adds."""
        return replace(self, filters=self.filters + (narrow,))

    def for_update(self, *_: AnyValue) -> Query:
        raise Refused("row locks: Spark has none")

    for_share = for_no_key_update = for_update

    # plans
    @property
    def effective_order(self) -> tuple[Term, ...]:
        if self.order_terms or self.unordered_:
            return self.order_terms
        return tuple(Term(c) for c in self.table.primary_key)

    def matching(self) -> DataFrame:
        """The rows that the predicates keep, without order and paging."""
        df = self.catalog.read(self.name, self.deleted)
        if self.preds:
            df = df.where(P.And(*self.preds).to_column(F.col))
        for narrow in self.filters:
            df = narrow(df)
        return df

    def sort_columns(self, at: Callable[[str], Column] = F.col) -> list[Column]:
        return [t.column(self.catalog.order_value(self.name, t.name, at(t.name))) for t in self.effective_order]

    def _keyset(self) -> Column:
        order, row = self.effective_order, dict(self.after_)
        if not order:
            raise QueryError("a page by key needs an order")
        if len({t.descending for t in order}) > 1:
            raise QueryError("a page by key needs all sort terms in one direction")
        missing = [t.name for t in order if row.get(t.name) is None]
        if missing:
            raise QueryError(f"a page by key needs a value of {', '.join(missing)}")
        if any(self.table.column(t.name).nullable for t in order):
            raise QueryError("a page by key cannot go by a nullable column")
        down = order[0].descending
        handles = [self[t.name] for t in order]
        # a > x or (a = x and (b > y ...)), and first a >= x, which the Parquet scan can use by itself
        strict = None
        for h, t in reversed(list(zip(handles, order))):
            v = row[t.name]
            beyond = (h.lt(v) if down else h.gt(v)).to_column(F.col)
            strict = beyond if strict is None else beyond | (h.eq(v).to_column(F.col) & strict)
        first = row[order[0].name]
        bound = (handles[0].lte(first) if down else handles[0].gte(first)).to_column(F.col)
        return bound & strict

    def df(self) -> DataFrame:
        """The read as a DataFrame: filtered, sorted, paged, projected."""
        df = self.matching()
        if self.after_ is not None:
            df = df.where(self._keyset())
        if order := self.sort_columns():
            df = df.orderBy(*order)
        if self.offset_:
            df = df.offset(self.offset_)
        if self.limit_ is not None:
            df = df.limit(self.limit_)
        return df.select(*(self.columns or [c.name for c in self.table.columns]))

    def count_df(self) -> DataFrame:
        """One row `n`: the matching rows, whatever the order, limit and offset."""
        return self.matching().agg(F.count(F.lit(1)).alias("n"))

    def exists_df(self) -> DataFrame:
        """One row `found`; stops at the first match and never sorts."""
        return self.matching().limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))

    # results
    def all(self) -> list[Row]:
        return self.df().collect()

    def one(self) -> Row | None:
        found = self.limit(1).df().collect()
        return found[0] if found else None

    def count(self) -> int:
        return self.count_df().first()[0]

    def exists(self) -> bool:
        return self.exists_df().first()[0]

    def rows(self) -> Iterator[Row]:
        """Rows one by one, a partition at a time on the driver."""
        return self.df().toLocalIterator()

    def each(self, fn: Callable[[Row], AnyValue]) -> None:
        """Calls `fn` on each row until it returns False."""
        for row in self.rows():
            if fn(row) is False:
                return


def query(catalog: Catalog, name: str) -> Query:
    catalog.table(name)
    return Query(catalog, name)


def conjunction(preds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, preds, F.lit(True))
