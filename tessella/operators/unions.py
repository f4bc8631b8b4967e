"""Declared unions: branches of one shape, merged, ordered by outputs and capped."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import predicates as P
from ..errors import DeclarationError, QueryError
from ..model import Catalog, snake
from ..types import Type, widen
from . import terms as T
from .ordering import Term
from .query import Query


@dataclass
class Branch:
    union: Union
    table: str
    takes: list[tuple[str, T.Expr]] = field(default_factory=list)
    conditions: list[T.Cond] = field(default_factory=list)

    def take(self, name: str, term: T.Expr | str) -> Branch:
        self.takes.append((snake(name), T.Col(term) if isinstance(term, str) else term))
        return self

    def const(self, name: str, value: Any) -> Branch:
        self.takes.append((snake(name), T.Lit(value)))
        return self

    def where(self, cond: T.Cond) -> Branch:
        self.conditions.append(cond)
        return self

    def scope(self) -> T.Scope:
        table = self.union.catalog.table(self.table)

        def find(alias: str | None, name: str) -> T.Typed:
            if alias is not None:
                raise DeclarationError(f"a branch has no table {alias}")
            c = table.column(name)
            return T.Typed(F.col(name), c.type, c.nullable)

        return find


@dataclass
class Union:
    """The builder: `branch` adds a table; all branches take the same names in the same order."""

    catalog: Catalog
    name: str = "union"
    branches: list[Branch] = field(default_factory=list)
    orders: list[Term] = field(default_factory=list)
    distinct_: bool = False

    def branch(self, table: str) -> Branch:
        self.branches.append(Branch(self, table))
        return self.branches[-1]

    def distinct(self) -> Union:
        self.distinct_ = True
        return self

    def order_by(self, *given: Term) -> Union:
        self.orders += given
        return self

    def build(self, params: Iterable[str] = ()) -> UnionReport:
        out = UnionReport(self, frozenset(params))
        if problems := out.problems():
            raise DeclarationError(problems)
        return out


class UnionReport:
    def __init__(self, spec: Union, params: frozenset[str]):
        self.spec, self.params = spec, params

    @property
    def columns(self) -> list[tuple[str, Type, bool]]:
        typed = [[t.resolve(b.scope(), T.Unbound()) for _, t in b.takes] for b in self.spec.branches]
        return [
            (n, reduce(lambda a, b: widen(a, b) if a else None, (row[i].type for row in typed)), any(row[i].nullable for row in typed))
            for i, (n, _) in enumerate(self.spec.branches[0].takes)
        ]

    def problems(self) -> list[str]:
        a, out = self.spec, []
        if len(a.branches) < 2:
            return [f"{a.name} needs two branches or more"]
        names = [n for n, _ in a.branches[0].takes]
        if not a.orders:
            out.append(f"{a.name} needs an order")
        out += [f"{a.name}: no output {t.name} to order by" for t in a.orders if t.name not in names]
        for b in a.branches:
            if [n for n, _ in b.takes] != names:
                out.append(f"{a.name}: the branch over {b.table} has other outputs than the first")
            for what in [t for _, t in b.takes] + b.conditions:
                try:
                    what.resolve(b.scope(), T.Unbound())
                except DeclarationError as e:
                    out += [f"{a.name}: {p}" for p in e.problems]
        if not out:
            out += [f"{a.name}: the branches' {n} have types that don't go together" for n, t, _ in self.columns if t is None]
        used = T.param_names([[t for _, t in b.takes] for b in a.branches], [b.conditions for b in a.branches])
        out += [f"{a.name}: the parameter {p} is not used" for p in sorted(self.params - used)]
        out += [f"{a.name}: the parameter {p} is not declared" for p in sorted(used - self.params)]
        return out

    def df(self, *, where: dict[str, list[P.Pred]] | None = None, limit: int | None = None, offset: int = 0, **params) -> DataFrame:
        """`where` narrows the branches by their tables."""
        if set(params) != set(self.params):
            raise QueryError(f"{self.spec.name} takes the parameters {sorted(self.params)}")
        kinds = self.columns
        parts = []
        for b in self.spec.branches:
            rows = Query(self.spec.catalog, b.table).where(*(where or {}).get(b.table, [])).matching()
            for c in b.conditions:
                rows = rows.where(c.resolve(b.scope(), params).column)
            parts.append(rows.select(*[t.resolve(b.scope(), params).column.cast(k.spark).alias(n) for (n, t), (_, k, _) in zip(b.takes, kinds)]))
        out = reduce(lambda x, y: x.unionAll(y), parts)
        if self.spec.distinct_:
            out = out.distinct()
        out = out.orderBy(*[t.column(F.col(t.name)) for t in self.spec.orders])
        if offset:
            out = out.offset(offset)
        return out if limit is None else out.limit(limit)
