"""Declared joins: inner and left joins along relations or column pairs, and joins with declared aggregations."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import predicates as P
from ..errors import DeclarationError, QueryError
from ..model import Catalog, snake
from ..types import Type
from . import terms as T
from .aggregation import Report
from .ordering import Term
from .query import Query


@dataclass
class _Side:
    alias: str
    kind: str
    table: str | None
    report: Report | None
    pairs: tuple[tuple[T.Expr, str], ...]


@dataclass
class Join:
    """The builder. The driving table has the alias `own`; each join adds a table or an aggregation under an alias of its own."""

    catalog: Catalog
    table: str
    name: str = "join"
    sides: list[_Side] = field(default_factory=list)
    reports: dict[str, Report] = field(default_factory=dict)
    takes: list[tuple[str, T.Expr]] = field(default_factory=list)
    conditions: list[T.Cond] = field(default_factory=list)
    orders: list[Term] = field(default_factory=list)

    def _table_of(self, alias: str | None) -> str:
        if alias in (None, "own"):
            return self.table
        for s in self.sides:
            if s.alias == alias and s.table:
                return s.table
        raise DeclarationError(f"{self.name}: no joined table {alias}")

    def _relation(self, kind: str, relation: str, alias: str | None, of: str | None) -> Join:
        r = self.catalog.table(self._table_of(of)).relation(relation)
        if r.link:
            raise DeclarationError(f"{self.name}: {relation} goes through {r.link}; join that table first")
        pairs = tuple((T.Col(a, of or "own"), b) for a, b in zip(r.columns, r.target_columns))
        self.sides.append(_Side(alias or relation, kind, r.target, None, pairs))
        return self

    def inner(self, relation: str, alias: str | None = None, of: str | None = None) -> Join:
        return self._relation("inner", relation, alias, of)

    def left(self, relation: str, alias: str | None = None, of: str | None = None) -> Join:
        return self._relation("left", relation, alias, of)

    def on(self, kind: str, table: str, alias: str, *pairs: tuple[T.Expr, str]) -> Join:
        """A join of a table on pairs of a term over the tables before it and a column of the new one."""
        self.sides.append(_Side(alias, kind, table, None, pairs))
        return self

    def with_(self, alias: str, report: Report) -> Join:
        """Makes a declared aggregation joinable."""
        self.reports[alias] = report
        return self

    def on_report(self, kind: str, alias: str, *pairs: tuple[T.Expr, str]) -> Join:
        if alias not in self.reports:
            raise DeclarationError(f"{self.name}: no aggregation {alias}")
        self.sides.append(_Side(alias, kind, None, self.reports[alias], pairs))
        return self

    def take(self, name: str, term: T.Expr) -> Join:
        self.takes.append((snake(name), term))
        return self

    def where(self, cond: T.Cond) -> Join:
        self.conditions.append(cond)
        return self

    def order_by(self, *given: Term) -> Join:
        self.orders += given
        return self

    def build(self, params: Iterable[str] = ()) -> JoinReport:
        out = JoinReport(self, frozenset(params))
        if problems := out.problems():
            raise DeclarationError(problems)
        return out


class JoinReport:
    def __init__(self, spec: Join, params: frozenset[str]):
        self.spec, self.params = spec, params

    def _scope(self) -> T.Scope:
        a = self.spec
        sides = {s.alias: s for s in a.sides}

        def find(table: str | None, name: str) -> T.Typed:
            if table in (None, "own"):
                c = a.catalog.table(a.table).column(name)
                return T.Typed(F.col(f"own__{name}"), c.type, c.nullable)
            if table not in sides:
                raise DeclarationError(f"no joined table {table}")
            s = sides[table]
            if s.report is not None:
                found = {n: (t, x) for n, t, x in s.report.columns}
                if name not in found:
                    raise DeclarationError(f"{table} has no output {name}")
                t, nullable = found[name]
            else:
                c = a.catalog.table(s.table).column(name)
                t, nullable = c.type, c.nullable
            return T.Typed(F.col(f"{table}__{name}"), t, nullable or s.kind == "left")

        return find

    @property
    def columns(self) -> list[tuple[str, Type, bool]]:
        out = []
        for n, term in self.spec.takes:
            t = term.resolve(self._scope(), T.Unbound())
            out.append((n, t.type, t.nullable))
        return out

    def problems(self) -> list[str]:
        a, out, scope, blank = self.spec, [], self._scope(), T.Unbound()
        aliases = ["own", *[s.alias for s in a.sides]]
        out += [f"{a.name}: the alias {x} is used twice" for x in sorted({x for x in aliases if aliases.count(x) > 1})]
        names = [n for n, _ in a.takes]
        out += [f"{a.name}: two outputs are called {n}" for n in sorted({n for n in names if names.count(n) > 1})]
        if not names:
            out.append(f"{a.name} takes no column")
        for s in a.sides:
            if s.kind not in ("inner", "left"):
                out.append(f"{a.name}: joins are inner or left, not {s.kind}")
            if not s.pairs:
                out.append(f"{a.name}: {s.alias} is joined on nothing")
            for term, column in s.pairs:
                try:
                    x, y = term.resolve(scope, blank), scope(s.alias, column)
                    if not T.comparable(x.type, y.type):
                        out.append(f"{a.name}: {s.alias}.{column}, a {y.type}, is joined with a {x.type}")
                except DeclarationError as e:
                    out += [f"{a.name}: {p}" for p in e.problems]
        for what in [t for _, t in a.takes] + a.conditions:
            try:
                what.resolve(scope, blank)
            except DeclarationError as e:
                out += [f"{a.name}: {p}" for p in e.problems]
        out += [f"{a.name}: no output {t.name} to order by" for t in a.orders if t.name not in names]
        used = T.param_names([t for _, t in a.takes], a.conditions)
        inner = set().union(*(s.report.params for s in a.sides if s.report)) if any(s.report for s in a.sides) else set()
        out += [f"{a.name}: the parameter {p} is not used" for p in sorted(self.params - used - inner)]
        out += [f"{a.name}: the parameter {p} is not declared" for p in sorted((used | inner) - self.params)]
        return out

    def _rows(self, where, with_where: dict[str, list[P.Pred]], query: Query | None, params: dict) -> DataFrame:
        a, scope = self.spec, self._scope()
        if set(params) != set(self.params):
            raise QueryError(f"{a.name} takes the parameters {sorted(self.params)}")
        if unknown := set(with_where) - set(a.reports):
            raise QueryError(f"{a.name}: no aggregation {', '.join(sorted(unknown))} to narrow")
        q = query if query is not None else Query(a.catalog, a.table)
        if q.order_terms or q.after_ is not None:
            raise QueryError(f"{a.name} has a declared order; a call cannot give another")
        rows = q.where(*where).matching()
        rows = rows.select(*[F.col(c).alias(f"own__{c}") for c in rows.columns])
        for s in a.sides:
            # deletions are filtered on the joined side first, so a left join keeps its rows
            if s.report is not None:
                mine = {p: params[p] for p in s.report.params}
                other = s.report.unordered_df(*with_where.get(s.alias, []), **mine)
            else:
                other = a.catalog.read(s.table)
            other = other.select(*[F.col(f"`{c}`").alias(f"{s.alias}__{c}") for c in other.columns])
            on = [term.resolve(scope, params).column == F.col(f"{s.alias}__{c}") for term, c in s.pairs]
            rows = rows.join(other, on, s.kind)
        for c in a.conditions:
            rows = rows.where(c.resolve(scope, params).column)
        return rows.select(*[t.resolve(scope, params).column.alias(n) for n, t in a.takes])

    def df(self, *where: P.Pred, with_where: dict | None = None, limit: int | None = None, offset: int = 0, order=None, query: Query | None = None, **params) -> DataFrame:
        if order is not None:
            raise QueryError(f"{self.spec.name} has a declared order; a call cannot give another")
        out = self._rows(where, with_where or {}, query, params)
        if self.spec.orders:
            out = out.orderBy(*[t.column(F.col(t.name)) for t in self.spec.orders])
        if offset:
            out = out.offset(offset)
        return out if limit is None else out.limit(limit)

    def count_df(self, *where: P.Pred, with_where: dict | None = None, query: Query | None = None, **params) -> DataFrame:
        return self._rows(where, with_where or {}, query, params).agg(F.count(F.lit(1)).alias("n"))
