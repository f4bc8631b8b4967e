"""Declared aggregations: grouping, filtered and ordered aggregates, HAVING, grouping sets, computed outputs and windows over groups.

The shape is declared and checked once by `build`; a call varies only predicates on the rows, parameters and paging.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import predicates as P
from ..errors import DeclarationError, QueryError
from ..functions import json_docs
from ..model import Catalog, snake
from ..types import Type, avg_type, extreme_type, sum_type
from . import terms as T
from .ordering import Term
from .query import Query
from .windows import Over

RANKINGS = ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist")
OVER_AGGREGATES = ("sum", "avg", "min", "max", "count")


@dataclass
class Output:
    name: str
    kind: str
    arg: T.Expr | None = None
    keep: T.Cond | None = None
    order: tuple = ()
    over: Over | None = None
    columns: tuple[str, ...] = ()

    def filter(self, cond: T.Cond) -> Output:
        """Only rows that meet the condition are aggregated."""
        self.keep = cond
        return self


@dataclass
class _Joined:
    table: str
    alias: str
    pairs: tuple[tuple[tuple[str | None, str], str], ...]


@dataclass
class Aggregation:
    """The builder. Methods that add an output return it, so that it can take a filter; all others return the builder."""

    catalog: Catalog
    table: str
    name: str = "report"
    groups: list[tuple[str, T.Expr]] = field(default_factory=list)
    outputs: list[Output] = field(default_factory=list)
    joins: list[_Joined] = field(default_factory=list)
    exploded: list[tuple[str, str]] = field(default_factory=list)
    conditions: list[T.Cond] = field(default_factory=list)
    havings: list[T.Cond] = field(default_factory=list)
    computed: list[tuple[str, T.Expr]] = field(default_factory=list)
    orders: list[Term] = field(default_factory=list)
    sets_: list[tuple[str, ...]] | None = None
    shape: str = "plain"
    deleted: bool = False

    # input
    def join(self, relation: str, alias: str | None = None, of: str | None = None) -> Aggregation:
        """Inner join along a to-one relation of the table, or of the joined table `of`."""
        source = next((j.table for j in self.joins if j.alias == of), self.table)
        r = self.catalog.table(source).relation(relation)
        if r.kind != "one":
            raise DeclarationError(f"{self.name}: an aggregation joins along relations to one")
        self.joins.append(_Joined(r.target, alias or relation, tuple(((of, a), b) for a, b in zip(r.columns, r.target_columns))))
        return self

    def elements(self, alias: str, column: str) -> Aggregation:
        """One row for each element of a JSON array; rows without any fall out."""
        if not self.catalog.table(self.table).column(column).type.is_("json", "jsonb"):
            raise DeclarationError(f"{self.name}: {column} holds no JSON")
        self.exploded.append((alias, column))
        return self

    def where(self, cond: T.Cond) -> Aggregation:
        self.conditions.append(cond)
        return self

    def across_deleted(self) -> Aggregation:
        self.deleted = True
        return self

    # groups
    def by(self, *columns: str, table: str | None = None) -> Aggregation:
        self.groups += [(c, T.Col(c, table)) for c in columns]
        return self

    def by_expr(self, name: str, term: T.Expr) -> Aggregation:
        self.groups.append((snake(name), term))
        return self

    def rollup(self) -> Aggregation:
        return self._shaped("rollup")

    def cube(self) -> Aggregation:
        return self._shaped("cube")

    def sets(self, *given: Iterable[str] | None) -> Aggregation:
        """Grouping sets by output names; None or an empty one is the grand total."""
        self.sets_ = [tuple(s or ()) for s in given]
        return self._shaped("sets")

    def _shaped(self, shape: str) -> Aggregation:
        if self.shape != "plain":
            raise DeclarationError(f"{self.name}: {self.shape} and {shape} exclude each other")
        self.shape = shape
        return self

    # outputs
    def _out(self, *args, **kw) -> Output:
        o = Output(*args, **kw)
        o.name = snake(o.name)
        self.outputs.append(o)
        return o

    def count(self, name: str) -> Output:
        return self._out(name, "count")

    def count_of(self, name: str, arg: T.Expr) -> Output:
        return self._out(name, "count", arg)

    def count_distinct(self, name: str, arg: T.Expr) -> Output:
        return self._out(name, "count_distinct", arg)

    def sum(self, name: str, arg: T.Expr) -> Output:
        return self._out(name, "sum", arg)

    def avg(self, name: str, arg: T.Expr) -> Output:
        return self._out(name, "avg", arg)

    def min(self, name: str, arg: T.Expr) -> Output:
        return self._out(name, "min", arg)

    def max(self, name: str, arg: T.Expr) -> Output:
        return self._out(name, "max", arg)

    def first(self, name: str, arg: T.Expr, *order: Term) -> Output:
        """The value in the group's first row by the order, whose names are columns of the table."""
        return self._out(name, "first", arg, order=order)

    def grouping(self, name: str, *groups: str) -> Output:
        """Bits that tell which of the groups a row of grouping sets has folded, the last group lowest."""
        return self._out(name, "grouping", columns=groups)

    def window(self, name: str, kind: str, over: Over, arg: T.Expr | None = None) -> Output:
        """A function over the groups: a ranking, lag, lead, first_value, last_value, or an aggregate of outputs."""
        return self._out(name, f"over:{kind}", arg, over=over)

    def compute(self, name: str, term: T.Expr) -> Aggregation:
        self.computed.append((snake(name), term))
        return self

    def having(self, cond: T.Cond) -> Aggregation:
        self.havings.append(cond)
        return self

    def order_by(self, *given: Term) -> Aggregation:
        self.orders += given
        return self

    def build(self, params: Iterable[str] = ()) -> Report:
        """Checks the declaration; `params` names the values that each call gives."""
        report = Report(self, frozenset(params))
        problems = report.problems()
        if problems:
            raise DeclarationError(problems)
        return report


def _over_type(o: Output, arg: T.Typed | None) -> tuple[Type, bool]:
    kind = o.kind.partition(":")[2]
    if kind in ("row_number", "rank", "dense_rank", "count"):
        return Type("int8"), False
    if kind in ("percent_rank", "cume_dist"):
        return Type("float8"), False
    if kind == "sum":
        return sum_type(arg.type), True
    if kind == "avg":
        return avg_type(arg.type), True
    if kind in ("min", "max"):
        return extreme_type(arg.type), True
    return arg.type, True


class Report:
    """A checked aggregation. `df` runs it; `columns` has each output's name, type and whether it may be null."""

    def __init__(self, spec: Aggregation, params: frozenset[str]):
        self.spec, self.params = spec, params

    # scopes
    def _row_scope(self) -> T.Scope:
        a = self.spec
        tables = {None: a.table, **{j.alias: j.table for j in a.joins}}
        elements = {alias for alias, _ in a.exploded}

        def find(table: str | None, name: str) -> T.Typed:
            if table == "":
                raise DeclarationError(f"{name} is an output, and not one of the rows")
            if table is None and name in elements:
                return T.Typed(F.col(f"element__{name}"), Type("jsonb"), True)
            if table not in tables:
                raise DeclarationError(f"no joined table {table}")
            c = a.catalog.table(tables[table]).column(name)
            return T.Typed(F.col(f"{table or 'own'}__{name}"), c.type, c.nullable, names=frozenset({(table, name)}))

        return find

    def _out_scope(self, upto: int | None = None) -> T.Scope:
        known = {n: (t, nullable) for n, t, nullable in self._typed_outputs(windows=False)}

        def find(table: str | None, name: str) -> T.Typed:
            if table != "" and (table, name) not in {(None, g) for g, _ in self.spec.groups}:
                raise DeclarationError(f"{name} is neither grouped nor aggregated")
            if name not in known:
                raise DeclarationError(f"no output {name}")
            t, nullable = known[name]
            return T.Typed(F.col(f"`{name}`"), t, nullable, names=frozenset({("", name)}))

        return find

    def _typed_outputs(self, windows: bool = True) -> list[tuple[str, Type, bool]]:
        a, rows, blank = self.spec, self._row_scope(), T.Unbound()
        folded = a.shape != "plain"
        out = []
        for n, term in a.groups:
            t = term.resolve(rows, blank)
            out.append((n, t.type, t.nullable or folded))
        for o in a.outputs:
            if o.kind.startswith("over:"):
                continue
            if o.kind == "grouping":
                out.append((o.name, Type("int4"), False))
                continue
            arg = o.arg.resolve(rows, blank) if o.arg is not None else None
            t = T.aggregate(o.kind, arg, None, self._first_order(o, rows))
            out.append((o.name, t.type, t.nullable))
        if not windows:
            return out
        scope = self._out_scope()
        for n, term in a.computed:
            t = term.resolve(scope, blank)
            out.append((n, t.type, t.nullable))
        for o in a.outputs:
            if o.kind.startswith("over:"):
                arg = o.arg.resolve(scope, blank) if o.arg is not None else None
                out.append((o.name, *_over_type(o, arg)))
        return out

    @property
    def columns(self) -> list[tuple[str, Type, bool]]:
        by_name = {n: (n, t, x) for n, t, x in self._typed_outputs()}
        return [by_name[n] for n in self._names()]

    def _names(self) -> list[str]:
        a = self.spec
        return [n for n, _ in a.groups] + [o.name for o in a.outputs] + [n for n, _ in a.computed]

    def _first_order(self, o: Output, rows: T.Scope) -> tuple:
        found = [(rows(None, t.name), t) for t in o.order]
        return tuple((x.column, t.descending, t.nulls_are_first, x.type) for x, t in found)

    def problems(self) -> list[str]:
        a, out = self.spec, []
        rows, blank = self._row_scope(), T.Unbound()
        names = self._names()
        out += [f"{a.name}: two outputs are called {n}" for n in sorted({n for n in names if names.count(n) > 1})]
        if not a.outputs and not a.groups:
            out.append(f"{a.name} has no output")

        def tried(what: str, fn):
            try:
                return fn()
            except DeclarationError as e:
                out.extend(f"{a.name}: {what}: {p}" for p in e.problems)
                return None

        seen = []
        for n, term in a.groups:
            t = tried(f"group {n}", lambda: term.resolve(rows, blank))
            if t is not None and t.aggregate:
                out.append(f"{a.name}: group {n} is an aggregate")
            if term in seen:
                out.append(f"{a.name}: {n} is grouped twice")
            seen.append(term)
        for c in a.conditions:
            tried("where", lambda: c.resolve(rows, blank))
        grouped = {n for n, _ in a.groups}
        for o in a.outputs:
            if o.kind == "grouping":
                if a.shape == "plain":
                    out.append(f"{a.name}: {o.name} needs grouping sets")
                out += [f"{a.name}: {o.name}: {c} is not grouped" for c in o.columns if c not in grouped]
                if not o.columns:
                    out.append(f"{a.name}: {o.name} names no group")
            elif not o.kind.startswith("over:"):
                if o.kind == "first" and not o.order:
                    out.append(f"{a.name}: {o.name} needs an order")
                tried(o.name, lambda: T.aggregate(o.kind, o.arg.resolve(rows, blank) if o.arg is not None else None, None, self._first_order(o, rows)))
                if o.keep is not None:
                    tried(f"filter of {o.name}", lambda: o.keep.resolve(rows, blank))
        if out:
            return out
        scope = self._out_scope()
        for c in a.havings:
            tried("having", lambda: c.resolve(scope, blank))
        for n, term in a.computed:
            tried(n, lambda: term.resolve(scope, blank))
        every = set(names)
        for o in a.outputs:
            if not o.kind.startswith("over:"):
                continue
            kind = o.kind.partition(":")[2]
            if kind not in (*RANKINGS, *OVER_AGGREGATES, "lag", "lead", "first_value", "last_value"):
                out.append(f"{a.name}: {o.name}: no window function {kind}")
                continue
            if (o.arg is None) != (kind in RANKINGS or kind == "count"):
                out.append(f"{a.name}: {o.name}: {kind} takes {'no' if kind in RANKINGS else 'an'} argument")
            out += [f"{a.name}: {p}" for p in o.over.problems(o.name, kind in RANKINGS or kind in ("lag", "lead"))]
            plain = {x.name for x in a.outputs if not x.kind.startswith("over:")} | grouped | {n for n, _ in a.computed}
            out += [f"{a.name}: {o.name}: {x} is no output of the groups" for x in [*o.over.partition, *(t.name for t in o.over.order)] if x not in plain]
            if o.arg is not None:
                arg = tried(o.name, lambda: o.arg.resolve(scope, blank))
                if arg is not None:
                    tried(o.name, lambda: _over_type(o, arg))
        out += [f"{a.name}: no output {t.name} to order by" for t in a.orders if t.name not in every]
        for s in a.sets_ or []:
            out += [f"{a.name}: a grouping set names {x}, which is not grouped" for x in s if x not in grouped]
        used = T.param_names(a.conditions, a.havings, [t for _, t in a.computed], [t for _, t in a.groups], [o.keep for o in a.outputs], [o.arg for o in a.outputs])
        out += [f"{a.name}: the parameter {p} is not used" for p in sorted(self.params - used)]
        out += [f"{a.name}: the parameter {p} is not declared" for p in sorted(used - self.params)]
        return out

    def df(self, *where: P.Pred, limit: int | None = None, offset: int = 0, order=None, query: Query | None = None, **params) -> DataFrame:
        """Runs the report over the rows that the predicates (or a whole `query`) keep. Its order is declared: a call has none."""
        if order is not None or (query is not None and (query.order_terms or query.after_ is not None)):
            raise QueryError(f"{self.spec.name} has a declared order; a call cannot give another")
        if set(params) != set(self.params):
            raise QueryError(f"{self.spec.name} takes the parameters {sorted(self.params)}")
        grouped = self._grouped(where, query, params)
        final = grouped.orderBy(*self._order())
        if offset:
            final = final.offset(offset)
        if limit is not None:
            final = final.limit(limit)
        return final.select(*[F.col(f"`{n}`") for n in self._names()])

    def unordered_df(self, *where: P.Pred, query: Query | None = None, **params) -> DataFrame:
        """The same rows in no order, for use inside a larger plan."""
        return self._grouped(where, query, params).select(*[F.col(f"`{n}`") for n in self._names()])

    def _order(self) -> list:
        a = self.spec
        chosen = [t for t in a.orders]
        held = {t.name for t in chosen}
        first = a.shape != "plain"
        chosen += [Term(n, False, first) for n, _ in a.groups if n not in held]
        return [t.column(F.col(f"`{t.name}`")) for t in chosen] or [F.lit(1)]

    def _grouped(self, where, query: Query | None, params: dict) -> DataFrame:
        a = self.spec
        q = query if query is not None else Query(a.catalog, a.table)
        if q.name != a.table:
            raise QueryError(f"{a.name} is over {a.table}")
        if a.deleted:
            q = q.with_deleted()
        rows = q.where(*where).matching()
        rows = rows.select(*[F.col(c).alias(f"own__{c}") for c in rows.columns])
        for j in a.joins:
            other = a.catalog.read(j.table)
            other = other.select(*[F.col(c).alias(f"{j.alias}__{c}") for c in other.columns])
            on = [F.col(f"{t or 'own'}__{x}") == F.col(f"{j.alias}__{y}") for (t, x), y in j.pairs]
            rows = rows.join(other, on, "inner")
        for alias, column in a.exploded:
            rows = rows.select("*", F.explode(json_docs.elements(F.col(f"own__{column}"))).alias(f"element__{alias}"))
        scope = self._row_scope()
        for c in a.conditions:
            rows = rows.where(c.resolve(scope, params).column)
        keys = [term.resolve(scope, params).column.alias(n) for n, term in a.groups]
        rows = rows.select("*", *keys) if keys else rows
        names = [n for n, _ in a.groups]
        aggs = []
        for o in a.outputs:
            if o.kind.startswith("over:"):
                continue
            if o.kind == "grouping":
                bits = F.lit(0)
                for c in o.columns:
                    bits = bits * 2 + F.grouping(F.col(f"`{c}`")).cast("int")
                aggs.append(bits.cast("int").alias(o.name))
                continue
            keep = o.keep.resolve(scope, params).column if o.keep is not None else None
            arg = o.arg.resolve(scope, params) if o.arg is not None else None
            aggs.append(T.aggregate(o.kind, arg, keep, self._first_order(o, scope)).column.alias(o.name))
        aggs = aggs or [F.count(F.lit(1)).alias("rows__")]
        cols = [F.col(f"`{n}`") for n in names]
        if a.shape == "rollup":
            grouped = rows.rollup(*cols).agg(*aggs)
        elif a.shape == "cube":
            grouped = rows.cube(*cols).agg(*aggs)
        elif a.shape == "sets":
            grouped = rows.groupingSets([[F.col(f"`{n}`") for n in s] for s in a.sets_], *cols).agg(*aggs)
        else:
            grouped = rows.groupBy(*cols).agg(*aggs) if cols else rows.agg(*aggs)
        out = self._out_scope()
        for c in a.havings:
            grouped = grouped.where(c.resolve(out, params).column)
        if a.computed:
            grouped = grouped.select("*", *[t.resolve(out, params).column.alias(n) for n, t in a.computed])
        over = [o for o in a.outputs if o.kind.startswith("over:")]
        return grouped.select("*", *[self._window(o, out, params).alias(o.name) for o in over]) if over else grouped

    def _window(self, o: Output, scope: T.Scope, params: dict):
        kind, w = o.kind.partition(":")[2], o.over.spec()
        if kind in ("row_number", "rank", "dense_rank"):
            return getattr(F, kind)().over(w).cast("long")
        if kind in ("percent_rank", "cume_dist"):
            return getattr(F, kind)().over(w)
        keep = o.keep.resolve(scope, params).column if o.keep is not None else None
        if kind == "count":
            return F.count(F.lit(1) if keep is None else F.when(keep, 1)).over(w)
        arg = o.arg.resolve(scope, params)
        x = arg.column if keep is None else F.when(keep, arg.column)
        if kind in ("lag", "lead"):
            return getattr(F, kind)(x, 1).over(w)
        if kind in ("first_value", "last_value"):
            return (F.first if kind == "first_value" else F.last)(x).over(w)
        t, _ = _over_type(o, arg)
        if kind == "sum":
            return F.sum(x.cast("decimal(38,0)") if arg.type.is_("int8") else x).over(w).cast(t.spark)
        if kind == "avg" and t.base == "numeric":
            n = F.count(x).over(w)
            total = F.sum(x.cast(f"decimal(38,{arg.type.scale or 0})")).over(w)
            return F.when(n > 0, F.round(total.cast("decimal(38,10)") / F.nullif(n, F.lit(0)).cast("decimal(20,0)"), 6)).cast(t.spark)
        return getattr(F, kind)(x).over(w)
