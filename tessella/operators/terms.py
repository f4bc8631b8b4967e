"""Typed terms and conditions of declared reads. They are resolved against the tables in scope when a report is declared."""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import DeclarationError
from ..functions import json_docs, scalars
from ..types import AVG_SCALE, NUMBERS, TEXTS, Type, avg_type, comparable, extreme_type, sum_type, widen


@dataclass(frozen=True)
class Typed:
    """A resolved term: its Spark column, type, whether it may be null, and the kind of rows that it is over."""

    column: Column
    type: Type
    nullable: bool
    aggregate: bool = False
    names: frozenset = frozenset()


#: Finds a column by table alias (or None) and name.
Scope = Callable[[str | None, str], Typed]


class Expr:
    def resolve(self, scope: Scope, params: dict) -> Typed:
        raise NotImplementedError


@dataclass(frozen=True)
class Col(Expr):
    name: str
    table: str | None = None

    def resolve(self, scope, params):
        return scope(self.table, self.name)


def literal_type(v: Any) -> Type:
    if isinstance(v, bool):
        return Type("bool")
    if isinstance(v, int):
        return Type("int8")
    if isinstance(v, float):
        return Type("float8")
    if isinstance(v, decimal.Decimal):
        scale = max(0, -v.as_tuple().exponent)
        return Type("numeric", 38, scale)
    if isinstance(v, str):
        return Type("text")
    if isinstance(v, dt.datetime):
        return Type("timestamptz" if v.tzinfo else "timestamp")
    if isinstance(v, dt.date):
        return Type("date")
    raise DeclarationError(f"no literal of {type(v).__name__}")


@dataclass(frozen=True)
class Lit(Expr):
    value: Any

    def resolve(self, scope, params):
        t = literal_type(self.value)
        return Typed(F.lit(self.value) if t.base == "numeric" else F.lit(self.value).cast(t.spark), t, False)


class Unbound(dict):
    """Stands for the parameters while a report is being declared: each goes with what it is compared with."""


@dataclass(frozen=True)
class Out(Expr):
    """An output of the same report, by its name."""

    name: str

    def resolve(self, scope, params):
        return scope("", self.name)


@dataclass(frozen=True)
class Param(Expr):
    """A value that the call supplies; its type is that of what it is first compared with."""

    name: str

    def resolve(self, scope, params):
        if isinstance(params, Unbound):
            return Typed(F.lit(None), Type("any"), False)
        if self.name not in params:
            raise DeclarationError(f"the parameter {self.name} has no value")
        return Lit(params[self.name]).resolve(scope, params)


@dataclass(frozen=True)
class Func(Expr):
    name: str
    args: tuple
    extra: Any = None

    def resolve(self, scope, params):
        args = [a.resolve(scope, params) for a in self.args]
        names = frozenset().union(*(a.names for a in args))
        agg = any(a.aggregate for a in args)

        def out(column: Column, t: Type, nullable: bool) -> Typed:
            return Typed(column, t, nullable, agg, names)

        if self.name in ("coalesce", "nullif"):
            t = args[0].type
            for a in args[1:]:
                t = widen(t, a.type)
                if t is None:
                    raise DeclarationError(f"{self.name}: {args[0].type} and {a.type} don't go together")
            cast = [a.column.cast(t.spark) for a in args]
            if self.name == "nullif":
                return out(F.nullif(*cast), t, True)
            return out(F.coalesce(*cast), t, all(a.nullable for a in args))
        if self.name in ("lower", "upper"):
            if not args[0].type.is_(*TEXTS):
                raise DeclarationError(f"{self.name} of {args[0].type}")
            return out(getattr(F, self.name)(args[0].column), Type("text"), args[0].nullable)
        if self.name == "abs":
            if not args[0].type.is_(*NUMBERS):
                raise DeclarationError(f"abs of {args[0].type}")
            return out(F.abs(args[0].column), args[0].type, args[0].nullable)
        if self.name == "date_trunc":
            if not args[0].type.is_("timestamp", "timestamptz"):
                raise DeclarationError(f"date_trunc of {args[0].type}")
            zoned = args[0].type.base == "timestamptz"
            try:
                return out(scalars.date_trunc(self.extra, args[0].column, zoned), args[0].type, args[0].nullable)
            except ValueError as e:
                raise DeclarationError(str(e)) from e
        if self.name == "field":
            return out(json_docs.field(args[0].column, self.extra), Type("text"), True)
        a, b = args
        t = widen(a.type, b.type)
        if t is None or t.base not in NUMBERS:
            raise DeclarationError(f"{self.name} of {a.type} and {b.type}")
        nullable = a.nullable or b.nullable
        if self.name == "div":
            scale = AVG_SCALE if self.extra is None else self.extra
            try:
                return out(scalars.div(a.column, b.column, scale), Type("numeric", 38, scale), nullable)
            except ValueError as e:
                raise DeclarationError(str(e)) from e
        x, y = (v.column if t.base == "numeric" else v.column.cast(t.spark) for v in (a, b))
        column = {"add": x + y, "sub": x - y, "mul": x * y}[self.name]
        if t.base == "numeric":
            scale = (a.type.scale or 0) + (b.type.scale or 0) if self.name == "mul" else max(a.type.scale or 0, b.type.scale or 0)
            t = Type("numeric", 38, min(scale, 18))
            column = column.cast(t.spark)
        return out(column, t, nullable)


def coalesce(*args: Expr) -> Expr:
    if len(args) < 2:
        raise DeclarationError("coalesce takes two arguments or more")
    return Func("coalesce", args)


def nullif(a: Expr, b: Expr) -> Expr:
    return Func("nullif", (a, b))


def lower(a: Expr) -> Expr:
    return Func("lower", (a,))


def upper(a: Expr) -> Expr:
    return Func("upper", (a,))


def abs_(a: Expr) -> Expr:
    return Func("abs", (a,))


def date_trunc(unit: str, a: Expr) -> Expr:
    return Func("date_trunc", (a,), unit)


def add(a: Expr, b: Expr) -> Expr:
    return Func("add", (a, b))


def sub(a: Expr, b: Expr) -> Expr:
    return Func("sub", (a, b))


def mul(a: Expr, b: Expr) -> Expr:
    return Func("mul", (a, b))


def div(a: Expr, b: Expr, scale: int | None = None) -> Expr:
    return Func("div", (a, b), scale)


def field(element: Expr, key: str) -> Expr:
    """The text under a key of a JSON element."""
    return Func("field", (element,), key)


# conditions
class Cond:
    def resolve(self, scope: Scope, params: dict) -> Typed:
        raise NotImplementedError

    def __bool__(self):
        raise DeclarationError("a condition has no truth value in Python; use all_of, any_of and none_of")


def _param_names(x: Any) -> set[str]:
    """Names of the parameters anywhere inside a term or condition."""
    if isinstance(x, Param):
        return {x.name}
    if isinstance(x, (list, tuple)):
        return set().union(*(_param_names(y) for y in x)) if x else set()
    if hasattr(x, "__dataclass_fields__"):
        return set().union(*(_param_names(getattr(x, f)) for f in x.__dataclass_fields__)) if x.__dataclass_fields__ else set()
    return set()


def param_names(*xs: Any) -> set[str]:
    return _param_names(list(xs))


@dataclass(frozen=True)
class Compare(Cond):
    op: str
    left: Any
    right: Any

    def resolve(self, scope, params):
        a, b = (x.resolve(scope, params) for x in (self.left, self.right))
        if "any" not in (a.type.base, b.type.base) and not comparable(a.type, b.type):
            raise DeclarationError(f"{a.type} and {b.type} are not comparable")
        x, y = a.column, b.column
        c = {"eq": x == y, "ne": x != y, "lt": x < y, "lte": x <= y, "gt": x > y, "gte": x >= y}[self.op]
        return Typed(c, Type("bool"), a.nullable or b.nullable, a.aggregate or b.aggregate, a.names | b.names)


@dataclass(frozen=True)
class Logic(Cond):
    op: str
    parts: tuple

    def resolve(self, scope, params):
        if not self.parts:
            raise DeclarationError(f"{self.op} of nothing")
        found = [p.resolve(scope, params) for p in self.parts]
        c = found[0].column
        for p in found[1:]:
            c = c & p.column if self.op == "and" else c | p.column
        if self.op == "not":
            c = ~c
        return Typed(c, Type("bool"), any(p.nullable for p in found), any(p.aggregate for p in found), frozenset().union(*(p.names for p in found)))


@dataclass(frozen=True)
class Null(Cond):
    term: Any
    wanted: bool

    def resolve(self, scope, params):
        a = self.term.resolve(scope, params)
        return Typed(a.column.isNull() if self.wanted else a.column.isNotNull(), Type("bool"), False, a.aggregate, a.names)


def _expr(x: Any) -> Expr:
    return x if isinstance(x, Expr) else Lit(x)


def eq(a, b) -> Cond:
    return Compare("eq", _expr(a), _expr(b))


def ne(a, b) -> Cond:
    return Compare("ne", _expr(a), _expr(b))


def lt(a, b) -> Cond:
    return Compare("lt", _expr(a), _expr(b))


def lte(a, b) -> Cond:
    return Compare("lte", _expr(a), _expr(b))


def gt(a, b) -> Cond:
    return Compare("gt", _expr(a), _expr(b))


def gte(a, b) -> Cond:
    return Compare("gte", _expr(a), _expr(b))


def all_of(*conds: Cond) -> Cond:
    return Logic("and", conds)


def any_of(*conds: Cond) -> Cond:
    return Logic("or", conds)


def none_of(cond: Cond) -> Cond:
    return Logic("not", (cond,))


def is_null(a: Expr) -> Cond:
    return Null(a, True)


def is_not_null(a: Expr) -> Cond:
    return Null(a, False)


def aggregate(kind: str, arg: Typed | None, keep: Column | None, first: tuple | None = None) -> Typed:
    """An aggregate function by its declared result type. `keep` is its FILTER; `first` orders the `first` aggregate."""

    def kept(c: Column) -> Column:
        return c if keep is None else F.when(keep, c)

    if kind == "count":
        return Typed(F.count(kept(F.lit(1) if arg is None else arg.column)), Type("int8"), False, True)
    if kind == "count_distinct":
        return Typed(F.count_distinct(kept(arg.column)), Type("int8"), False, True)
    t = arg.type
    if kind == "sum":
        out = sum_type(t)
        if t.base == "interval":
            parts = [F.sum(kept(arg.column[f])).cast(k).alias(f) for f, k in (("months", "int"), ("days", "int"), ("micros", "bigint"))]
            return Typed(F.when(F.count(kept(arg.column["months"])) > 0, F.struct(*parts)), out, True, True)
        exact = arg.column.cast("decimal(38,0)") if t.base == "int8" else arg.column
        return Typed(F.sum(kept(exact)).cast(out.spark), out, True, True)
    if kind == "avg":
        out = avg_type(t)
        if out.base == "numeric":
            places = t.scale if t.base == "numeric" else 0
            total = F.sum(kept(arg.column.cast(f"decimal(38,{places})")))
            n = F.count(kept(arg.column))
            return Typed(F.when(n > 0, F.round(total.cast("decimal(38,10)") / F.nullif(n, F.lit(0)).cast("decimal(20,0)"), AVG_SCALE)).cast(out.spark), out, True, True)
        return Typed(F.avg(kept(arg.column)), out, True, True)
    if kind in ("min", "max"):
        extreme_type(t)
        return Typed(getattr(F, kind)(kept(arg.column)), t, True, True)
    if kind == "first":
        if t.array:
            raise DeclarationError("first of an array is not defined")
        return Typed(first_in_order(arg.column, first, keep), t, True, True)
    raise DeclarationError(f"no aggregate {kind}")


def _reversed(c: Column, t: Type) -> Column:
    """A key that sorts ascending as the column does descending."""
    if t.base in ("float4", "float8", "numeric"):
        return -c
    if t.base in ("int2", "int4", "int8"):
        return -c.cast("decimal(20,0)")
    if t.base in ("timestamp", "timestamptz"):
        return -F.unix_micros(c.cast("timestamp"))
    if t.base == "date":
        return -F.unix_date(c)
    if t.base == "bool":
        return ~c
    # complemented bytes, with an end mark above them, so that longer texts come before their beginnings
    return F.concat(F.translate(F.hex(c.cast("string")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))


def first_in_order(value: Column, order: tuple, keep: Column | None) -> Column:
    """The value of the group's first row in an order of `(column, descending, nulls_first, type)`; a null value is kept.

    It folds in constant space by `min_by` or `max_by`: a flag before each term places its nulls, and where directions are mixed,
    descending terms are turned round.
    """
    down = all(d for _, d, _, _ in order)
    parts = []
    for i, (c, falling, nulls_first, t) in enumerate(order):
        # least (or greatest, if all fall) wins, so the flag of a null is below (above) if nulls come first
        flag = F.when(c.isNull(), 0 if nulls_first != down else 2).otherwise(1)
        parts += [flag.alias(f"f{i}"), (_reversed(c, t) if falling and not down else c).alias(f"v{i}")]
    key, boxed = F.struct(*parts), F.struct(value.alias("x"))
    key = key if keep is None else F.when(keep, key)
    return (F.max_by if down else F.min_by)(boxed, key)["x"]
