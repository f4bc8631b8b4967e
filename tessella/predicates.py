"""Typed predicates on columns, composed with three-valued logic, and turned into Spark columns only at the end.

A predicate is checked when it is made: the operator has to apply to the column's type, and the value to be of it. Values
become literals; none is ever part of SQL text.
"""

from __future__ import annotations

import datetime as dt
import decimal
import uuid as uuid_
from collections.abc import Callable
from functools import reduce
from typing import Any as AnyValue

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import QueryError
from .functions import arrays, json_docs, ranges, text_search
from .model import Table
from .types import FLOATS, INTEGERS, Type

_ORDERED = (*INTEGERS, *FLOATS, "numeric", "text", "timestamptz", "timestamp", "date", "time")
_NO_EQUALITY = ("tsvector", "jsonb", "json", "interval", "tstzrange", "hstore")
_LISTED = ("uuid", "text", "enum", *INTEGERS)
_ARRAYS = ("text", "uuid", "int4", "int8", "numeric")

#: Operator -> whether it applies to a type.
APPLIES: dict[str, Callable[[Type], bool]] = {
    "eq": lambda t: not t.array and t.base not in _NO_EQUALITY,
    "ne": lambda t: not t.array and t.base not in _NO_EQUALITY,
    **dict.fromkeys(("gt", "gte", "lt", "lte"), lambda t: t.is_(*_ORDERED)),
    **dict.fromkeys(("eq_lower", "like", "ilike", "has_prefix", "has_suffix", "contains_text"), lambda t: t.is_("text")),
    **dict.fromkeys(("in_", "not_in"), lambda t: t.is_(*_LISTED)),
    **dict.fromkeys(("is_null", "is_not_null"), lambda t: True),
    "is_null_or_empty": lambda t: t.is_("text"),
    **dict.fromkeys(("matches", "web_search"), lambda t: t.is_("tsvector")),
    **dict.fromkeys(("range_overlaps", "contains_range", "range_contained_by"), lambda t: t.is_("tstzrange")),
    **dict.fromkeys(("array_contains", "array_contained_by", "array_overlaps"), lambda t: t.array and t.base in _ARRAYS),
    **dict.fromkeys(("json_contains", "json_contained_by", "has_any_key", "has_all_keys", "text_like_any", "json_is_empty"), lambda t: t.is_("jsonb")),
}

_PYTHON = {
    "bool": bool, "int2": int, "int4": int, "int8": int, "float4": (int, float), "float8": (int, float), "numeric": (int, decimal.Decimal),
    "text": str, "enum": str, "uuid": (str, uuid_.UUID), "inet": str, "cidr": str, "macaddr": str, "bytea": (bytes, bytearray), "timestamptz": dt.datetime,
    "timestamp": dt.datetime, "date": dt.date, "time": dt.time,
}

Resolve = Callable[[str], Column]


def value_of(t: Type, value: AnyValue, where: str) -> Column:
    """A literal of the column's type; a wrong kind of value is an error and not a cast."""
    element = Type(t.base, t.precision, t.scale)
    kinds = _PYTHON[t.base]
    if value is None:
        raise QueryError(f"{where}: compare with null by is_null")
    if not isinstance(value, kinds) or (isinstance(value, bool) and t.base != "bool"):
        raise QueryError(f"{where}: {value!r} is not a value of {element}")
    if t.base == "uuid":
        value = str(value).lower()
    if t.base == "timestamp" and value.tzinfo is not None:
        raise QueryError(f"{where}: {value!r} has a time zone")
    if t.base == "numeric":
        return F.lit(decimal.Decimal(value))  # its own scale: rounding it to the column's could make unequal values equal
    return F.lit(value).cast(element.spark)


class Pred:
    """A predicate. `to_column` gets how column names are found, so that it works on aliased tables too."""

    def to_column(self, at: Resolve) -> Column:
        raise NotImplementedError

    def document(self) -> str | None:
        """The column of JSON documents that the whole predicate tests by their parsed form, if there is one."""
        return None

    def on_document(self, text: Column, doc: Column) -> Column:
        """The predicate of a document's text and its parsed form."""
        raise NotImplementedError

    def __bool__(self):
        raise QueryError("a predicate has no truth value in Python; compose with And, Any and Not")


class Leaf(Pred):
    def __init__(self, name: str, build: Callable[[Column], Column]):
        self.name, self.build = name, build

    def to_column(self, at: Resolve) -> Column:
        return self.build(at(self.name))


class DocumentLeaf(Pred):
    """A test of a parsed JSON document."""

    def __init__(self, name: str, build: Callable[[Column, Column], Column]):
        self.name, self.build = name, build

    def to_column(self, at: Resolve) -> Column:
        return json_docs.sharing(at(self.name), lambda doc: self.build(at(self.name), doc))

    def document(self) -> str | None:
        return self.name

    def on_document(self, text: Column, doc: Column) -> Column:
        return self.build(text, doc)


class _Several(Pred):
    """Predicates under one connective. Those on the same JSON documents share their parsed form."""

    def __init__(self, *preds: Pred):
        self.preds = checked(preds)

    @staticmethod
    def joined(a: Column, b: Column) -> Column:
        raise NotImplementedError

    def to_column(self, at: Resolve) -> Column:
        if not self.preds:
            return F.lit(True)
        alike: dict[AnyValue, list[Pred]] = {}
        for i, p in enumerate(self.preds):
            alike.setdefault(p.document() or i, []).append(p)
        parts = []
        for name, preds in alike.items():
            parts.append(preds[0].to_column(at) if len(preds) == 1 else self._sharing(at(name), preds))
        return reduce(self.joined, parts)

    def _sharing(self, text: Column, preds: list[Pred]) -> Column:
        return json_docs.sharing(text, lambda doc: reduce(self.joined, [p.on_document(text, doc) for p in preds]))

    def document(self) -> str | None:
        names = {p.document() for p in self.preds}
        return names.pop() if len(names) == 1 else None

    def on_document(self, text: Column, doc: Column) -> Column:
        return reduce(self.joined, [p.on_document(text, doc) for p in self.preds])


class And(_Several):
    @staticmethod
    def joined(a: Column, b: Column) -> Column:
        return a & b


class Any(_Several):
    """At least one. Of nothing, it is no predicate."""

    @staticmethod
    def joined(a: Column, b: Column) -> Column:
        return a | b


class AnyOf(Any):
    """At least one of several conjunctions; empty ones don't count."""

    def __init__(self, *groups: And):
        super().__init__(*[g for g in groups if not (isinstance(g, And) and not g.preds)])


class Not(Pred):
    def __init__(self, pred: Pred):
        (self.pred,) = checked([pred])

    def to_column(self, at: Resolve) -> Column:
        return ~self.pred.to_column(at)

    def document(self) -> str | None:
        return self.pred.document()

    def on_document(self, text: Column, doc: Column) -> Column:
        return ~self.pred.on_document(text, doc)


def NotAny(*preds: Pred) -> Pred:
    return Not(Any(*preds)) if preds else And()


def NotAnyOf(*groups: And) -> Pred:
    some = AnyOf(*groups)
    return Not(some) if some.preds else And()


def checked(preds) -> tuple[Pred, ...]:
    """A malformed predicate must not widen a read, so anything else than a predicate is an error."""
    for p in preds:
        if not isinstance(p, Pred):
            raise QueryError(f"not a predicate: {p!r}")
    return tuple(preds)


class Handle:
    """A column of a table, with the predicates that its type has."""

    def __init__(self, table: Table, name: str):
        self.table, self.column, self.name = table, table.column(name), name

    def _leaf(self, op: str, build: Callable[[Column], Column]) -> Pred:
        if not APPLIES[op](self.column.type):
            raise QueryError(f"{op} doesn't apply to {self.table.name}.{self.name}, a {self.column.type}")
        if op in ("is_null", "is_not_null", "is_null_or_empty") and not self.column.nullable:
            raise QueryError(f"{self.table.name}.{self.name} is never null")
        return Leaf(self.name, build)

    def _document(self, op: str, build: Callable[[Column, Column], Column]) -> Pred:
        self._leaf(op, F.isnotnull)  # the operator has to apply
        return DocumentLeaf(self.name, build)

    def _value(self, op: str, value) -> Column:
        if not APPLIES[op](self.column.type):
            raise QueryError(f"{op} doesn't apply to {self.table.name}.{self.name}, a {self.column.type}")
        return value_of(self.column.type, value, f"{self.table.name}.{self.name}")

    def _compared(self, op: str, value, compare) -> Pred:
        v = self._value(op, value)
        return self._leaf(op, lambda c: compare(c, v))

    def eq(self, v) -> Pred:
        return self._compared("eq", v, lambda c, x: c == x)

    def ne(self, v) -> Pred:
        return self._compared("ne", v, lambda c, x: c != x)

    def gt(self, v) -> Pred:
        return self._compared("gt", v, lambda c, x: c > x)

    def gte(self, v) -> Pred:
        return self._compared("gte", v, lambda c, x: c >= x)

    def lt(self, v) -> Pred:
        return self._compared("lt", v, lambda c, x: c < x)

    def lte(self, v) -> Pred:
        return self._compared("lte", v, lambda c, x: c <= x)

    def eq_lower(self, v: str) -> Pred:
        return self._compared("eq_lower", v, lambda c, x: F.lower(c) == F.lower(x))

    def like(self, v: str) -> Pred:
        return self._compared("like", v, lambda c, _: c.like(v))

    def ilike(self, v: str) -> Pred:
        return self._compared("ilike", v, lambda c, _: c.ilike(v))

    def has_prefix(self, v: str) -> Pred:
        return self._compared("has_prefix", v, F.startswith)

    def has_suffix(self, v: str) -> Pred:
        return self._compared("has_suffix", v, F.endswith)

    def contains_text(self, v: str) -> Pred:
        return self._compared("contains_text", v, F.contains)

    def _listed(self, op: str, values: list, keep: bool) -> Pred:
        found = [None if v is None else self._value(op, v) for v in values]
        if not found:
            return self._leaf(op, lambda c: F.lit(not keep))
        lits = [F.lit(None) if v is None else v for v in found]
        return self._leaf(op, lambda c: c.isin(*lits) if keep else ~c.isin(*lits))

    def in_(self, values: list) -> Pred:
        return self._listed("in_", values, True)

    def not_in(self, values: list) -> Pred:
        """Unequal to every value; with a null among them, no row is."""
        return self._listed("not_in", values, False)

    def is_null(self) -> Pred:
        return self._leaf("is_null", lambda c: c.isNull())

    def is_not_null(self) -> Pred:
        return self._leaf("is_not_null", lambda c: c.isNotNull())

    def is_null_or_empty(self) -> Pred:
        return self._leaf("is_null_or_empty", lambda c: F.coalesce(c, F.lit("")) == "")

    def matches(self, query: str) -> Pred:
        return self._leaf("matches", lambda c: text_search.has_all(c, text_search.terms(query)))

    def web_search(self, query: str) -> Pred:
        return self._leaf("web_search", lambda c: text_search.web_search(c, query))

    def _range(self, lower, upper, bounds: str) -> Column:
        low, high = (F.lit(x).cast("timestamp_ntz") for x in (lower, upper))
        if lower is not None and upper is not None and lower > upper:
            raise QueryError("a range's lower bound is above its upper bound")
        return ranges.time_range(low, high, bounds)

    def range_overlaps(self, lower, upper, bounds: str = "[)") -> Pred:
        return self._leaf("range_overlaps", lambda c: ranges.overlaps(c, self._range(lower, upper, bounds)))

    def contains_range(self, lower, upper, bounds: str = "[)") -> Pred:
        return self._leaf("contains_range", lambda c: ranges.contains(c, self._range(lower, upper, bounds)))

    def range_contained_by(self, lower, upper, bounds: str = "[)") -> Pred:
        return self._leaf("range_contained_by", lambda c: ranges.contains(self._range(lower, upper, bounds), c))

    def _array(self, op: str, values: list, test) -> Pred:
        t = self.column.type
        if not APPLIES[op](t):
            raise QueryError(f"{op} doesn't apply to {self.table.name}.{self.name}, a {t}")
        for v in values:
            value_of(t, v, f"{self.table.name}.{self.name}")
        element = t.spark.elementType.simpleString()
        return self._leaf(op, lambda c: test(c, arrays.literal(values, element)))

    def array_contains(self, values: list) -> Pred:
        return self._array("array_contains", values, arrays.contains)

    def array_contained_by(self, values: list) -> Pred:
        return self._array("array_contained_by", values, arrays.contained_by)

    def array_overlaps(self, values: list) -> Pred:
        return self._array("array_overlaps", values, arrays.overlaps)

    def json_contains(self, value) -> Pred:
        return self._document("json_contains", lambda text, doc: json_docs.doc_contains(text, doc, value))

    def json_contained_by(self, value) -> Pred:
        return self._leaf("json_contained_by", lambda c: json_docs.contained_by(c, value))

    def has_any_key(self, keys: list[str]) -> Pred:
        return self._document("has_any_key", lambda text, doc: json_docs.doc_has_any_key(text, doc, keys))

    def has_all_keys(self, keys: list[str]) -> Pred:
        return self._document("has_all_keys", lambda text, doc: json_docs.doc_has_all_keys(text, doc, keys))

    def text_like_any(self, patterns: list[str]) -> Pred:
        return self._leaf("text_like_any", lambda c: json_docs.text_like_any(c, patterns))

    def json_is_empty(self) -> Pred:
        return self._leaf("json_is_empty", json_docs.is_empty)
