"""Declared type names, their Spark types, and the result types of aggregates."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

from .errors import DeclarationError

_PLAIN = {
    "bool": T.BooleanType(),
    "int2": T.ShortType(),
    "int4": T.IntegerType(),
    "int8": T.LongType(),
    "float4": T.FloatType(),
    "float8": T.DoubleType(),
    "text": T.StringType(),
    "enum": T.StringType(),
    "uuid": T.StringType(),
    "inet": T.StringType(),
    "cidr": T.StringType(),
    "macaddr": T.StringType(),
    "json": T.StringType(),
    "jsonb": T.StringType(),
    "bytea": T.BinaryType(),
    "timestamptz": T.TimestampType(),
    "timestamp": T.TimestampNTZType(),
    "date": T.DateType(),
    "time": T.TimeType() if hasattr(T, "TimeType") else T.LongType(),
    "interval": T.StructType().add("months", "integer").add("days", "integer").add("micros", "long"),
    "tsvector": T.ArrayType(T.StringType(), False),
    "hstore": T.MapType(T.StringType(), T.StringType()),
    "tstzrange": T.StructType()
    .add("lower", T.TimestampNTZType())
    .add("upper", T.TimestampNTZType())
    .add("lower_inc", "boolean")
    .add("upper_inc", "boolean")
    .add("lower_inf", "boolean")
    .add("upper_inf", "boolean")
    .add("empty", "boolean"),
}
INTEGERS = ("int2", "int4", "int8")
FLOATS = ("float4", "float8")
NUMBERS = (*INTEGERS, "numeric", *FLOATS)
TEXTS = ("text", "enum")
#: Widening order inside the numeric family.
_WIDTH = {"int2": 0, "int4": 1, "int8": 2, "numeric": 3, "float4": 4, "float8": 5}


@dataclass(frozen=True)
class Type:
    """A declared type: `base`, with precision and scale for numeric, a size for varchar, `array` for a one-dimensional array."""

    base: str
    precision: int | None = None
    scale: int | None = None
    size: int | None = None
    array: bool = False
    labels: tuple[str, ...] = ()

    def __str__(self) -> str:
        inner = f"({self.precision},{self.scale})" if self.base == "numeric" else f"({self.size})" if self.size else ""
        return self.base + inner + "[]" * self.array

    @property
    def spark(self) -> T.DataType:
        inner = T.DecimalType(self.precision or 38, self.scale if self.scale is not None else 6) if self.base == "numeric" else _PLAIN[self.base]
        return T.ArrayType(inner) if self.array else inner

    def is_(self, *bases: str) -> bool:
        return not self.array and self.base in bases


def parse(text: str | Type) -> Type:
    """`int8`, `numeric(12,2)`, `varchar(32)`, `text[]`, ..."""
    if isinstance(text, Type):
        return text
    m = re.fullmatch(r"([a-z]+\d?)(?:\((\d+)(?:,\s*(\d+))?\))?(\[\])?", text.strip())
    if not m:
        raise DeclarationError(f"not a type: {text!r}")
    base, a, b, array = m.groups()
    if base == "varchar":
        return Type("text", size=int(a) if a else None, array=bool(array))
    if base == "numeric":
        p = int(a) if a else 38
        s = int(b) if b else (0 if a else 6)
        if not 1 <= p <= 38 or s > p:
            raise DeclarationError(f"numeric({p},{s}): a precision is 1 to 38 and no less than the scale")
        return Type("numeric", p, s, array=bool(array))
    if base not in _PLAIN or a:
        raise DeclarationError(f"not a type: {text!r}")
    return Type(base, array=bool(array))


def of_spark(t: T.DataType) -> Type:
    """The declared type that a Spark type comes from, for introspection."""
    if isinstance(t, T.ArrayType):
        inner = of_spark(t.elementType)
        if inner.array:
            raise DeclarationError("nested arrays are not supported")
        return Type(inner.base, inner.precision, inner.scale, array=True)
    if isinstance(t, T.DecimalType):
        return Type("numeric", t.precision, t.scale)
    for name in ("bool", "int2", "int4", "int8", "float4", "float8", "text", "bytea", "timestamptz", "timestamp", "date", "time", "hstore"):
        if _PLAIN[name] == t:
            return Type(name)
    raise DeclarationError(f"no declared type for {t.simpleString()}")


def comparable(a: Type, b: Type) -> bool:
    """Whether two values may be compared: the same type, both numbers, or both texts."""
    if a.array or b.array:
        return a == b
    return a.base == b.base or (a.base in NUMBERS and b.base in NUMBERS) or (a.base in TEXTS and b.base in TEXTS)


def widen(a: Type, b: Type) -> Type | None:
    """The type that holds both, or None."""
    if a == b:
        return a
    if a.array or b.array:
        return None
    if a.base in NUMBERS and b.base in NUMBERS:
        if a.base == b.base == "numeric":
            s = max(a.scale, b.scale)
            return Type("numeric", min(38, max(a.precision - a.scale, b.precision - b.scale) + s), s)
        top = a if _WIDTH[a.base] >= _WIDTH[b.base] else b
        if {a.base, b.base} == {"numeric", "float4"}:
            return Type("float8")
        if top.base == "numeric":
            return Type("numeric", 38, top.scale)
        return top
    if a.base in TEXTS and b.base in TEXTS:
        return Type("text")
    return None


# Result types of sum and avg, and the types that min and max take.
SUM_TYPES = {"int2": "int8", "int4": "int8", "int8": "numeric(38,0)", "numeric": "numeric", "float4": "float4", "float8": "float8", "interval": "interval"}
AVG_TYPES = {"int2": "numeric", "int4": "numeric", "int8": "numeric", "numeric": "numeric", "float4": "float8", "float8": "float8", "interval": "interval"}
ORDERED_TYPES = ("int2", "int4", "int8", "numeric", "float4", "float8", "text", "timestamptz", "timestamp", "date", "time", "interval", "inet")
# Fixed values end.

#: Averages of exact numbers, and divisions, are rounded to so many places.
AVG_SCALE = 6


def sum_type(t: Type) -> Type:
    if t.array or t.base not in SUM_TYPES:
        raise DeclarationError(f"sum of {t} is not defined")
    if t.base == "numeric":
        return Type("numeric", 38, t.scale)
    return parse(SUM_TYPES[t.base])


def avg_type(t: Type) -> Type:
    if t.array or t.base not in AVG_TYPES:
        raise DeclarationError(f"avg of {t} is not defined")
    return Type("numeric", 38, AVG_SCALE) if AVG_TYPES[t.base] == "numeric" else parse(AVG_TYPES[t.base])


def extreme_type(t: Type) -> Type:
    if t.array or t.base not in ORDERED_TYPES:
        raise DeclarationError(f"min and max of {t} are not defined")
    return t
