"""Tests of JSON documents held as text. They are parsed on use; text that is not JSON matches nothing."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


_NAME = re.compile(r"[A-Za-z_]\w*")


def parsed(text: Column) -> Column:
    return F.try_parse_json(text)


def _step(key: str) -> str:
    if _NAME.fullmatch(key):
        return f".{key}"
    quoted = key.replace("\\", "\\\\").replace('"', '\\"')
    return f'["{quoted}"]'


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_array(v: Column) -> Column:
    return _kind(v).startswith("ARRAY<")


def _is_object(v: Column) -> Column:
    return _kind(v).startswith("OBJECT<")


def _scalar(v: Column, value: Any, path: str = "$") -> Column:
    """What is at the path is the value. Few documents have it, so the value is looked at before its kind."""
    kind = _kind(F.try_variant_get(v, path, "variant") if path != "$" else v)
    if value is None:
        return kind == "VOID"
    as_type, value, kinds = (
        ("boolean", value, kind == "BOOLEAN")
        if isinstance(value, bool)
        else ("double", float(value), kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"))
        if isinstance(value, (int, float))
        else ("string", value, kind == "STRING")
    )
    return F.coalesce(F.try_variant_get(v, path, as_type) == F.lit(value), F.lit(False)) & kinds


def _held(value: Any):
    return lambda e: _holds(e, value, False)


def _holds(v: Column, value: Any, top: bool) -> Column:
    if isinstance(value, dict):
        out = F.lit(True)
        for k, x in value.items():
            at = "$" + _step(k)
            if isinstance(x, (dict, list)):
                inner = F.try_variant_get(v, at, "variant")
                out = out & inner.isNotNull() & _holds(inner, x, False)
            else:
                out = out & _scalar(v, x, at)
        return out & _is_object(v)
    items = F.try_variant_get(v, "$", "array<variant>")
    if isinstance(value, list):
        out = _is_array(v)
        for x in value:
            out = out & F.coalesce(F.exists(items, _held(x)), F.lit(False))
        return out
    if top:  # a document that is an array also holds a scalar that is one of its elements
        return _scalar(v, value) | (_is_array(v) & F.coalesce(F.exists(items, lambda e: _scalar(e, value)), F.lit(False)))
    return _scalar(v, value)


def sharing(text: Column, test: Callable[[Column], Column]) -> Column:
    """A test of the parsed document, which is parsed once however often the test names it: Spark would parse it at each."""
    return F.element_at(F.transform(F.array(parsed(text)), test), 1)


def doc_contains(text: Column, doc: Column, value: Any) -> Column:
    """`contains` of a document that is parsed already."""
    return F.when(text.isNotNull(), F.coalesce(_holds(doc, value, True), F.lit(False)))


def contains(text: Column, value: Any) -> Column:
    """The document holds the value: its keys with values that hold theirs, its elements each somewhere, its scalars exactly."""
    return sharing(text, lambda doc: doc_contains(text, doc, value))


def contained_by(text: Column, value: Any) -> Column:
    """The value holds the document. The document is known only to the row, so this one runs in vectorised Python."""

    def holds(doc: Any, value: Any, top: bool = True) -> bool:
        if isinstance(doc, dict):
            return isinstance(value, dict) and all(k in value and holds(x, value[k], False) for k, x in doc.items())
        if isinstance(doc, list):
            return isinstance(value, list) and all(any(holds(x, y, False) for y in value) for x in doc)
        if top and isinstance(value, list):
            return any(holds(doc, y, False) for y in value if not isinstance(y, (dict, list)))
        if isinstance(value, (dict, list)):
            return False
        if isinstance(doc, bool) or isinstance(value, bool):
            return doc is value
        return doc == value

    @F.pandas_udf("boolean")
    def within(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import json

        def one(t):
            if t is None:
                return None
            try:
                return holds(json.loads(t), value)
            except ValueError:
                return False

        for batch in batches:
            yield batch.map(one, na_action=None).astype(object)

    return within(text)


def _top_strings(text: Column, doc: Column) -> Column:
    """Keys of an object, string elements of an array, a string itself."""
    items = F.transform(
        F.filter(F.try_variant_get(doc, "$", "array<variant>"), lambda e: _kind(e) == "STRING"), lambda e: F.try_variant_get(e, "$", "string")
    )
    none = F.array().cast("array<string>")
    return (
        F.when(_is_object(doc), F.coalesce(F.json_object_keys(text), none))
        .when(_is_array(doc), F.coalesce(items, none))
        .when(_kind(doc) == "STRING", F.array(F.try_variant_get(doc, "$", "string")))
        .otherwise(none)
    )


def doc_has_any_key(text: Column, doc: Column, keys: list[str]) -> Column:
    wanted = F.array(*map(F.lit, keys)).cast("array<string>")
    out = F.coalesce(F.arrays_overlap(_top_strings(text, doc), wanted), F.lit(False))
    for k in reversed(keys):  # a key that a path can name is found without a list of all keys
        if _NAME.fullmatch(k):
            out = F.try_variant_get(doc, "$" + _step(k), "variant").isNotNull() | out
    return F.when(text.isNotNull(), out)


def has_any_key(text: Column, keys: list[str]) -> Column:
    return sharing(text, lambda doc: doc_has_any_key(text, doc, keys))


def doc_has_all_keys(text: Column, doc: Column, keys: list[str]) -> Column:
    wanted = F.array(*map(F.lit, keys)).cast("array<string>")
    return F.when(text.isNotNull(), F.size(F.array_except(wanted, _top_strings(text, doc))) == 0)


def has_all_keys(text: Column, keys: list[str]) -> Column:
    return sharing(text, lambda doc: doc_has_all_keys(text, doc, keys))


def text_like_any(text: Column, patterns: list[str]) -> Column:
    """The document's text is like one of the patterns; a null document counts as empty text."""
    body, out = F.coalesce(text, F.lit("")), F.lit(False)
    for p in patterns:
        out = out | body.like(p)
    return out


def is_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).isin("", "null", "[]", "{}")


def field(v: Column, key: str) -> Column:
    """The text of an element's field."""
    return F.try_variant_get(v, "$" + _step(key), "string")


def elements(text: Column) -> Column:
    """The elements of a document that is an array; nothing for objects, scalars, nulls and text that is not JSON."""
    found = sharing(text, lambda doc: F.when(_is_array(doc), F.try_variant_get(doc, "$", "array<variant>")))
    return F.coalesce(found, F.array().cast("array<variant>"))
