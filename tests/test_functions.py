"""Ranges, documents, arrays, text search and scalars on small rows, and windows' null places."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessella.functions import arrays, json_docs, ranges, scalars, text_search
from tessella.operators import terms as T
from tessella.types import Type


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def day(n):
    return F.lit(dt.datetime(2020, 1, n)).cast("timestamp_ntz")


def test_ranges(spark):
    r = ranges.time_range
    none = F.lit(None).cast("timestamp_ntz")
    assert one(spark, ranges.overlaps(r(day(1), day(3)), r(day(2), day(4))))
    assert not one(spark, ranges.overlaps(r(day(1), day(3)), r(day(3), day(4))))
    assert one(spark, ranges.overlaps(r(day(1), day(3), "[]"), r(day(3), day(4))))
    assert one(spark, ranges.overlaps(r(none, none), r(day(3), day(4))))
    assert not one(spark, ranges.overlaps(r(day(3), day(3)), r(none, none)))
    assert one(spark, ranges.contains(r(day(1), day(5)), r(day(1), day(5))))
    assert not one(spark, ranges.contains(r(day(1), day(5)), r(day(1), day(5), "[]")))
    assert one(spark, ranges.contains(r(day(1), day(5)), r(day(9), day(9))))
    assert not one(spark, ranges.contains(r(day(1), day(5)), r(day(1), none)))
    with pytest.raises(Exception, match="above its upper"):
        one(spark, r(day(5), day(1))["empty"])


@pytest.mark.parametrize(
    "doc, value, want",
    [
        ('{"a": 1, "b": [1, 2, {"c": "x"}]}', {"b": [{"c": "x"}]}, True),
        ('{"a": 1}', {"a": 1.0}, True),
        ('{"a": "1"}', {"a": 1}, False),
        ('{"a": true}', {"a": True}, True),
        ('{"a": null}', {"a": None}, True),
        ("[1, 2, 3]", [3, 1], True),
        ("[1, 2, 3]", 2, True),
        ("[1, 2, 3]", [], True),
        ("[]", {}, False),
        ("nonsense", {"a": 1}, False),
        (None, {"a": 1}, None),
    ],
)
def test_json_contains(spark, doc, value, want):
    assert one(spark, json_docs.contains(F.lit(doc).cast("string"), value)) is want


def test_json_keys_and_elements(spark):
    s = lambda x: F.lit(x).cast("string")
    assert one(spark, json_docs.has_any_key(s('["a", 1]'), ["a"]))
    assert one(spark, json_docs.has_all_keys(s('{"a": 1, "b": 2}'), ["a", "b"]))
    assert not one(spark, json_docs.has_all_keys(s('{"a": 1}'), ["a", "b"]))
    assert one(spark, json_docs.contained_by(s('{"a": [1]}'), {"a": [1, 2], "b": 3}))
    assert not one(spark, json_docs.contained_by(s('{"a": true}'), {"a": 1}))
    for doc, n in (('[{"k": 1}, 2]', 2), ('{"k": 1}', 0), ("3", 0), ("null", 0), ("broken", 0), (None, 0)):
        assert one(spark, F.size(json_docs.elements(s(doc)))) == n
    for doc in ("", "null", "[]", "{}", None):
        assert one(spark, json_docs.is_empty(s(doc)))


def test_arrays_with_nulls(spark):
    a = F.array(F.lit("x"), F.lit(None))
    lit = lambda *v: arrays.literal(list(v), "string")
    assert one(spark, arrays.contains(a, lit("x")))
    assert one(spark, arrays.contains(a, lit()))
    assert not one(spark, arrays.overlaps(a, lit("y")))
    assert one(spark, arrays.overlaps(F.lit(None).cast("array<string>"), lit("y"))) is None
    assert one(spark, arrays.contained_by(lit("x"), lit("x", "y")))


def test_web_search(spark):
    v = text_search.words(F.lit("The quick brown fox, the LAZY dog."))
    for query, want in (("quick fox", True), ('"quick brown"', True), ('"brown quick"', False), ("-cat dog", True), ("-dog", False), ("cat or lazy", True), ("", False)):
        assert bool(one(spark, text_search.web_search(v, query))) is want, query


def test_truncation_and_division(spark):
    at = F.lit(dt.datetime(2000, 7, 9, 5, 6, 7)).cast("timestamp_ntz")
    assert one(spark, scalars.date_trunc("decade", at)) == dt.datetime(2000, 1, 1)
    assert one(spark, scalars.date_trunc("century", at)) == dt.datetime(1901, 1, 1)
    assert one(spark, scalars.date_trunc("millennium", at)) == dt.datetime(1001, 1, 1)
    assert one(spark, scalars.date_trunc("milliseconds", at)) == dt.datetime(2000, 7, 9, 5, 6, 7)
    assert one(spark, scalars.date_trunc("week", at)) == dt.datetime(2000, 7, 3)
    assert one(spark, scalars.div(F.lit(1), F.lit(8), 2)) == Decimal("0.13")
    with pytest.raises(Exception, match="(?i)zero"):
        one(spark, scalars.div(F.lit(1), F.lit(0)))


def test_first_keeps_nulls_in_every_order(spark):
    rows = spark.createDataFrame([(1, None, "n"), (1, 2, "b"), (1, 1, "a"), (1, 3, None)], "g int, k int, v string")
    k, i4 = F.col("k"), Type("int4")
    for down, nulls_first, want in ((False, False, "a"), (False, True, "n"), (True, True, "n"), (True, False, None)):
        got = rows.groupBy("g").agg(T.first_in_order(F.col("v"), ((k, down, nulls_first, i4),), None).alias("x")).first().x
        assert got == want
    mixed = ((F.col("g"), True, True, i4), (k, False, False, i4))
    assert rows.groupBy("g").agg(T.first_in_order(F.col("v"), mixed, None).alias("x")).first().x == "a"
    assert rows.groupBy("g").agg(T.first_in_order(F.col("v"), mixed, F.lit(False)).alias("x")).first().x is None


def test_mixed_orders_turn_every_type_round(spark):
    values = {
        "int8": [-(2**63), -1, 0, 5, 2**63 - 1],
        "float8": [-1.5, 0.0, 2.25],
        "text": ["", "a", "ab", "abc", "b", "é"],
        "date": [dt.date(1969, 1, 2), dt.date(2020, 5, 5)],
        "timestamp": [dt.datetime(1960, 1, 1), dt.datetime(2020, 1, 1, 3)],
    }
    for base, some in values.items():
        t = Type(base)
        rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(some)], "g int, i int, v " + t.spark.simpleString())
        order = ((F.col("g"), False, False, Type("int4")), (F.col("v"), True, True, t))
        assert rows.groupBy("g").agg(T.first_in_order(F.col("i"), order, None).alias("x")).first().x == len(some) - 1, base


def test_exact_averages_of_money(spark):
    rows = spark.createDataFrame([(Decimal("0.10"),)] * 3, "m decimal(12,2)")
    arg = T.Typed(F.col("m"), Type("numeric", 12, 2), False)
    got = rows.agg(T.aggregate("sum", arg, None).column.alias("s"), T.aggregate("avg", arg, None).column.alias("a")).first()
    assert got.s == Decimal("0.30") and got.a == Decimal("0.100000")


def test_predicates_of_a_document_agree_with_each_by_itself(spark):
    from tessella.model import Column, Table
    from tessella.predicates import And, Any, Handle, Not

    docs = ['{"k": 1}', '{"k": "1"}', '{"k": null}', '{"zz": 2}', '{"k": 1, "k": 2}', '["k", 1]', '"k"', "1", "null", "broken", "", "{}", None]
    rows = spark.createDataFrame(list(enumerate(docs)), "i int, d string")
    h = Handle(Table("x", (Column("i", "int4"), Column("d", "jsonb", True)), ("i",)), "d")
    leaves = [h.json_contains({"k": 1}), h.json_contains({}), h.json_contains(1), h.has_any_key(["k", "a b"]), h.has_all_keys(["zz"])]
    alone = [x.to_column(F.col) for x in leaves]
    pairs = [
        (And(*leaves[:2]), alone[0] & alone[1]),
        (Any(*leaves), alone[0] | alone[1] | alone[2] | alone[3] | alone[4]),
        (Not(And(leaves[1], Any(leaves[3], leaves[4]))), ~(alone[1] & (alone[3] | alone[4]))),
        (And(), F.lit(True)),
    ]
    for r in rows.select(*[x for a, b in pairs for x in (a.to_column(F.col), b)]).collect():
        assert tuple(r)[::2] == tuple(r)[1::2]
    got = rows.orderBy("i").select(*alone[:1], alone[3]).collect()
    assert [r[0] for r in got] == [True, *[False] * 11, None]
    assert [r[1] for r in got] == [True, True, True, False, False, True, True, *[False] * 5, None]
