"""What is refused, and when."""

import datetime as dt

import pytest

from tessella import Catalog, Column, DeclarationError, QueryError, Refused, Relation, Table
from tessella.operators import recursion, topn, unions
from tessella.operators import terms as T
from tessella.operators.aggregation import Aggregation
from tessella.operators.joins import Join
from tessella.operators.ordering import asc, desc
from tessella.operators.query import Query
from tessella.operators.windows import CURRENT, UNBOUNDED_FOLLOWING, over, preceding
from tessella.plans.relations import plan
from tessella.predicates import Any, AnyOf, Not, NotAny

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def c(spark):
    from tessella.reports import catalog

    return catalog(spark, SF)


def refused(match, fn, error=DeclarationError):
    with pytest.raises(error, match=match):
        fn()


def test_predicates_check_their_types(c):
    q = Query(c, "orders")
    refused("not a value", lambda: q["o_orderkey"].eq("x"), QueryError)
    refused("doesn't apply", lambda: q["o_orderkey"].like("x"), QueryError)
    refused("doesn't apply", lambda: q["o_tags"].eq("x"), QueryError)
    refused("never null", lambda: q["o_orderkey"].is_null(), QueryError)
    refused("is_null", lambda: q["o_orderkey"].eq(None), QueryError)
    refused("time zone", lambda: q["o_orderdate"].gt(dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc)), QueryError)
    refused("not a predicate", lambda: q.where("o_orderkey = 1"), QueryError)
    refused("no column", lambda: q["nope"])
    with pytest.raises(QueryError):
        bool(q["o_orderkey"].eq(1))


def test_values_never_become_sql(c):
    q = Query(c, "orders")
    assert q.where(q["o_orderstatus"].eq("' OR 1=1 --")).count() == 0
    assert q.where(q["o_orderstatus"].has_prefix("%")).count() == 0


def test_empty_groups_do_not_widen_or_narrow(c):
    q = Query(c, "region")
    assert q.where(Any()).count() == q.where(AnyOf()).count() == q.where(NotAny()).count() == 5
    assert q.where(Not(q["r_name"].in_([]))).count() == 5
    assert q.where(q["r_name"].in_([])).count() == 0


def test_locks_and_servers_are_refused(c):
    from tessella.sources import tables

    for fn in (Query(c, "orders").for_update, Query(c, "orders").for_share, tables.lock_tables, tables.advisory_lock, tables.trigger, tables.transaction, tables.sessions):
        refused(r"\w+:|own Spark", fn, Refused)


def test_keyset_paging(c):
    q = Query(c, "orders").order(asc("o_totalprice"), asc("o_orderkey")).limit(97)
    seen, row = [], None
    while True:
        page = (q.after(row) if row else q).all()
        if not page:
            break
        seen += [r.o_orderkey for r in page]
        row = page[-1]
    assert len(seen) == len(set(seen)) == Query(c, "orders").count()
    row = {"o_totalprice": 1.0, "o_orderkey": 1}
    refused("one direction", lambda: Query(c, "orders").order(asc("o_totalprice"), desc("o_orderkey")).after(row).df(), QueryError)
    refused("needs an order", lambda: Query(c, "orders").unordered().after(row).df(), QueryError)
    refused("nullable", lambda: Query(c, "customer").order(asc("c_age")).after({"c_age": 3}).df(), QueryError)
    refused("at most 4", lambda: Query(c, "orders").order(*[asc("o_orderkey")] * 5), QueryError)


def test_keyset_reaches_the_scan(c):
    q = Query(c, "orders").order(asc("o_totalprice"), asc("o_orderkey")).after({"o_totalprice": 1.0, "o_orderkey": 1})
    text = q.project("o_orderkey").df()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_totalprice,1.0)" in text


def test_aggregation_refusals(c):
    def agg():
        return Aggregation(c, "customer", "r").by("c_mktsegment")

    def built(change):
        a = agg()
        change(a)
        return a.build

    refused("min and max of bool", lambda: T.aggregate("min", T.Typed(None, __import__("tessella.types").types.Type("bool"), False), None))
    refused("no output", built(lambda a: a.having(T.gt(T.Out("n"), 1))))
    refused("neither grouped", built(lambda a: a.compute("X", T.Col("c_name"))))
    refused("grouped twice", built(lambda a: a.by_expr("Again", T.Col("c_mktsegment"))))
    refused("sum of text", built(lambda a: a.sum("S", T.Col("c_name"))))
    refused("not comparable", built(lambda a: a.where(T.eq(T.Col("c_name"), 1))))
    refused("needs an order", built(lambda a: (a.count("N"), a.window("R", "rank", over()))))
    refused("needs an order unless", built(lambda a: (a.count("N"), a.window("S", "sum", over().rows(preceding(2), CURRENT), T.Out("n")))))
    refused("needs grouping sets", built(lambda a: a.grouping("G", "c_mktsegment")))
    refused("called n", built(lambda a: (a.count("N"), a.count("N"))))
    with pytest.raises(DeclarationError, match="not used"):
        agg().build(params=("p",))
    with pytest.raises(DeclarationError, match="not declared"):
        a = agg()
        a.count("N").filter(T.gt(T.Col("c_acctbal"), T.Param("p")))
        a.build()
    refused("exclude each other", lambda: agg().rollup().cube())
    refused("starts before", lambda: over().rows(CURRENT, preceding(1)))
    refused("RANGE", lambda: over().range(preceding(3), UNBOUNDED_FOLLOWING))
    refused("unit", lambda: Aggregation(c, "orders").by_expr("D", T.date_trunc("fortnight", T.Col("o_orderdate"))).build())
    a = agg()
    a.count("N")
    refused("declared order", lambda: a.build().df(order=[asc("n")]), QueryError)


def test_every_problem_is_reported(c):
    a = Aggregation(c, "customer", "r").by("c_mktsegment")
    a.sum("S", T.Col("c_name"))
    a.min("M", T.Col("missing"))
    with pytest.raises(DeclarationError) as e:
        a.build()
    assert len(e.value.problems) == 2


def test_join_union_and_plan_refusals(c):
    refused("no column", lambda: Join(c, "orders").inner("customer").take("x", T.Col("nope", "customer")).build())
    refused("takes no column", lambda: Join(c, "orders").inner("customer").build())
    refused("is joined with", lambda: Join(c, "orders").on("inner", "customer", "c", (T.Col("o_orderstatus", "own"), "c_custkey")).take("k", T.Col("o_orderkey")).build())
    refused("inner or left", lambda: Join(c, "orders").on("full", "customer", "c", (T.Col("o_custkey", "own"), "c_custkey")).take("k", T.Col("o_orderkey")).build())
    u = unions.Union(c)
    u.branch("orders").take("Id", "o_orderkey")
    refused("two branches", u.build)
    u.branch("customer").take("Id", "c_name")
    refused("needs an order", u.build)
    u.order_by(asc("id"))
    refused("don't go together", u.build)
    refused("needs an order", lambda: plan(Query(c, "customer")).load("orders", top=2), QueryError)
    refused("order terms", lambda: topn.distinct_on(Query(c, "orders"), 1), QueryError)
    refused("depth", lambda: recursion.descend(c, "part", [0], 0), QueryError)
    refused("exactly one", lambda: recursion.descend(c, "orders", [0], 3))


def test_child_limit_is_an_error(c):
    from tessella.errors import ChildLimitError

    with pytest.raises(ChildLimitError):
        plan(Query(c, "customer").limit(20)).limited(3).load("orders").all()


def test_model_problems_come_together(spark):
    bad = Table("t", (Column("a", "int8"), Column("a", "text")), ("missing",), (Relation("r", "one", "nowhere", ("a",), ("x",)),), soft_delete="a")
    with pytest.raises(DeclarationError) as e:
        Catalog(spark, [bad], {})
    assert len(e.value.problems) >= 4
    refused("not a type", lambda: Column("x", "int3"))
    refused("nested", lambda: __import__("tessella.types").types.of_spark(spark.sql("SELECT array(array(1)) AS x").schema["x"].dataType))
