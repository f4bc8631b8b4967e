"""The registered queries: each reads the test tables through a catalog and has its SQL beside it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import json_docs, scalars
from .model import Arc, Catalog, Column, ForeignKey, Relation, Table, Unique
from .operators import probes, recursion, topn, unions, writes
from .operators import terms as T
from .operators.aggregation import Aggregation
from .operators.joins import Join
from .operators.ordering import asc, asc_nulls_first, desc, desc_nulls_last
from .operators.query import Query
from .operators.windows import CURRENT, UNBOUNDED_FOLLOWING, UNBOUNDED_PRECEDING, over, preceding
from .plans.raw import Registry
from .plans.relations import plan
from .predicates import And, Any, Not
from .sources import schema_diff, shards, tables
from .streaming.rows import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AGE = "CASE WHEN c_custkey % 7 <> 0 THEN CAST(18 + c_custkey % 60 AS INT) END"
NOTE = "CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN c_mktsegment END"
DELETED = "CASE WHEN o_orderstatus = 'P' THEN o_orderdate END"
RANGE = (
    "named_struct('lower', o_orderdate, 'upper', o_orderdate + INTERVAL '7' DAY, 'lower_inc', true, 'upper_inc', false, "
    "'lower_inf', false, 'upper_inf', false, 'empty', false)"
)
WORDS = r"array_remove(split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ')), ' '), '')"


def _tables() -> list[Table]:
    orders = (
        Column("o_orderkey", "int8"),
        Column("o_custkey", "int8"),
        Column("o_orderstatus", "text"),
        Column("o_totalprice", "float8"),
        Column("o_orderdate", "timestamp"),
        Column("o_orderpriority", "text"),
        Column("o_total", "numeric(12,2)", source="o_totalprice"),
    )
    to_customer = Relation("customer", "one", "customer", ("o_custkey",), ("c_custkey",))
    return [
        Table("region", (Column("r_regionkey", "int4"), Column("r_name", "text")), ("r_regionkey",)),
        Table(
            "nation",
            (Column("n_nationkey", "int4"), Column("n_name", "text"), Column("n_regionkey", "int4")),
            ("n_nationkey",),
            (
                Relation("region", "one", "region", ("n_regionkey",), ("r_regionkey",)),
                Relation("customers", "many", "customer", ("n_nationkey",), ("c_nationkey",)),
                Relation("neighbours", "many", "nation", ("n_nationkey",), ("n_nationkey",), "borders", (("from_key",), ("to_key",))),
            ),
            (ForeignKey(("n_regionkey",), "region", ("r_regionkey",)),),
        ),
        Table(
            "customer",
            (
                Column("c_custkey", "int8"),
                Column("c_name", "text"),
                Column("c_nationkey", "int4"),
                Column("c_acctbal", "float8"),
                Column("c_mktsegment", "text"),
                Column("c_age", "int4", True, source=AGE),
                Column("c_note", "text", True, source=NOTE),
            ),
            ("c_custkey",),
            (Relation("nation", "one", "nation", ("c_nationkey",), ("n_nationkey",)), Relation("orders", "many", "orders", ("c_custkey",), ("o_custkey",))),
            enums={"c_mktsegment": ("MACHINERY", "BUILDING", "AUTOMOBILE", "HOUSEHOLD", "FURNITURE")},
        ),
        Table("supplier", (Column("s_suppkey", "int8"), Column("s_name", "text"), Column("s_nationkey", "int4"), Column("s_acctbal", "float8")), ("s_suppkey",)),
        Table(
            "part",
            (
                Column("p_partkey", "int8"),
                Column("p_name", "text"),
                Column("p_brand", "text"),
                Column("p_type", "text"),
                Column("p_size", "int4"),
                Column("p_retailprice", "float8"),
                Column("p_parent", "int8", source="p_partkey div 2"),
            ),
            ("p_partkey",),
            (
                Relation("parent", "one", "part", ("p_parent",), ("p_partkey",)),
                Relation("suppliers", "many", "supplier", ("p_partkey",), ("s_suppkey",), "supply", (("l_partkey",), ("l_suppkey",))),
            ),
        ),
        Table(
            "orders",
            (
                *orders,
                Column("o_tags", "text[]", source="array(o_orderpriority, o_orderstatus)"),
                Column("o_during", "tstzrange", source=RANGE),
                Column("o_open_for", "int8", True, source="CASE WHEN o_orderstatus = 'O' THEN o_custkey END"),
                Column("o_done_for", "int8", True, source="CASE WHEN o_orderstatus <> 'O' THEN o_custkey END"),
            ),
            ("o_orderkey",),
            (to_customer, Relation("lines", "many", "lineitem", ("o_orderkey",), ("l_orderkey",))),
            (ForeignKey(("o_custkey",), "customer", ("c_custkey",), "cascade"),),
            arcs=(Arc("subject", {"open": ("o_open_for", "customer"), "done": ("o_done_for", "customer")}),),
        ),
        Table("live_orders", (*orders, Column("deleted_at", "timestamp", True, source=DELETED)), ("o_orderkey",), (to_customer,), soft_delete="deleted_at", uniques=(Unique(("o_orderkey",)),)),
        Table(
            "lineitem",
            tuple(
                Column(n, t)
                for n, t in (
                    ("l_orderkey", "int8"), ("l_partkey", "int8"), ("l_suppkey", "int8"), ("l_linenumber", "int4"), ("l_quantity", "float8"), ("l_extendedprice", "float8"),
                    ("l_discount", "float8"), ("l_tax", "float8"), ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "timestamp"),
                )
            ),
            (),
            (Relation("order", "one", "orders", ("l_orderkey",), ("o_orderkey",)), Relation("part", "one", "part", ("l_partkey",), ("p_partkey",)), Relation("supplier", "one", "supplier", ("l_suppkey",), ("s_suppkey",))),
        ),
        Table("borders", (Column("from_key", "int4"), Column("to_key", "int4")), ("from_key", "to_key")),
        Table(
            "shelf",
            (
                Column("id", "int8", identity=True),
                Column("sku", "text"),
                Column("on_hand", "int4", default=0, inc_when="on_hand < 25"),
                Column("version", "int4", default=1, version=True),
                Column("twice", "int4", generated="on_hand * 2"),
                Column("label", "uuid", default=writes.new_uuid()),
            ),
            ("id",),
        ),
        Table("supply", (Column("l_partkey", "int8"), Column("l_suppkey", "int8"), Column("quantity", "float8")), ("l_partkey", "l_suppkey")),
        Table(
            "events",
            (
                Column("event_id", "int8"), Column("ts", "timestamp"), Column("user_id", "int8"), Column("event_type", "text"), Column("value", "float8"), Column("props", "jsonb"),
                Column("items", "jsonb", source="CASE event_id % 4 WHEN 0 THEN concat('[', props, ',', props, ']') WHEN 1 THEN props WHEN 2 THEN 'null' ELSE '[]' END"),
            ),
            ("event_id",),
        ),
        Table("documents", (Column("doc_id", "int8"), Column("lang", "text"), Column("source", "text"), Column("n_chars", "int8"), Column("words", "tsvector", source=WORDS)), ("doc_id",)),
    ]


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    def at(name: str) -> str:
        return f"{sf_dir}/{name}.parquet"

    sources: dict = {n: at(n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")}
    sources["live_orders"] = at("orders")
    sources["supply"] = lambda s: s.read.parquet(at("lineitem")).groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("quantity"))
    sources["shelf"] = lambda s: s.read.parquet(at("part")).selectExpr("p_partkey AS id", "p_name AS sku", "p_size AS on_hand", "1 AS version", "p_size * 2 AS twice", "'00000000-0000-0000-0000-000000000000' AS label")
    sources["borders"] = lambda s: _borders(s.read.parquet(at("nation")))
    return Catalog(spark, _tables(), sources)


def _borders(nation: DataFrame) -> DataFrame:
    """From each nation to those of its region with larger keys."""
    a = nation.select("n_regionkey", F.col("n_nationkey").alias("from_key"))
    return a.join(nation.select("n_regionkey", F.col("n_nationkey").alias("to_key")), "n_regionkey").where("from_key < to_key").select("from_key", "to_key")


def plain(df: DataFrame) -> DataFrame:
    """Decimals and doubles as doubles of four places, which two engines can agree on."""
    return df.select(*[F.round(F.col(f"`{c}`").cast("double"), 4).alias(c) if k.startswith(("decimal", "double", "float")) else F.col(f"`{c}`") for c, k in df.dtypes])


def report(sql: str | None = None, name: str | None = None):
    """Registers a function of the catalog."""

    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = lambda spark, sf_dir: plain(fn(catalog(spark, sf_dir)))
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add


# single-table reads
@report("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000 AND o_totalprice <= 400000 AND o_orderpriority <> '5-LOW' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '2000-01-01'")
def flt_compare(c):
    q = Query(c, "orders").limit(None)
    q = q.where(q["o_orderstatus"].eq("F"), q["o_totalprice"].gt(200000.0), q["o_totalprice"].lte(400000.0), q["o_orderpriority"].ne("5-LOW"))
    return q.where(q["o_orderdate"].gte(dt.datetime(1996, 1, 1)), q["o_orderdate"].lt(dt.datetime(2000, 1, 1))).project("o_orderkey", "o_totalprice").df()


@report("SELECT p_partkey, p_name FROM part WHERE p_size IN (1, 5, 9, 14) AND p_brand NOT IN ('Brand#11', 'Brand#12') AND p_size >= 1")
def flt_in_notin(c):
    q = Query(c, "part").limit(None)
    return q.where(q["p_size"].in_([1, 5, 9, 14]), q["p_brand"].not_in(["Brand#11", "Brand#12"]), q["p_size"].gte(1)).project("p_partkey", "p_name").df()


@report("SELECT p_partkey FROM part WHERE p_brand NOT IN ('Brand#11', NULL)")
def flt_notin_null(c):
    q = Query(c, "part").limit(None)
    return q.where(q["p_brand"].not_in(["Brand#11", None])).project("p_partkey").df()


@report("SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%' AND (p_name ILIKE '%RED%' OR p_type ILIKE 's%')")
def flt_like_ilike(c):
    q = Query(c, "part").limit(None)
    return q.where(q["p_type"].like("%A%")).any(q["p_name"].ilike("%RED%"), q["p_type"].ilike("s%")).project("p_partkey", "p_type").df()


@report("SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#0') AND (suffix(c_name, '7') OR contains(c_name, '00_') OR contains(c_name, '12'))")
def flt_prefix_suffix_contains(c):
    q = Query(c, "customer").limit(None)
    q = q.where(q["c_name"].has_prefix("Customer#0")).any(q["c_name"].has_suffix("7"), q["c_name"].contains_text("00_"), q["c_name"].contains_text("12"))
    return q.project("c_custkey", "c_name").df()


@report(f"SELECT c_custkey FROM (SELECT *, {AGE} AS c_age, {NOTE} AS c_note FROM customer) WHERE (c_age IS NULL AND c_note IS NOT NULL) OR coalesce(c_note, '') = ''")
def flt_null(c):
    q = Query(c, "customer").limit(None)
    return q.any(And(q["c_age"].is_null(), q["c_note"].is_not_null()), q["c_note"].is_null_or_empty()).project("c_custkey").df()


@report("SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = lower('Building')")
def flt_eqlower(c):
    q = Query(c, "customer").limit(None)
    return q.where(q["c_mktsegment"].eq_lower("Building")).project("c_custkey", "c_mktsegment").df()


@report("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 300000) OR (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')")
def flt_any_of(c):
    q = Query(c, "orders").limit(None)
    q = q.any_of(And(q["o_orderstatus"].eq("F"), q["o_totalprice"].gt(300000.0)), And(), And(q["o_orderstatus"].eq("P"), q["o_orderpriority"].eq("1-URGENT")))
    return q.project("o_orderkey").df()


@report(f"SELECT c_custkey FROM (SELECT *, {AGE} AS c_age FROM customer) WHERE NOT (c_age > 40) AND NOT (c_nationkey = 3 OR c_nationkey = 5) AND NOT ((c_nationkey = 7 AND c_acctbal > 0) OR (c_nationkey = 8 AND c_acctbal < 0))")
def flt_not(c):
    q = Query(c, "customer").limit(None)
    q = q.not_(q["c_age"].gt(40)).not_any(q["c_nationkey"].eq(3), q["c_nationkey"].eq(5))
    q = q.not_any_of(And(q["c_nationkey"].eq(7), q["c_acctbal"].gt(0.0)), And(q["c_nationkey"].eq(8), q["c_acctbal"].lt(0.0))).not_any().not_any_of()
    return q.project("c_custkey").df()


@report("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 250000")
def flt_when(c):
    q = Query(c, "orders").limit(None)
    q = q.where_if(True, lambda: q["o_orderstatus"].eq("O")).where_if(False, lambda: q["o_orderkey"].eq(-1))
    return q.when_set(250000.0, q["o_totalprice"].gte).when_set(None, q["o_totalprice"].lte).project("o_orderkey").df()


@report("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice < 250000")
def flt_shorthand(c):
    return Query(c, "orders").limit(None).o_orderstatus_eq("P").o_totalprice_lt(250000.0).project("o_orderkey").df()


def _ages(c, *order):
    return Query(c, "customer").order(*order, asc("c_custkey")).limit(60).project("c_custkey", "c_age").df()


def _ages_sql(order: str) -> str:
    return f"SELECT c_custkey, c_age FROM (SELECT *, {AGE} AS c_age FROM customer) ORDER BY {order}, c_custkey LIMIT 60"


report(_ages_sql("c_age ASC NULLS LAST"), "ord_asc")(lambda c: _ages(c, asc("c_age")))
report(_ages_sql("c_age DESC NULLS FIRST"), "ord_desc")(lambda c: _ages(c, desc("c_age")))
report(_ages_sql("c_age ASC NULLS FIRST"), "ord_asc_nulls_first")(lambda c: _ages(c, asc_nulls_first("c_age")))
report(_ages_sql("c_age DESC NULLS LAST"), "ord_desc_nulls_last")(lambda c: _ages(c, desc_nulls_last("c_age")))


@report("SELECT c_custkey, c_mktsegment FROM customer ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'AUTOMOBILE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 WHEN 'FURNITURE' THEN 4 END NULLS LAST, c_custkey LIMIT 500")
def ord_enum(c):
    return Query(c, "customer").order(asc("c_mktsegment"), asc("c_custkey")).limit(500).project("c_custkey", "c_mktsegment").df()


@report("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25 OFFSET 50")
def lim_offset(c):
    return Query(c, "orders").order(asc("o_totalprice"), asc("o_orderkey")).limit(25).offset(50).project("o_orderkey", "o_totalprice").df()


@report("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 1000")
def lim_default(c):
    return Query(c, "customer").project("c_custkey", "c_name").df()


@report("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice, o_orderkey) > (150000.0, 400) ORDER BY o_totalprice, o_orderkey LIMIT 40")
def keyset_page(c):
    q = Query(c, "orders").order(asc("o_totalprice"), asc("o_orderkey")).limit(40)
    return q.after({"o_totalprice": 150000.0, "o_orderkey": 400}).project("o_orderkey", "o_totalprice").df()


@report("SELECT o_orderkey, o_orderstatus FROM orders WHERE (o_orderstatus, o_orderkey) < ('O', 9000) ORDER BY o_orderstatus DESC, o_orderkey DESC LIMIT 40")
def keyset_page_desc(c):
    q = Query(c, "orders").order(desc("o_orderstatus"), desc("o_orderkey")).limit(40)
    return q.after({"o_orderstatus": "O", "o_orderkey": 9000}).project("o_orderkey", "o_orderstatus").df()


@report("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def count_where(c):
    q = Query(c, "orders")
    return q.where(q["o_orderstatus"].eq("F")).limit(5).offset(2).count_df()


@report("SELECT count(*) > 0 AS found FROM (SELECT 1 FROM orders WHERE o_totalprice > 1e12 LIMIT 1)")
def exists_probe(c):
    q = Query(c, "orders")
    return q.where(q["o_totalprice"].gt(1e12)).exists_df()


@report("SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_size > 40 ORDER BY p_partkey LIMIT 1000")
def proj_named(c):
    q = Query(c, "part")
    return q.where(q["p_size"].gt(40)).project("p_partkey", "p_name", "p_retailprice").df()


# aggregations
def by_status(c: Catalog) -> Aggregation:
    a = Aggregation(c, "orders", "ByStatus").by("o_orderstatus")
    a.count("Orders")
    a.count("Large").filter(T.gte(T.Col("o_totalprice"), 200000.0))
    a.sum("Total", T.Col("o_totalprice"))
    a.avg("Mean", T.Col("o_totalprice"))
    a.min("FirstAt", T.Col("o_orderdate"))
    a.max("LastAt", T.Col("o_orderdate"))
    return a.having(T.gt(T.Out("orders"), 0))


@report("SELECT o_orderstatus, count(*) AS orders, count(*) FILTER (o_totalprice >= 200000) AS large, round(sum(o_totalprice), 4) AS total, round(avg(o_totalprice), 4) AS mean, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at FROM orders GROUP BY 1 HAVING count(*) > 0 ORDER BY 1")
def agg_by_status(c):
    return by_status(c).build().df()


@report("SELECT date_trunc('month', o_orderdate) AS month, count(*) AS orders, round(sum(o_totalprice), 4) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY 1")
def agg_by_expression(c):
    a = Aggregation(c, "orders").by_expr("Month", T.date_trunc("month", T.Col("o_orderdate")))
    a.count("Orders")
    a.sum("Total", T.Col("o_totalprice"))
    q = Query(c, "orders")
    return a.build().df(q["o_orderstatus"].eq("F"))


@report(f"SELECT count(*) AS n, count(c_age) AS with_age, count(DISTINCT c_nationkey) AS nations, sum(c_age)::BIGINT AS ages, round(avg(c_age), 4) AS mean_age, min(c_age) AS youngest, max(c_acctbal) AS richest FROM (SELECT *, {AGE} AS c_age FROM customer)")
def agg_totals(c):
    a = Aggregation(c, "customer")
    a.count("N")
    a.count_of("WithAge", T.Col("c_age"))
    a.count_distinct("Nations", T.Col("c_nationkey"))
    a.sum("Ages", T.Col("c_age"))
    a.avg("MeanAge", T.Col("c_age"))
    a.min("Youngest", T.Col("c_age"))
    a.max("Richest", T.Col("c_acctbal"))
    return a.build().df()


@report("SELECT count(*) AS n, sum(o_totalprice) AS total, avg(o_totalprice) AS mean, max(o_orderdate) AS last_at FROM orders WHERE o_orderkey < 0")
def agg_empty(c):
    a = Aggregation(c, "orders")
    a.count("N")
    a.sum("Total", T.Col("o_totalprice"))
    a.avg("Mean", T.Col("o_totalprice"))
    a.max("LastAt", T.Col("o_orderdate"))
    q = Query(c, "orders")
    return a.build().df(q["o_orderkey"].lt(0))


@report("SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice::DECIMAL(12,2))::DOUBLE, 4) AS spent FROM orders GROUP BY 1 ORDER BY spent DESC NULLS FIRST, o_custkey LIMIT 20")
def agg_top_customers(c):
    a = Aggregation(c, "orders").by("o_custkey")
    a.count("Orders")
    a.sum("Spent", T.Col("o_total"))
    return a.order_by(desc("spent")).build().df(limit=20)


@report("SELECT o_orderpriority, count(*) FILTER (o_totalprice >= 123456.0) AS large, count(*) AS orders FROM orders GROUP BY 1 HAVING count(*) FILTER (o_totalprice >= 123456.0) > 100 ORDER BY 1")
def agg_filter_param(c):
    a = Aggregation(c, "orders").by("o_orderpriority")
    a.count("Large").filter(T.gte(T.Col("o_totalprice"), T.Param("floor")))
    a.count("Orders")
    a.having(T.gt(T.Out("large"), T.Param("least")))
    return a.build(params=("floor", "least")).df(floor=123456.0, least=100)


@report("SELECT o_orderstatus, count(*) AS orders, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, round(count(*) FILTER (o_orderpriority = '1-URGENT')::DOUBLE / nullif(count(*), 0), 4) AS share FROM orders GROUP BY 1 ORDER BY 1")
def agg_ratio_div(c):
    a = Aggregation(c, "orders").by("o_orderstatus")
    a.count("Orders")
    a.count("Urgent").filter(T.eq(T.Col("o_orderpriority"), "1-URGENT"))
    return a.compute("Share", T.div(T.Out("urgent"), T.nullif(T.Out("orders"), T.Lit(0)))).build().df()


@report("SELECT c_mktsegment, round(sum(c_acctbal) + abs(min(c_acctbal)) - coalesce(max(c_age), 0) * 2.0, 4) AS score FROM (SELECT *, " + AGE + " AS c_age FROM customer) GROUP BY 1 ORDER BY 1")
def agg_arithmetic(c):
    a = Aggregation(c, "customer").by("c_mktsegment")
    a.sum("Balance", T.Col("c_acctbal"))
    a.min("Least", T.Col("c_acctbal"))
    a.max("Oldest", T.Col("c_age"))
    a.compute("Score", T.sub(T.add(T.Out("balance"), T.abs_(T.Out("least"))), T.mul(T.coalesce(T.Out("oldest"), T.Lit(0)), T.Lit(2.0))))
    return a.build().df().select("c_mktsegment", "score")


_SETS = "SELECT o_orderstatus, o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 4) AS total, grouping(o_orderstatus, o_orderpriority)::INT AS folded FROM orders GROUP BY {}"


def _facets(c: Catalog) -> Aggregation:
    a = Aggregation(c, "orders").by("o_orderstatus", "o_orderpriority")
    a.count("Orders")
    a.sum("Total", T.Col("o_totalprice"))
    a.grouping("Folded", "o_orderstatus", "o_orderpriority")
    return a


report(_SETS.format("GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"), "agg_sets")(lambda c: _facets(c).sets(["o_orderstatus"], ["o_orderpriority"], None).build().df())
report(_SETS.format("ROLLUP (o_orderstatus, o_orderpriority)"), "agg_rollup")(lambda c: _facets(c).rollup().build().df())
report(_SETS.format("CUBE (o_orderstatus, o_orderpriority)"), "agg_cube")(lambda c: _facets(c).cube().build().df())


@report("SELECT o_custkey, first(o_orderkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS top_order, first(o_orderpriority ORDER BY o_orderdate, o_orderkey) AS first_priority, first(o_orderkey ORDER BY o_orderdate DESC, o_orderkey ASC) FILTER (o_orderstatus = 'F') AS last_done FROM orders GROUP BY 1")
def agg_first_of(c):
    a = Aggregation(c, "orders").by("o_custkey")
    a.first("TopOrder", T.Col("o_orderkey"), desc("o_totalprice"), desc("o_orderkey"))
    a.first("FirstPriority", T.Col("o_orderpriority"), asc("o_orderdate"), asc("o_orderkey"))
    a.first("LastDone", T.Col("o_orderkey"), desc("o_orderdate"), asc("o_orderkey")).filter(T.eq(T.Col("o_orderstatus"), "F"))
    return a.build().df()


@report("SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 4) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1 ORDER BY 1")
def agg_joined(c):
    a = Aggregation(c, "orders").join("customer").join("nation", of="customer").by("n_name", table="nation")
    a.count("Orders")
    a.sum("Total", T.Col("o_totalprice"))
    return a.where(T.gt(T.Col("c_acctbal", "customer"), 0.0)).build().df()


@report("SELECT json_extract_string(e, '$.k') AS k, count(*) AS n FROM (SELECT unnest([props, props]) AS e FROM events WHERE event_id % 4 = 0) GROUP BY 1 ORDER BY n DESC, k LIMIT 30")
def agg_elements(c):
    a = Aggregation(c, "events").elements("item", "items").by_expr("K", T.field(T.Col("item"), "k"))
    a.count("N")
    return a.order_by(desc("n")).build().df(limit=30)


@report("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1")
def agg_across_deleted(c):
    a = Aggregation(c, "live_orders").across_deleted().by("o_orderstatus")
    a.count("N")
    return a.build().df()


@report("SELECT lower(c_mktsegment) AS segment, upper(coalesce(c_note, 'none')) AS note, count(*) AS n FROM (SELECT *, " + NOTE + " AS c_note FROM customer) WHERE (c_note IS NULL OR c_note <> '') AND NOT (c_nationkey < 3) GROUP BY ALL")
def agg_functions(c):
    a = Aggregation(c, "customer").by_expr("Segment", T.lower(T.Col("c_mktsegment"))).by_expr("Note", T.upper(T.coalesce(T.Col("c_note"), T.Lit("none"))))
    a.count("N")
    note = T.Col("c_note")
    return a.where(T.all_of(T.any_of(T.is_null(note), T.ne(note, "")), T.none_of(T.lt(T.Col("c_nationkey"), 3)))).build().df()


# windows over groups
_DAILY = "SELECT date_trunc('month', o_orderdate) AS month, o_orderstatus, count(*) AS orders, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2"


def _monthly(c: Catalog) -> Aggregation:
    a = Aggregation(c, "orders").by_expr("Month", T.date_trunc("month", T.Col("o_orderdate"))).by("o_orderstatus")
    a.count("Orders")
    a.sum("Total", T.Col("o_totalprice"))
    return a


@report(f"SELECT month, o_orderstatus, orders, round(total, 4) AS total, row_number() OVER w AS place, rank() OVER r AS ranked, dense_rank() OVER r AS dense FROM ({_DAILY}) WINDOW w AS (PARTITION BY o_orderstatus ORDER BY total DESC NULLS FIRST, month), r AS (PARTITION BY o_orderstatus ORDER BY orders DESC NULLS FIRST)")
def win_rank_family(c):
    a = _monthly(c)
    a.window("Place", "row_number", over().by("o_orderstatus").desc("total").asc("month"))
    a.window("Ranked", "rank", over().by("o_orderstatus").desc("orders"))
    a.window("Dense", "dense_rank", over().by("o_orderstatus").desc("orders"))
    return a.build().df()


@report(f"SELECT month, o_orderstatus, orders, round(total, 4) AS total, lag(orders) OVER w AS before, lead(orders) OVER w AS after FROM ({_DAILY}) WINDOW w AS (PARTITION BY o_orderstatus ORDER BY month)")
def win_lag_lead(c):
    a, w = _monthly(c), over().by("o_orderstatus").asc("month")
    a.window("Before", "lag", w, T.Out("orders"))
    a.window("After", "lead", w, T.Out("orders"))
    return a.build().df()


@report(f"SELECT month, o_orderstatus, orders, round(total, 4) AS total, round(avg(total) OVER w, 4) AS moving, sum(orders) OVER c::BIGINT AS running, min(orders) OVER w AS low, max(orders) OVER w AS high FROM ({_DAILY}) WINDOW w AS (PARTITION BY o_orderstatus ORDER BY month ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), c AS (PARTITION BY o_orderstatus ORDER BY month)")
def win_moving(c):
    a = _monthly(c)
    w = over().by("o_orderstatus").asc("month").rows(preceding(6), CURRENT)
    a.window("Moving", "avg", w, T.Out("total"))
    a.window("Running", "sum", over().by("o_orderstatus").asc("month"), T.Out("orders"))
    a.window("Low", "min", w, T.Out("orders"))
    a.window("High", "max", w, T.Out("orders"))
    out = a.build().df()
    return out.withColumn("running", F.col("running").cast("long"))


@report(f"SELECT month, o_orderstatus, orders, round(total, 4) AS total, round(sum(total) OVER p, 4) AS of_status, count(*) OVER p AS months, count(*) FILTER (orders > 50) OVER p AS busy FROM ({_DAILY}) WINDOW p AS (PARTITION BY o_orderstatus)")
def win_share_of_group(c):
    a, p = _monthly(c), over().by("o_orderstatus")
    a.window("OfStatus", "sum", p, T.Out("total"))
    a.window("Months", "count", p)
    a.window("Busy", "count", p).filter(T.gt(T.Out("orders"), 50))
    return a.build().df()


@report(f"SELECT month, o_orderstatus, orders, round(total, 4) AS total, first_value(orders) OVER w AS opening, last_value(orders) OVER w AS so_far, last_value(orders) OVER f AS closing FROM ({_DAILY}) WINDOW w AS (PARTITION BY o_orderstatus ORDER BY month), f AS (PARTITION BY o_orderstatus ORDER BY month RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def win_first_last(c):
    a, w = _monthly(c), over().by("o_orderstatus").asc("month")
    a.window("Opening", "first_value", w, T.Out("orders"))
    a.window("SoFar", "last_value", w, T.Out("orders"))
    a.window("Closing", "last_value", w.range(UNBOUNDED_PRECEDING, UNBOUNDED_FOLLOWING), T.Out("orders"))
    return a.build().df()


@report(f"SELECT month, o_orderstatus, orders, round(total, 4) AS total, round(percent_rank() OVER w, 4) AS pct, round(cume_dist() OVER w, 4) AS cume FROM ({_DAILY}) WINDOW w AS (PARTITION BY o_orderstatus ORDER BY orders NULLS FIRST)")
def win_pct_cume(c):
    a, w = _monthly(c), over().by("o_orderstatus").asc_nulls_first("orders")
    a.window("Pct", "percent_rank", w)
    a.window("Cume", "cume_dist", w)
    return a.build().df()


@report(f"SELECT c_age, count(*) AS n, row_number() OVER (ORDER BY c_age ASC NULLS FIRST) AS low_first, row_number() OVER (ORDER BY c_age DESC NULLS LAST) AS high_first FROM (SELECT *, {AGE} AS c_age FROM customer) GROUP BY 1")
def win_null_places(c):
    a = Aggregation(c, "customer").by("c_age")
    a.count("N")
    a.window("LowFirst", "row_number", over().asc_nulls_first("c_age"))
    a.window("HighFirst", "row_number", over().desc_nulls_last("c_age"))
    return a.build().df()


@report("SELECT o_orderpriority, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY 1")
def agg_own_function(c):
    tables.aggregate_function(c.spark, "tessella_spread", "double", lambda v: float(v.max() - v.min()))
    return c.live("orders").groupBy("o_orderpriority").agg(F.expr("tessella_spread(o_totalprice)").alias("spread"))


class _Parts:
    """The parts of a priority such as 1-URGENT."""

    def eval(self, text: str):
        for i, part in enumerate(text.split("-", 1)):
            yield i, part


@report("SELECT o_orderkey, unnest(range(0, 2))::INT AS place, unnest(string_split(o_orderpriority, '-')[1:2]) AS part FROM orders WHERE o_orderpriority LIKE '%-%' AND o_orderpriority NOT LIKE '%-%-%'")
def table_own_function(c):
    tables.table_function(c.spark, "tessella_parts", "place int, part string", _Parts)
    tables.view(c.live("orders").select("o_orderkey", "o_orderpriority"), "tessella_prioritised")
    return c.spark.sql("SELECT o_orderkey, place, part FROM tessella_prioritised, LATERAL tessella_parts(o_orderpriority) WHERE o_orderpriority LIKE '%-%' AND o_orderpriority NOT LIKE '%-%-%'")


# joins
@report("SELECT o_orderkey, c_name AS customer, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 300000 AND c_acctbal > 0")
def join_inner_fk(c):
    j = Join(c, "orders").inner("customer").inner("nation", of="customer")
    j.take("o_orderkey", T.Col("o_orderkey")).take("Customer", T.Col("c_name", "customer")).take("Nation", T.Col("n_name", "nation"))
    j.where(T.gt(T.Col("c_acctbal", "customer"), 0.0)).order_by(asc("o_orderkey"))
    q = Query(c, "orders")
    return j.build().df(q["o_totalprice"].gt(300000.0))


@report("SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON o_custkey = c_custkey WHERE c_nationkey = 4")
def join_left_live(c):
    j = Join(c, "customer").on("left", "live_orders", "o", (T.Col("c_custkey", "own"), "o_custkey"))
    j.take("c_custkey", T.Col("c_custkey")).take("o_orderkey", T.Col("o_orderkey", "o")).take("o_totalprice", T.Col("o_totalprice", "o"))
    q = Query(c, "customer")
    return j.build().df(q["c_nationkey"].eq(4))


@report("SELECT o_orderkey, lifetime, round(o_totalprice / nullif(lifetime, 0), 4) AS share FROM orders LEFT JOIN (SELECT o_custkey AS k, round(sum(o_totalprice), 4) AS lifetime FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON k = o_custkey WHERE o_orderdate >= TIMESTAMP '2000-01-01'")
def join_cte_lifetime(c):
    a = Aggregation(c, "orders", "ByCustomer").by("o_custkey")
    a.sum("Lifetime", T.Col("o_totalprice"))
    j = Join(c, "orders").with_("lv", a.build()).on_report("left", "lv", (T.Col("o_custkey", "own"), "o_custkey"))
    j.take("o_orderkey", T.Col("o_orderkey")).take("Lifetime", T.Col("lifetime", "lv")).take("o_totalprice", T.Col("o_totalprice"))
    q = Query(c, "orders")
    rows = j.build().df(q["o_orderdate"].gte(dt.datetime(2000, 1, 1)), with_where={"lv": [q["o_orderstatus"].eq("F")]})
    life = F.round("lifetime", 4)
    return rows.select("o_orderkey", life.alias("lifetime"), F.try_divide("o_totalprice", life).alias("share"))


@report("SELECT a.n_name AS nation, b.n_name AS neighbour FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey ORDER BY 1, 2")
def join_self(c):
    j = Join(c, "nation").on("inner", "nation", "b", (T.Col("n_regionkey", "own"), "n_regionkey"))
    j.take("Nation", T.Col("n_name")).take("Neighbour", T.Col("n_name", "b")).where(T.lt(T.Col("n_nationkey"), T.Col("n_nationkey", "b")))
    return j.order_by(asc("nation"), asc("neighbour")).build().df()


@report("SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_quantity, s.q AS supplied FROM lineitem l JOIN (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) s ON l.l_partkey = s.l_partkey AND l.l_suppkey = s.l_suppkey WHERE l.l_quantity > 45")
def join_multikey(c):
    j = Join(c, "lineitem").on("inner", "supply", "s", (T.Col("l_partkey", "own"), "l_partkey"), (T.Col("l_suppkey", "own"), "l_suppkey"))
    for n in ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity"):
        j.take(n, T.Col(n))
    q = Query(c, "lineitem")
    return j.take("Supplied", T.Col("quantity", "s")).build().df(q["l_quantity"].gt(45.0))


@report("SELECT c_custkey, n_name AS nation FROM customer JOIN nation ON coalesce(c_nationkey, -1) = n_nationkey WHERE c_acctbal > 9000")
def join_on_function(c):
    j = Join(c, "customer").on("inner", "nation", "n", (T.coalesce(T.Col("c_nationkey", "own"), T.Lit(-1)), "n_nationkey"))
    q = Query(c, "customer")
    return j.take("c_custkey", T.Col("c_custkey")).take("Nation", T.Col("n_name", "n")).build().df(q["c_acctbal"].gt(9000.0))


@report("SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING'")
def join_count(c):
    j = Join(c, "orders").inner("customer").take("o_orderkey", T.Col("o_orderkey")).where(T.eq(T.Col("c_mktsegment", "customer"), "BUILDING"))
    q = Query(c, "orders")
    return j.build().count_df(q["o_orderstatus"].eq("F"))


# probes
@report("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def semi_having(c):
    o = Query(c, "orders")
    return probes.having(Query(c, "customer").limit(None), "orders", o["o_totalprice"].gt(450000.0)).project("c_custkey").df()


@report("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_not_having(c):
    o = Query(c, "orders")
    return probes.not_having(Query(c, "customer").limit(None), "orders", o["o_orderstatus"].eq("P")).project("c_custkey").df()


@report("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 100000) AND c_acctbal > 0")
def semi_and_anti(c):
    o, q = Query(c, "orders"), Query(c, "customer").limit(None)
    q = probes.having(q.where(q["c_acctbal"].gt(0.0)), "orders", o["o_totalprice"].gt(400000.0))
    return probes.not_having(q, "orders", o["o_orderstatus"].eq("P"), o["o_totalprice"].gt(100000.0)).project("c_custkey").df()


@report("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'FURNITURE') AND o_totalprice > 250000")
def probe_to_one(c):
    u, q = Query(c, "customer"), Query(c, "orders").limit(None)
    return probes.having(q.where(q["o_totalprice"].gt(250000.0)), "customer", u["c_mktsegment"].eq("FURNITURE")).project("o_orderkey").df()


@report("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal > 9900)")
def probe_on_columns(c):
    u = Query(c, "customer")
    return probes.having_on(Query(c, "supplier").limit(None), "customer", [("s_nationkey", "c_nationkey")], u["c_acctbal"].gt(9900.0)).project("s_suppkey").df()


@report("SELECT c_custkey FROM customer WHERE c_acctbal < -900 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 480000) OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def probe_inside_or(c):
    o, q = Query(c, "orders"), Query(c, "customer").limit(None)
    large = probes.Exists(c, "customer", "orders", o["o_totalprice"].gt(480000.0))
    done = probes.Exists(c, "customer", "orders", o["o_orderstatus"].eq("F"))
    return q.where(Any(q["c_acctbal"].lt(-900.0), large, Not(done))).project("c_custkey").df()


@report("SELECT c_mktsegment, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) GROUP BY 1 ORDER BY 1")
def probe_agg(c):
    a = Aggregation(c, "customer").by("c_mktsegment")
    a.count("N")
    o = Query(c, "orders")
    return a.build().df(query=probes.having(Query(c, "customer"), "orders", o["o_totalprice"].gt(400000.0)))


@report("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
def arc_variant(c):
    q = Query(c, "orders")
    return q.where(probes.variant_is(q, "subject", "open")).count_df()


# first rows of groups
@report("SELECT o_custkey, o_orderkey, turn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS turn FROM orders) WHERE turn <= 3")
def topn_per_customer(c):
    q = Query(c, "orders").order(desc("o_totalprice"), desc("o_orderkey"))
    return topn.top_n_per_parent(q, "o_custkey", 3).select("o_custkey", "o_orderkey", "turn")


@report("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey")
def distinct_on_first(c):
    q = Query(c, "orders").order(asc("o_custkey"), asc("o_orderdate"), asc("o_orderkey")).limit(None)
    return topn.distinct_on(q, 1).select("o_custkey", "o_orderkey", "o_orderdate")


@report("""WITH g AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'), p AS (SELECT k FROM g ORDER BY k < 1000, k LIMIT 40),
n AS (SELECT o.*, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS turn FROM orders o WHERE o_custkey IN (SELECT k FROM p))
SELECT o_orderkey, o_custkey, turn FROM n WHERE turn <= 3 ORDER BY turn, o_totalprice, o_orderkey LIMIT 100""")
def turns_round_robin(c):
    q = Query(c, "orders").order(asc("o_totalprice"), asc("o_orderkey")).limit(100)
    g = Query(c, "orders")
    return topn.turns(q, "o_custkey", g.where(g["o_orderstatus"].eq("P")), 1000, 40, 3).select("o_orderkey", "o_custkey", "turn")


# unions
def _feed(c: Catalog) -> unions.Union:
    u = unions.Union(c, "Feed")
    u.branch("orders").const("Kind", "order").take("Id", "o_orderkey").take("At", "o_orderdate").where(T.gt(T.Col("o_totalprice"), T.Param("floor")))
    u.branch("events").const("Kind", "event").take("Id", "event_id").take("At", "ts").where(T.gt(T.Col("value"), T.Param("floor")))
    return u.order_by(desc("at"), asc("id"))


@report("SELECT * FROM (SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS \"at\" FROM orders WHERE o_totalprice > 90.0 UNION ALL SELECT 'event', event_id, ts FROM events WHERE value > 90.0) ORDER BY \"at\" DESC, id, kind LIMIT 300")
def union_all_feed(c):
    u = _feed(c).order_by(asc("kind"))
    return u.build(params=("floor",)).df(limit=300, floor=90.0)


@report("SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier ORDER BY 1")
def union_distinct(c):
    u = unions.Union(c, "Nations").distinct()
    u.branch("customer").take("Nation", "c_nationkey").where(T.gt(T.Col("c_acctbal"), 9000.0))
    u.branch("supplier").take("Nation", "s_nationkey")
    return u.order_by(asc("nation")).build().df()


@report("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 300000 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY 1")
def union_live_branches(c):
    u = unions.Union(c, "Mixed")
    u.branch("live_orders").take("Id", "o_orderkey")
    u.branch("orders").take("Id", "o_orderkey").where(T.eq(T.Col("o_orderpriority"), "1-URGENT"))
    q = Query(c, "live_orders")
    return u.order_by(asc("id")).build().df(where={"live_orders": [q["o_totalprice"].gt(300000.0)]})


# relation plans, flattened for comparison
@report("SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_nationkey = 2) LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000")
def plan_to_many(c):
    q, o = Query(c, "customer"), Query(c, "orders")
    out = plan(q.where(q["c_nationkey"].eq(2)).limit(None)).load("orders", o["o_totalprice"].gt(200000.0)).df()
    return out.select("c_custkey", F.explode_outer("orders.o_orderkey").alias("o_orderkey"))


@report("SELECT o_orderkey, c_name AS customer, n_name AS nation FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def plan_nested(c):
    out = plan(Query(c, "orders").limit(None)).load("customer", into=lambda p: p.load("nation")).df()
    return out.select("o_orderkey", F.col("customer.c_name").alias("customer"), F.col("customer.nation.n_name").alias("nation"))


@report("SELECT c_custkey, o_orderkey, pos FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) - 1 AS pos FROM customer JOIN orders ON o_custkey = c_custkey) WHERE pos < 2")
def plan_child_top(c):
    out = plan(Query(c, "customer").limit(None)).load("orders", order=(desc("o_totalprice"), desc("o_orderkey")), top=2).df()
    return out.select("c_custkey", F.posexplode("orders.o_orderkey").alias("pos", "o_orderkey")).withColumn("pos", F.col("pos").cast("long"))


@report("SELECT DISTINCT l_partkey AS p_partkey, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey")
def plan_many_to_many(c):
    out = plan(Query(c, "part").limit(None)).load("suppliers").df()
    return out.select("p_partkey", F.explode("suppliers.s_name").alias("s_name"))


@report("SELECT l_partkey AS p_partkey, s_name, sum(l_quantity) AS quantity FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY ALL")
def plan_payload(c):
    out = plan(Query(c, "part").limit(None)).load("suppliers", payload=True).df()
    return out.select("p_partkey", F.explode("suppliers").alias("s")).select("p_partkey", "s.s_name", "s.quantity")


@report("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'done' END AS kind, c_name AS customer FROM orders JOIN customer ON c_custkey = o_custkey")
def plan_arc(c):
    out = plan(Query(c, "orders").limit(None)).load_arc("subject").df()
    return out.select("o_orderkey", F.col("subject_kind").alias("kind"), F.coalesce("subject_open.c_name", "subject_done.c_name").alias("customer"))


@report("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 100000")
def plan_flat(c):
    o = Query(c, "orders")
    return plan(Query(c, "customer").limit(None)).load("orders", o["o_totalprice"].gt(100000.0)).flat("orders").select("c_custkey", "orders.o_orderkey")


@report("SELECT a.n_name AS nation, b.n_name AS neighbour FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def plan_self_directed(c):
    out = plan(Query(c, "nation").limit(None)).load("neighbours").df()
    return out.select(F.col("n_name").alias("nation"), F.explode("neighbours.n_name").alias("neighbour"))


# recursion
_TREE = """WITH RECURSIVE w AS (SELECT p_partkey, p_partkey // 2 AS p_parent, 1 AS depth, [p_partkey] AS path FROM part WHERE p_partkey IN {roots}
UNION ALL SELECT t.p_partkey, t.p_partkey // 2, w.depth + 1, list_append(w.path, t.p_partkey) FROM w JOIN part t ON {on} WHERE NOT list_contains(w.path, t.p_partkey) AND w.depth < {depth})
SELECT p_partkey, depth FROM w"""


@report(_TREE.format(roots="(0, 5)", on="t.p_partkey // 2 = w.p_partkey", depth=5))
def rec_descend(c):
    return recursion.descend(c, "part", [0, 5], 5).select("p_partkey", "depth")


@report(_TREE.format(roots="(150, 77)", on="t.p_partkey = w.p_parent", depth=20))
def rec_ascend(c):
    return recursion.ascend(c, "part", [150, 77], 20).select("p_partkey", "depth")


# JSON, arrays, ranges, text
def _events(c: Catalog, pred) -> DataFrame:
    q = Query(c, "events").limit(None)
    return q.where(pred(q)).project("event_id").df()


report("SELECT event_id FROM events WHERE json_extract(props, '$.k')::INT = 42", "json_contains")(lambda c: _events(c, lambda q: q["props"].json_contains({"k": 42})))
report("SELECT event_id FROM events WHERE json_extract(props, '$.k')::INT IN (7) OR props = '{}'", "json_contained_by")(lambda c: _events(c, lambda q: q["props"].json_contained_by({"k": 7, "x": [1]})))
report("SELECT event_id FROM events WHERE list_has_any(json_keys(props), ['k', 'zz']) AND json_extract(props, '$.k')::INT < 10", "json_any_key")(
    lambda c: _events(c, lambda q: And(q["props"].has_any_key(["k", "zz"]), Any(*[q["props"].json_contains({"k": i}) for i in range(10)])))
)
report("SELECT event_id FROM events WHERE list_has_all(json_keys(props), ['k', 'zz'])", "json_all_keys")(lambda c: _events(c, lambda q: q["props"].has_all_keys(["k", "zz"])))
report("SELECT event_id FROM events WHERE props LIKE '%: 4%' OR props LIKE '%9}'", "json_like_any")(lambda c: _events(c, lambda q: q["props"].text_like_any(["%: 4%", "%9}"])))
report("SELECT event_id FROM events WHERE event_id % 4 IN (2, 3)", "json_is_empty")(lambda c: _events(c, lambda q: q["items"].json_is_empty()))
report("SELECT event_id FROM events WHERE event_id % 4 IN (0, 1) AND json_extract(props, '$.k')::INT = 11 AND event_id % 4 = 0", "json_array_contains")(
    lambda c: _events(c, lambda q: q["items"].json_contains([{"k": 11}]))
)


@report("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'purchase'")
def json_field(c):
    q = Query(c, "events").limit(None)
    rows = q.where(q["event_type"].eq("purchase")).df()
    return rows.select("event_id", json_docs.field(json_docs.parsed(F.col("props")), "k").alias("k"))


def _orders(c: Catalog, pred) -> DataFrame:
    q = Query(c, "orders").limit(None)
    return q.where(pred(q)).project("o_orderkey").df()


_TAGGED = "SELECT o_orderkey FROM orders WHERE {}([o_orderpriority, o_orderstatus], {})"
report(_TAGGED.format("list_has_all", "['1-URGENT', 'F']"), "arr_contains")(lambda c: _orders(c, lambda q: q["o_tags"].array_contains(["1-URGENT", "F"])))
report("SELECT o_orderkey FROM orders", "arr_contains_nothing")(lambda c: _orders(c, lambda q: q["o_tags"].array_contains([])))
report(_TAGGED.format("list_has_any", "['2-HIGH', 'P']"), "arr_overlaps")(lambda c: _orders(c, lambda q: q["o_tags"].array_overlaps(["2-HIGH", "P"])))
report("SELECT o_orderkey FROM orders WHERE list_has_all(['1-URGENT', '2-HIGH', 'O'], [o_orderpriority, o_orderstatus])", "arr_contained_by")(
    lambda c: _orders(c, lambda q: q["o_tags"].array_contained_by(["1-URGENT", "2-HIGH", "O"]))
)
_A, _B = dt.datetime(1998, 3, 1), dt.datetime(1998, 3, 20)
report("SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-03-20' AND o_orderdate + INTERVAL 7 DAY > TIMESTAMP '1998-03-01'", "range_overlaps")(lambda c: _orders(c, lambda q: q["o_during"].range_overlaps(_A, _B)))
report("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-03-01' AND o_orderdate + INTERVAL 7 DAY <= TIMESTAMP '1998-03-20'", "range_contained_by")(lambda c: _orders(c, lambda q: q["o_during"].range_contained_by(_A, _B)))
report("SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1998-03-03' AND o_orderdate + INTERVAL 7 DAY >= TIMESTAMP '1998-03-05'", "range_contains")(
    lambda c: _orders(c, lambda q: q["o_during"].contains_range(dt.datetime(1998, 3, 3), dt.datetime(1998, 3, 5)))
)
report("SELECT o_orderkey FROM orders WHERE o_orderdate + INTERVAL 7 DAY > TIMESTAMP '2001-06-01'", "range_unbounded")(lambda c: _orders(c, lambda q: q["o_during"].range_overlaps(dt.datetime(2001, 6, 1), None)))

_WORD_LIST = r"(SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda w: w <> '') AS words FROM documents)"


def _docs(c: Catalog, pred) -> DataFrame:
    q = Query(c, "documents").limit(None)
    return q.where(pred(q)).project("doc_id").df()


report(f"SELECT doc_id FROM {_WORD_LIST} WHERE list_has_all(words, ['the', 'ering'])", "text_matches")(lambda c: _docs(c, lambda q: q["words"].matches("The ering")))
report(
    f"SELECT doc_id FROM {_WORD_LIST} WHERE (contains(' ' || array_to_string(words, ' ') || ' ', ' of the ') AND NOT list_contains(words, 'license')) OR list_contains(words, 'reserved')",
    "text_web_search",
)(lambda c: _docs(c, lambda q: q["words"].web_search('"of the" -license or reserved')))


# scalars
@report("SELECT o_orderkey, date_trunc('quarter', o_orderdate) AS quarter, date_trunc('week', o_orderdate) AS week, date_trunc('decade', o_orderdate)::TIMESTAMP AS decade FROM orders")
def fn_date_trunc(c):
    rows = c.live("orders")
    at = F.col("o_orderdate")
    return rows.select("o_orderkey", *[scalars.date_trunc(u, at).alias(u) for u in ("quarter", "week", "decade")])


@report("SELECT o_orderkey, round(o_totalprice::DECIMAL(12,2)::DOUBLE / 3, 4) AS third FROM orders")
def fn_div(c):
    return c.live("orders").select("o_orderkey", scalars.div(F.col("o_total"), F.lit(3), 6).alias("third"))


@report("SELECT d::TIMESTAMP AS day, count(o_orderkey) AS n FROM generate_series(TIMESTAMP '1998-01-01', TIMESTAMP '1998-01-31', INTERVAL 1 DAY) g(d) LEFT JOIN orders ON date_trunc('day', o_orderdate) = d GROUP BY 1")
def gap_fill(c):
    days = c.spark.range(1).select(F.explode(F.expr("sequence(timestamp_ntz'1998-01-01', timestamp_ntz'1998-01-31', interval 1 day)")).alias("day"))
    orders = c.live("orders").select(scalars.date_trunc("day", F.col("o_orderdate")).alias("of"), "o_orderkey")
    return days.join(orders, days["day"] == orders["of"], "left").groupBy("day").agg(F.count("o_orderkey").alias("n"))


# soft delete and writes: the state after the write
@report("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 200000")
def soft_delete_read(c):
    q = Query(c, "live_orders").limit(None)
    return q.where(q["o_totalprice"].gt(200000.0)).project("o_orderkey").df()


@report("SELECT o_orderkey FROM orders WHERE o_totalprice > 200000")
def soft_delete_with_deleted(c):
    q = Query(c, "live_orders").limit(None).with_deleted()
    return q.where(q["o_totalprice"].gt(200000.0)).project("o_orderkey").df()


@report("SELECT p_partkey, CASE WHEN p_size > 30 THEN 'Brand#00' ELSE p_brand END AS p_brand, CASE WHEN p_size > 30 THEN p_size + 1 ELSE p_size END AS p_size FROM part")
def wr_update_all(c):
    q = Query(c, "part")
    return writes.update_all(q.where(q["p_size"].gt(30)), p_brand="Brand#00", p_size=writes.plus("p_size", 1)).state.select("p_partkey", "p_brand", "p_size")


@report("SELECT p_partkey FROM part WHERE NOT (p_size <= 10 OR p_brand = 'Brand#11')")
def wr_delete_all(c):
    q = Query(c, "part")
    return writes.delete_all(q.any(q["p_size"].lte(10), q["p_brand"].eq("Brand#11"))).state.select("p_partkey")


@report("SELECT count(*) AS hidden FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 400000")
def wr_soft_delete(c):
    q = Query(c, "live_orders")
    state = writes.delete_all(q.where(q["o_totalprice"].gt(400000.0))).state
    return state.where("deleted_at IS NOT NULL").agg(F.count(F.lit(1)).alias("hidden"))


@report("SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'renamed' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL SELECT 100 + r_regionkey, 'of ' || r_name, r_regionkey FROM region")
def wr_upsert(c):
    old = c.base("nation").where("n_nationkey < 5").select("n_nationkey", F.lit("renamed").alias("n_name"), "n_regionkey")
    new = c.base("region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.concat(F.lit("of "), "r_name").alias("n_name"), F.col("r_regionkey").alias("n_regionkey"))
    return writes.upsert(c, "nation", old.unionAll(new), ("n_nationkey",)).state


@report("SELECT s_suppkey, CASE WHEN s_suppkey < 20 THEN round(s_acctbal + 10.5, 4) ELSE round(s_acctbal, 4) END AS s_acctbal FROM supplier")
def wr_upsert_accumulate(c):
    rows = c.base("supplier").where("s_suppkey < 20").withColumn("s_acctbal", F.lit(10.5))
    return writes.upsert(c, "supplier", rows, ("s_suppkey",), accumulate=("s_acctbal",)).state.select("s_suppkey", "s_acctbal")


@report("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 90, 'NEW'")
def wr_insert(c):
    return writes.insert(c, "region", {"r_regionkey": 90, "r_name": "NEW"}).state


@report("SELECT o_orderkey, 'T' AS o_orderstatus FROM (SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 15)")
def wr_take(c):
    q = Query(c, "orders").order(desc("o_totalprice"), desc("o_orderkey")).limit(15)
    return writes.take(q.where(q["o_orderstatus"].eq("O")), o_orderstatus="T").affected.select("o_orderkey", "o_orderstatus")


@report("SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders EXCEPT SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100))")
def wr_delete_batch(c):
    q = Query(c, "orders").order(asc("o_totalprice"), asc("o_orderkey")).limit(100)
    return writes.delete_batch(q).state.agg(F.count(F.lit(1)).alias("n"))


@report("SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey + 1000, 'copied' FROM nation WHERE n_regionkey = 1")
def wr_insert_per(c):
    q = Query(c, "nation")
    src = q.where(q["n_regionkey"].eq(1))
    keyed = Catalog(c.spark, [*c.tables.values()], c.sources | {"nation": c.stored("nation").withColumn("n_nationkey", F.col("n_nationkey") + 1000)})
    return writes.insert_per(c, "region", Query(keyed, "nation", src.preds), {"r_regionkey": "n_nationkey"}, r_name="copied").state


@report("SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def wr_cascade(c):
    gone = c.base("customer").where("c_nationkey = 3")
    return writes.cascade(c, "customer", gone)["orders"].agg(F.count(F.lit(1)).alias("n"))


@report("SELECT c_custkey, c_nationkey + coalesce(n, 0) AS c_nationkey FROM customer LEFT JOIN (SELECT o_custkey, count(*)::INT AS n FROM orders WHERE o_totalprice > 350000 GROUP BY 1) ON o_custkey = c_custkey")
def wr_tally(c):
    o = Query(c, "orders")
    touched = writes.update_all(o.where(o["o_totalprice"].gt(350000.0)), o_orderpriority="1-URGENT").affected
    return writes.tally(Query(c, "customer"), "orders", "c_nationkey", touched).state.select("c_custkey", "c_nationkey")


@report("SELECT s_suppkey FROM supplier UNION ALL SELECT 5000 + n_nationkey FROM nation")
def wr_insert_all(c):
    rows = c.base("nation").select((F.col("n_nationkey") + 5000).alias("s_suppkey"), F.col("n_name").alias("s_name"), F.col("n_nationkey").alias("s_nationkey"), F.lit(0.0).alias("s_acctbal"))
    return writes.insert_all(c, "supplier", rows).state.select("s_suppkey")


@report("SELECT c_custkey, c_name FROM customer UNION ALL SELECT -1, 'absent'")
def wr_insert_if_absent(c):
    new = c.base("customer").where("c_custkey < 5").withColumn("c_name", F.lit("kept"))
    extra = new.where("c_custkey < 1").withColumn("c_custkey", F.col("c_custkey") - 1).withColumn("c_name", F.lit("absent"))
    return writes.insert_if_absent(c, "customer", new.unionAll(extra), ("c_custkey",)).state.select("c_custkey", "c_name")


@report("SELECT o_orderkey, CASE WHEN o_orderkey = 7 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def wr_update_by_key(c):
    return writes.update(c, "orders", {"o_orderkey": 7}, o_orderstatus="Z").state.select("o_orderkey", "o_orderstatus")


@report("SELECT o_orderkey FROM orders WHERE o_orderkey <> 7")
def wr_delete_by_key(c):
    return writes.delete(c, "orders", {"o_orderkey": 7}).state.select("o_orderkey")


@report("SELECT o_custkey, o_orderdate, o_orderkey FROM (SELECT o_custkey, o_orderdate, o_orderkey, lag(o_orderdate + INTERVAL 7 DAY) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) WHERE before > o_orderdate")
def wr_overlaps(c):
    rows = c.base("orders").select("o_custkey", "o_orderdate", (F.col("o_orderdate") + F.expr("INTERVAL '7' DAY")).alias("until"), "o_orderkey")
    return writes.overlapping(rows, ("o_custkey",), "o_orderdate", "until").select("o_custkey", "o_orderdate", "o_orderkey")


_SHELF = "SELECT p_partkey AS id, {n} AS on_hand, {v} AS version, 2 * ({n}) AS twice FROM part"


@report(_SHELF.format(n="p_size + (p_partkey = 7)::INT", v="1 + (p_partkey = 7)::INT"))
def wr_version(c):
    return writes.update(c, "shelf", {"id": 7}, version=1, on_hand=writes.plus("on_hand", 1)).state.select("id", "on_hand", "version", "twice")


@report(_SHELF.format(n="p_size + (p_size < 25 AND p_brand = 'Brand#11')::INT", v="1 + (p_brand = 'Brand#11')::INT").replace("FROM part", "FROM part"))
def wr_guarded_increment(c):
    t = c.table("shelf")
    branded = c.live("part").where("p_brand = 'Brand#11'").select(F.col("p_partkey").alias("id"))
    keyed = c.base("shelf").join(branded.withColumn("hit", F.lit(True)), "id", "left")
    marked = Catalog(c.spark, [*c.tables.values()], c.sources | {"shelf": keyed.withColumn("sku", F.when(F.col("hit"), "hit").otherwise("")).drop("hit")})
    q = Query(marked, "shelf")
    return writes.update_all(q.where(q["sku"].eq("hit")), on_hand=writes.plus_when(t, "on_hand")).state.select("id", "on_hand", "version", "twice")


@report(_SHELF.format(n="greatest(p_size, 25)", v="1 + (p_size < 25)::INT"))
def wr_guarded_upsert(c):
    rows = c.base("shelf").select("id", "sku", F.lit(25).alias("on_hand"))
    return writes.upsert(c, "shelf", rows, ("id",), when=lambda old, new: old("on_hand") < new("on_hand")).state.select("id", "on_hand", "version", "twice")


@report("SELECT p_partkey AS id, true AS labelled FROM part UNION ALL SELECT (SELECT max(p_partkey) FROM part) + row_number() OVER (), true FROM nation")
def wr_identity(c):
    rows = c.base("nation").select(F.col("n_name").alias("sku"))
    return writes.insert_all(c, "shelf", rows).state.select("id", F.col("label").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$").alias("labelled"))


# raw SQL, views, functions, shards, windows of events
@report("""WITH RECURSIVE w AS (SELECT p_partkey, 1 AS depth FROM part WHERE p_partkey = 3
UNION ALL SELECT t.p_partkey, depth + 1 FROM w JOIN part t ON t.p_partkey // 2 = w.p_partkey WHERE depth < 5) SELECT p_partkey, depth FROM w""")
def raw_recursive(c):
    tables.view(c.live("part").select("p_partkey", "p_parent"), "tessella_parts_tree")
    r = Registry(c.spark)
    text = """WITH RECURSIVE w(p_partkey, depth) AS (SELECT p_partkey, 1 FROM tessella_parts_tree WHERE p_partkey = :root
    UNION ALL SELECT t.p_partkey, depth + 1 FROM w JOIN tessella_parts_tree t ON t.p_parent = w.p_partkey WHERE depth < 5) SELECT p_partkey, depth FROM w"""
    r.declare("tree", text, "p_partkey bigint, depth int", ("root",))
    return r.query("tree", root=3)


@report("SELECT column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'int8' WHEN 'INTEGER' THEN 'int4' WHEN 'DOUBLE' THEN 'float8' WHEN 'VARCHAR' THEN 'text' ELSE 'timestamp' END AS kind FROM (DESCRIBE orders)")
def introspection(c):
    t = tables.describe(c.spark, c.sources["orders"], "orders")
    return c.spark.createDataFrame([(x.name, str(x.type)) for x in t.columns], "name string, kind string")


@report("SELECT 'orders' AS name, count(*) AS n_rows, 1::BIGINT AS n_files FROM orders UNION ALL SELECT 'nation', count(*), 1 FROM nation")
def table_sizes(c):
    return tables.sizes(c.spark, {n: c.sources[n] for n in ("orders", "nation")})


@report("SELECT 'orders' AS \"table\", 'drop' AS kind, 'o_orderpriority' AS \"column\" UNION ALL SELECT 'orders', 'add', 'o_note' UNION ALL SELECT 'orders', 'retype', 'o_custkey'")
def schema_drift(c):
    declared = [x for x in c.table("orders").columns if not x.source and x.name not in ("o_orderpriority", "o_custkey")]
    wanted = Table("orders", (*declared, Column("o_custkey", "int4"), Column("o_note", "text", True)), ("o_orderkey",))
    found = schema_diff.diff(wanted, c.stored("orders"))
    return c.spark.createDataFrame([(x.table, x.kind, x.column) for x in found], "table string, kind string, column string")


@report("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 420000 AND o_orderstatus = 'O'")
def raw_pinned(c):
    tables.view(c.live("orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), "raw_orders")
    r = Registry(c.spark)
    text = "SELECT o_orderkey, o_totalprice FROM raw_orders WHERE o_totalprice > :floor AND o_orderstatus = :status"
    r.declare("large", text, "o_orderkey bigint, o_totalprice double", ("floor", "status"))
    r.prepare({"large": {"floor": 1.0, "status": "F"}})
    return r.query("large", floor=420000.0, status="O")


@report("SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'large' ELSE 'small' END AS size FROM orders")
def sql_function(c):
    tables.sql_function(c.spark, "tessella_size_of", "x DOUBLE", "STRING", "CASE WHEN x >= 300000 THEN 'large' ELSE 'small' END")
    return c.live("orders").select("o_orderkey", F.expr("tessella_size_of(o_totalprice)").alias("size"))


@report("SELECT c_custkey % 4 AS shard, count(*) AS n FROM customer GROUP BY 1")
def shard_modulo(c):
    return c.live("customer").groupBy(shards.modulo(F.col("c_custkey"), 4).cast("long").alias("shard")).agg(F.count(F.lit(1)).alias("n"))


def _key_hash(key: str, tag: int, octets: list[str]) -> str:
    """FNV-1a of a tag and bytes in wider integers, which don't wrap."""
    h = str(shards.FNV_OFFSET)
    for byte in (str(tag), *octets):
        h = f"((xor(({h})::UBIGINT, ({byte})::UBIGINT)::HUGEINT * {shards.FNV_PRIME}) % 18446744073709551616)"
    return h


_INT_HASH = _key_hash("c_custkey", shards.INTEGER, [f"(c_custkey >> {8 * i}) & 255" for i in range(8)])


@report(f"""WITH RECURSIVE w AS (SELECT c_custkey, {_INT_HASH} AS k, (-1)::BIGINT AS b, 0::BIGINT AS j FROM customer
UNION ALL SELECT c_custkey, n, j, floor((j + 1) * (2147483648.0::DOUBLE / ((n // 8589934592) + 1)::DOUBLE))::BIGINT
FROM (SELECT c_custkey, j, (k * {shards.JUMP} + 1) % 18446744073709551616 AS n FROM w WHERE j < 8))
SELECT c_custkey, max(b)::INT AS shard FROM w GROUP BY 1""")
def shard_jump(c):
    return c.live("customer").select("c_custkey", shards.Jump(8).column(F.col("c_custkey")).alias("shard"))


@report(f"SELECT c_custkey, ({_INT_HASH} % 6)::INT AS shard FROM customer")
def shard_hash_modulo(c):
    return c.live("customer").select("c_custkey", shards.Modulo(6).column(F.col("c_custkey")).alias("shard"))


@report("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 WHEN 'HOUSEHOLD' THEN 1 END AS shard FROM customer")
def shard_lookup(c):
    to = shards.Lookup(2, {"BUILDING": 0, "MACHINERY": 1, "HOUSEHOLD": 1})
    return c.live("customer").select("c_custkey", to.column(F.col("c_mktsegment")).alias("shard"))


@report("SELECT 's' || c_custkey % 2 AS shard, c_custkey FROM customer WHERE c_acctbal > 9500")
def shard_each(c):
    part = lambda i: lambda s, n: c.live(n).where(shards.modulo(F.col("c_custkey"), 2) == i)
    every = shards.ShardSet({"s0": part(0), "s1": part(1)}, lambda k: f"s{k % 2}").each(c.spark, "customer")
    return every.where("c_acctbal > 9500").select("shard", "c_custkey")


@report("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_windowed(c):
    return windowed_counts(c.live("events"), "ts", "event_type")
