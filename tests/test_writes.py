"""Writes, constraints, versions, cached results, pinned SQL and streams on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessella import Catalog, Column, DeclarationError, ForeignKey, QueryError, Relation, Table
from tessella.errors import Conflict, ConstraintViolation, NothingAssigned, PagedWrite, StaleWrite, UnfilteredWrite
from tessella.model import AnyRef, Arc, Check, Exclude, Sql, Unique
from tessella.operators import writes as W
from tessella.operators.ordering import asc
from tessella.operators.query import Query

STOCK = Table(
    "stock",
    (
        Column("id", "int8", identity=True),
        Column("sku", "text"),
        Column("on_hand", "int4", default=0, inc_when="on_hand < 10"),
        Column("version", "int4", default=1, version=True),
        Column("twice", "int4", generated="on_hand * 2"),
        Column("note", "text", True, default=Sql("upper('new')")),
        Column("gone_at", "timestamp", True),
    ),
    ("id",),
    uniques=(Unique(("lower(sku)",)),),
    checks=(Check("on_hand >= 0", "on_hand_ok"),),
    soft_delete="gone_at",
)
MOVE = Table("move", (Column("id", "int8"), Column("stock_id", "int8", True)), ("id",), (Relation("stock", "one", "stock", ("stock_id",), ("id",)),), (ForeignKey(("stock_id",), "stock", ("id",), "set_null"),))


@pytest.fixture
def c(spark):
    stock = spark.createDataFrame(
        [(1, "A", 5, 1, 10, None, None), (2, "b", 20, 3, 40, "x", None), (3, "c", 0, 1, 0, "", dt.datetime(2020, 1, 1))],
        "id long, sku string, on_hand int, version int, twice int, note string, gone_at timestamp_ntz",
    )
    return Catalog(spark, [STOCK, MOVE], {"stock": stock, "move": spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, None)], "id long, stock_id long")})


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_insert_takes_defaults(c):
    w = W.insert(c, "stock", {"sku": "d"}, {"sku": "e", "on_hand": 7, "id": 9})
    assert rows(w.affected, "sku", "on_hand", "twice", "note", "version") == [("d", 0, 0, "NEW", 1), ("e", 7, 14, "NEW", 1)]
    assert {r.id for r in w.affected.collect()} == {4, 9}
    with pytest.raises(NothingAssigned):
        W.insert(c, "stock", {})
    with pytest.raises(ConstraintViolation):
        W.insert(c, "stock", {"on_hand": 1})
    with pytest.raises(DeclarationError):
        W.insert(c, "stock", {"sku": "x", "twice": 3})


def test_update_moves_versions_and_generated_columns(c):
    w = W.update(c, "stock", {"id": 2}, version=3, on_hand=W.plus("on_hand", 1))
    assert rows(w.affected, "on_hand", "twice", "version") == [(21, 42, 4)]
    with pytest.raises(StaleWrite):
        W.update(c, "stock", {"id": 2}, version=1, on_hand=1)
    with pytest.raises(DeclarationError):
        W.update(c, "stock", {"id": 2}, id=5)
    q = Query(c, "stock")
    w = W.update_all(q.where(q["on_hand"].gte(0)), on_hand=W.plus_when(STOCK, "on_hand"))
    assert rows(w.state, "id", "on_hand") == [(1, 6), (2, 20), (3, 0)]


def test_set_based_writes_need_a_predicate(c):
    q = Query(c, "stock")
    with pytest.raises(UnfilteredWrite):
        W.delete_all(q)
    with pytest.raises(PagedWrite):
        W.delete_all(q.where(q["id"].eq(1)).limit(3))


def test_soft_delete_and_restore(c):
    q = Query(c, "stock")
    assert W.delete_all(q.where(q["id"].in_([1, 3]))).count() == 1
    assert rows(W.restore_all(q.where(q["id"].eq(3))).state.where("gone_at IS NULL"), "id") == [(1,), (2,), (3,)]
    assert rows(W.hard_delete_all(q.where(q["id"].eq(1))).state, "id") == [(2,), (3,)]
    assert W.delete(c, "stock", {"id": 2}).count() == 1
    assert q.count() == 2 and q.with_deleted().count() == 3


def test_take_and_batch(c):
    q = Query(c, "stock").order(asc("sku")).limit(1)
    assert rows(W.take(q, note="taken").affected, "id", "note") == [(1, "taken")]
    assert rows(W.delete_batch(q).state, "id") == [(2,), (3,)]


def test_upserts(c, spark):
    new = spark.createDataFrame([("a", 3), ("z", 4)], "sku string, on_hand int")
    key = ("lower(sku)",)
    w = W.upsert(c, "stock", new, key)
    assert rows(w.state.where("lower(sku) IN ('a', 'z')"), "on_hand", "note") == [(3, None), (4, "NEW")]
    assert rows(W.upsert(c, "stock", new, key, accumulate=("on_hand",)).affected, "on_hand") == [(4,), (8,)]
    guarded = W.upsert(c, "stock", new, key, when=lambda old, fresh: fresh("on_hand") > old("on_hand"))
    assert guarded.count() == 1
    with pytest.raises(Conflict):
        W.upsert(c, "stock", new.unionAll(new), key)
    with pytest.raises(DeclarationError):
        W.upsert(c, "stock", new, ("note",))
    assert W.insert_if_absent(c, "stock", new, key).count() == 1
    with pytest.raises(Conflict):
        W.insert_if_absent(c, "stock", new, key, strict=True)


def test_tally_and_cascade(c):
    gone = c.base("stock").where("id = 1")
    assert rows(W.cascade(c, "stock", gone)["move"], "id", "stock_id") == [(1, None), (2, None), (3, 2), (4, None)]
    assert W.write_order(c, ["move", "stock"]) == ["stock", "move"]


def test_constraints(c, spark):
    W.check(c, "move")
    with pytest.raises(ConstraintViolation, match="not_null"):
        W.check(c, "stock", c.base("stock").withColumn("sku", F.lit(None).cast("string")))
    with pytest.raises(ConstraintViolation, match="unique"):
        W.check(c, "stock", c.base("stock").withColumn("sku", F.lit("same")))
    with pytest.raises(ConstraintViolation, match="on_hand_ok"):
        W.check(c, "stock", c.base("stock").withColumn("on_hand", F.lit(-1)))
    with pytest.raises(ConstraintViolation, match="foreign_key"):
        W.check(c, "move", spark.createDataFrame([(1, 77)], "id long, stock_id long"))


def test_exclusion_finds_overlaps_without_pairs(spark):
    d = lambda n: dt.datetime(2020, 1, n)
    t = Table("b", (Column("room", "int4"), Column("f", "timestamp"), Column("u", "timestamp", True)), excludes=(Exclude(("room",), "f", "u"),))
    ok = spark.createDataFrame([(1, d(1), d(3)), (1, d(3), d(4)), (2, d(1), None)], "room int, f timestamp_ntz, u timestamp_ntz")
    W.check(Catalog(spark, [t], {"b": ok}), "b")
    bad = ok.unionAll(spark.createDataFrame([(2, d(9), d(10))], ok.schema))
    with pytest.raises(ConstraintViolation, match="exclusion"):
        W.check(Catalog(spark, [t], {"b": bad}), "b")


def test_arcs_and_free_references(spark):
    cols = (Column("id", "int8"), Column("a", "int8", True), Column("b", "int8", True))
    t = Table("x", cols, ("id",), arcs=(Arc("of", {"a": ("a", "x"), "b": ("b", "x")}),))
    both = spark.createDataFrame([(1, 1, 1)], "id long, a long, b long")
    with pytest.raises(ConstraintViolation, match="check"):
        W.check(Catalog(spark, [t], {"x": both}), "x")
    with pytest.raises(DeclarationError, match="acknowledge"):
        Catalog(spark, [Table("y", cols, any_refs=(AnyRef("r", "a", "b"),))], {})


def test_store_moves_its_pointer(c, spark, tmp_path):
    store = W.Store(spark, f"file://{tmp_path}/store")
    assert store.pointer() == {}
    store.commit({"stock": c.base("stock")}, 1)
    q = Query(c, "stock")
    store.commit({"stock": W.hard_delete_all(q.where(q["id"].eq(1))).state}, 2)
    assert store.read("stock").count() == 2


def test_pinned_sql(spark):
    from tessella.plans.raw import Registry

    r = Registry(spark)
    with pytest.raises(DeclarationError, match="markers"):
        r.declare("bad", "SELECT ':x' AS y", "y string", ("x",))
    r.declare("good", "SELECT id FROM range(10) WHERE id > :low", "id bigint", ("low",))
    r.declare("wrong", "SELECT 1 AS id", "id string")
    with pytest.raises(DeclarationError, match="wrong gives"):
        r.prepare({"good": {"low": 1}})
    assert r.query("good", low=7).count() == 2
    with pytest.raises(QueryError):
        r.query("good")
    with pytest.raises(QueryError, match="not declared"):
        r.run_text("SELECT 1")


def test_cache_by_plan_and_tag(spark):
    from tessella.sources.cache import ResultCache

    now = [0.0]
    cache = ResultCache(lambda: now[0])
    df = spark.range(10).where("id > 3")
    first = cache.get(df, ttl=5, tags=("t",))
    assert cache.get(spark.range(10).where("id > 3"), ttl=5) is first
    assert cache.invalidate("t") == 1 and cache.invalidate("t") == 0


def test_stream_and_hooks(spark, tmp_path):
    from tessella.streaming.rows import Hooks, read_stream, windowed_counts

    rows_ = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 5), "a"), (dt.datetime(2024, 1, 1, 2, 5), "a")], "ts timestamp_ntz, kind string")
    rows_.write.parquet(f"{tmp_path}/in")
    stream = windowed_counts(read_stream(spark, f"{tmp_path}/in", rows_.schema), "ts", "kind")
    query = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    query.awaitTermination(60)
    assert spark.table("counts").count() == windowed_counts(rows_, "ts", "kind").count() == 2
    hooks, seen = Hooks(), []
    hooks.after.append(lambda name, s, e: seen.append((name, e)))
    with pytest.raises(ZeroDivisionError), hooks.around("x"):
        1 / 0
    assert seen[0][0] == "x" and hooks.calls == 1


def test_introspection_bulk_loads_and_sizes(spark, tmp_path):
    from tessella.sources import tables

    path = f"file://{tmp_path}/t"
    tables.append(spark.range(5).selectExpr("id", "cast(id AS decimal(12,2)) AS money", "array('x') AS tags"), path)
    tables.append(spark.range(3).selectExpr("id", "cast(id AS decimal(12,2)) AS money", "array('y') AS tags"), path)
    t = tables.describe(spark, path, "t")
    assert [str(c.type) for c in t.columns] == ["int8", "numeric(12,2)", "text[]"]
    assert tables.sizes(spark, {"t": path}).first().n_rows == 8
    assert tables.parquet(spark, path, t).columns == ["id", "money", "tags"]


def test_jdbc_options():
    from tessella.sources.tables import jdbc_options

    got = jdbc_options("jdbc:postgresql://h/d", "t", partition_column="id", bounds=(0, 1000), partitions=4, fetchsize=500)
    assert got == {"url": "jdbc:postgresql://h/d", "dbtable": "t", "fetchsize": "500", "partitionColumn": "id", "lowerBound": "0", "upperBound": "1000", "numPartitions": "4"}
    for wrong in ({"partition_column": "id"}, {"bounds": (0, 1)}, {"partition_column": "id", "bounds": (5, 1)}):
        with pytest.raises(QueryError):
            jdbc_options("u", "t", **wrong)


def test_schema_diff_of_stored_tables(spark):
    from tessella.sources import schema_diff

    t = Table("t", (Column("a", "int8"), Column("b", "text"), Column("d", "int4", source="1")), ("a",))
    got = schema_diff.diff(t, spark.createDataFrame([], "a int, c string"))
    assert [x.statement for x in got] == ["ALTER TABLE t ALTER COLUMN a TYPE bigint", "ALTER TABLE t ADD COLUMN b string", "ALTER TABLE t DROP COLUMN c"]
    assert schema_diff.diff(t, spark.createDataFrame([], "a long, b string")) == []


@pytest.mark.parametrize("block", [1, 30, 100_000])
def test_overlaps_over_any_blocks_of_time(spark, block):
    day = dt.datetime(2020, 1, 1)
    spans = [(k, day + dt.timedelta(days=a), None if b is None else day + dt.timedelta(days=b), i) for i, (k, a, b) in enumerate([("x", 0, 90), ("x", 40, 41), ("x", 95, 96), ("y", 1, 2), ("y", 2, 3), ("z", 5, None), ("z", 400, 401), (None, 3, 9), (None, 8, 9), ("x", 50, 50)])]
    spans.append(("x", None, day, 10))
    df = spark.createDataFrame(spans, "k string, a timestamp_ntz, b timestamp_ntz, i int")
    assert sorted(r.i for r in W.overlapping(df, ("k",), "a", "b", block_days=block).collect()) == [1, 6, 8]
    assert sorted(r.i for r in W.overlapping(df.where("k in ('y', 'z')"), (), "a", "b", block_days=block).collect()) == [6]


def test_identity_numbers_follow_the_largest(c, spark):
    w = W.insert_all(c, "stock", spark.range(0, 40, 1, 5).selectExpr("concat('s', id) AS sku"))
    assert sorted(r.id for r in w.affected.collect()) == list(range(4, 44))
    two = W.insert(c, "stock", {"sku": "d"}, {"sku": "e"})
    assert sorted(r.id for r in two.affected.collect()) == [4, 5]


def test_child_limits_hold_for_frames_too(c):
    from tessella.errors import ChildLimitError
    from tessella.plans.relations import plan

    q = Query(Catalog(c.spark, [Table(STOCK.name, STOCK.columns, STOCK.primary_key, (Relation("moves", "many", "move", ("id",), ("stock_id",)),)), MOVE], c.sources), "stock")
    assert plan(q).load("moves").limited(3).df().count() == 3
    with pytest.raises(ChildLimitError):
        plan(q).load("moves").limited(2).df()


def test_shards_by_table_and_name(spark):
    from tessella.sources.shards import Jump, Lookup, ShardSet, TableLocator

    where = TableLocator([(0, "low"), (100, "high")])
    assert (where.locate(99), where.locate(100)) == ("low", "high")
    with pytest.raises(QueryError):
        where.locate(-1)
    shards = ShardSet({n: (lambda s, t, n=n: s.range(3).withColumn("n", F.lit(n))) for n in ("low", "high")}, where.locate)
    assert shards.for_key(spark, "t", 500).first().n == "high" and shards.each(spark, "t").count() == 6
    with pytest.raises(QueryError):
        shards.for_id(spark, "t", "none")
    with pytest.raises(QueryError, match="over 3 shards"):
        ShardSet(shards.shards, Jump(3))
    placed = ShardSet(shards.shards, Lookup(2, {"a": 1}))
    assert placed.for_key(spark, "t", "a").first().n == "high"
    with pytest.raises(QueryError):
        placed.for_key(spark, "t", "b")
    with pytest.raises(QueryError):
        Jump(2).locate(None)
