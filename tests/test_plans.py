"""Plans that have to hold at any size: what reaches the scan, which joins are chosen, and that totals are partial first."""

import pytest

from tessella import reports
from tessella.operators import probes, topn
from tessella.operators.ordering import desc
from tessella.operators.query import Query

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def c(spark):
    return reports.catalog(spark, SF)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(c):
    q = Query(c, "orders")
    text = plan(q.where(q["o_totalprice"].gt(1000.0), q["o_orderstatus"].eq("F")).limit(None).project("o_orderkey").df())
    assert "GreaterThan(o_totalprice,1000.0)" in text and "EqualTo(o_orderstatus,F)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in text


def test_probes_are_semi_and_anti_joins(c):
    o = Query(c, "orders")
    assert "LeftSemi" in plan(probes.having(Query(c, "customer"), "orders", o["o_totalprice"].gt(1.0)).matching())
    assert "LeftAnti" in plan(probes.not_having(Query(c, "customer"), "orders", o["o_totalprice"].gt(1.0)).matching())


def test_top_n_prunes_before_the_shuffle(c):
    text = plan(topn.top_n_per_parent(Query(c, "orders").order(desc("o_totalprice"), desc("o_orderkey")), "o_custkey", 3))
    assert text.count("WindowGroupLimit") >= 2 and "Partial" in text


def test_groups_are_partial_first_and_limits_keep_only_the_top(c):
    text = plan(reports.by_status(c).build().df(limit=5))
    assert "partial_count" in text and "TakeOrderedAndProject" in text


def test_counts_and_existence_do_not_sort(c):
    q = Query(c, "orders").order(desc("o_totalprice"))
    assert "Sort" not in plan(q.count_df()) and "Sort" not in plan(q.exists_df())


def test_budgets_name_what_is_over(c):
    from tessella.errors import DeclarationError
    from tessella.plans import lint

    df = reports.by_status(c).build().df(limit=5)
    got = lint.cost(df)
    assert (got.joins, got.exchanges, got.python, got.scans) == (0, 1, 0, 1)
    assert lint.hold("ok", df, lint.Budget(joins=0, exchanges=1)) is df
    with pytest.raises(DeclarationError, match="1 exchanges, the budget is 0"):
        lint.hold("dear", df, lint.Budget(exchanges=0))
    assert lint.over(reports.shard_jump(c), lint.Budget()) == ["1 python, the budget is 0"]
    joined = lint.cost(reports.join_multikey(c))
    assert joined.joins == 1 and joined.crosses == 0


def test_flat_plans_gather_nothing_by_parent(c):
    text = plan(reports.plan_flat(c))
    assert "Window" not in text and "collect_list" not in text


def test_turns_keep_no_more_of_a_group_than_the_limit(c):
    q = Query(c, "orders").order(desc("o_totalprice"), desc("o_orderkey")).limit(7)
    assert "WindowGroupLimit" in plan(topn.turns(q, "o_custkey", Query(c, "orders")))


def test_descents_end_with_the_tree(c):
    from tessella.operators import recursion

    assert recursion.descend(c, "part", [1], 100_000).agg({"depth": "max"}).first()[0] < 20




def test_tests_of_a_document_parse_it_once(c, spark):
    def parses(df):
        return [x.count("parseJson") for x in plan(df).splitlines() if "Filter " in x and "FileScan" not in x]

    for name in ("json_any_key", "json_contains", "json_all_keys", "json_array_contains"):
        assert parses(reports.QUERIES[name](spark, SF)) == [1], name
    q = Query(c, "events")
    apart = q.where(q["props"].json_contains({"k": 1})).not_(q["props"].has_any_key(["zz"])).where(q["items"].json_contains([1]))
    assert parses(apart.limit(None).df()) == [2]  # two documents


def test_a_traversal_never_broadcasts_its_table(c, monkeypatch):
    from tessella.operators import recursion

    plans, keep = [], recursion.checkpointed
    monkeypatch.setattr(recursion, "checkpointed", lambda df: plans.append(plan(df)) or keep(df))
    for walk, roots in ((recursion.ascend, [150, 77]), (recursion.descend, [0, 5])):
        found = []
        for most in (20_000, 1, 0):
            plans.clear()
            monkeypatch.setattr(recursion, "BROADCAST_ROWS", most, raising=False)
            found.append(sorted(map(tuple, walk(c, "part", roots, 6).select("p_partkey", "depth", "path").collect())))
            assert len(plans) > 3
            for text in plans:
                lines = text.splitlines()
                for i, line in enumerate(lines):
                    if "BroadcastExchange" in line:  # what is below it in the tree is what is sent
                        deep = line.index("BroadcastExchange")
                        below = next((j for j in range(i + 1, len(lines)) if len(lines[j]) - len(lines[j].lstrip(" :+-")) <= deep), len(lines))
                        assert not any("FileScan" in x for x in lines[i:below])
            assert any("SortMergeJoin" in x for x in plans) == (most < 20_000)
        assert found[0] == found[1] == found[2]


def test_no_query_crosses_or_runs_python(spark):
    python = {"shard_jump", "shard_hash_modulo", "json_contained_by", "agg_own_function", "table_own_function", "introspection", "schema_drift"}
    for name, fn in reports.QUERIES.items():
        text = plan(fn(spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
        assert name in python or not any(x in text for x in ("Python", "Pandas", "Arrow")), name
