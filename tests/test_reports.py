"""Every registered query against its SQL."""

import uuid

import pytest
from row_text import rows_of

from tessella import reports

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(reports.ORACLES))
def test_query_agrees_with_sql(spark, oracle, name):
    got = reports.QUERIES[name](spark, SF).toPandas()
    want = oracle(reports.ORACLES[name], SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_jump_hash_moves_keys_only_into_the_new_shard():
    from tessella.sources.shards import Jump

    for key in [*range(500), *map(str, range(500)), *(uuid.UUID(int=i << 90) for i in range(200))]:
        a, b = Jump(8).locate(key), Jump(9).locate(key)
        assert a == b or b == 8


def test_places_of_null_large_and_other_keys(spark):
    from tessella.sources.shards import Jump, Modulo

    rows = [(2**63 - 1, "x", b"0" * 16), (None, None, None), (-(2**63), "", b"1" * 16), (2**53 + 1, "é" * 40, b"2" * 16)]
    df = spark.createDataFrame(rows, "n long, s string, u binary")
    for kind in (Jump(7), Modulo(7)):
        got = df.coalesce(1).select(*[kind.column(df[c]).alias(c) for c in df.columns]).collect()
        for (n, s, u), r in zip(rows, got):
            assert tuple(r) == ((None,) * 3 if n is None else (kind.locate(n), kind.locate(s), kind.locate(uuid.UUID(bytes=u))))
    assert Jump(100).locate(1) != Jump(100).locate("1")
