"""The registered queries that SQL can state, against their SQL on whole tables."""

import os

import pytest

from wordmill.llm import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = c.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(x) for x in columns]
    assert sorted(repr([r[x] for x in columns]) for r in got.collect()) == sorted(repr([r[i] for i in at]) for r in want.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))
