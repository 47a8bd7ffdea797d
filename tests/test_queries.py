"""Every query that has SQL gives the same rows as DuckDB, at the smallest scale."""

from __future__ import annotations

import os

import pytest

from tillage.plans import registry

duckdb = pytest.importorskip("duckdb")
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"}


@pytest.fixture(scope="module")
def views(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{small}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_rows_are_the_same(spark, views, small, name):
    df = registry.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(tuple(map(repr, (r[c] for c in columns))) for r in df.collect())
    result = views.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    rows = sorted(tuple(map(repr, (r[names.index(c)] for c in columns))) for r in result.fetchall())
    assert sorted(names) == columns
    assert got == rows
    assert not [(c, k, kinds[c]) for c, k in df.dtypes if KINDS.get(k, kinds[c]) != kinds[c] and kinds[c] != "HUGEINT"]


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_no_python_in_query_plans(spark, small):
    for name, query in registry.QUERIES.items():
        plan = query(spark, small)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")), name
