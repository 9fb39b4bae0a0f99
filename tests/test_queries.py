"""Every query outside the text subpackage against its DuckDB twin on the smallest tables, and the driver's contract."""

from __future__ import annotations

import math

import pytest

from quern.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
#: Queries of loops over the graph take some seconds each; one for each loop is run here, others only against the driver's twins.
SLOW = {
    "g_tangles", "g_inner_edges", "g_weakest_edge", "g_tangle_degrees", "g_shape_ratios", "g_verdict", "h_cyclicity",
    "g_inner_edges_sparse", "g_weakest_edge_sparse", "g_tangle_degrees_sparse", "g_shape_ratios_sparse", "g_reachable_sparse", "h_cumulative_dependency_sparse", "r_notes", "r_totals",
}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows):
    def one(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "None"
        return repr(float(x)) if isinstance(x, float) else str(x)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(set(ORACLE_SQL) - SLOW))
def test_query_equals_its_twin(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    twin = duck.sql(ORACLE_SQL[name])
    assert columns == sorted(twin.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]}) q").fetchall()
    assert canonical(map(tuple, df.select(*columns).collect())) == canonical(want)


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert 0 < entry.entry(spark).count() <= 10
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_each_twin_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
