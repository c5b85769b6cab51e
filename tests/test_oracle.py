"""Every registered query against its DuckDB oracle on the smallest test data."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from stagewatch.plans import catalog
from stagewatch.sources.tables import TABLES, table_path

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = table_path(SF, t)
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def norm(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def v(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 9)
        return x
    return sorted((tuple(v(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    got = norm(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == norm(cols, cur.fetchall())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["transaction_date", "total_revenue", "transaction_count", "avg_order_value"]
    assert df.count() > 0


def test_every_query_builds(spark):
    for name, q in catalog.queries().items():
        assert q(spark, SF).columns, name


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(catalog.queries()) <= set(E.queries())
