"""Contents reconciled by a hash tree, and the routes of quality issues."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from stagewatch.functions.exprs import fx_rate
from stagewatch.operators import reconcile as R
from stagewatch.operators import report as K
from stagewatch.operators import transform as T

SCHEMA = "k string, a int, b string"
SOURCE = [("1", 1, "x"), ("2", 2, None), ("3", 3, "z"), ("4", 4, "w"), ("4", 4, "w"), ("5", 5, "v"), ("5", 6, "v"),
          (None, 7, "n"), ("6", None, "null"), ("7", 1, "p"), ("7", 2, "q")]
TARGET = [("1", 1, "x"), ("2", 2, "null"), ("4", 4, "w"), ("5", 6, "v"), ("5", 5, "v"), (None, 8, "n"), ("6", None, "null"),
          ("7", 1, "q"), ("7", 2, "p"), ("8", 1, "new"), ("8", 1, "new")]
WANT = {("2", "changed", 1, 1, "b"), ("3", "missing", 1, 0, ""), ("4", "row_count", 2, 1, ""),
        (None, "changed", 1, 1, "a"), ("7", "changed", 2, 2, ""), ("8", "extra", 0, 2, "")}


@pytest.mark.parametrize("leaves", [1, 3, 1 << 16])
def test_differences(spark, leaves):
    a, b = (spark.createDataFrame(x, SCHEMA).repartition(3) for x in (SOURCE, TARGET))
    found = R.content_differences(a, b, "k", ["a", "b"], leaves)
    # key 7 has the same values in each column, paired in another way
    assert {tuple(r) for r in found.collect()} == WANT
    assert R.content_differences(a, a, "k", ["a", "b"], leaves).count() == 0
    assert R.content_differences(a.limit(0), a.limit(0), "k", ["a", "b"], leaves).count() == 0
    empty = R.content_differences(a.limit(0), b, "k", ["a", "b"], leaves)
    assert {r.status for r in empty.collect()} == {"extra"}


def test_types_may_differ(spark):
    a = spark.createDataFrame([("1", 5)], "k string, a int")
    b = spark.createDataFrame([("1", "5")], "k string, a string")
    assert R.content_differences(a, b, "k", ["a"]).count() == 0


def test_summary_and_samples(spark):
    a, b = (spark.createDataFrame(x, SCHEMA) for x in (SOURCE, TARGET))
    found = R.content_differences(a, b, "k", ["a", "b"])
    got = {(r.status, r.column_name): r.n_keys for r in R.difference_summary(found).collect()}
    assert got == {("changed", ""): 3, ("changed", "a"): 1, ("changed", "b"): 1, ("missing", ""): 1, ("extra", ""): 1,
                   ("row_count", ""): 1}
    rows = {tuple(r) for r in R.difference_samples(a, b, found, "k", ["a", "b"], 2).collect()}
    assert ("missing", "3", "source", "3|z") in rows and ("extra", "8", "target", "1|new") in rows
    assert {k for s, k, _, _ in rows if s == "changed"} == {None, "2"}


def test_only_rows_of_differing_leaves_are_opened(spark):
    a = spark.range(20_000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"))
    b = a.where("k != '77'")
    trees = [R.hash_tree(t, "k", ["v"]) for t in (a, b)]
    assert R.differing_leaves(*trees).count() == 1
    plan = R.content_differences(a, b, "k", ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_both_sides_are_shuffled_once_and_as_they_are(spark, tmp_path):
    from stagewatch.plans import catalog
    keys = [1, 2, 89, 97, 101, 103, 107, 109, 89 * 103, 97 * 101, 97 * 107, 101 * 103, 101 * 107, 103 * 107, 107 * 109]
    lines = [(k, n, k % 7, 1.0 + n, 10.25 * k, None if n == 4 else "NRA"[k % 3]) for k in [*keys, 107, 55] for n in (1, 2, 2, 4)]
    orders = [(k, k % 5, None if k == 2 else "FOP"[k % 3], dt.date(1995, 1, 1 + k % 28)) for k in keys]
    for name, rows, schema in (
            ("lineitem", lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, "
                                "l_extendedprice double, l_returnflag string"),
            ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate date")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")       # as for tables that are large
    try:
        for name in ("content_differences", "content_summary", "content_samples"):
            found = catalog.queries()[name](spark, str(tmp_path))
            got = sorted(map(tuple, found.collect()), key=str)
            sql = con.execute(catalog.oracle_sql()[name])
            at = [[c[0] for c in sql.description].index(c) for c in found.columns]
            assert got == sorted((tuple(r[i] for i in at) for r in sql.fetchall()), key=str) and got
            plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert "ReusedExchange" in plan and "FullOuter" not in plan, name
            if name != "content_samples":                             # its keys are kept before
                assert plan.count("hashpartitioning(key") == 1, name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


STAGES = "run_id long, stage_name string, stage_ordinal int, attempt int, status string, error_message string"
METRICS = ("run_id long, total_rows long, null_count long, duplicate_count long, out_of_range_count long, "
           "schema_violations array<string>, type_mismatches map<string,string>, extra_columns array<string>")


def test_every_kind_of_issue_is_routed(spark):
    stages = spark.createDataFrame(
        [(r, "ingestion", 1, 1, "failed" if r in (1, 2) else "success", None) for r in range(1, 9)]
        + [(2, "ingestion", 1, 2, "success", None)], STAGES)
    metrics = spark.createDataFrame([
        (r, 10, int(r == 3), int(r == 4), int(r == 5), ["x"] if r == 6 else [], {"p": "y"} if r == 7 else {},
         ["more"] if r == 8 else []) for r in range(1, 9)], METRICS)
    got = {r.run_id: (r.route, r.reasons) for r in K.quality_route(stages, metrics).collect()}
    assert got == {1: ("diagnose", "stage"), 2: ("report", ""), 3: ("diagnose", "nulls"), 4: ("diagnose", "duplicates"),
                   5: ("diagnose", "range"), 6: ("diagnose", "schema"), 7: ("diagnose", "type"), 8: ("report", "")}
    history = spark.createDataFrame([(r, "s", "HEALTHY", 0, 0) for r in range(1, 9)],
                                    "run_id long, scenario_name string, outcome string, total_nulls long, duplicate_count long")
    known = spark.createDataFrame([(5, 3, True)], "run_id long, recent_occurrences long, is_known_recurring boolean")
    routes = {r.run_id: r.route for r in K.triage_route(history, known, metrics).collect()}
    assert routes == {1: "report", 2: "report", 3: "report", 4: "report", 5: "repair", 6: "diagnose", 7: "diagnose", 8: "report"}
    listed = history.withColumn("schema_violations", F.when(F.col("run_id") == 1, "Missing").otherwise(""))
    assert {r.run_id: r.route for r in K.triage_route(listed, known).collect()}[1] == "diagnose"


def test_small_rates_keep_their_scale(spark):
    sales = spark.createDataFrame([("VND", 1000.0, 3), ("USD", 2.0, 1)], "currency string, unit_price double, quantity int")
    table = spark.createDataFrame([("VND", 0.000039), ("USD", 1.0)], "currency string, rate double")
    for rates in ({"VND": 0.000039, "USD": 1}, table):
        got = {r.currency: float(r.revenue_usd) for r in T.fx_convert(sales, rates).collect()}
        assert got == {"VND": pytest.approx(0.117), "USD": 2.0}
    row = spark.range(1).select(fx_rate(F.lit("X"), {}).alias("none"), fx_rate(F.lit("A"), {"A": 12345.678901}).alias("a")).first()
    assert float(row.none) == 1.0 and float(row.a) == 12345.678901
