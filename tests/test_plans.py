"""Plan-shape tests: the physical plans we rely on for scale."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F
import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_no_python_udf_or_pairwise_join_in_any_query(spark):
    for name, q in E.queries().items():
        p = plan(q(spark, SF))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_fx_conversion_needs_no_join(spark):
    from stagewatch.operators import transform as tr
    from stagewatch.sources import views as V
    li = V.read_table(spark, SF, "lineitem", "l_extendedprice", "l_quantity", "l_returnflag") \
        .selectExpr("cast(l_extendedprice as decimal(12,2)) as unit_price", "cast(l_quantity as int) as quantity",
                    "case l_returnflag when 'R' then 'EUR' else 'USD' end as currency")
    p = plan(tr.fx_convert(li))
    assert "Join" not in p and "Exchange" not in p


def test_dedup_is_limited_before_the_shuffle(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan(E.queries()["dedup_sales"](spark, SF))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "WindowGroupLimit" in p


def test_scan_reads_only_needed_columns(spark):
    p = plan(E.queries()["daily_revenue"](spark, SF))
    assert "l_tax" not in p and "l_shipdate" not in p and "o_totalprice" not in p


def test_history_lookback_is_pushed_to_the_scan(spark):
    p = plan(E.queries()["recurrence"](spark, SF))
    assert "GreaterThanOrEqual(ts,2024-01-30T00:00)" in p
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in p


def test_report_joins_reuse_run_id_partitioning(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan(E.queries()["incident_report"](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # one exchange per input aggregate level; none added by the join chain
    assert p.count("SortMergeJoin") == 4
    assert p.count("Exchange hashpartitioning") == 7


@pytest.mark.parametrize("name,joins", [("run_outcome", 3), ("pipeline_health", 3), ("source_target_reconcile", 3),
                                        ("schema_drift", 3), ("dedup_sales", 2)])
def test_queries_join_only_what_they_use(spark, name, joins):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan(E.queries()[name](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    found = p.count("SortMergeJoin") + p.count("ShuffledHashJoin")
    assert found <= joins, found


def test_known_failures_builds_without_a_job(spark):
    from stagewatch.operators.prefix import prior_counts
    tracker, group = spark.sparkContext.statusTracker(), "prefix-build"
    spark.sparkContext.setJobGroup(group, group)
    df = spark.range(10).selectExpr("id", "id % 2 as k", "cast('2024-01-01 00:00:00' as timestamp_ntz) as ts")
    prior_counts(df, "id", ["k"], "ts", F.lit(True), lookback_us=10)
    assert not tracker.getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_dedup_on_join_key_parts_reuses_the_join_partitioning(spark):
    from stagewatch.operators import repair as R
    from stagewatch.sources import views as V
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        s = V.sales(spark, SF, with_region=False, with_keys=True)
        p = plan(R.dedup_first(s, ["order_key", "line_no"], ["product_id"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # only the two join inputs are shuffled; the de-dup window adds no exchange
    assert p.count("Exchange hashpartitioning") == 2 and "WindowGroupLimit" in p


@pytest.mark.parametrize("name,exchanges,joins", [("known_failures", 7, 2), ("triage_route", 7, 2),
                                                  ("incident_report_lines", 11, 6), ("dedup_conflicts", 6, 2)])
def test_exchanges_and_joins_of_the_larger_reports(spark, name, exchanges, joins):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan(E.queries()[name](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    found = (p.count("Exchange hashpartitioning") - p.count("ReusedExchange"),
             p.count("SortMergeJoin") + p.count("ShuffledHashJoin"))
    assert found[0] <= exchanges and found[1] <= joins, found
