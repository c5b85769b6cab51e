"""History analytics: the reference's numeric checks plus the prefix count."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stagewatch.operators import history as H
from stagewatch.operators.prefix import prior_counts

NOW = dt.datetime(2024, 1, 31, 0, 0, 0)
SCHEMA = ("run_id string, scenario_name string, failure_type string, ts timestamp_ntz, outcome string, "
          "duration_seconds double, total_rows bigint, total_nulls bigint, duplicate_count bigint")


def rec(run_id, outcome="HEALTHY", scenario="healthy", ftype=None, hours=1.0, dur=10.0, rows=200, nulls=0, dups=0):
    return (run_id, scenario, ftype, NOW - dt.timedelta(hours=hours), outcome, dur, rows, nulls, dups)


def test_failure_trend_counts(spark):
    h = spark.createDataFrame([rec("a", "FAILED"), rec("b", "RESOLVED"), rec("c", "FAILED")], SCHEMA)
    r = {x["failure_type_filter"]: x for x in H.failure_trend(h, NOW).collect()}["all"]
    assert (r["total_runs"], r["failed_count"], r["resolved_count"]) == (3, 2, 1)


def test_lookback_excludes_old_records(spark):
    h = spark.createDataFrame([rec("a", "FAILED", hours=30)], SCHEMA)
    assert H.failure_trend(h, NOW).where("failure_type_filter = 'all'").count() == 0


def test_mttr(spark):
    h = spark.createDataFrame([rec("a", "RESOLVED", dur=20.0), rec("b", "RESOLVED", dur=40.0),
                               rec("c", "RESOLVED", dur=0.0), rec("d", "FAILED", dur=99.0)], SCHEMA)
    assert H.failure_trend(h, NOW).where("failure_type_filter = 'all'").first()["mttr_seconds"] == 30.0
    none = spark.createDataFrame([rec("a", "FAILED")], SCHEMA)
    assert H.failure_trend(none, NOW).where("failure_type_filter = 'all'").first()["mttr_seconds"] is None


def test_baseline_ratio_of_averages(spark):
    h = spark.createDataFrame([rec("a", rows=200), rec("b", rows=200, nulls=10, dups=4)], SCHEMA)
    r = H.baseline_metrics(h).first()
    assert r["sample_size"] == 2 and r["avg_null_rate"] == 0.025 and r["avg_duplicate_rate"] == 0.01


def test_baseline_deviation_anomaly(spark):
    h = spark.createDataFrame([rec("old1", hours=48), rec("old2", hours=47),
                               rec("cur", hours=1, nulls=20)], SCHEMA)
    r = H.baseline_deviation(h, NOW).first()
    assert r["run_id"] == "cur" and r["baseline_available"] and r["anomaly_detected"]
    assert r["null_rate_delta"] == pytest.approx(0.1)


def test_known_failure_threshold(spark):
    rows = [rec(f"p{i}", "FAILED", "s", "schema_drift", hours=5 - i) for i in range(3)] + \
           [rec("now", "FAILED", "s", "schema_drift", hours=0.5), rec("other", "FAILED", "t", None, hours=0.5)]
    h = spark.createDataFrame(rows, SCHEMA)
    got = {r["run_id"]: r for r in H.known_failures(h).collect()}
    assert got["now"]["recent_occurrences"] == 3 and got["now"]["is_known_recurring"]
    assert got["p1"]["recent_occurrences"] == 1 and not got["p1"]["is_known_recurring"]
    assert got["other"]["recent_occurrences"] == 0


def test_recent_runs_rejects_zero_limit(spark):
    h = spark.createDataFrame([rec("a")], SCHEMA)
    with pytest.raises(ValueError):
        H.recent_runs(h, 0)
    assert H.recent_runs(h, 1).count() == 1


def _brute(rows, lookback):
    out = {}
    for rid, key, t, m in rows:
        out[rid] = sum(1 for _, k2, t2, m2 in rows if m2 and k2 == key and t - lookback <= t2 < t)
    return out


def test_prior_counts_match_brute_force_with_a_hot_key(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(600):
        key = "hot" if i % 3 else rnd.choice(["a", "b", None])     # two thirds in one key
        rows.append((i, key, rnd.randrange(0, 5000), rnd.random() < 0.6))
    df = spark.createDataFrame(rows, "id long, k string, t long, m boolean") \
        .withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz"))
    got = {r["id"]: r["prior_count"] for r in
           prior_counts(df, "id", ["k"], "ts", F.col("m"), lookback_us=700 * 1_000_000, bucket_us=60 * 1_000_000).collect()}
    assert got == _brute(rows, 700)
    got = {r["id"]: r["prior_count"] for r in prior_counts(df, "id", ["k"], "ts", F.lit(True)).collect()}
    assert got == {rid: sum(1 for _, k2, t2, _m in rows if k2 == k and t2 < t) for rid, k, t, _ in rows}


def test_prior_counts_when_all_runs_share_one_time(spark):
    df = spark.range(50_000).selectExpr("id", "'s' as k", "cast('2024-01-01 00:00:00' as timestamp_ntz) as ts")
    later = spark.range(50_000, 50_001).selectExpr("id", "'s' as k", "cast('2024-01-01 00:00:05' as timestamp_ntz) as ts")
    out = prior_counts(df.union(later), "id", ["k"], "ts", F.lit(True), lookback_us=60_000_000)
    assert {r["id"]: r["prior_count"] for r in out.where("id in (0, 49999, 50000)").collect()} == {
        0: 0, 49999: 0, 50000: 50_000}
    # what meets in one window is one point per distinct time, however many runs share it
    points = df.union(later).groupBy("k", "ts").count()
    assert points.count() == 2


def test_prior_counts_carry_columns_and_rows_without_a_time(spark):
    rows = [(1, "a", None, "x"), (2, "a", None, "y"), (3, None, "2024-01-01 00:00:00", "z"),
            (4, None, "2024-01-01 00:00:01", None), (5, "a", "2024-01-01 00:00:02", "w")]
    df = spark.createDataFrame(rows, "id long, k string, at string, _t string").selectExpr(
        "id", "k", "cast(at as timestamp_ntz) as ts", "_t")
    got = sorted(map(tuple, prior_counts(df, "id", ["k"], "ts", F.lit(True), lookback_us=10_000_000,
                                         carry=["_t", "k"]).collect()))
    assert got == [(1, "x", "a", None), (2, "y", "a", None), (3, "z", None, 0), (4, None, None, 1), (5, "w", "a", 0)]


def test_triage_counts_known_failures_itself(spark):
    from stagewatch.operators import report as K
    h = spark.createDataFrame([rec(f"o{i}", "FAILED", "s", "schema_drift", hours=2 + i) for i in range(3)]
                              + [rec("now", "HEALTHY", "s", "schema_drift", hours=1), rec("t", "HEALTHY", "u", None)], SCHEMA)
    assert sorted(K.triage_route(h).collect()) == sorted(K.triage_route(h, H.known_failures(h)).collect())


def test_latest_runs_over_all_scenarios(spark):
    h = spark.createDataFrame([rec("a", scenario="s", hours=3), rec("b", scenario="t", hours=1),
                               rec("c", scenario="s", hours=2)], SCHEMA)
    assert [r["run_id"] for r in H.latest_runs(h, 2).collect()] == ["b", "c"]
    assert [r["run_id"] for r in H.latest_runs(h, 5, "s").collect()] == ["c", "a"]
    with pytest.raises(ValueError):
        H.latest_runs(h, 0)


def test_filter_history_null_safe_failure_type(spark):
    h = spark.createDataFrame([rec("a", "FAILED", "s", None), rec("b", "FAILED", "s", "schema_drift"),
                               rec("c", "HEALTHY", "t", None)], SCHEMA)
    assert [r["run_id"] for r in H.filter_history(h, scenario="s", failure_type=None).collect()] == ["a"]
    assert H.filter_history(h, failure_type="schema_drift").count() == 1
    assert H.filter_history(h, outcomes=["FAILED"]).count() == 2
    assert H.filter_history(h).count() == 3


def test_history_summary_latest_run(spark):
    h = spark.createDataFrame([rec("a", "FAILED", "s", hours=3), rec("b", "RESOLVED", "s", hours=1, dur=30.0),
                               rec("c", "HEALTHY", "s", hours=50)], SCHEMA)
    r = H.history_summary(h, NOW).first()
    assert (r["total_runs"], r["runs_in_window"], r["failed_in_window"]) == (3, 2, 1)
    assert (r["last_run_id"], r["last_outcome"], r["mttr_in_window"]) == ("b", "RESOLVED", 30.0)


def test_prior_counts_property(spark):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    row = st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 300), st.booleans())

    @settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(row, min_size=1, max_size=60), st.integers(1, 120), st.integers(1, 6))
    def check(rows, lookback, parts):
        data = [(i, k, t, m) for i, (k, t, m) in enumerate(rows)]
        df = spark.createDataFrame(data, "id long, k string, t long, m boolean") \
            .withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz"))
        got = {r["id"]: r["prior_count"] for r in
               prior_counts(df, "id", ["k"], "ts", F.col("m"), lookback_us=lookback * 1_000_000,
                            bucket_us=parts * 7_000_000).collect()}
        assert got == _brute(data, lookback)

    check()


def test_trend_filtered_by_failure_type(spark):
    h = spark.createDataFrame([rec("a", "FAILED", ftype="schema_drift"), rec("b", "RESOLVED", ftype="data_quality"),
                               rec("c", "FAILED", ftype="schema_drift")], SCHEMA)
    t = {r["failure_type_filter"]: r for r in H.failure_trend(h, NOW).collect()}
    assert (t["schema_drift"]["total_runs"], t["schema_drift"]["failed_count"]) == (2, 2)
    assert (t["data_quality"]["total_runs"], t["data_quality"]["resolved_count"]) == (1, 1)


def test_no_baseline_without_earlier_records(spark):
    h = spark.createDataFrame([rec("cur", hours=1, nulls=50)], SCHEMA)
    r = H.baseline_deviation(h, NOW).first()
    assert not r["baseline_available"] and r["sample_size"] == 0 and not r["anomaly_detected"]
    assert r["baseline_null_rate"] is None


def test_old_failures_are_not_known(spark):
    rows = [rec(f"o{i}", "FAILED", "s", "schema_drift", hours=40 + i) for i in range(3)] + \
           [rec("now", "FAILED", "s", "schema_drift", hours=1)]
    got = {r["run_id"]: r for r in H.known_failures(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["now"]["recent_occurrences"] == 0 and not got["now"]["is_known_recurring"]


def test_recent_runs_limit_and_scenario(spark):
    h = spark.createDataFrame([rec(f"s{i}", scenario="s", hours=i) for i in range(5)] +
                              [rec("t0", scenario="t", hours=0)], SCHEMA)
    got = H.recent_runs(h, 2, scenario="s").orderBy("recency_rank").collect()
    assert [r["run_id"] for r in got] == ["s0", "s1"]
    assert H.recent_runs(h, 10).count() == 6


def test_own_baseline_against_brute_force(spark):
    """Ties in time, a scenario with most runs, null metrics, times and scenarios, runs on both sides of an hour."""
    rng = random.Random(7)
    rows = [rec(f"r{i}", scenario=rng.choice(["hot", "hot", "hot", "a", None]), hours=rng.choice([0, 1, 1.5, 2, 30, 31.25]),
                rows=rng.choice([0, 100, 200]), nulls=rng.randrange(30), dups=rng.randrange(9)) for i in range(120)]
    h = spark.createDataFrame(rows, SCHEMA)
    gone = F.col("run_id").isin("r3", "r4")
    for c in ("total_rows", "total_nulls", "duplicate_count"):
        h = h.withColumn(c, F.when(~gone, F.col(c)))
    h = h.withColumn("ts", F.when(~F.col("run_id").isin("r5", "r6"), F.col("ts"))).cache()
    got = {r.run_id: r for r in H.own_baseline_deviation(h).collect()}
    runs = h.collect()
    assert len(got) == len(runs)
    seen = set()
    for r in runs:
        before = [b for b in runs if r.ts and b.ts and b.ts < r.ts and b.scenario_name == r.scenario_name]
        n = sum(b.total_rows is not None for b in before)
        total, nulls, dups = (sum(getattr(b, c) or 0 for b in before) for c in ("total_rows", "total_nulls", "duplicate_count"))
        mine = got[r.run_id]
        assert (mine.sample_size, mine.baseline_available) == (n, n > 0)
        cn, cd = (r.total_nulls or 0) / (r.total_rows or 1), (r.duplicate_count or 0) / (r.total_rows or 1)
        assert mine.current_null_rate == pytest.approx(cn, abs=6e-5)
        if not n:
            assert mine.baseline_null_rate is None and not mine.anomaly_detected
            continue
        bn, bd = (nulls / total, dups / total) if total else (0, 0)
        assert mine.baseline_null_rate == pytest.approx(bn, abs=6e-5)
        assert mine.duplicate_rate_delta == pytest.approx(cd - bd, abs=6e-5)
        assert mine.anomaly_detected == (abs(cn - bn) > 0.05 or abs(cd - bd) > 0.05)
        seen.add(mine.anomaly_detected)
    assert seen == {True, False}
