"""Structured Streaming quality monitor over files landing in a folder."""

from stagewatch.streaming.monitor import start_quality_stream

SCHEMA = "transaction_id string, quantity int, unit_price double, currency string"


def test_stream_profiles_each_batch(spark, tmp_path):
    src, out, ck = tmp_path / "in", tmp_path / "metrics", tmp_path / "ck"
    spark.createDataFrame([("a", 1, 1.0, "USD"), ("a", 0, None, "XXX")], SCHEMA).write.parquet(str(src / "b1"))
    q = start_quality_stream(spark, str(src / "*"), SCHEMA, str(out), str(ck))
    q.awaitTermination(120)
    m = spark.read.parquet(str(out))
    got = {(r["column_name"], r["metric"]): r["value"] for r in m.collect()}
    assert got[("unit_price", "nulls")] == 1
    assert got[("quantity", "violations_range")] == 1
    assert got[("currency", "violations_allowed")] == 1
    assert got[("transaction_id", "duplicates")] == 1
    # a second landing is picked up as a new batch; the first is not reprocessed
    spark.createDataFrame([("b", 2, 2.0, "EUR")], SCHEMA).write.parquet(str(src / "b2"))
    q = start_quality_stream(spark, str(src / "*"), SCHEMA, str(out), str(ck))
    q.awaitTermination(120)
    assert spark.read.parquet(str(out)).select("batch_id").distinct().count() == 2


def test_trend_stream_emits_final_windows(spark, tmp_path):
    import datetime as dt

    from stagewatch.streaming.monitor import HISTORY_RECORD_SCHEMA, start_trend_stream
    src, out, ck = tmp_path / "hist", tmp_path / "trend", tmp_path / "ck2"
    t0 = dt.datetime(2024, 1, 1, 10, 30)
    first = [("a", "s", "schema_drift", t0, "FAILED", 5.0), ("b", "s", "schema_drift", t0, "RESOLVED", 20.0),
             ("c", "s", None, t0, "HEALTHY", 1.0)]
    spark.createDataFrame(first, HISTORY_RECORD_SCHEMA).write.parquet(str(src / "b1"))
    for batch in range(2):
        if batch:   # much later records move the watermark past the first windows
            later = [("d", "s", None, t0 + dt.timedelta(days=5), "HEALTHY", 1.0)]
            spark.createDataFrame(later, HISTORY_RECORD_SCHEMA).write.parquet(str(src / "b2"))
        q = start_trend_stream(spark, str(src / "*"), str(out), str(ck), window_hours=2, slide_hours=1,
                               late_hours=1)
        q.awaitTermination(120)
    res = spark.read.parquet(str(out))
    drift = res.where("failure_type = 'schema_drift'").orderBy("window_start").collect()
    assert len(drift) == 2                      # 10:30 falls in the 09-11 and 10-12 windows
    assert all((r["total_runs"], r["failed_count"], r["resolved_count"]) == (2, 1, 1) for r in drift)
    assert drift[0]["mttr_seconds"] == 20.0
