"""Publishing by attempt: no gap when a write fails, roll-backs, returns, state as of a time."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stagewatch.sources import published as P


def frame(spark, n, day="2024-01-01"):
    return spark.range(n).select(F.col("id").cast("string").alias("transaction_id"),
                                 F.lit(day).cast("date").alias("transaction_date"))


def rows(spark, target, as_of=None):
    found = P.read_published(spark, target, as_of).groupBy("run_id", "attempt").count().collect()
    return {(str(r.run_id), r.attempt): r["count"] for r in found}


def at(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


def test_attempts_and_times(spark, tmp_path):
    target = str(tmp_path / "fact")
    assert P.attempt_events(spark, target).count() == 0
    assert not P.roll_back(spark, target, "a")
    put = lambda n, run, minute: P.publish(frame(spark, n), target, run, ["transaction_date"], at=at(minute))
    assert put(5, "a", 1) == (1, 5) and put(7, "b", 2) == (1, 7) and put(3, "a", 3) == (2, 3)
    assert rows(spark, target) == {("a", 2): 3, ("b", 1): 7}
    assert P.roll_back(spark, target, "a", at=at(4)) and P.roll_back(spark, target, "a", to_attempt=1, at=at(6))
    assert rows(spark, target) == {("a", 1): 5, ("b", 1): 7}
    states = [{}, {("a", 1): 5}, {("a", 1): 5, ("b", 1): 7}, {("a", 2): 3, ("b", 1): 7}, {("b", 1): 7}, {("b", 1): 7},
              {("a", 1): 5, ("b", 1): 7}]
    for minute, want in enumerate(states):
        assert rows(spark, target, at(minute)) == want
    got = P.published_as_of(P.attempt_events(spark, target), [at(m) for m in range(7)]).collect()
    assert sorted((r.as_of.minute, r.run_id, r.attempt, r.n_rows) for r in got) == sorted(
        (m, *k, n) for m, want in enumerate(states) for k, n in want.items())
    with pytest.raises(ValueError):
        P.roll_back(spark, target, "b", to_attempt=9)


def test_a_failed_write_leaves_the_old_rows(spark, tmp_path):
    target = str(tmp_path / "fact")
    P.publish(frame(spark, 5), target, "a", ["transaction_date"], retain=False)
    bad = frame(spark, 50).withColumn("transaction_id", F.when(
        F.col("transaction_id") == "49", F.raise_error(F.lit("lost"))).otherwise(F.col("transaction_id")))
    with pytest.raises(Exception, match="lost"):
        P.publish(bad, target, "a", ["transaction_date"], retain=False)
    assert rows(spark, target) == {("a", 1): 5}
    # the next attempt replaces what the failed one left, and only then goes the first
    assert P.publish(frame(spark, 2, "2024-01-02"), target, "a", ["transaction_date"], retain=False) == (2, 2)
    assert rows(spark, target) == {("a", 2): 2}
    assert spark.read.parquet(target).count() == 2


def test_events_of_one_moment(spark):
    moment = at(5)
    events = spark.createDataFrame([("a", 1, "publish", moment, 4), ("a", 1, "rollback", moment, 0),
                                    ("b", 1, "publish", moment, 4), ("b", 2, "publish", moment, 9)], P.EVENT_SCHEMA)
    assert [(r.run_id, r.attempt) for r in P.effective_attempts(events).collect()] == [("b", 2)]
    assert [(r.run_id, r.attempt) for r in P.published_as_of(events, [moment]).collect()] == [("b", 2)]
    assert P.published_as_of(events.limit(0), [moment]).count() == 0
