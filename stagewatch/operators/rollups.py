"""A5-A8 for any moment: hourly roll-ups of the history, looked back on through prefix sums.

A roll-up row holds one failure type's counts and exact duration sums of one
hour.  Roll-ups of several loads are merged by adding, so each load appends its
own.  The look-back of a moment is the difference of two prefix sums over whole
hours plus the records of its two edge hours, whichever and however many
moments are asked for: the history is read for those hours only.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import FAILED_OUTCOMES, LOOKBACK_HOURS
from .history import DURATION_TYPE

ALL = "all"
SUMS = ["total_runs", "failed_count", "resolved_count", "timed_count", "timed_seconds"]
#: Sums of decimals would grow wider with every addition.
SECONDS = "decimal(38,9)"


def _measures() -> list[Column]:
    seconds = F.when((F.col("outcome") == "RESOLVED") & F.col("duration_seconds").isNotNull()
                     & (F.col("duration_seconds") != 0), F.col("duration_seconds").cast(DURATION_TYPE))
    return [F.count(F.lit(1)).alias("total_runs"), F.count_if(F.col("outcome").isin(*FAILED_OUTCOMES)).alias("failed_count"),
            F.count_if(F.col("outcome") == "RESOLVED").alias("resolved_count"), F.count(seconds).alias("timed_count"),
            F.coalesce(F.sum(seconds), F.lit(0)).cast(SECONDS).alias("timed_seconds")]


def hourly_rollup(history: DataFrame) -> DataFrame:
    """``failure_type, hour`` and the sums of each: a row per type and hour met (records without a time are left out)."""
    return history.where("ts is not null").groupBy("failure_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias(
        "hour")).agg(*_measures())


def merge_rollups(rollups: DataFrame) -> DataFrame:
    """One row per type and hour from the appended roll-ups of many loads."""
    return rollups.groupBy("failure_type", "hour").agg(*[_added(c) for c in SUMS])


def _added(name: str) -> Column:
    total = F.coalesce(F.sum(name), F.lit(0))
    return (total.cast(SECONDS) if name == "timed_seconds" else total.cast("bigint")).alias(name)


def _moments(spark: SparkSession, moments: list, hours: int) -> DataFrame:
    """``as_of, low, from_hour, to_hour``: the look-back and the whole hours inside it."""
    rows = [(m if isinstance(m, dt.datetime) else dt.datetime.fromisoformat(str(m)),) for m in moments]
    asked = spark.createDataFrame(rows, "as_of timestamp_ntz").distinct()
    low = F.col("as_of") - F.make_dt_interval(hours=F.lit(hours))
    begin = F.date_trunc("hour", "low").cast("timestamp_ntz")
    return asked.withColumn("low", low).select(
        "as_of", "low", F.when(begin == F.col("low"), begin).otherwise(begin + F.make_dt_interval(hours=F.lit(1))).alias(
            "from_hour"), F.date_trunc("hour", "as_of").cast("timestamp_ntz").alias("to_hour"))


def _with_all(rows: DataFrame) -> DataFrame:
    """Each row under its type and under ``all``; rows without a type only under ``all``."""
    return rows.withColumn("filter", F.explode(F.array_compact(F.array(F.lit(ALL), F.col("failure_type")))))


def trend_at(rollups: DataFrame, history: DataFrame, moments: list, hours: int = LOOKBACK_HOURS) -> DataFrame:
    """A5 at every one of ``moments`` at once, as a store queried at that moment would give it.

    ``as_of, failure_type_filter, window_hours, total_runs, failed_count,
    resolved_count, mttr_seconds`` over the records from ``hours`` before the
    moment up to it.  ``moments`` is a list that the caller holds; what is
    broadcast is a row or two per moment.
    """
    spark = rollups.sparkSession
    asked = _moments(spark, moments, hours)
    hourly = _with_all(merge_rollups(rollups)).groupBy("filter", "hour").agg(*[_added(c) for c in SUMS])
    # each type's hours and the asked hour borders in one order; a border's prefix is all before it
    marks = [F.struct(F.lit(r.as_of).alias("as_of"), F.lit(h).alias("hour"), F.lit(sign).alias("sign"))
             for r in asked.collect() for h, sign in ((r.from_hour, -1), (r.to_hour, 1))]     # the caller's list
    borders = hourly.select("filter").distinct().select("filter", F.explode(F.array(*marks)).alias("b"))
    line = hourly.unionByName(borders.select("filter", "b.as_of", "b.hour", "b.sign"), allowMissingColumns=True)
    # a border stands before the hour that begins with it
    before = Window.partitionBy("filter").orderBy("hour", F.col("sign").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    whole = line.select("filter", "as_of", "sign", *[
        F.coalesce(F.sum(c).over(before), F.lit(0)).cast(SECONDS).alias(c) for c in SUMS]).where("sign is not null")
    inner = whole.groupBy("as_of", "filter").agg(*[
        _added_signed(c) for c in SUMS])
    # the records of the edge hours
    edges = asked.select("as_of", F.explode(F.array(
        F.struct(F.col("low").alias("a"), F.col("from_hour").alias("b"), F.lit(False).alias("closed")),
        F.struct(F.col("to_hour").alias("a"), F.col("as_of").alias("b"), F.lit(True).alias("closed")))).alias("e")).select(
        "as_of", "e.*").withColumn("edge_hour", F.date_trunc("hour", "a").cast("timestamp_ntz"))
    inside = (F.col("ts") >= F.col("a")) & ((F.col("ts") < F.col("b")) | (F.col("closed") & (F.col("ts") == F.col("b"))))
    near = history.where("ts is not null").select("failure_type", "outcome", "duration_seconds", "ts").join(
        F.broadcast(edges), (F.date_trunc("hour", "ts").cast("timestamp_ntz") == F.col("edge_hour")) & inside)
    outer = _with_all(near).groupBy("as_of", "filter").agg(*_measures())
    total = inner.unionByName(outer.select("as_of", "filter", *[F.col(c).cast(SECONDS).alias(c) for c in SUMS])).groupBy(
        "as_of", "filter").agg(*[F.sum(c).cast(SECONDS).alias(c) for c in SUMS])
    return total.where("total_runs > 0").select(
        "as_of", F.col("filter").alias("failure_type_filter"), F.lit(hours).cast("bigint").alias("window_hours"),
        *[F.col(c).cast("bigint").alias(c) for c in SUMS[:3]],
        F.try_divide(F.col("timed_seconds").cast("double"), F.col("timed_count").cast("double")).alias("mttr_seconds"))


def _added_signed(name: str) -> Column:
    return F.sum(F.col(name) * F.col("sign")).cast(SECONDS).alias(name)
