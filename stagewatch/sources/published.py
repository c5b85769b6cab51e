"""Publishing without a gap (S6, B3), re-runs and roll-backs by attempt (B5, B6), published state as of any time.

A publication writes its rows into a folder of its own, ``run_id=…/attempt=…``,
and then appends one event to a small table beside them.  What is published is
decided by the events alone: readers join the rows to the active attempts.  So
a write that fails leaves the rows of the attempt before it readable, a
roll-back is one event, and every earlier state can be asked for as long as its
attempts are retained.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .files import delete_path, write_partitioned

EVENT_SCHEMA = "run_id string, attempt int, action string, at timestamp_ntz, n_rows bigint"
PUBLISH, ROLL_BACK = "publish", "rollback"
#: Beside the rows; Spark's readers of the rows pass over names that begin so.
EVENTS = "_attempts"


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def attempt_events(spark: SparkSession, target: str) -> DataFrame:
    """The events of all runs (``EVENT_SCHEMA``); none where nothing was ever published."""
    try:
        return spark.read.schema(EVENT_SCHEMA).parquet(f"{target.rstrip('/')}/{EVENTS}")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], EVENT_SCHEMA)


def _append(spark: SparkSession, target: str, run_id: str, attempt: int, action: str, at: dt.datetime, n_rows: int) -> None:
    spark.createDataFrame([(run_id, attempt, action, at, n_rows)], EVENT_SCHEMA).coalesce(1).write.mode(
        "append").parquet(f"{target.rstrip('/')}/{EVENTS}")


def _folder(target: str, run_id: str, attempt: int) -> str:
    return f"{target.rstrip('/')}/run_id={run_id}/attempt={attempt}"


def _order() -> Column:
    """Events of one moment: by attempt, a roll-back after its publication."""
    return F.struct("at", "attempt", "action")


def effective_attempts(events: DataFrame, as_of=None) -> DataFrame:
    """``run_id, attempt, n_rows, at`` of the attempt of each run that is published, now or at the moment ``as_of``.

    One aggregate over the events; a run that was rolled back last has none.
    """
    if as_of is not None:
        events = events.where(F.col("at") <= F.lit(as_of).cast("timestamp_ntz"))
    last = F.max_by(F.struct("attempt", "action", "n_rows", "at"), _order()).alias("last")
    return events.groupBy("run_id").agg(last).where(F.col("last.action") == PUBLISH).select(
        "run_id", "last.attempt", "last.n_rows", "last.at")


def attempt_intervals(events: DataFrame) -> DataFrame:
    """``run_id, attempt, n_rows, valid_from, valid_to``: when each attempt was what its run had published.

    ``valid_to`` is the run's next event (null: still published).  A run has
    few events, so its window is small; runs are spread.
    """
    after = F.lead("at").over(Window.partitionBy("run_id").orderBy("at", "attempt", "action"))
    return events.withColumn("valid_to", after).where(
        (F.col("action") == PUBLISH) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("at")))).select(
        "run_id", "attempt", "n_rows", F.col("at").alias("valid_from"), "valid_to")


def published_as_of(events: DataFrame, moments: list) -> DataFrame:
    """``as_of, run_id, attempt, n_rows`` of every run at each of a list of moments: one pass over the events."""
    asked = F.array(*[F.lit(m).cast("timestamp_ntz") for m in moments])
    inside = F.filter(asked, lambda m: (m >= F.col("valid_from")) & (F.col("valid_to").isNull() | (m < F.col("valid_to"))))
    return attempt_intervals(events).select(F.explode(inside).alias("as_of"), "run_id", "attempt", "n_rows")


def publish(df: DataFrame, target: str, run_id: str, partition_by: list[str], cluster_by: list[str] | None = None,
            retain: bool = True, at: dt.datetime | None = None) -> tuple[int, int]:
    """Publish ``df`` as the next attempt of ``run_id``: (its number, the rows written).

    The attempt counts when its event is written, after all of its rows.  A
    folder that an unfinished write left behind is replaced.  Without
    ``retain`` the attempts before it are deleted after that, never before.
    """
    spark = df.sparkSession
    own = attempt_events(spark, target).where(F.col("run_id") == run_id)
    before = [r.attempt for r in own.select("attempt").distinct().collect()]         # a run's attempts
    attempt = max(before, default=0) + 1
    counted = Observation(f"publish_{run_id}_{attempt}")
    write_partitioned(df, _folder(target, run_id, attempt), partition_by, cluster_by, observation=counted, replace_all=True)
    n_rows = int(counted.get["rows"])
    _append(spark, target, run_id, attempt, PUBLISH, at or _now(), n_rows)
    if not retain:
        for old in before:
            delete_path(spark, _folder(target, run_id, old))
    return attempt, n_rows


def roll_back(spark: SparkSession, target: str, run_id: str, to_attempt: int | None = None, retain: bool = True,
              at: dt.datetime | None = None) -> bool:
    """Take back what ``run_id`` has published, or return to an earlier attempt of it; False if nothing is published.

    Without ``retain`` the rows are deleted after the event is written.
    """
    events = attempt_events(spark, target).where(F.col("run_id") == run_id)
    current = effective_attempts(events).first()
    if current is None and to_attempt is None:
        return False
    if to_attempt is None:
        _append(spark, target, run_id, current.attempt, ROLL_BACK, at or _now(), 0)
        if not retain:
            for r in events.select("attempt").distinct().collect():                  # a run's attempts
                delete_path(spark, _folder(target, run_id, r.attempt))
        return True
    known = events.where((F.col("attempt") == to_attempt) & (F.col("action") == PUBLISH)).first()
    if known is None:
        raise ValueError(f"run {run_id} has no attempt {to_attempt}")
    if not retain:
        raise ValueError("only retained attempts can be returned to")
    _append(spark, target, run_id, to_attempt, PUBLISH, at or _now(), known.n_rows)
    return True


def read_published(spark: SparkSession, target: str, as_of=None) -> DataFrame:
    """The published rows of all runs, now or as of a moment, with ``run_id`` and ``attempt``.

    A semi-join on the partition columns: folders of other attempts are pruned.
    """
    active = effective_attempts(attempt_events(spark, target), as_of).select(
        F.col("run_id").alias("active_run"), F.col("attempt").alias("active_attempt"))
    rows = spark.read.option("basePath", target).parquet(target)
    return rows.join(active, (F.col("run_id").cast("string") == F.col("active_run"))
                     & (F.col("attempt") == F.col("active_attempt")), "left_semi")
