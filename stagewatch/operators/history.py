"""Run-history analytics: trend, MTTR, recurrence, baselines, known failures,
recent runs (A5-A9, F4, F5, J5, J6, W5, P10, P11).

``as_of`` is always a parameter (the reference moment), so results are
reproducible; look-back windows are ``ts >= as_of - hours`` with no upper
bound, like a store queried "now".
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import (ANOMALY_THRESHOLD, FAILED_OUTCOMES, KNOWN_FAILURE_MIN,
                                   KNOWN_FAILURE_OUTCOMES, LOOKBACK_HOURS)
from ..functions.exprs import safe_ratio
from .prefix import prior_counts, prior_sums

DURATION_TYPE = "decimal(38,9)"   # exact, order-independent sums of durations


def _ts(as_of) -> Column:
    """A TIMESTAMP_NTZ literal parsed from text (independent of any time zone)."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, _dt.datetime):
        as_of = as_of.isoformat(sep=" ")
    return F.lit(str(as_of)).cast("timestamp_ntz")


def within(history: DataFrame, as_of, hours: int | None = LOOKBACK_HOURS, ts_col: str = "ts") -> DataFrame:
    """records at or after ``as_of - hours`` (missing timestamps excluded)."""
    if hours is None:
        return history.where(F.col(ts_col).isNotNull())
    cutoff = _ts(as_of) - F.make_dt_interval(hours=F.lit(hours))
    out = history.where(F.col(ts_col) >= cutoff)
    if "run_date" in history.columns:
        # the history store is partitioned by run_date: prune whole date folders
        out = out.where(F.col("run_date") >= F.to_date(cutoff))
    return out


def failure_label(c: Column) -> Column:
    """``failure_type or 'none'``."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("none"))


def mttr(outcome: Column, duration: Column) -> Column:
    """Mean duration of RESOLVED runs, ignoring null and zero durations."""
    d = F.when((outcome == "RESOLVED") & duration.isNotNull() & (duration != 0),
               duration.cast(DURATION_TYPE))
    return F.try_divide(F.sum(d).cast("double"), F.count(d).cast("double"))


def failure_trend(history: DataFrame, as_of, hours: int = LOOKBACK_HOURS) -> DataFrame:
    """A5: per failure-type filter and overall ('all'): totals, failed,
    resolved and MTTR inside the look-back — one rollup aggregate."""
    h = within(history, as_of, hours)
    g = h.rollup("failure_type").agg(
        F.grouping("failure_type").alias("_all"),
        F.count(F.lit(1)).alias("total_runs"),
        F.sum(F.when(F.col("outcome").isin(*FAILED_OUTCOMES), 1).otherwise(0)).cast("bigint").alias("failed_count"),
        F.sum(F.when(F.col("outcome") == "RESOLVED", 1).otherwise(0)).cast("bigint").alias("resolved_count"),
        mttr(F.col("outcome"), F.col("duration_seconds")).alias("mttr_seconds"))
    # a null failure type is only part of 'all' (a filter of None means no filter)
    g = g.where((F.col("_all") == 1) | F.col("failure_type").isNotNull())
    return g.select(F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col("failure_type"))
                    .alias("failure_type_filter"),
                    F.lit(hours).cast("bigint").alias("window_hours"),
                    "total_runs", "failed_count", "resolved_count", "mttr_seconds")


def mttr_by_type(history: DataFrame, as_of=None, hours: int | None = None) -> DataFrame:
    """MTTR and resolved-run count per failure label."""
    h = history if as_of is None else within(history, as_of, hours)
    dur_ok = (F.col("outcome") == "RESOLVED") & F.col("duration_seconds").isNotNull() & (F.col("duration_seconds") != 0)
    return h.groupBy(failure_label(F.col("failure_type")).alias("failure_type")).agg(
        F.sum(F.when(F.col("outcome") == "RESOLVED", 1).otherwise(0)).cast("bigint").alias("resolved_count"),
        F.sum(F.when(dur_ok, 1).otherwise(0)).cast("bigint").alias("timed_count"),
        mttr(F.col("outcome"), F.col("duration_seconds")).alias("mttr_seconds"))


def recurrence(history: DataFrame, as_of, hours: int = LOOKBACK_HOURS) -> DataFrame:
    """Runs per failure label in the look-back, most frequent first."""
    return (within(history, as_of, hours)
            .groupBy(failure_label(F.col("failure_type")).alias("failure_type"))
            .agg(F.count(F.lit(1)).alias("occurrences"))
            .orderBy(F.desc("occurrences"), "failure_type"))


def baseline_metrics(history: DataFrame, before=None) -> DataFrame:
    """Per scenario, sample size, mean rows and the ratio-of-averages
    null and duplicate rates (sum/sum), 0 when rows sum to 0.

    ``before`` restricts the baseline to records strictly earlier.
    """
    h = history.where(F.col("total_rows").isNotNull() | F.col("total_nulls").isNotNull()
                      | F.col("duplicate_count").isNotNull())
    if before is not None:
        h = h.where(F.col("ts") < _ts(before))
    rows, nulls, dups = (F.coalesce(F.col(c), F.lit(0)) for c in ("total_rows", "total_nulls", "duplicate_count"))
    agg = h.groupBy("scenario_name").agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.sum(rows).cast("bigint").alias("_r"), F.sum(nulls).cast("bigint").alias("_n"),
        F.sum(dups).cast("bigint").alias("_d"))
    return agg.select("scenario_name", "sample_size",
                      (F.col("_r").cast("double") / F.col("sample_size").cast("double")).alias("avg_total_rows"),
                      safe_ratio(F.col("_n"), F.col("_r")).alias("avg_null_rate"),
                      safe_ratio(F.col("_d"), F.col("_r")).alias("avg_duplicate_rate"))


def _places(rate: Column) -> Column:
    """A rate to four places, rounded as a decimal."""
    return F.round(rate.cast("decimal(28,10)"), 4).cast("double")


def baseline_deviation(history: DataFrame, as_of, hours: int = LOOKBACK_HOURS) -> DataFrame:
    """Each run of the current period (the look-back before ``as_of``)
    against its scenario's baseline from all earlier records.

    The baseline is one aggregate per scenario (map-side combined); the
    join back has one baseline row per scenario.  Anomaly: either absolute
    delta strictly above the threshold, tested on unrounded rates; the rates
    are then shown to four places (P12).
    """
    period_start = _ts(as_of) - F.make_dt_interval(hours=F.lit(hours))
    current = history.where(F.col("ts") >= period_start)
    base = baseline_metrics(history.where(F.col("ts") < period_start))
    j = current.join(base, "scenario_name", "left")
    return _deviation(j, F.col("avg_null_rate"), F.col("avg_duplicate_rate"))


def own_baseline_deviation(history: DataFrame) -> DataFrame:
    """J5 for every run of the history at once: each against all records of its
    scenario that are strictly earlier than the run itself.

    Sums before each run come from ``prefix.prior_sums``: no window spans a
    scenario's runs, so a scenario may hold any share of them.  Runs without a
    time have no baseline and are in none; null scenarios are one of their own.
    """
    metrics = ["total_rows", "total_nulls", "duplicate_count"]
    measured = F.coalesce(*[F.col(c) for c in metrics]).isNotNull()
    sums = {"sample_size": measured.cast("bigint"),
            **{f"prior_{c}": F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in metrics}}
    j = prior_sums(history, "run_id", ["scenario_name"], "ts", sums, ["scenario_name", *metrics])
    rows = F.col("prior_total_rows")
    return _deviation(j, safe_ratio(F.col("prior_total_nulls"), rows), safe_ratio(F.col("prior_duplicate_count"), rows))


def _deviation(j: DataFrame, null_rate: Column, duplicate_rate: Column) -> DataFrame:
    """Runs beside their baseline (``sample_size`` and its rates): rates, deltas and the anomaly flag."""
    rows = F.coalesce(F.nullif(F.col("total_rows"), F.lit(0)), F.lit(1)).cast("double")
    cn = F.coalesce(F.col("total_nulls"), F.lit(0)).cast("double") / rows
    cd = F.coalesce(F.col("duplicate_count"), F.lit(0)).cast("double") / rows
    avail = F.coalesce(F.col("sample_size"), F.lit(0)) > 0
    nd, dd = cn - null_rate, cd - duplicate_rate
    return j.select(
        "run_id", "scenario_name", avail.alias("baseline_available"),
        F.coalesce(F.col("sample_size"), F.lit(0)).alias("sample_size"),
        _places(cn).alias("current_null_rate"),
        _places(F.when(avail, null_rate)).alias("baseline_null_rate"),
        _places(F.when(avail, nd)).alias("null_rate_delta"),
        _places(cd).alias("current_duplicate_rate"),
        _places(F.when(avail, duplicate_rate)).alias("baseline_duplicate_rate"),
        _places(F.when(avail, dd)).alias("duplicate_rate_delta"),
        F.when(avail, (F.abs(nd) > ANOMALY_THRESHOLD) | (F.abs(dd) > ANOMALY_THRESHOLD))
        .otherwise(F.lit(False)).alias("anomaly_detected"))


def known_failures(history: DataFrame, hours: int = LOOKBACK_HOURS,
                   min_occurrences: int = KNOWN_FAILURE_MIN, carry: list[str] | None = None) -> DataFrame:
    """For every run, earlier runs of the same scenario and (null-safe)
    failure type with a failure-like outcome within ``hours`` before it.

    Uses the skew-safe prefix count (no per-key task, no pairs).  ``carry``
    names further columns of the history to keep.
    """
    match = F.col("outcome").isin(*KNOWN_FAILURE_OUTCOMES)
    kept = ["scenario_name", "failure_type"] + list(carry or [])
    counted = prior_counts(history, "run_id", ["scenario_name", "failure_type"], "ts", match,
                           lookback_us=hours * 3600 * 1_000_000, carry=kept)
    return counted.select(
        "run_id", *kept,
        F.coalesce(F.col("prior_count"), F.lit(0)).alias("recent_occurrences"),
        (F.coalesce(F.col("prior_count"), F.lit(0)) >= min_occurrences).alias("is_known_recurring"),
        F.lit(hours).cast("bigint").alias("window_hours"))


def latest_runs(history: DataFrame, limit: int = 10, scenario: str | None = None) -> DataFrame:
    """The last ``limit`` runs over all scenarios, or of one (newest
    first, ties by id): a bounded top-n, no window."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    h = history if scenario is None else history.where(F.col("scenario_name") == scenario)
    return h.orderBy(F.col("ts").desc_nulls_last(), F.col("run_id").desc()).limit(limit)


def recent_runs(history: DataFrame, limit: int = 10, scenario: str | None = None) -> DataFrame:
    """The last ``limit`` runs per scenario (newest first, ties by id).

    ``row_number() <= limit`` is planned with a partial WindowGroupLimit, so
    each map task forwards at most ``limit`` rows per scenario.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    h = history if scenario is None else history.where(F.col("scenario_name") == scenario)
    w = Window.partitionBy("scenario_name").orderBy(F.col("ts").desc_nulls_last(), F.col("run_id").desc())
    return h.withColumn("recency_rank", F.row_number().over(w)).where(F.col("recency_rank") <= limit)


def duration_seconds(start: Column, end: Column) -> Column:
    """P10: seconds between two timestamps; null if either is missing."""
    return F.timestamp_diff("MICROSECOND", start, end).cast("double") / 1e6


_UNSET = object()


def filter_history(history: DataFrame, scenario: str | None = None, failure_type=_UNSET,
                   outcomes: list[str] | None = None, with_quality: bool = False) -> DataFrame:
    """history filters.  ``failure_type`` compares null-safely (passing
    None selects runs without a failure type); ``outcomes`` is a set test;
    ``with_quality`` keeps records that carry quality metrics."""
    h = history
    if scenario:
        h = h.where(F.col("scenario_name") == scenario)
    if failure_type is not _UNSET:
        h = h.where(F.col("failure_type").eqNullSafe(F.lit(failure_type).cast("string")))
    if outcomes is not None:
        h = h.where(F.col("outcome").isin(*outcomes))
    if with_quality:
        h = h.where(F.col("total_rows").isNotNull())
    return h


def history_summary(history: DataFrame, as_of, hours: int = LOOKBACK_HOURS) -> DataFrame:
    """One row per scenario for the history view: runs, failures and
    resolutions in the look-back, MTTR, and the latest run.

    The counts and the latest timestamp are one hash aggregate (fixed-width
    buffers, map-side combine).  The latest run is then picked only among
    the rows at that timestamp (ties by the largest run id), so the
    string-valued arg-max never runs over the whole history.
    """
    h = history.where(F.col("ts").isNotNull())
    cutoff = _ts(as_of) - F.make_dt_interval(hours=F.lit(hours))
    recent = F.col("ts") >= cutoff
    agg = h.groupBy("scenario_name").agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.sum(F.when(recent, 1).otherwise(0)).cast("bigint").alias("runs_in_window"),
        F.sum(F.when(recent & F.col("outcome").isin(*FAILED_OUTCOMES), 1).otherwise(0)).cast("bigint")
        .alias("failed_in_window"),
        F.sum(F.when(recent & (F.col("outcome") == "RESOLVED"), 1).otherwise(0)).cast("bigint")
        .alias("resolved_in_window"),
        mttr(F.when(recent, F.col("outcome")), F.col("duration_seconds")).alias("mttr_in_window"),
        F.max("ts").alias("last_run_ts"))
    at_last = h.join(agg.select("scenario_name", F.col("last_run_ts").alias("ts")), ["scenario_name", "ts"])
    last = at_last.groupBy("scenario_name").agg(
        F.max_by(F.col("outcome"), F.col("run_id")).alias("last_outcome"),
        F.max("run_id").alias("last_run_id"))
    return agg.join(last, "scenario_name")
