"""Registered run-history queries."""

from __future__ import annotations

from ..functions.constants import LOOKBACK_HOURS
from ..operators import history as H
from ..operators import report as K
from ..operators import rollups as U
from ..sources import views as V
from .catalog import register
from .oracle_views import with_views

AS_OF = V.AS_OF
CUTOFF = f"TIMESTAMP '{AS_OF}' - INTERVAL {LOOKBACK_HOURS} HOUR"
_DUR_OK = "outcome = 'RESOLVED' AND duration_seconds IS NOT NULL AND duration_seconds <> 0"
_MTTR = (f"cast(sum(CASE WHEN {_DUR_OK} THEN cast(duration_seconds AS decimal(38,9)) END) AS double) "
         f"/ count(CASE WHEN {_DUR_OK} THEN 1 END)")


@register("failure_trend", with_views(f"""
SELECT CASE WHEN grouping(failure_type) = 1 THEN 'all' ELSE failure_type END AS failure_type_filter,
       cast({LOOKBACK_HOURS} AS bigint) AS window_hours, count(*) AS total_runs,
       cast(sum(CASE WHEN outcome IN ('FAILED', 'UNRESOLVED') THEN 1 ELSE 0 END) AS bigint) AS failed_count,
       cast(sum(CASE WHEN outcome = 'RESOLVED' THEN 1 ELSE 0 END) AS bigint) AS resolved_count,
       {_MTTR} AS mttr_seconds
FROM run_history WHERE ts >= {CUTOFF}
GROUP BY ROLLUP (failure_type)
HAVING grouping(failure_type) = 1 OR failure_type IS NOT NULL""", "run_history"))
def failure_trend(spark, d):
    """A5: 24 h trend overall and per failure type, one rollup."""
    return H.failure_trend(V.run_history(spark, d), AS_OF)


@register("mttr_by_type", with_views(f"""
SELECT coalesce(nullif(failure_type, ''), 'none') AS failure_type,
       cast(sum(CASE WHEN outcome = 'RESOLVED' THEN 1 ELSE 0 END) AS bigint) AS resolved_count,
       cast(sum(CASE WHEN {_DUR_OK} THEN 1 ELSE 0 END) AS bigint) AS timed_count,
       {_MTTR} AS mttr_seconds
FROM run_history GROUP BY 1""", "run_history"))
def mttr_by_type(spark, d):
    """Mean time to resolution per failure type over the whole history."""
    return H.mttr_by_type(V.run_history(spark, d))


@register("recurrence", with_views(f"""
SELECT coalesce(nullif(failure_type, ''), 'none') AS failure_type, count(*) AS occurrences
FROM run_history WHERE ts >= {CUTOFF} GROUP BY 1""", "run_history"))
def recurrence(spark, d):
    """Occurrences per failure type in the last 24 h, most frequent first."""
    return H.recurrence(V.run_history(spark, d), AS_OF)


@register("baseline_metrics", with_views("""
SELECT scenario_name, count(*) AS sample_size,
       cast(sum(total_rows) AS double) / count(*) AS avg_total_rows,
       coalesce(cast(sum(total_nulls) AS double) / nullif(cast(sum(total_rows) AS double), 0), 0.0) AS avg_null_rate,
       coalesce(cast(sum(duplicate_count) AS double) / nullif(cast(sum(total_rows) AS double), 0), 0.0) AS avg_duplicate_rate
FROM run_history GROUP BY scenario_name""", "run_history"))
def baseline_metrics(spark, d):
    """Per-scenario baseline null and duplicate rates (sum / sum)."""
    return H.baseline_metrics(V.run_history(spark, d))


def _places(rate: str) -> str:
    return f"cast(round(cast({rate} AS decimal(28,10)), 4) AS double)"


@register("baseline_deviation", with_views(f"""
WITH base AS (
  SELECT scenario_name, count(*) AS sample_size,
         coalesce(cast(sum(total_nulls) AS double) / nullif(cast(sum(total_rows) AS double), 0), 0.0) AS bn,
         coalesce(cast(sum(duplicate_count) AS double) / nullif(cast(sum(total_rows) AS double), 0), 0.0) AS bd
  FROM run_history WHERE ts < {CUTOFF} GROUP BY scenario_name),
cur AS (
  SELECT run_id, scenario_name,
         cast(total_nulls AS double) / cast(coalesce(nullif(total_rows, 0), 1) AS double) AS cn,
         cast(duplicate_count AS double) / cast(coalesce(nullif(total_rows, 0), 1) AS double) AS cd
  FROM run_history WHERE ts >= {CUTOFF})
SELECT c.run_id, c.scenario_name, coalesce(b.sample_size, 0) > 0 AS baseline_available,
       coalesce(b.sample_size, 0) AS sample_size,
       {_places("c.cn")} AS current_null_rate, {_places("b.bn")} AS baseline_null_rate,
       {_places("c.cn - b.bn")} AS null_rate_delta,
       {_places("c.cd")} AS current_duplicate_rate, {_places("b.bd")} AS baseline_duplicate_rate,
       {_places("c.cd - b.bd")} AS duplicate_rate_delta,
       coalesce(abs(c.cn - b.bn) > 0.05 OR abs(c.cd - b.bd) > 0.05, false) AS anomaly_detected
FROM cur c LEFT JOIN base b ON c.scenario_name = b.scenario_name""", "run_history"))
def baseline_deviation(spark, d):
    """Last-24h runs against their scenario's earlier baseline."""
    return H.baseline_deviation(V.run_history(spark, d), AS_OF)


@register("own_baseline_deviation", with_views(f"""
WITH prior AS (
  SELECT run_id, scenario_name,
         cast(total_nulls AS double) / cast(coalesce(nullif(total_rows, 0), 1) AS double) AS cn,
         cast(duplicate_count AS double) / cast(coalesce(nullif(total_rows, 0), 1) AS double) AS cd,
         count(*) OVER earlier AS sample_size, sum(total_rows) OVER earlier AS r,
         sum(total_nulls) OVER earlier AS n, sum(duplicate_count) OVER earlier AS d
  FROM run_history
  WINDOW earlier AS (PARTITION BY scenario_name ORDER BY epoch_us(ts)
                     RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rates AS (
  SELECT *, CASE WHEN sample_size > 0 THEN coalesce(cast(n AS double) / nullif(cast(r AS double), 0), 0.0) END AS bn,
         CASE WHEN sample_size > 0 THEN coalesce(cast(d AS double) / nullif(cast(r AS double), 0), 0.0) END AS bd
  FROM prior)
SELECT run_id, scenario_name, sample_size > 0 AS baseline_available, cast(sample_size AS bigint) AS sample_size,
       {_places("cn")} AS current_null_rate, {_places("bn")} AS baseline_null_rate,
       {_places("cn - bn")} AS null_rate_delta,
       {_places("cd")} AS current_duplicate_rate, {_places("bd")} AS baseline_duplicate_rate,
       {_places("cd - bd")} AS duplicate_rate_delta,
       coalesce(abs(cn - bn) > 0.05 OR abs(cd - bd) > 0.05, false) AS anomaly_detected
FROM rates""", "run_history"))
def own_baseline_deviation(spark, d):
    """Every run against its scenario's records before it."""
    return H.own_baseline_deviation(V.run_history(spark, d))


_KNOWN_SQL = f"""known AS (
  SELECT run_id, scenario_name, failure_type,
         coalesce(sum(CASE WHEN outcome IN ('FAILED', 'UNRESOLVED', 'RESOLVED') THEN 1 ELSE 0 END) OVER (
           PARTITION BY scenario_name, failure_type ORDER BY epoch_us(ts)
           RANGE BETWEEN {LOOKBACK_HOURS * 3600 * 1_000_000} PRECEDING AND 1 PRECEDING), 0) AS recent_occurrences
  FROM run_history)"""


@register("known_failures", with_views(f"""
WITH {_KNOWN_SQL}
SELECT run_id, scenario_name, failure_type, cast(recent_occurrences AS bigint) AS recent_occurrences,
       recent_occurrences >= 2 AS is_known_recurring, cast({LOOKBACK_HOURS} AS bigint) AS window_hours
FROM known""", "run_history"))
def known_failures(spark, d):
    """Recurrence of each run's scenario+failure type in the 24 h before it."""
    return H.known_failures(V.run_history(spark, d))


@register("recent_runs", with_views(f"""
SELECT run_id, scenario_name, failure_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, outcome,
       duration_seconds, total_rows, total_nulls, duplicate_count, recency_rank
FROM (SELECT *, row_number() OVER (PARTITION BY scenario_name ORDER BY ts DESC NULLS LAST, run_id DESC) AS recency_rank
      FROM run_history) t WHERE recency_rank <= 10""", "run_history"))
def recent_runs(spark, d):
    """The ten latest runs of every scenario."""
    return H.recent_runs(V.run_history(spark, d), 10)


@register("latest_runs", with_views("""
SELECT run_id, scenario_name, failure_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, outcome,
       duration_seconds, total_rows, total_nulls, duplicate_count
FROM run_history ORDER BY run_history.ts DESC NULLS LAST, run_id DESC LIMIT 10""", "run_history"))
def latest_runs(spark, d):
    """The ten latest runs over all scenarios (the default call)."""
    return H.latest_runs(V.run_history(spark, d), 10)


@register("triage_route", with_views(f"""
WITH {_KNOWN_SQL}
SELECT h.run_id, h.scenario_name, h.outcome, cast(k.recent_occurrences AS bigint) AS recent_occurrences,
       CASE WHEN k.recent_occurrences >= 2 THEN 'repair'
            WHEN h.outcome IN ('FAILED', 'UNRESOLVED') OR h.total_nulls > 0 OR h.duplicate_count > 0 THEN 'diagnose'
            ELSE 'report' END AS route
FROM run_history h JOIN known k ON h.run_id = k.run_id""", "run_history"))
def triage_route(spark, d):
    """K7/K8: repair known recurring failures, diagnose other issues, report the rest."""
    return K.triage_route(V.run_history(spark, d))


@register("history_summary", with_views(f"""
SELECT scenario_name, count(*) AS total_runs,
       cast(sum(CASE WHEN ts >= {CUTOFF} THEN 1 ELSE 0 END) AS bigint) AS runs_in_window,
       cast(sum(CASE WHEN ts >= {CUTOFF} AND outcome IN ('FAILED', 'UNRESOLVED') THEN 1 ELSE 0 END) AS bigint) AS failed_in_window,
       cast(sum(CASE WHEN ts >= {CUTOFF} AND outcome = 'RESOLVED' THEN 1 ELSE 0 END) AS bigint) AS resolved_in_window,
       cast(sum(CASE WHEN ts >= {CUTOFF} AND {_DUR_OK} THEN cast(duration_seconds AS decimal(38,9)) END) AS double)
         / count(CASE WHEN ts >= {CUTOFF} AND {_DUR_OK} THEN 1 END) AS mttr_in_window,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_run_ts,
       arg_max(outcome, (ts, run_id)) AS last_outcome, arg_max(run_id, (ts, run_id)) AS last_run_id
FROM run_history WHERE ts IS NOT NULL GROUP BY scenario_name""", "run_history"))
def history_summary(spark, d):
    """Per-scenario history view (window counts, MTTR, latest run)."""
    return H.history_summary(V.run_history(spark, d), AS_OF)


@register("history_filter", with_views(f"""
SELECT run_id, scenario_name, failure_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, outcome,
       duration_seconds, total_rows, total_nulls, duplicate_count
FROM run_history
WHERE scenario_name = 'data_quality_nulls' AND failure_type IS NOT DISTINCT FROM NULL
  AND outcome IN ('HEALTHY', 'FAILED')""", "run_history"))
def history_filter(spark, d):
    """one scenario's runs without a failure type (null-safe), by outcome."""
    return H.filter_history(V.run_history(spark, d), scenario="data_quality_nulls", failure_type=None,
                            outcomes=["HEALTHY", "FAILED"])


MOMENTS = ["2024-01-02 00:00:00", "2024-01-05 13:27:45.5", "2024-01-09 23:59:59", "2024-01-10 00:00:00", "2024-01-17 06:30:00",
           "2024-01-24 18:00:00.000001", "2024-01-30 11:11:11", "2024-01-31 00:00:00", "2024-02-15 00:00:00"]


@register("trend_at_moments", with_views(f"""
SELECT strftime(as_of, '%Y-%m-%d %H:%M:%S.%f') AS as_of,
       CASE WHEN grouping(failure_type) = 1 THEN 'all' ELSE failure_type END AS failure_type_filter,
       cast({LOOKBACK_HOURS} AS bigint) AS window_hours, count(*) AS total_runs,
       cast(sum(CASE WHEN outcome IN ('FAILED', 'UNRESOLVED') THEN 1 ELSE 0 END) AS bigint) AS failed_count,
       cast(sum(CASE WHEN outcome = 'RESOLVED' THEN 1 ELSE 0 END) AS bigint) AS resolved_count, {_MTTR} AS mttr_seconds
FROM run_history JOIN (SELECT unnest([{", ".join(f"TIMESTAMP '{m}'" for m in MOMENTS)}]) AS as_of) m
  ON ts >= as_of - INTERVAL {LOOKBACK_HOURS} HOUR AND ts <= as_of
GROUP BY GROUPING SETS ((as_of), (as_of, failure_type))
HAVING grouping(failure_type) = 1 OR failure_type IS NOT NULL""", "run_history"))
def trend_at_moments(spark, d):
    """A5 at many moments from hourly roll-ups: prefix sums over whole hours, records for the edge hours only."""
    history = V.run_history(spark, d)
    return U.trend_at(U.hourly_rollup(history), history, MOMENTS)
