"""Registered run-table queries: logs, stages, rules, ledger, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import report as K
from ..operators import runlog as L
from ..operators import stage_graph as G
from ..sources import published as P
from ..sources import views as V
from .catalog import register
from .oracle_views import with_views

TS = "'%Y-%m-%d %H:%M:%S.%f'"


def _t(c, alias=None):
    return f"strftime({c}, {TS}) AS {alias or c.split('.')[-1]}"


LA = """la AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY run_id, stage_name
        ORDER BY attempt DESC) AS rn FROM stage_results) t WHERE rn = 1)"""
ST = """st AS (SELECT f.run_id, CASE WHEN f.ff THEN 'failed' ELSE 'success' END AS overall_status,
               CASE WHEN c.cf THEN 'failed' ELSE 'success' END AS current_status
        FROM (SELECT run_id, bool_or(status = 'failed') AS ff FROM stage_results WHERE attempt = 1 GROUP BY run_id) f
        JOIN (SELECT run_id, bool_or(status = 'failed') AS cf FROM la GROUP BY run_id) c ON f.run_id = c.run_id)"""
ROLL = """roll AS (SELECT run_id,
          coalesce(string_agg(CASE WHEN status = 'failed' THEN stage_name END, ',' ORDER BY stage_ordinal), '') AS failed_stages,
          coalesce(string_agg(CASE WHEN status = 'skipped' THEN stage_name END, ',' ORDER BY stage_ordinal), '') AS skipped_stages,
          coalesce(string_agg(CASE WHEN status = 'remediated' THEN stage_name END, ',' ORDER BY stage_ordinal), '') AS remediated_stages,
          cast(sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS bigint) AS n_failed
        FROM la GROUP BY run_id)"""
LC = """lc AS (SELECT run_id, count(*) AS total_logs,
          cast(sum(CASE WHEN level IN ('error', 'critical') THEN 1 ELSE 0 END) AS bigint) AS error_count,
          cast(sum(CASE WHEN level = 'warning' THEN 1 ELSE 0 END) AS bigint) AS warning_count
        FROM log_entries GROUP BY run_id)"""
LED = """led AS (SELECT run_id, string_agg(action, ' | ' ORDER BY seq, action) AS remediation_applied,
          count(*) AS remediation_count
        FROM (SELECT run_id, action, min(seq) AS seq FROM remediations GROUP BY run_id, action) t GROUP BY run_id)"""
FACTS = """facts AS (SELECT r.*, st.overall_status, st.current_status, roll.failed_stages, roll.skipped_stages,
          roll.remediated_stages,
          lc.total_logs, lc.error_count, led.remediation_applied,
          coalesce(roll.n_failed, 0) AS nf, coalesce(lc.error_count, 0) AS ne,
          coalesce(led.remediation_count, 0) AS nr, coalesce(lc.warning_count, 0) AS nw,
          q.total_rows AS m_total_rows, q.null_count AS m_null_count, q.duplicate_count AS m_duplicate_count,
          q.n_schema_violations, q.n_type_mismatches, q.schema_violations_text
        FROM runs r LEFT JOIN st ON r.run_id = st.run_id LEFT JOIN roll ON r.run_id = roll.run_id
        LEFT JOIN lc ON r.run_id = lc.run_id LEFT JOIN led ON r.run_id = led.run_id
        LEFT JOIN quality_metrics q ON r.run_id = q.run_id)"""
ALL_RUN_VIEWS = ("runs", "stage_results", "log_entries", "remediations", "quality_metrics")


def _facts_sql(body):
    return with_views(f"WITH {LA}, {ST}, {ROLL}, {LC}, {LED}, {FACTS}\n{body}", *ALL_RUN_VIEWS)


def _run_tables(spark, d):
    return (V.runs(spark, d), V.stage_results(spark, d), V.log_entries(spark, d),
            V.remediations(spark, d), V.quality_metrics(spark, d))


# ---------------------------------------------------------------------------
# logs F1-F3, A3, A4, P13
# ---------------------------------------------------------------------------

@register("log_filter", with_views(f"""
SELECT run_id, seq, {_t('ts')}, level, stage, message, details FROM log_entries
WHERE level = 'warning' AND stage = 'load'""", "log_entries"))
def log_filter(spark, d):
    """warnings of the load stage, across all runs."""
    return L.log_filter(V.log_entries(spark, d), level="warning", stage="load")


@register("severity_counts", with_views("""
SELECT run_id, level, count(*) AS n FROM log_entries GROUP BY run_id, level""", "log_entries"))
def severity_counts(spark, d):
    """A3: lines per run and level."""
    return L.severity_counts(V.log_entries(spark, d))


@register("error_counts", with_views(f"WITH {LC} SELECT * FROM lc", "log_entries"))
def error_counts(spark, d):
    """Total, error/critical and warning lines per run."""
    return L.error_counts(V.log_entries(spark, d))


@register("log_details", with_views("""
SELECT run_id, seq, json_extract_string(details, '$.k') AS detail_k FROM log_entries""", "log_entries"))
def log_details(spark, d):
    """A field of each line's JSON details."""
    return L.log_details(V.log_entries(spark, d), "k")


# ---------------------------------------------------------------------------
# stages J4, F6, W6, A13, A12, J7, K1
# ---------------------------------------------------------------------------

@register("stage_gate", with_views("""
WITH p AS (SELECT run_id, max(CASE WHEN stage_name = 'ingestion' THEN status END) AS ingestion_status,
                  max(CASE WHEN stage_name = 'transform' THEN status END) AS transform_status,
                  max(CASE WHEN stage_name = 'load' THEN status END) AS load_status
           FROM stage_results WHERE attempt = 1 GROUP BY run_id)
SELECT run_id, ingestion_status, transform_status, load_status,
       coalesce(ingestion_status, '') <> 'failed' AS transform_allowed,
       NOT (coalesce(transform_status, '') IN ('failed', 'skipped')) AS load_allowed,
       (coalesce(ingestion_status, '') <> 'failed' OR transform_status = 'skipped')
       AND (NOT (coalesce(transform_status, '') IN ('failed', 'skipped')) OR load_status = 'skipped') AS gate_ok
FROM p""", "stage_results"))
def stage_gate(spark, d):
    """The stage dependency gate verified on every run's first pass."""
    return L.stage_gate(V.stage_results(spark, d))


@register("stage_status_rollup", with_views(f"WITH {LA}, {ROLL} SELECT * FROM roll", "stage_results"))
def stage_status_rollup(spark, d):
    """failed / skipped / remediated stages per run (latest attempts)."""
    return L.stage_status_rollup(V.stage_results(spark, d))


@register("latest_attempt", with_views(f"""
WITH {LA}
SELECT run_id, stage_name, cast(stage_ordinal AS bigint) AS stage_ordinal, cast(attempt AS bigint) AS attempt,
       status, rows_in, rows_out, {_t('started_at')}, {_t('finished_at')}, error_message FROM la""", "stage_results"))
def latest_attempt(spark, d):
    """Latest attempt per run and stage of the append-only table."""
    return L.latest_attempt(V.stage_results(spark, d))


@register("stage_metrics", with_views(f"""
WITH {LA}
SELECT la.run_id, la.stage_name, cast(la.attempt AS bigint) AS attempt, la.status, la.rows_in, la.rows_out,
       {_t('la.started_at')}, {_t('la.finished_at')}, la.error_message,
       cast(coalesce(q.total_rows, 0) AS bigint) AS total_rows, cast(coalesce(q.null_count, 0) AS bigint) AS null_count,
       cast(coalesce(q.duplicate_count, 0) AS bigint) AS duplicate_count,
       cast(coalesce(q.n_schema_violations, 0) AS bigint) AS n_schema_violations,
       cast(coalesce(q.n_type_mismatches, 0) AS bigint) AS n_type_mismatches
FROM la LEFT JOIN quality_metrics q ON la.run_id = q.run_id AND la.stage_name = 'ingestion'""",
    "stage_results", "quality_metrics"))
def stage_metrics(spark, d):
    """Each stage's latest record with its quality metrics."""
    return L.stage_metrics(V.stage_results(spark, d), V.quality_metrics(spark, d))


@register("overall_status", with_views(f"WITH {LA}, {ST} SELECT * FROM st", "stage_results"))
def overall_status(spark, d):
    """K1/A10: first-pass verdict and current verdict per run."""
    return L.overall_status(V.stage_results(spark, d))


@register("run_inspection", with_views(f"""
WITH {LA}, {ST}, {LC},
summ AS (SELECT run_id, string_agg(stage_name || ':' || status || ':in=' || cast(rows_in AS varchar)
                || ':out=' || cast(rows_out AS varchar), '; ' ORDER BY stage_ordinal) AS stage_summary
         FROM la GROUP BY run_id)
SELECT r.run_id, r.pipeline_name, r.scenario_name, st.overall_status, r.failure_injected, r.failure_type,
       {_t('r.started_at')}, {_t('r.finished_at')}, summ.stage_summary,
       coalesce(lc.total_logs, 0) AS total_log_entries, coalesce(lc.error_count, 0) AS error_log_count
FROM runs r LEFT JOIN st ON r.run_id = st.run_id LEFT JOIN summ ON r.run_id = summ.run_id
LEFT JOIN lc ON r.run_id = lc.run_id""", "runs", "stage_results", "log_entries"))
def run_inspection(spark, d):
    """Header, stage summary and log counts of every run."""
    return L.run_inspection(V.runs(spark, d), V.stage_results(spark, d), V.log_entries(spark, d))


@register("error_chain", with_views(f"""
WITH {LA},
el AS (SELECT run_id, stage AS stage_name, seq AS log_seq, level AS log_level, message AS log_message
       FROM log_entries WHERE level IN ('error', 'critical')),
cnt AS (SELECT run_id, stage_name, count(*) AS n FROM el GROUP BY run_id, stage_name)
SELECT la.run_id, la.stage_name, cast(la.stage_ordinal AS bigint) AS stage_ordinal, la.status, la.error_message,
       coalesce(cnt.n, 0) AS n_error_logs, el.log_seq, el.log_level, el.log_message
FROM la LEFT JOIN cnt ON la.run_id = cnt.run_id AND la.stage_name = cnt.stage_name
LEFT JOIN el ON la.run_id = el.run_id AND la.stage_name = el.stage_name""", "stage_results", "log_entries"))
def error_chain(spark, d):
    """Per run and stage, status, error and one row per error log line."""
    return L.error_chain(V.stage_results(spark, d), V.log_entries(spark, d))


@register("root_cause", with_views(f"""
WITH {LA},
rc AS (SELECT run_id, arg_min(stage_name, stage_ordinal) FILTER (WHERE error_message IS NOT NULL) AS root_stage,
              min(stage_ordinal) FILTER (WHERE error_message IS NOT NULL) AS o,
              arg_min(error_message, stage_ordinal) FILTER (WHERE error_message IS NOT NULL) AS root_error
       FROM la GROUP BY run_id),
e AS (SELECT run_id, count(*) AS total_errors FROM log_entries WHERE level IN ('error', 'critical') GROUP BY run_id)
SELECT rc.run_id, rc.root_stage, rc.root_error,
       CASE rc.o WHEN 1 THEN 'transform,load' WHEN 2 THEN 'load' WHEN 3 THEN '' END AS downstream_impact,
       coalesce(e.total_errors, 0) AS total_errors
FROM rc LEFT JOIN e ON rc.run_id = e.run_id""", "stage_results", "log_entries"))
def root_cause(spark, d):
    """First erroring stage, its error and the stages downstream of it."""
    return L.root_cause(V.stage_results(spark, d), V.log_entries(spark, d))


# ---------------------------------------------------------------------------
# rules K2-K6, K9, K10; ledger B7; records B8; reports B9, B11, P14; P10
# ---------------------------------------------------------------------------

@register("pipeline_health", _facts_sql("""
SELECT run_id, CASE WHEN overall_status = 'success' AND ne = 0 THEN 'HEALTHY'
                    WHEN overall_status = 'failed' THEN 'FAILED' ELSE 'DEGRADED' END AS health,
       overall_status, coalesce(failed_stages, '') AS failed_stages, coalesce(skipped_stages, '') AS skipped_stages,
       ne AS error_log_count, coalesce(remediation_applied, '') AS remediation_applied
FROM facts"""))
def pipeline_health(spark, d):
    """K2: HEALTHY / DEGRADED / FAILED per run."""
    return K.pipeline_health(*_run_tables(spark, d))


_HIST_OUT = ("CASE WHEN nr > 0 THEN CASE WHEN nf > 0 THEN 'UNRESOLVED' ELSE 'RESOLVED' END "
             "ELSE CASE WHEN nf > 0 THEN 'FAILED' ELSE 'HEALTHY' END END")
_REP_OUT = "CASE WHEN nr > 0 AND nf = 0 THEN 'RESOLVED' WHEN nf > 0 THEN 'UNRESOLVED' ELSE 'HEALTHY' END"


@register("run_outcome", _facts_sql(f"""
SELECT run_id, scenario_name, {_HIST_OUT} AS history_outcome, {_REP_OUT} AS report_outcome FROM facts"""))
def run_outcome(spark, d):
    """History and report outcomes of every run."""
    return K.run_outcome(*_run_tables(spark, d))


@register("history_records", _facts_sql(f"""
SELECT run_id, scenario_name, failure_type, {_t('started_at', 'ts')}, {_HIST_OUT} AS outcome,
       (epoch_us(finished_at) - epoch_us(started_at)) / 1e6 AS duration_seconds,
       coalesce(remediation_applied, '') AS remediation_applied, coalesce(failed_stages, '') AS failed_stages,
       cast(coalesce(m_total_rows, 0) AS bigint) AS total_rows, cast(coalesce(m_null_count, 0) AS bigint) AS total_nulls,
       cast(coalesce(m_duplicate_count, 0) AS bigint) AS duplicate_count,
       coalesce(schema_violations_text, '') AS schema_violations
FROM facts"""))
def history_records(spark, d):
    """The history record of every run."""
    return K.history_records(*_run_tables(spark, d))


@register("remediation_ledger", with_views(f"WITH {LED} SELECT * FROM led", "remediations"))
def remediation_ledger(spark, d):
    """Distinct actions per run in first-call order."""
    return L.remediation_ledger(V.remediations(spark, d))


@register("run_duration", with_views(f"""
SELECT run_id, {_t('started_at')}, {_t('finished_at')},
       (epoch_us(finished_at) - epoch_us(started_at)) / 1e6 AS duration_seconds FROM runs""", "runs"))
def run_duration(spark, d):
    """P10: seconds between start and finish of every run."""
    r = V.runs(spark, d)
    return r.select("run_id", "started_at", "finished_at",
                    H.duration_seconds(F.col("started_at"), F.col("finished_at")).alias("duration_seconds"))


def _recs_sql(sv, tm, dc, nc, ft):
    return (f"coalesce(nullif(concat_ws(' | ', CASE WHEN {sv} > 0 THEN 'Implement schema version pinning in the ingestion contract.' END, "
            f"CASE WHEN {tm} > 0 THEN 'Add explicit type validation and casting at ingestion boundary.' END, CASE WHEN {dc} > 0 THEN 'Enable upstream deduplication or add unique constraint monitoring.' END, "
            f"CASE WHEN {nc} > 0 THEN 'Define and enforce NOT NULL constraints for critical fields.' END, CASE WHEN {ft} = 'pipeline_failure' THEN 'Implement file arrival SLA checks before pipeline trigger.' END), ''), "
            f"'Continue monitoring. No significant issues detected.')")


@register("recommendations", with_views(f"""
SELECT r.run_id, {_recs_sql('q.n_schema_violations', 'q.n_type_mismatches', 'q.duplicate_count', 'q.null_count', 'r.failure_type')} AS recommendations
FROM runs r LEFT JOIN quality_metrics q ON r.run_id = q.run_id""", "runs", "quality_metrics"))
def recommendations(spark, d):
    """K6: recommendation texts per run."""
    return K.recommendations_by_run(V.runs(spark, d), V.quality_metrics(spark, d))


_ISSUE = ("CASE WHEN q.n_schema_violations > 0 THEN 'missing_column' WHEN q.n_type_mismatches > 0 THEN 'type_change' "
          "WHEN q.duplicate_count > 0 THEN 'duplicates' WHEN q.n_extra_columns > 0 THEN 'extra_column' "
          "WHEN q.null_count > 0 THEN 'nulls' END")


@register("failure_category", with_views(f"""
WITH {LA}, {ROLL}
SELECT q.run_id,
       CASE WHEN q.n_schema_violations > 0 OR q.n_type_mismatches > 0 OR q.n_extra_columns > 0 THEN 'schema_drift'
            WHEN q.duplicate_count > 0 OR q.null_count > 0 THEN 'data_quality'
            WHEN coalesce(roll.n_failed, 0) > 0 THEN 'pipeline_failure' ELSE 'none' END AS failure_category,
       {_ISSUE} AS issue, coalesce(roll.n_failed, 0) AS n_failed_stages
FROM quality_metrics q LEFT JOIN roll ON q.run_id = roll.run_id""", "quality_metrics", "stage_results"))
def failure_category(spark, d):
    """Failure category and issue derived from the measurements."""
    return K.failure_category(V.quality_metrics(spark, d), V.stage_results(spark, d))


# the expected steps, written out for the oracle alone
_RERUN = ["rerun_stage(ingestion)", "rerun_stage(transform)", "rerun_stage(load)"]
_EXPECTED_STEPS = {
    "missing_column": ["apply_schema_fix(add_missing_column_default)", *_RERUN],
    "type_change": ["apply_schema_fix(fix_type_cast)", *_RERUN],
    "extra_column": ["apply_schema_fix(drop_extra_columns)", *_RERUN],
    "duplicates": ["deduplicate_records(sales)", *_RERUN[1:]],
    "nulls": ["fill_null_defaults(customers.email)", *_RERUN[1:]],
    "pipeline_failure": _RERUN,
}


def _playbook_values():
    return ", ".join(f"('{k}', {i}, '{a}')" for k, steps in _EXPECTED_STEPS.items()
                     for i, a in enumerate([*steps, "rollback_stage(load)"], 1))


@register("remediation_plan", with_views(f"""
WITH {LA}, {ROLL},
book(issue, step, action) AS (VALUES {_playbook_values()}),
need AS (SELECT q.run_id, CASE WHEN {_ISSUE} IS NOT NULL THEN {_ISSUE}
                               WHEN coalesce(roll.n_failed, 0) > 0 THEN 'pipeline_failure' END AS issue
         FROM quality_metrics q LEFT JOIN roll ON q.run_id = roll.run_id)
SELECT need.run_id, need.issue, cast(book.step AS bigint) AS step, book.action
FROM need JOIN book ON need.issue = book.issue""", "quality_metrics", "stage_results"))
def remediation_plan(spark, d):
    """K9: ordered repair steps for every run that needs repair."""
    return K.remediation_plan(V.quality_metrics(spark, d), V.stage_results(spark, d))


@register("incident_report", _facts_sql(f"""
SELECT 'INC-' || cast(run_id AS varchar) AS report_id, run_id, pipeline_name, scenario_name,
       CASE WHEN nf = 0 AND ne = 0 THEN 'HEALTHY' WHEN nf > 0 THEN 'FAILED' ELSE 'DEGRADED' END AS health_status,
       CASE WHEN nf = 0 AND ne = 0 THEN 'NONE' WHEN nf > 1 THEN 'HIGH' WHEN nf > 0 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
       overall_status, failure_type, {_t('started_at')}, {_t('finished_at')},
       ne AS n_errors, nw AS n_warnings, nr AS remediation_count, {_REP_OUT} AS final_outcome,
       cast(coalesce(m_total_rows, 0) AS bigint) AS total_rows, cast(coalesce(m_null_count, 0) AS bigint) AS null_count,
       cast(coalesce(m_duplicate_count, 0) AS bigint) AS duplicate_count,
       cast(coalesce(n_schema_violations, 0) AS bigint) AS n_schema_violations,
       cast(coalesce(n_type_mismatches, 0) AS bigint) AS n_type_mismatches,
       coalesce(failed_stages, '') AS failed_stages, coalesce(skipped_stages, '') AS skipped_stages,
       coalesce(remediated_stages, '') AS remediated_stages,
       {_recs_sql('coalesce(n_schema_violations, 0)', 'coalesce(n_type_mismatches, 0)', 'coalesce(m_duplicate_count, 0)', 'coalesce(m_null_count, 0)', 'failure_type')} AS recommendations
FROM facts"""))
def incident_report(spark, d):
    """The structured incident report of every run."""
    return K.incident_report(*_run_tables(spark, d))


def _sql_lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# the expected texts, written out for the oracle alone
_L = {k: _sql_lit(v) for k, v in {
    "rule": "=" * 70, "title": "  ETL PIPELINE INCIDENT REPORT",
    "report_id": "  Report ID : ", "generated": "  Generated : ", "pipeline": "PIPELINE     : ",
    "run_id": "RUN ID       : ", "scenario": "SCENARIO     : ", "health": "HEALTH       : ",
    "severity": "SEVERITY     : ", "failure_type": "FAILURE TYPE : ", "outcome": "OUTCOME      : ",
    "started": "  Started  : ", "finished": "  Finished : ", "timeline": "TIMELINE", "stages": "STAGE SUMMARY",
    "errors": "ERRORS DETECTED", "warnings": "WARNINGS", "remediation": "REMEDIATION APPLIED",
    "recommendations": "RECOMMENDATIONS", "no_failure_type": "N/A", "no_remediation": "  None required",
    "bullet": "  • ", "warn_open": "  [WARN] [", "counts": "in=%5d out=%5d", "err_prefix": " | ERR: "}.items()}


_TEXT_SQL = _facts_sql(f"""
, rep AS (SELECT run_id, 'INC-' || cast(run_id AS varchar) AS report_id, pipeline_name, scenario_name,
          CASE WHEN nf = 0 AND ne = 0 THEN 'HEALTHY' WHEN nf > 0 THEN 'FAILED' ELSE 'DEGRADED' END AS health_status,
          CASE WHEN nf = 0 AND ne = 0 THEN 'NONE' WHEN nf > 1 THEN 'HIGH' WHEN nf > 0 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
          failure_type, {_REP_OUT} AS final_outcome, started_at, finished_at,
          {_recs_sql('coalesce(n_schema_violations, 0)', 'coalesce(n_type_mismatches, 0)', 'coalesce(m_duplicate_count, 0)', 'coalesce(m_null_count, 0)', 'failure_type')} AS recommendations
        FROM facts),
sl AS (SELECT run_id, string_agg('  ' || ICONS || ' ' || stage_name || repeat(' ', greatest(0, 12 - length(stage_name))) || ' | '
              || status || repeat(' ', greatest(0, 12 - length(status))) || ' | ' || printf({_L['counts']}, rows_in, rows_out)
              || coalesce({_L['err_prefix']} || error_message, ''), chr(10) ORDER BY stage_ordinal) AS stage_lines
       FROM la GROUP BY run_id),
ll AS (SELECT run_id,
              string_agg('  [' || upper(level) || '] [' || stage || '] ' || message, chr(10) ORDER BY seq)
                FILTER (WHERE level IN ('error', 'critical')) AS error_lines,
              string_agg({_L['warn_open']} || stage || '] ' || message, chr(10) ORDER BY seq)
                FILTER (WHERE level = 'warning') AS warning_lines
       FROM log_entries GROUP BY run_id),
fc AS (SELECT run_id, action, min(seq) AS seq FROM remediations GROUP BY run_id, action),
rl AS (SELECT run_id, string_agg('  ' || cast(rn AS varchar) || '. ' || action, chr(10) ORDER BY seq) AS remediation_lines
       FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS rn FROM fc) t GROUP BY run_id)
SELECT rep.report_id, rep.run_id, concat_ws(chr(10),
  {_L['rule']}, {_L['title']}, {_L['report_id']} || rep.report_id,
  {_L['generated']} || strftime(rep.finished_at, {TS}), {_L['rule']}, '',
  {_L['pipeline']} || rep.pipeline_name, {_L['run_id']} || cast(rep.run_id AS varchar),
  {_L['scenario']} || rep.scenario_name, {_L['health']} || rep.health_status,
  {_L['severity']} || rep.severity, {_L['failure_type']} || coalesce(rep.failure_type, {_L['no_failure_type']}),
  {_L['outcome']} || rep.final_outcome, '', {_L['timeline']},
  {_L['started']} || strftime(rep.started_at, {TS}), {_L['finished']} || strftime(rep.finished_at, {TS}), '',
  {_L['stages']}, coalesce(sl.stage_lines, ''),
  CASE WHEN coalesce(ll.error_lines, '') <> '' THEN chr(10) || {_L['errors']} || chr(10) || ll.error_lines END,
  CASE WHEN coalesce(ll.warning_lines, '') <> '' THEN chr(10) || {_L['warnings']} || chr(10) || ll.warning_lines END,
  chr(10) || {_L['remediation']} || chr(10) || coalesce(nullif(rl.remediation_lines, ''), {_L['no_remediation']}),
  chr(10) || {_L['recommendations']} || chr(10) || array_to_string(list_transform(string_split(rep.recommendations, ' | '),
      lambda r: {_L['bullet']} || r), chr(10)),
  '', {_L['rule']}) AS report_text
FROM rep LEFT JOIN sl ON rep.run_id = sl.run_id LEFT JOIN ll ON rep.run_id = ll.run_id
LEFT JOIN rl ON rep.run_id = rl.run_id""".replace("ICONS", "CASE la.status WHEN 'success' THEN '✓' WHEN 'failed' THEN '✗' WHEN 'skipped' THEN '↷' WHEN 'remediated' THEN '⟳' WHEN 'pending' THEN '?' WHEN 'running' THEN '►' ELSE '?' END"))


@register("incident_report_text", _TEXT_SQL)
def incident_report_text(spark, d):
    """The readable report text of every run (rows-only check)."""
    return K.incident_report_text(*_run_tables(spark, d))

_LINES_SQL = _facts_sql(f"""
, rep AS (SELECT run_id, 'INC-' || cast(run_id AS varchar) AS report_id, pipeline_name, scenario_name,
          CASE WHEN nf = 0 AND ne = 0 THEN 'HEALTHY' WHEN nf > 0 THEN 'FAILED' ELSE 'DEGRADED' END AS health_status,
          CASE WHEN nf = 0 AND ne = 0 THEN 'NONE' WHEN nf > 1 THEN 'HIGH' WHEN nf > 0 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
          failure_type, {_REP_OUT} AS final_outcome, started_at, finished_at,
          {_recs_sql('coalesce(n_schema_violations, 0)', 'coalesce(n_type_mismatches, 0)', 'coalesce(m_duplicate_count, 0)', 'coalesce(m_null_count, 0)', 'failure_type')} AS recommendations
        FROM facts),
lists AS (
  SELECT run_id, 0 AS section, [{_L['rule']}, {_L['title']}, {_L['report_id']} || report_id,
      {_L['generated']} || strftime(finished_at, {TS}), {_L['rule']}, '',
      {_L['pipeline']} || pipeline_name, {_L['run_id']} || cast(run_id AS varchar),
      {_L['scenario']} || scenario_name, {_L['health']} || health_status, {_L['severity']} || severity,
      {_L['failure_type']} || coalesce(failure_type, {_L['no_failure_type']}), {_L['outcome']} || final_outcome, '', {_L['timeline']},
      {_L['started']} || strftime(started_at, {TS}), {_L['finished']} || strftime(finished_at, {TS}), '',
      {_L['stages']}] AS l, 0 AS base FROM rep
  UNION ALL SELECT run_id, 4, ['', {_L['remediation']}], 0 FROM rep
  UNION ALL SELECT run_id, 5, ['', {_L['recommendations']}], 0 FROM rep
  UNION ALL SELECT run_id, 5, list_transform(string_split(recommendations, ' | '), lambda r: {_L['bullet']} || r), 2 FROM rep
  UNION ALL SELECT run_id, 6, ['', {_L['rule']}], 0 FROM rep
  UNION ALL SELECT run_id, 2, ['', {_L['errors']}], -2 FROM log_entries GROUP BY run_id
    HAVING bool_or(level IN ('error', 'critical'))
  UNION ALL SELECT run_id, 3, ['', {_L['warnings']}], -2 FROM log_entries GROUP BY run_id HAVING bool_or(level = 'warning')),
fc AS (SELECT run_id, action, min(seq) AS seq FROM remediations GROUP BY run_id, action),
acts AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS rn, action FROM fc),
lines AS (
  SELECT run_id, section, base + unnest(range(len(l))) AS item, unnest(l) AS line FROM lists
  UNION ALL
  SELECT la.run_id, 1, la.stage_ordinal, '  ' || ICONS || ' ' || la.stage_name || repeat(' ', greatest(0, 12 - length(la.stage_name))) || ' | '
         || la.status || repeat(' ', greatest(0, 12 - length(la.status))) || ' | ' || printf({_L['counts']}, la.rows_in, la.rows_out)
         || coalesce({_L['err_prefix']} || la.error_message, '') FROM la
  UNION ALL
  SELECT run_id, 2, seq, '  [' || upper(level) || '] [' || stage || '] ' || message FROM log_entries
  WHERE level IN ('error', 'critical')
  UNION ALL
  SELECT run_id, 3, seq, {_L['warn_open']} || stage || '] ' || message FROM log_entries WHERE level = 'warning'
  UNION ALL
  SELECT run_id, 4, rn + 1, '  ' || cast(rn AS varchar) || '. ' || action FROM acts
  UNION ALL
  SELECT r.run_id, 4, 2, {_L['no_remediation']} FROM rep r WHERE NOT EXISTS (SELECT 1 FROM acts a WHERE a.run_id = r.run_id))
SELECT lines.run_id, cast(section AS bigint) AS section, cast(item AS bigint) AS item, line, rep.report_id
FROM lines JOIN rep ON lines.run_id = rep.run_id""".replace("ICONS", "CASE la.status WHEN 'success' THEN '✓' WHEN 'failed' THEN '✗' WHEN 'skipped' THEN '↷' WHEN 'remediated' THEN '⟳' WHEN 'pending' THEN '?' WHEN 'running' THEN '►' ELSE '?' END"))


@register("incident_report_lines", _LINES_SQL)
def incident_report_lines(spark, d):
    """The readable report of every run as ordered lines (distributed form)."""
    return K.incident_report_lines(*_run_tables(spark, d))


@register("quality_route", with_views("""
WITH last AS (SELECT run_id, stage_name, status, row_number() OVER (PARTITION BY run_id, stage_name ORDER BY attempt DESC) AS n
              FROM stage_results),
failed AS (SELECT run_id, bool_or(status = 'failed') AS f FROM last WHERE n = 1 GROUP BY run_id),
why AS (SELECT m.run_id, concat_ws(',', CASE WHEN f THEN 'stage' END, CASE WHEN n_schema_violations > 0 THEN 'schema' END,
               CASE WHEN n_type_mismatches > 0 THEN 'type' END, CASE WHEN null_count > 0 THEN 'nulls' END,
               CASE WHEN duplicate_count > 0 THEN 'duplicates' END,
               CASE WHEN out_of_range_count > 0 THEN 'range' END) AS reasons
        FROM quality_metrics m LEFT JOIN failed USING (run_id))
SELECT run_id, CASE WHEN reasons = '' THEN 'report' ELSE 'diagnose' END AS route, reasons FROM why""",
    "stage_results", "quality_metrics"))
def quality_route(spark, d):
    """K8: any failed stage or quality issue of any kind sends a run to diagnosis."""
    return K.quality_route(V.stage_results(spark, d), V.quality_metrics(spark, d))


MOMENTS = ["1994-06-01 00:00:30", "1996-02-29 12:00:00", "1997-12-31 23:59:59", "2030-01-01 00:00:00"]


@register("published_as_of", with_views(f"""
WITH loads AS (SELECT run_id, attempt, 'publish' AS action, finished_at AS t, rows_out AS n_rows FROM stage_results
               WHERE stage_name = 'load' AND status = 'success'),
events AS (SELECT * FROM loads
           UNION ALL SELECT run_id, max(attempt), 'rollback', max(t) + INTERVAL 40 DAY, 0 FROM loads
                     WHERE run_id % 13 = 0 GROUP BY run_id
           UNION ALL SELECT run_id, min(attempt), 'publish', max(t) + INTERVAL 300 DAY, min_by(n_rows, attempt) FROM loads
                     WHERE run_id % 26 = 0 GROUP BY run_id),
ordered AS (SELECT m.as_of, e.*, row_number() OVER (PARTITION BY m.as_of, run_id ORDER BY t DESC, attempt DESC, action DESC) AS n
            FROM events e JOIN (SELECT unnest([{", ".join(f"TIMESTAMP '{m}'" for m in MOMENTS)}]) AS as_of) m ON e.t <= m.as_of)
SELECT strftime(as_of, '%Y-%m-%d %H:%M:%S.%f') AS as_of, cast(run_id AS varchar) AS run_id, cast(attempt AS bigint) AS attempt,
       cast(n_rows AS bigint) AS n_rows
FROM ordered WHERE n = 1 AND action = 'publish'""", "stage_results"))
def published_as_of(spark, d):
    """What every run had published at several moments, before and after roll-backs and returns to an attempt."""
    loads = V.stage_results(spark, d).where("stage_name = 'load' and status = 'success'").select(
        "run_id", F.col("attempt").cast("int").alias("attempt"), F.lit("publish").alias("action"),
        F.col("finished_at").alias("at"), F.col("rows_out").alias("n_rows"))
    days = lambda n: F.max("at") + F.make_dt_interval(days=F.lit(n))
    back = loads.where(F.col("run_id") % 13 == 0).groupBy("run_id").agg(
        F.max("attempt").alias("attempt"), F.lit("rollback").alias("action"), days(40).alias("at"),
        F.lit(0).cast("bigint").alias("n_rows"))
    again = loads.where(F.col("run_id") % 26 == 0).groupBy("run_id").agg(
        F.min("attempt").alias("attempt"), F.lit("publish").alias("action"), days(300).alias("at"),
        F.min_by("n_rows", "attempt").alias("n_rows"))
    events = loads.unionByName(back).unionByName(again).withColumn("run_id", F.col("run_id").cast("string"))
    return P.published_as_of(events, MOMENTS)


#: A pipeline with branches: two sources, two checks, a join of both, two outputs.
GRAPH = [("clean_orders", "read_orders"), ("clean_customers", "read_customers"), ("enrich", "clean_orders"),
         ("enrich", "clean_customers"), ("daily_totals", "enrich"), ("publish", "enrich"), ("notify", "publish"),
         ("notify", "daily_totals")]
_OWN = {"read_orders": "run_id % 11 = 0", "read_customers": "o_custkey % 13 = 0", "clean_orders": "run_id % 17 = 0",
        "clean_customers": "o_custkey % 7 = 0", "enrich": "run_id % 5 = 0", "daily_totals": "run_id % 9 = 0",
        "publish": "run_id % 4 = 0", "notify": "run_id % 3 = 0"}
_GRAPH_SQL = "WITH RECURSIVE " + ("""
edges(stage, up) AS (VALUES {edges}),
reach AS (SELECT up, stage FROM edges UNION SELECT r.up, e.stage FROM reach r JOIN edges e ON e.up = r.stage),
graph_stages AS ({own})""".format(
    edges=", ".join(f"('{a}', '{b}')" for a, b in GRAPH),
    own=" UNION ALL ".join(f"SELECT o_orderkey AS run_id, '{s}' AS stage, "
                           f"({c.replace('run_id', 'o_orderkey')}) AS bad FROM orders" for s, c in _OWN.items())))


def _graph_stages(spark, d):
    from ..sources.tables import read_table
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey").withColumn("run_id", F.col("o_orderkey"))
    states = F.array(*[F.struct(F.lit(s).alias("stage_name"), F.when(F.expr(c), "failed").otherwise("success").alias("status"))
                       for s, c in _OWN.items()])
    return o.select("run_id", F.explode(states).alias("s")).select("run_id", "s.*")


def _reach(spark):
    return G.closure(spark.createDataFrame(GRAPH, "stage string, depends_on string"))


@register("graph_gate", _GRAPH_SQL + """
SELECT g.run_id, g.stage AS stage_name, CASE WHEN any_value(g.bad) THEN 'failed' ELSE 'success' END AS status,
       coalesce(string_agg(u.stage, ',' ORDER BY u.stage), '') AS blocked_by,
       CASE WHEN count(u.stage) > 0 THEN 'skipped' WHEN any_value(g.bad) THEN 'failed' ELSE 'success' END AS effective_status,
       count(u.stage) = 0 AS gate_ok
FROM graph_stages g LEFT JOIN reach r ON r.stage = g.stage
LEFT JOIN graph_stages u ON u.run_id = g.run_id AND u.stage = r.up AND u.bad
GROUP BY g.run_id, g.stage""")
def graph_gate(spark, d):
    """J4 over a graph with branches: what blocks each stage of every run."""
    return G.gate(_graph_stages(spark, d), _reach(spark))


@register("graph_root_cause", _GRAPH_SQL + """,
failed AS (SELECT run_id, stage FROM graph_stages WHERE bad),
roots AS (SELECT run_id, stage FROM failed f WHERE NOT EXISTS (
            SELECT 1 FROM reach r JOIN failed u ON u.stage = r.up WHERE r.stage = f.stage AND u.run_id = f.run_id)),
down AS (SELECT DISTINCT t.run_id, r.stage FROM roots t JOIN reach r ON r.up = t.stage
         EXCEPT SELECT run_id, stage FROM roots)
SELECT t.run_id, t.s AS root_stages, coalesce(d.s, '') AS downstream_impact
FROM (SELECT run_id, string_agg(stage, ',' ORDER BY stage) AS s FROM roots GROUP BY run_id) t
LEFT JOIN (SELECT run_id, string_agg(stage, ',' ORDER BY stage) AS s FROM down GROUP BY run_id) d ON d.run_id = t.run_id""")
def graph_root_cause(spark, d):
    """J7 over a graph with branches: the failed stages that no failed stage explains, and what they reach."""
    return G.root_causes(_graph_stages(spark, d), _reach(spark))
