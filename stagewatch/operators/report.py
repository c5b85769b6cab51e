"""Classification rules and reports.

The rules are column expressions evaluated for every run at once; the
report joins per-run aggregates (each aggregated before the join, so every
join is one-row-per-run on both sides).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.constants import (REC_ARRIVAL, REC_DUPES, REC_NONE, REC_NULLS, REC_SCHEMA, REC_TYPES,
                                   REPORT_BULLET, REPORT_COUNT_FORMAT, REPORT_ERR_PREFIX, REPORT_LABELS,
                                   REPORT_NO_FAILURE_TYPE, REPORT_NO_REMEDIATION, REPORT_RULE, REPORT_SECTIONS,
                                   REPORT_STAGE_WIDTH, REPORT_TITLE, REPORT_WARN_TAG, STATUS_ICONS)
from ..functions.exprs import is_error_level, ts_text
from . import history as H
from . import runlog as L

# ---------------------------------------------------------------------------
# Repair playbook per detected issue (step order matters)
# ---------------------------------------------------------------------------
RERUN_ALL = ["rerun_stage(ingestion)", "rerun_stage(transform)", "rerun_stage(load)"]
PLAYBOOK = {
    "missing_column": ["apply_schema_fix(add_missing_column_default)"] + RERUN_ALL,
    "type_change": ["apply_schema_fix(fix_type_cast)"] + RERUN_ALL,
    "extra_column": ["apply_schema_fix(drop_extra_columns)"] + RERUN_ALL,
    "duplicates": ["deduplicate_records(sales)", "rerun_stage(transform)", "rerun_stage(load)"],
    "nulls": ["fill_null_defaults(customers.email)", "rerun_stage(transform)", "rerun_stage(load)"],
    "pipeline_failure": RERUN_ALL,
}
FALLBACK_STEP = "rollback_stage(load)"


def health(overall: Column, error_count: Column) -> Column:
    """K2: SUCCESS with no error logs -> HEALTHY; FAILED -> FAILED; else DEGRADED."""
    return (F.when((overall == "success") & (error_count == 0), "HEALTHY")
            .when(overall == "failed", "FAILED").otherwise("DEGRADED"))


def report_health(n_failed: Column, error_count: Column) -> tuple[Column, Column]:
    """K3: (health, severity) used by the incident report."""
    h = (F.when((n_failed == 0) & (error_count == 0), "HEALTHY")
         .when(n_failed > 0, "FAILED").otherwise("DEGRADED"))
    s = (F.when((n_failed == 0) & (error_count == 0), "NONE")
         .when(n_failed > 1, "HIGH").when(n_failed > 0, "MEDIUM").otherwise("LOW"))
    return h, s


def report_outcome(n_remediations: Column, n_failed: Column) -> Column:
    """K4: RESOLVED / UNRESOLVED / HEALTHY as the report states it."""
    return (F.when((n_remediations > 0) & (n_failed == 0), "RESOLVED")
            .when(n_failed > 0, "UNRESOLVED").otherwise("HEALTHY"))


def history_outcome(n_remediations: Column, n_failed: Column) -> Column:
    """K5: the outcome stored in history."""
    return (F.when(n_remediations > 0, F.when(n_failed > 0, "UNRESOLVED").otherwise("RESOLVED"))
            .otherwise(F.when(n_failed > 0, "FAILED").otherwise("HEALTHY")))


def recommendations(metrics_prefix: str = "") -> Column:
    """K6: recommendation texts from the ingestion metrics and failure type,
    as an ordered ``' | '``-joined text (default text when none apply)."""
    p = metrics_prefix
    recs = F.filter(F.array(
        F.when(F.size(F.col(f"{p}schema_violations")) > 0, F.lit(REC_SCHEMA)),
        F.when(F.size(F.col(f"{p}type_mismatches")) > 0, F.lit(REC_TYPES)),
        F.when(F.col(f"{p}duplicate_count") > 0, F.lit(REC_DUPES)),
        F.when(F.col(f"{p}null_count") > 0, F.lit(REC_NULLS)),
        F.when(F.col("failure_type") == "pipeline_failure", F.lit(REC_ARRIVAL))), lambda x: x.isNotNull())
    return F.when(F.size(recs) > 0, F.concat_ws(" | ", recs)).otherwise(F.lit(REC_NONE))


def issue(metrics: DataFrame) -> Column:
    """K10 detail: the first detected issue, in playbook priority order."""
    return (F.when(F.size("schema_violations") > 0, "missing_column")
            .when(F.size("type_mismatches") > 0, "type_change")
            .when(F.col("duplicate_count") > 0, "duplicates")
            .when(F.size("extra_columns") > 0, "extra_column")
            .when(F.col("null_count") > 0, "nulls"))


def failure_category(metrics: DataFrame, stages: DataFrame) -> DataFrame:
    """schema_drift / data_quality / pipeline_failure / none, derived
    from what was measured rather than from an injected label."""
    st = L.stage_status_rollup(stages).select("run_id", "n_failed")
    j = metrics.join(st, "run_id", "left")
    schema = (F.size("schema_violations") > 0) | (F.size("type_mismatches") > 0) | (F.size("extra_columns") > 0)
    quality = (F.col("duplicate_count") > 0) | (F.col("null_count") > 0)
    cat = (F.when(schema, "schema_drift").when(quality, "data_quality")
           .when(F.coalesce("n_failed", F.lit(0)) > 0, "pipeline_failure").otherwise("none"))
    return j.select("run_id", cat.alias("failure_category"), issue(metrics).alias("issue"),
                    F.coalesce("n_failed", F.lit(0)).alias("n_failed_stages"))


def remediation_plan(metrics: DataFrame, stages: DataFrame) -> DataFrame:
    """K9: the ordered repair steps for every run that needs one.

    The playbook is a literal table (bounded by construction) and is
    broadcast; runs with a failed stage but no measured issue get the
    pipeline-failure steps; every plan ends with the rollback fallback.
    """
    spark = metrics.sparkSession
    rows = [(k, i + 1, a) for k, steps in PLAYBOOK.items() for i, a in enumerate(steps + [FALLBACK_STEP])]
    book = spark.createDataFrame(rows, "issue string, step int, action string")
    cat = failure_category(metrics, stages)
    need = cat.select("run_id", F.when(F.col("issue").isNotNull(), F.col("issue"))
                      .when(F.col("n_failed_stages") > 0, F.lit("pipeline_failure")).alias("issue")) \
        .where(F.col("issue").isNotNull())
    return need.join(F.broadcast(book), "issue").select("run_id", "issue", "step", "action")


def quality_route(stages: DataFrame, metrics: DataFrame) -> DataFrame:
    """K8: runs whose latest attempts hold a failed stage, or with any quality
    issue (nulls, duplicates, schema violations, type mismatches, values out of
    range), are diagnosed; the rest is reported.  ``reasons`` lists why."""
    failed = L.stage_facts(stages).select("run_id", F.col("current_failed").alias("stage_failed"))
    m = metrics.select("run_id", "null_count", "duplicate_count", F.size("schema_violations").alias("violations"),
                       F.size("type_mismatches").alias("mismatches"), "out_of_range_count")
    j = failed.join(m, "run_id", "full_outer")
    reasons = F.concat_ws(",", F.when(F.col("stage_failed"), "stage"), *[
        F.when(F.col(c) > 0, name) for c, name in (("violations", "schema"), ("mismatches", "type"), ("null_count", "nulls"),
                                                   ("duplicate_count", "duplicates"), ("out_of_range_count", "range"))])
    return j.select("run_id", F.when(reasons != "", "diagnose").otherwise("report").alias("route"),
                    reasons.alias("reasons"))


def triage_route(history: DataFrame, known: DataFrame | None = None, metrics: DataFrame | None = None) -> DataFrame:
    """K7/K8: a known recurring failure goes straight to repair; otherwise a
    failed run or a quality issue is diagnosed, and the rest reported.  With
    ``metrics`` (of the same runs) schema violations, type mismatches and values
    out of range are issues too, as are schema violations in the history itself.
    ``known`` (``history.known_failures``) is counted from the history where it is not given."""
    if known is None:
        listed = [c for c in ("schema_violations",) if c in history.columns]
        j = H.known_failures(history, carry=["outcome", "total_nulls", "duplicate_count", *listed])
    else:
        j = history.join(known.select("run_id", "recent_occurrences", "is_known_recurring"), "run_id", "left")
    issue_ = (F.col("outcome").isin("FAILED", "UNRESOLVED") | (F.col("total_nulls") > 0)
              | (F.col("duplicate_count") > 0))
    if "schema_violations" in history.columns:
        listed = F.col("schema_violations")
        issue_ = issue_ | F.coalesce(F.size(listed) > 0 if isinstance(history.schema["schema_violations"].dataType, ArrayType)
                                     else listed != "", F.lit(False))
    if metrics is not None:
        found = (F.size("schema_violations") > 0) | (F.size("type_mismatches") > 0) | (F.col("out_of_range_count") > 0)
        j = j.join(metrics.select("run_id", found.alias("_found")), "run_id", "left")
        issue_ = issue_ | F.coalesce("_found", F.lit(False))
    route = (F.when(F.coalesce("is_known_recurring", F.lit(False)), "repair")
             .when(issue_, "diagnose").otherwise("report"))
    return j.select("run_id", "scenario_name", "outcome",
                    F.coalesce("recent_occurrences", F.lit(0)).alias("recent_occurrences"),
                    route.alias("route"))


# ---------------------------------------------------------------------------
# per-run building blocks
# ---------------------------------------------------------------------------

def run_facts(runs: DataFrame, stages: DataFrame, logs: DataFrame, calls: DataFrame,
              metrics: DataFrame | None) -> DataFrame:
    """One row per run with everything the rules need (all joins 1:1 on run_id);
    rules that use no metrics pass None for them."""
    st = L.stage_facts(stages).select(
        "run_id", F.when(F.col("first_failed"), "failed").otherwise("success").alias("overall_status"),
        F.when(F.col("current_failed"), "failed").otherwise("success").alias("current_status"),
        "failed_stages", "skipped_stages", "remediated_stages", "n_failed")
    lc = L.error_counts(logs)
    led = L.remediation_actions(calls).select(
        "run_id", "actions", F.concat_ws(" | ", "actions").alias("remediation_applied"),
        F.size("actions").cast("bigint").alias("remediation_count"))
    m = None if metrics is None else metrics.select("run_id", F.col("total_rows").alias("m_total_rows"),
                       F.col("null_count").alias("m_null_count"),
                       F.col("duplicate_count").alias("m_duplicate_count"),
                       F.col("schema_violations").alias("m_schema_violations"),
                       F.col("type_mismatches").alias("m_type_mismatches"))
    j = (runs.join(st, "run_id", "left").join(lc, "run_id", "left")
         .join(led, "run_id", "left"))
    if m is not None:
        j = j.join(m, "run_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select("*", z("n_failed").alias("_nf"), z("error_count").alias("_ne"),
                    z("remediation_count").alias("_nr"), z("warning_count").alias("_nw"))


def run_outcome(runs, stages, logs, calls, metrics=None) -> DataFrame:
    """Scenario and both outcome vocabularies per run."""
    f = run_facts(runs, stages, logs, calls, None)
    return f.select("run_id", "scenario_name",
                    history_outcome(F.col("_nr"), F.col("_nf")).alias("history_outcome"),
                    report_outcome(F.col("_nr"), F.col("_nf")).alias("report_outcome"))


def pipeline_health(runs, stages, logs, calls, metrics=None) -> DataFrame:
    """K2: monitor health per run, with failed/skipped stages and error count."""
    f = run_facts(runs, stages, logs, calls, None)
    return f.select("run_id", health(F.col("overall_status"), F.col("_ne")).alias("health"),
                    "overall_status", F.coalesce("failed_stages", F.lit("")).alias("failed_stages"),
                    F.coalesce("skipped_stages", F.lit("")).alias("skipped_stages"),
                    F.col("_ne").alias("error_log_count"),
                    F.coalesce("remediation_applied", F.lit("")).alias("remediation_applied"))


def history_records(runs, stages, logs, calls, metrics) -> DataFrame:
    """The history record of every run (outcome K5, duration P10)."""
    f = run_facts(runs, stages, logs, calls, metrics)
    return f.select(
        "run_id", "scenario_name", "failure_type", F.col("started_at").alias("ts"),
        history_outcome(F.col("_nr"), F.col("_nf")).alias("outcome"),
        H.duration_seconds(F.col("started_at"), F.col("finished_at")).alias("duration_seconds"),
        F.coalesce("remediation_applied", F.lit("")).alias("remediation_applied"),
        F.coalesce("failed_stages", F.lit("")).alias("failed_stages"),
        F.coalesce("m_total_rows", F.lit(0)).alias("total_rows"),
        F.coalesce("m_null_count", F.lit(0)).alias("total_nulls"),
        F.coalesce("m_duplicate_count", F.lit(0)).alias("duplicate_count"),
        F.concat_ws(" | ", F.coalesce("m_schema_violations", F.array().cast("array<string>")))
        .alias("schema_violations"))


def recommendations_by_run(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """K6 per run."""
    j = runs.select("run_id", "failure_type").join(metrics, "run_id", "left")
    return j.select("run_id", recommendations().alias("recommendations"))


def incident_report(runs, stages, logs, calls, metrics) -> DataFrame:
    """The structured incident report of every run, with its data quality
    summary and stage summary (latest attempts)."""
    return _report_rows(runs, stages, logs, calls, metrics).drop("actions")


def _report_rows(runs, stages, logs, calls, metrics) -> DataFrame:
    """The rows of ``incident_report`` and the list of each run's actions."""
    f = run_facts(runs, stages, logs, calls, metrics)
    h, s = report_health(F.col("_nf"), F.col("_ne"))
    rec = F.filter(F.array(
        F.when(F.size(F.coalesce("m_schema_violations", F.array())) > 0, F.lit(REC_SCHEMA)),
        F.when(F.size(F.coalesce("m_type_mismatches", F.create_map())) > 0, F.lit(REC_TYPES)),
        F.when(F.coalesce("m_duplicate_count", F.lit(0)) > 0, F.lit(REC_DUPES)),
        F.when(F.coalesce("m_null_count", F.lit(0)) > 0, F.lit(REC_NULLS)),
        F.when(F.col("failure_type") == "pipeline_failure", F.lit(REC_ARRIVAL))), lambda x: x.isNotNull())
    return f.select(
        F.concat(F.lit("INC-"), F.col("run_id").cast("string")).alias("report_id"),
        "run_id", "pipeline_name", "scenario_name", h.alias("health_status"), s.alias("severity"),
        "overall_status", "failure_type", "started_at", "finished_at",
        F.col("_ne").alias("n_errors"), F.col("_nw").alias("n_warnings"),
        F.col("_nr").alias("remediation_count"),
        report_outcome(F.col("_nr"), F.col("_nf")).alias("final_outcome"),
        *[F.coalesce(f"m_{c}", F.lit(0)).cast("bigint").alias(c) for c in ("total_rows", "null_count", "duplicate_count")],
        F.coalesce(F.size("m_schema_violations"), F.lit(0)).cast("bigint").alias("n_schema_violations"),
        F.coalesce(F.size("m_type_mismatches"), F.lit(0)).cast("bigint").alias("n_type_mismatches"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("failed_stages", "skipped_stages", "remediated_stages")],
        F.when(F.size(rec) > 0, F.concat_ws(" | ", rec)).otherwise(F.lit(REC_NONE)).alias("recommendations"), "actions")


def incident_report_lines(runs, stages, logs, calls, metrics) -> DataFrame:
    """The readable report as ``(run_id, section, item, line)`` rows.

    Ordering by (section, item) inside a run gives the report text.  Every
    part is built row-wise (log lines keep their own rows, ordered by their
    sequence number), so no run's log is gathered into one task; only the
    bounded parts (distinct repair actions, recommendations) are collected.
    """
    rep = _report_rows(runs, stages, logs, calls, metrics)
    lab, sec = REPORT_LABELS, REPORT_SECTIONS

    def line(section: int, item, text) -> Column:
        item = item if isinstance(item, Column) else F.lit(item)
        return F.struct(F.lit(section).alias("section"), item.cast("bigint").alias("item"),
                        (text if isinstance(text, Column) else F.lit(text)).alias("line"))

    def labelled(key: str, value) -> Column:
        return F.concat(F.lit(lab[key]), value)

    header = [F.lit(REPORT_RULE), F.lit(REPORT_TITLE), labelled("report_id", F.col("report_id")),
              labelled("generated", ts_text(F.col("finished_at"))), F.lit(REPORT_RULE), F.lit(""),
              labelled("pipeline", F.col("pipeline_name")), labelled("run_id", F.col("run_id").cast("string")),
              labelled("scenario", F.col("scenario_name")), labelled("health", F.col("health_status")),
              labelled("severity", F.col("severity")),
              labelled("failure_type", F.coalesce("failure_type", F.lit(REPORT_NO_FAILURE_TYPE))),
              labelled("outcome", F.col("final_outcome")), F.lit(""), F.lit(sec["timeline"]),
              labelled("started", ts_text(F.col("started_at"))), labelled("finished", ts_text(F.col("finished_at"))),
              F.lit(""), F.lit(sec["stages"])]
    actions = F.coalesce("actions", F.array().cast("array<string>"))
    numbered = F.transform(actions, lambda a, i: line(4, i + 2, F.concat(
        F.lit("  "), (i + 1).cast("string"), F.lit(". "), a)))
    bullets = F.transform(F.split("recommendations", r" \| "),
                          lambda r, i: line(5, i + 2, F.concat(F.lit(REPORT_BULLET), r)))

    def head(section: int, name: str, count: str) -> Column:
        lines = F.array(line(section, -2, ""), line(section, -1, sec[name]))
        return F.slice(lines, F.lit(1), F.when(F.col(count) > 0, 2).otherwise(0))

    # every line that depends only on the run's report row, built as ONE array and exploded once
    per_run = F.concat(
        F.array(*[line(0, i, h) for i, h in enumerate(header)]),
        head(2, "errors", "n_errors"), head(3, "warnings", "n_warnings"),    # only where the section has lines
        F.array(line(4, 0, ""), line(4, 1, sec["remediation"])),
        F.when(F.size(actions) > 0, numbered).otherwise(F.array(line(4, 2, REPORT_NO_REMEDIATION))),
        F.array(line(5, 0, ""), line(5, 1, sec["recommendations"])), bullets,
        F.array(line(6, 0, ""), line(6, 1, REPORT_RULE)))
    rep_lines = rep.select("run_id", F.explode(per_run).alias("l")).select("run_id", "l.section", "l.item", "l.line")
    icon = F.create_map(*[x for k, v in STATUS_ICONS.items() for x in (F.lit(k), F.lit(v))])
    stage_rows = L.latest_attempt(stages).select(
        "run_id", F.lit(1).alias("section"), F.col("stage_ordinal").cast("bigint").alias("item"),
        F.concat(F.lit("  "), F.coalesce(F.try_element_at(icon, F.col("status")), F.lit("?")), F.lit(" "),
                 _padded("stage_name"), F.lit(" | "),
                 _padded("status"), F.lit(" | "),
                 F.format_string(REPORT_COUNT_FORMAT, F.col("rows_in"), F.col("rows_out")),
                 F.when(F.col("error_message").isNotNull(),
                        F.concat(F.lit(REPORT_ERR_PREFIX), F.col("error_message"))).otherwise(F.lit("")))
        .alias("line"))
    lv = F.col("level")
    is_err = is_error_level(lv)
    # error and warning lines in one scan of the logs
    log_lines = logs.where(is_err | (lv == "warning")).select(
        "run_id", F.when(is_err, 2).otherwise(3).alias("section"), F.col("seq").cast("bigint").alias("item"),
        F.when(is_err, F.concat(F.lit("  ["), F.upper(lv), F.lit("] [")))
        .otherwise(F.lit(f"  [{REPORT_WARN_TAG}] [")).alias("_tag"), "stage", "message") \
        .select("run_id", "section", "item",
                F.concat(F.col("_tag"), F.col("stage"), F.lit("] "), F.col("message")).alias("line"))
    # stage and log lines only for runs that have a report (a semi-join on the run ids)
    other = stage_rows.unionByName(log_lines) \
        .join(runs.select("run_id"), "run_id", "left_semi")
    out = rep_lines.unionByName(other)
    return out.withColumn("report_id", F.concat(F.lit("INC-"), F.col("run_id").cast("string")))


def _padded(name: str) -> Column:
    """Padded to the column width, never cut."""
    return F.rpad(name, F.greatest(F.length(name), F.lit(REPORT_STAGE_WIDTH)), F.lit(" "))


def incident_report_text(runs, stages, logs, calls, metrics) -> DataFrame:
    """The report as one text value per run, assembled from the lines.

    A report is one value, so each run's lines meet in one task; use
    ``incident_report_lines`` where a run's log may be very large.
    """
    lines = incident_report_lines(runs, stages, logs, calls, metrics)
    return lines.groupBy("report_id", "run_id").agg(F.concat_ws("\n", F.transform(
        F.array_sort(F.collect_list(F.struct("section", "item", "line"))), lambda x: x["line"])).alias("report_text"))
