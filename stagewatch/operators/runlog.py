"""Operators over the run tables: logs, stage attempts, inspection, error
chains (F1-F3, F6, A3, A4, A12, A13, J4, J7, W6, P13).

Every operator answers its question for all runs at once; a single-run
answer is the same operator plus ``where(run_id = x)``, which Parquet
filter pushdown turns into a cheap scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import STAGE_STATUSES, STAGES
from ..functions.exprs import is_error_level, ordered_text


# ---------------------------------------------------------------------------
# logs
# ---------------------------------------------------------------------------

def log_filter(logs: DataFrame, level: str = "all", stage: str = "all") -> DataFrame:
    """equality filters on level and stage; ``'all'`` disables one."""
    out = logs
    if level != "all":
        out = out.where(F.col("level") == level)
    if stage != "all":
        out = out.where(F.col("stage") == stage)
    return out


def error_logs(logs: DataFrame) -> DataFrame:
    """level error or critical."""
    return logs.where(is_error_level(F.col("level")))


def warning_logs(logs: DataFrame) -> DataFrame:
    """level warning."""
    return logs.where(F.col("level") == "warning")


def severity_counts(logs: DataFrame) -> DataFrame:
    """A3: log lines per run and level (always over all logs)."""
    return logs.groupBy("run_id", "level").agg(F.count(F.lit(1)).alias("n"))


def error_counts(logs: DataFrame) -> DataFrame:
    """A4: per run, total lines, error/critical lines and warnings."""
    lv = F.col("level")
    return logs.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_logs"),
        F.sum(F.when(is_error_level(lv), 1).otherwise(0)).cast("bigint").alias("error_count"),
        F.sum(F.when(lv == "warning", 1).otherwise(0)).cast("bigint").alias("warning_count"))


def log_details(logs: DataFrame, key: str) -> DataFrame:
    """One field of the JSON ``details`` of each line."""
    return logs.select("run_id", "seq", F.get_json_object("details", f"$.{key}").alias(f"detail_{key}"))


# ---------------------------------------------------------------------------
# stage attempts
# ---------------------------------------------------------------------------

def latest_attempt(stages: DataFrame) -> DataFrame:
    """The latest attempt per (run, stage) of an append-only table.

    ``row_number() = 1`` gets a partial WindowGroupLimit before the shuffle.
    """
    w = Window.partitionBy("run_id", "stage_name").orderBy(F.col("attempt").desc())
    return stages.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def first_attempt(stages: DataFrame) -> DataFrame:
    return stages.where(F.col("attempt") == 1)


def _status_code_of(stage: str):
    return F.max(F.when(F.col("stage_name") == stage, _status_code(F.col("status"))))


def _status_name(code):
    return F.try_element_at(F.array(*[F.lit(x) for x in STAGE_STATUSES]), code)


def stage_gate(stages: DataFrame) -> DataFrame:
    """The dependency gate, checked per run on the first pass.

    Transform may run only if ingestion did not fail; load only if
    transform neither failed nor was skipped (remediated passes).
    """
    codes = first_attempt(stages).groupBy("run_id").agg(          # int codes: hash aggregation
        *[_status_code_of(s).alias(f"_{s}") for s in STAGES])
    p = codes.select("run_id", *[_status_name(F.col(f"_{s}")).alias(f"{s}_status") for s in STAGES])
    t_ok = F.coalesce(F.col("ingestion_status"), F.lit("")) != "failed"
    l_ok = ~F.coalesce(F.col("transform_status"), F.lit("")).isin("failed", "skipped")
    gate_ok = ((t_ok | (F.col("transform_status") == "skipped"))
               & (l_ok | (F.col("load_status") == "skipped")))
    return p.select("run_id", *[f"{s}_status" for s in STAGES],
                    t_ok.alias("transform_allowed"), l_ok.alias("load_allowed"), gate_ok.alias("gate_ok"))


def _status_code(c):
    """Status as a small int (1-based position in the status list) so the
    per-stage aggregates keep fixed-width buffers (hash aggregation)."""
    return F.array_position(F.array(*[F.lit(x) for x in STAGE_STATUSES]), c).cast("int")


def stage_facts(stages: DataFrame) -> DataFrame:
    """Per run, from ONE two-level aggregate over all attempts:
    first-pass and current failure flags and the ordered stage lists.

    Level 1 groups by (run, stage) and keeps the status of the earliest and
    of the latest attempt (``min_by``/``max_by`` on int codes, map-side
    combined); level 2 groups by run.  Two shuffles, no window.
    """
    code = _status_code(F.col("status"))
    per = stages.groupBy("run_id", "stage_name").agg(
        F.min_by(code, F.col("attempt")).alias("_first"), F.max_by(code, F.col("attempt")).alias("_last"),
        F.max("stage_ordinal").alias("_ord"))
    failed, skipped, remediated = (STAGE_STATUSES.index(x) + 1 for x in ("failed", "skipped", "remediated"))

    def names(c: int):
        return F.concat_ws(",", F.transform(F.array_sort(F.collect_list(
            F.when(F.col("_last") == c, F.struct(F.col("_ord"), F.col("stage_name"))))),
            lambda x: x["stage_name"]))
    return per.groupBy("run_id").agg(
        F.max(F.col("_first") == failed).alias("first_failed"),
        F.max(F.col("_last") == failed).alias("current_failed"),
        names(failed).alias("failed_stages"), names(skipped).alias("skipped_stages"),
        names(remediated).alias("remediated_stages"),
        F.sum(F.when(F.col("_last") == failed, 1).otherwise(0)).cast("bigint").alias("n_failed"))


def stage_status_rollup(stages: DataFrame) -> DataFrame:
    """failed / skipped / remediated stages per run (latest attempts),
    as ordered text lists."""
    return stage_facts(stages).select("run_id", "failed_stages", "skipped_stages", "remediated_stages",
                                      "n_failed")


def stage_metrics(stages: DataFrame, metrics: DataFrame, stage: str | None = None) -> DataFrame:
    """Each stage's latest record with its quality metrics.

    Only ingestion records quality metrics; other stages report zeros.
    ``stage`` narrows to one stage; an unknown name is an error that lists
    the known stages.
    """
    if stage is not None and stage not in STAGES:
        raise ValueError(f"Stage '{stage}' not found; available stages: {STAGES}")
    la = latest_attempt(stages if stage is None else stages.where(F.col("stage_name") == stage))
    m = metrics.select("run_id", F.lit("ingestion").alias("stage_name"), "total_rows", "null_count",
                       "duplicate_count", F.size("schema_violations").alias("n_schema_violations"),
                       F.size("type_mismatches").alias("n_type_mismatches"))
    j = la.join(m, ["run_id", "stage_name"], "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return j.select("run_id", "stage_name", "attempt", "status", "rows_in", "rows_out", "started_at",
                    "finished_at", "error_message", z("total_rows"), z("null_count"), z("duplicate_count"),
                    z("n_schema_violations"), z("n_type_mismatches"))


def overall_status(stages: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """K1/A10: FAILED if any first-pass stage failed, else SUCCESS; plus the
    current status from the latest attempts (the first stays as it was)."""
    f = stage_facts(stages) if facts is None else facts
    return f.select(
        "run_id",
        F.when(F.col("first_failed"), "failed").otherwise("success").alias("overall_status"),
        F.when(F.col("current_failed"), "failed").otherwise("success").alias("current_status"))


def run_inspection(runs: DataFrame, stages: DataFrame, logs: DataFrame) -> DataFrame:
    """Run header, stage summary (ordered text) and log counts per run."""
    la = latest_attempt(stages)
    line = F.concat_ws(":", F.col("stage_name"), F.col("status"),
                       F.concat(F.lit("in="), F.col("rows_in").cast("string")),
                       F.concat(F.lit("out="), F.col("rows_out").cast("string")))
    summ = la.groupBy("run_id").agg(ordered_text(line, F.col("stage_ordinal")).alias("stage_summary"))
    st = overall_status(stages)
    lc = error_counts(logs)
    return (runs.join(st, "run_id", "left").join(summ, "run_id", "left").join(lc, "run_id", "left")
            .select("run_id", "pipeline_name", "scenario_name", "overall_status", "failure_injected",
                    "failure_type", "started_at", "finished_at", "stage_summary",
                    F.coalesce("total_logs", F.lit(0)).alias("total_log_entries"),
                    F.coalesce("error_count", F.lit(0)).alias("error_log_count")))


def error_chain(stages: DataFrame, logs: DataFrame) -> DataFrame:
    """Per run and stage (latest attempt): status, error, and one row per
    error log line of that stage (stages without error logs keep one row with
    empty log fields).

    Long form on purpose: a run with very many log lines is spread over rows,
    never gathered into one value.  The per-stage count is a map-side
    combined aggregate joined back 1:1; the fan-out to log lines is an inner
    join (skew-splittable on both sides).
    """
    la = latest_attempt(stages)
    el = error_logs(logs).select("run_id", F.col("stage").alias("stage_name"), F.col("seq").alias("log_seq"),
                                 F.col("level").alias("log_level"), F.col("message").alias("log_message"))
    cnt = el.groupBy("run_id", "stage_name").agg(F.count(F.lit(1)).alias("n_error_logs"))
    stage_rows = la.join(cnt, ["run_id", "stage_name"], "left").select(
        "run_id", "stage_name", "stage_ordinal", "status", "error_message",
        F.coalesce("n_error_logs", F.lit(0)).alias("n_error_logs"))
    # stages with error lines: an INNER join, so AQE can split a run with a huge
    # log on either side; stages without any: straight from the 1:1 counts
    with_logs = stage_rows.where(F.col("n_error_logs") > 0).join(el, ["run_id", "stage_name"], "inner")
    without = stage_rows.where(F.col("n_error_logs") == 0).select(
        "*", F.lit(None).cast("bigint").alias("log_seq"), F.lit(None).cast("string").alias("log_level"),
        F.lit(None).cast("string").alias("log_message"))
    cols = ["run_id", "stage_name", "stage_ordinal", "status", "error_message", "n_error_logs",
            "log_seq", "log_level", "log_message"]
    return with_logs.select(*cols).unionByName(without.select(*cols))


def root_cause(stages: DataFrame, logs: DataFrame) -> DataFrame:
    """The first stage (by ordinal, latest attempt) carrying an error is
    the root cause; downstream impact = the stages after it."""
    la = latest_attempt(stages)
    has_err = F.col("error_message").isNotNull()
    # the first erroring ordinal per run (an int: hash aggregation), then that
    # stage's own row by an equi-join (one stage row per run and ordinal)
    first = la.groupBy("run_id").agg(F.min(F.when(has_err, F.col("stage_ordinal"))).alias("_ord"))
    named = la.where(has_err).select("run_id", F.col("stage_ordinal").alias("_ord"),
                                     F.col("stage_name").alias("root_stage"),
                                     F.col("error_message").alias("root_error"))
    rc = first.join(named, ["run_id", "_ord"], "left")
    stages_arr = F.array(*[F.struct(F.lit(i + 1).alias("o"), F.lit(s).alias("s")) for i, s in enumerate(STAGES)])
    downstream = F.when(F.col("_ord").isNotNull(), F.concat_ws(",", F.transform(
        F.filter(stages_arr, lambda x: x["o"] > F.col("_ord")), lambda x: x["s"])))
    errs = error_logs(logs).groupBy("run_id").agg(F.count(F.lit(1)).alias("total_errors"))
    return rc.join(errs, "run_id", "left").select(
        "run_id", "root_stage", "root_error", downstream.alias("downstream_impact"),
        F.coalesce("total_errors", F.lit(0)).alias("total_errors"))


def remediation_actions(calls: DataFrame) -> DataFrame:
    """``run_id, actions``: the distinct actions of a run (a bounded list) in first-call order, ties by name."""
    first = calls.groupBy("run_id", "action").agg(F.min("seq").alias("seq"))
    return first.groupBy("run_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "action"))), lambda a: a["action"]).alias("actions"))


def remediation_ledger(calls: DataFrame) -> DataFrame:
    """Each distinct action once per run, in first-call order, as text, and their number."""
    return remediation_actions(calls).select(
        "run_id", F.concat_ws(" | ", "actions").alias("remediation_applied"),
        F.size("actions").cast("bigint").alias("remediation_count"))
