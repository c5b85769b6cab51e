"""Whole runs: inject a scenario, run the stages, repair by playbook, record.

This replaces the monitored system's agent loop with its deterministic
rules: the failure category (K10) picks the playbook (K9), the repairs are
the pure operators of ``operators.repair``, the re-runs are new stage
attempts (B5), a run that still fails is rolled back (B6), and every run is
appended to the run tables (stage results, logs, remediations, metrics,
history) that all analytics queries read.

    python -m stagewatch.plans.scenarios --sf-dir /root/testdata/sf0.01 --out /path/to/tables
"""

from __future__ import annotations

import argparse
import datetime as _dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import SCENARIOS
from ..operators import faults as I
from ..operators import repair as R
from ..sources import files as S
from . import jobs

# ---------------------------------------------------------------------------
# Failure type of each scenario (None = no failure injected)
# ---------------------------------------------------------------------------
SCENARIO_FAILURE_TYPES = {
    "healthy": None,
    "schema_drift_new_column": "schema_drift",
    "schema_drift_type_change": "schema_drift",
    "schema_drift_missing_column": "schema_drift",
    "data_quality_nulls": "data_quality",
    "data_quality_duplicates": "data_quality",
    "missing_source_file": "pipeline_failure",
    "pk_constraint_violation": "data_quality",
}
MISSING_SOURCE_NAME = "product_catalog"
# The scenarios run when none are named
DEFAULT_SCENARIOS = [
    "healthy", "schema_drift_type_change", "data_quality_nulls", "data_quality_duplicates",
    "schema_drift_missing_column", "pk_constraint_violation",
]


def inject(name: str, src: jobs.Sources) -> jobs.Sources:
    """The scenario's corrupted copy of the sources (unknown names: healthy)."""
    if name == "schema_drift_new_column":
        return src.replace(sales=I.inject_new_column(src.sales))
    if name == "schema_drift_type_change":
        return src.replace(sales=I.inject_type_change(src.sales))
    if name == "schema_drift_missing_column":
        return src.replace(sales=I.inject_missing_column(src.sales, "region"))
    if name == "data_quality_nulls":
        return src.replace(customers=I.inject_nulls(src.customers, "email"))
    if name == "data_quality_duplicates":
        return src.replace(sales=I.inject_duplicates(src.sales, fraction=0.15))     # by content hash
    if name == "missing_source_file":
        return src.replace(products=None, missing=[MISSING_SOURCE_NAME])
    if name == "pk_constraint_violation":
        return src.replace(sales=I.inject_pk_violation(src.sales))
    return src


def _apply(run: jobs.RunResult, action: str) -> None:
    if action not in run.remediations:
        run.remediations.append(action)
    run.log("info", "remediation", f"Applied {action}")


def auto_remediate(src: jobs.Sources, run: jobs.RunResult, target: str | None = None) -> jobs.Sources:
    """K9 applied: repair what the first pass measured, re-run, roll back if
    still failing.  Decisions read only the one-row metrics and the stage
    records already in the driver; the repairs themselves are lazy
    DataFrame transforms."""
    m, fixed, rerun_from = run.metrics, src, None
    if src.missing:
        rerun_from = "ingestion"                      # nothing to repair: the source must arrive
    elif m.get("schema_violations"):
        fixed = fixed.replace(sales=R.add_missing_columns(fixed.sales))
        _apply(run, "apply_schema_fix(add_missing_column_default)")
        rerun_from = "ingestion"
    elif m.get("n_type_mismatches"):
        fixed = fixed.replace(sales=R.fix_type_cast(fixed.sales))
        _apply(run, "apply_schema_fix(fix_type_cast)")
        rerun_from = "ingestion"
    elif m.get("extra_columns"):
        fixed = fixed.replace(sales=R.drop_extra_columns(fixed.sales))
        _apply(run, "apply_schema_fix(drop_extra_columns)")
        rerun_from = "ingestion"
    if not src.missing:
        if m.get("email_nulls"):
            fixed = fixed.replace(customers=R.fill_nulls(fixed.customers, "email"))
            _apply(run, "fill_null_defaults(customers.email)")
            rerun_from = rerun_from or "transform"
        load = run.stage("load")
        if m.get("duplicate_count") or (load is not None and load["status"] == "failed"):
            fixed = fixed.replace(sales=R.dedup_first(fixed.sales, "transaction_id", ["transaction_id"]))
            _apply(run, "deduplicate_records(sales)")
            rerun_from = rerun_from or "transform"
    if rerun_from is None:
        return fixed
    order = ["ingestion", "transform", "load"]
    for stage in order[order.index(rerun_from):]:
        jobs.rerun_stage(fixed, run, stage, target)
    if run.has_failures and run.stage("load") is not None and run.stage("load")["status"] == "failed":
        jobs.rollback_stage(run, "load", target)
    return fixed


def run_scenario(src: jobs.Sources, name: str, target: str | None = None,
                 remediate: bool = True) -> jobs.RunResult:
    """One whole run of a scenario (B4, then the playbook)."""
    run = jobs.run_pipeline(inject(name, src), scenario_name=name,
                            failure_type=SCENARIO_FAILURE_TYPES.get(name), target=target)
    if remediate and (run.has_failures or run.metrics.get("extra_columns") or run.metrics.get("email_nulls")
                      or run.metrics.get("duplicate_count")):
        auto_remediate(inject(name, src), run, target)
    return run


def history_outcome(run: jobs.RunResult) -> str:
    """K5 for one run."""
    if run.remediations:
        return "UNRESOLVED" if run.has_failures else "RESOLVED"
    return "FAILED" if run.has_failures else "HEALTHY"


def record_runs(spark: SparkSession, runs: list[jobs.RunResult], base: str, bucketed: bool = False) -> None:
    """Append a batch of runs to the run tables under ``base`` (B8 included).

    The records are run metadata (a few rows per run) built in the driver;
    every table is appended, never rewritten.  The ``runs`` headers are
    written last, so readers that start from ``runs`` never see a run whose
    other records are still missing.  ``bucketed`` writes the
    run_id-keyed tables bucketed by run_id (co-located joins).
    """
    for r in runs:
        jobs.record_run(spark, r, base, bucketed)
    metrics = [(r.run_id, int(r.metrics.get("sales_rows", 0)),
                int(r.metrics.get("sales_null_cells", 0)) + int(r.metrics.get("email_nulls", 0)),
                int(r.metrics.get("duplicate_count", 0)),
                int(r.metrics.get("out_of_range_count", 0)), list(r.metrics.get("schema_violations", [])),
                {"unit_price": "expected float, got string"} if r.metrics.get("n_type_mismatches") else {},
                list(r.metrics.get("extra_columns", []))) for r in runs]
    S.append_run_table(spark.createDataFrame(
        metrics, "run_id string, total_rows bigint, null_count bigint, duplicate_count bigint, "
                 "out_of_range_count bigint, schema_violations array<string>, "
                 "type_mismatches map<string,string>, extra_columns array<string>"),
        base, "quality_metrics", bucketed)
    hist = []
    for r in runs:
        latest = {}
        for s in r.stages:
            latest[s["stage_name"]] = s["status"]
        dur = (r.finished_at - r.started_at).total_seconds() if r.finished_at else None
        hist.append((r.run_id, r.scenario_name, r.failure_type, r.started_at, history_outcome(r), dur,
                     list(r.remediations), [k for k, v in latest.items() if v == "failed"],
                     (int(r.metrics.get("sales_rows", 0)),
                      int(r.metrics.get("sales_null_cells", 0)) + int(r.metrics.get("email_nulls", 0)),
                      int(r.metrics.get("duplicate_count", 0)), list(r.metrics.get("schema_violations", [])))))
    S.append_history(spark.createDataFrame(hist, S.HISTORY_SCHEMA), f"{base}/run_history")
    # the run headers go last: reports start from `runs`, so a run becomes visible
    # only once all its other records are written
    header = [(r.run_id, "sales_etl", r.scenario_name, r.started_at, r.finished_at,
               r.failure_type is not None, r.failure_type) for r in runs]
    S.append_run_table(spark.createDataFrame(header, "run_id string, pipeline_name string, scenario_name string, "
                                                     "started_at timestamp_ntz, finished_at timestamp_ntz, "
                                                     "failure_injected boolean, failure_type string"),
                       base, "runs", bucketed)


def read_run_tables(spark: SparkSession, base: str, bucketed: bool = False) -> dict[str, DataFrame]:
    """The recorded run tables, in the shapes the analytics operators take."""
    t = {n: S.read_run_table(spark, base, n, bucketed and n != "log_entries")
         for n in ("runs", "stage_results", "log_entries", "quality_metrics")}
    try:
        t["remediations"] = S.read_run_table(spark, base, "remediations", bucketed)
    except AnalysisException as exc:                # no run needed a repair yet
        if exc.getCondition() not in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"):
            raise
        t["remediations"] = spark.createDataFrame([], "run_id string, seq bigint, action string")
    h = S.read_history(spark, f"{base}/run_history")
    cols = ["run_id", "scenario_name", "failure_type", "ts", "outcome", "duration_seconds"]
    if "run_date" in h.columns:
        cols.append("run_date")                 # partition column: look-back filters prune on it
    t["run_history"] = h.select(*cols, F.col("data_quality.total_rows").alias("total_rows"),
                                F.col("data_quality.total_nulls").alias("total_nulls"),
                                F.col("data_quality.duplicate_count").alias("duplicate_count"))
    return t


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description="Run scenarios end to end and record the run tables.")
    ap.add_argument("scenario", nargs="*", help=f"scenario names (default: {' '.join(DEFAULT_SCENARIOS)})")
    ap.add_argument("--sf-dir", required=True)
    ap.add_argument("--out", required=True, help="folder for the run tables (shared storage on a cluster)")
    ap.add_argument("--no-remediation", action="store_true")
    ap.add_argument("--bucketed", action="store_true", help="write run tables bucketed by run_id")
    a = ap.parse_args(argv)
    names = a.scenario or DEFAULT_SCENARIOS
    unknown = [n for n in names if n not in SCENARIOS]
    if unknown:
        ap.error(f"unknown scenario(s) {unknown}; available: {SCENARIOS}")
    spark = SparkSession.builder.getOrCreate()
    src = jobs.Sources.from_views(spark, a.sf_dir)
    runs = []
    for name in names:
        r = run_scenario(src, name, target=f"{a.out}/sales_fact", remediate=not a.no_remediation)
        print(f"{name:30s} {history_outcome(r):10s} "
              + " ".join(f"{s['stage_name']}#{s['attempt']}={s['status']}" for s in r.stages))
        runs.append(r)
    record_runs(spark, runs, a.out, bucketed=a.bucketed)
    print(f"recorded {len(runs)} runs under {a.out} at {_dt.datetime.now(_dt.timezone.utc).isoformat()}")


if __name__ == "__main__":
    main()
