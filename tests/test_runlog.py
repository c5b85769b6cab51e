"""Run-table operators on small literal tables (modelled on the tool tests)."""

import datetime as dt

import pytest

from stagewatch.operators import report as K
from stagewatch.operators import runlog as L

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)
STAGE_SCHEMA = ("run_id string, stage_name string, stage_ordinal int, attempt int, status string, rows_in bigint, "
                "rows_out bigint, started_at timestamp_ntz, finished_at timestamp_ntz, error_message string")
LOG_SCHEMA = "run_id string, seq bigint, ts timestamp_ntz, level string, stage string, message string, details string"


def st(run, name, attempt, status, err=None):
    o = {"ingestion": 1, "transform": 2, "load": 3}[name]
    return (run, name, o, attempt, status, 10, 10 if status == "success" else 0, T0, T0, err)


@pytest.fixture(scope="module")
def tables(spark):
    stages = spark.createDataFrame([
        st("ok", "ingestion", 1, "success"), st("ok", "transform", 1, "success"), st("ok", "load", 1, "success"),
        st("bad", "ingestion", 1, "failed", "Schema validation errors"), st("bad", "transform", 1, "skipped"),
        st("bad", "load", 1, "skipped"),
        st("fixed", "ingestion", 1, "success"), st("fixed", "transform", 1, "success"),
        st("fixed", "load", 1, "failed", "PK constraint violation"), st("fixed", "load", 2, "success"),
        st("two", "ingestion", 1, "success"), st("two", "transform", 1, "failed", "boom"),
        st("two", "load", 1, "failed", "later"),
    ], STAGE_SCHEMA)
    logs = spark.createDataFrame([
        ("bad", 0, T0, "error", "ingestion", "missing region", "{\"k\": 1}"),
        ("bad", 1, T0, "critical", "ingestion", "stop", "{}"),
        ("bad", 2, T0, "warning", "transform", "skipped", "{}"),
        ("fixed", 0, T0, "error", "load", "pk", "{}"),
        ("ok", 0, T0, "info", "load", "done", "{}"),
    ], LOG_SCHEMA)
    calls = spark.createDataFrame([("fixed", 0, "deduplicate_records(sales)"), ("fixed", 1, "rerun_stage(load)"),
                                   ("fixed", 2, "deduplicate_records(sales)")], "run_id string, seq bigint, action string")
    runs = spark.createDataFrame([(r, "sales_etl", r, T0, T0, r != "ok", None if r == "ok" else "x")
                                  for r in ("ok", "bad", "fixed", "two")],
                                 "run_id string, pipeline_name string, scenario_name string, started_at timestamp_ntz, "
                                 "finished_at timestamp_ntz, failure_injected boolean, failure_type string")
    metrics = spark.createDataFrame([(r, 10, 0, 0, 0, [], {}, []) for r in ("ok", "bad", "fixed", "two")],
                                    "run_id string, total_rows bigint, null_count bigint, duplicate_count bigint, "
                                    "out_of_range_count bigint, schema_violations array<string>, "
                                    "type_mismatches map<string,string>, extra_columns array<string>")
    return runs, stages, logs, calls, metrics


def by_run(df):
    return {r["run_id"]: r for r in df.collect()}


def test_latest_attempt_and_rollup(tables):
    _, stages, *_ = tables
    la = {(r["run_id"], r["stage_name"]): r["attempt"] for r in L.latest_attempt(stages).collect()}
    assert la[("fixed", "load")] == 2 and len(la) == 12
    roll = by_run(L.stage_status_rollup(stages))
    assert roll["fixed"]["failed_stages"] == "" and roll["bad"]["skipped_stages"] == "transform,load"
    assert roll["two"]["failed_stages"] == "transform,load" and roll["two"]["n_failed"] == 2


def test_overall_status_keeps_first_pass(tables):
    _, stages, *_ = tables
    s = by_run(L.overall_status(stages))
    assert (s["fixed"]["overall_status"], s["fixed"]["current_status"]) == ("failed", "success")
    assert s["ok"]["overall_status"] == "success"


def test_stage_gate(tables):
    _, stages, *_ = tables
    g = by_run(L.stage_gate(stages))
    assert not g["bad"]["transform_allowed"] and g["bad"]["gate_ok"]
    assert g["ok"]["gate_ok"] and g["ok"]["load_allowed"]
    assert not g["two"]["load_allowed"] and not g["two"]["gate_ok"]   # load ran after a failed transform


def test_root_cause_reads_latest_attempt_and_lists_later_stages(tables):
    _, stages, logs, *_ = tables
    rc = by_run(L.root_cause(stages, logs))
    assert rc["bad"]["root_stage"] == "ingestion" and rc["bad"]["downstream_impact"] == "transform,load"
    assert rc["bad"]["total_errors"] == 2
    assert rc["fixed"]["root_stage"] is None            # the repaired load no longer carries its error
    assert rc["two"]["root_stage"] == "transform" and rc["two"]["downstream_impact"] == "load"


def test_error_chain_long_form(tables):
    _, stages, logs, *_ = tables
    rows = [r for r in L.error_chain(stages, logs).collect() if r["run_id"] == "bad" and r["stage_name"] == "ingestion"]
    assert sorted(r["log_message"] for r in rows) == ["missing region", "stop"]
    assert all(r["n_error_logs"] == 2 for r in rows)


def test_log_operators(tables):
    _, _, logs, *_ = tables
    assert L.log_filter(logs, "error").count() == 2 and L.log_filter(logs, stage="load").count() == 2
    assert L.log_filter(logs, "error", "load").count() == 1
    ec = by_run(L.error_counts(logs))
    assert (ec["bad"]["error_count"], ec["bad"]["warning_count"]) == (2, 1)
    assert {(r["run_id"], r["level"]): r["n"] for r in L.severity_counts(logs).collect()}[("bad", "critical")] == 1
    assert L.log_details(logs, "k").where("seq = 0 and run_id = 'bad'").first()["detail_k"] == "1"


def test_ledger_and_outcomes(tables):
    runs, stages, logs, calls, metrics = tables
    led = by_run(L.remediation_ledger(calls))
    assert led["fixed"]["remediation_applied"] == "deduplicate_records(sales) | rerun_stage(load)"
    assert led["fixed"]["remediation_count"] == 2
    out = by_run(K.run_outcome(runs, stages, logs, calls, metrics))
    assert (out["fixed"]["history_outcome"], out["fixed"]["report_outcome"]) == ("RESOLVED", "RESOLVED")
    assert (out["bad"]["history_outcome"], out["bad"]["report_outcome"]) == ("FAILED", "UNRESOLVED")
    assert out["ok"]["history_outcome"] == "HEALTHY"
    health = by_run(K.pipeline_health(runs, stages, logs, calls, metrics))
    assert health["ok"]["health"] == "HEALTHY" and health["bad"]["health"] == "FAILED"
    rep = by_run(K.incident_report(runs, stages, logs, calls, metrics))
    assert (rep["two"]["health_status"], rep["two"]["severity"]) == ("FAILED", "HIGH")
    assert (rep["bad"]["severity"], rep["ok"]["severity"]) == ("MEDIUM", "NONE")
    assert rep["ok"]["recommendations"] == "Continue monitoring. No significant issues detected."


def test_text_report_is_the_ordered_lines(tables):
    runs, stages, logs, calls, metrics = tables
    text = by_run(K.incident_report_text(runs, stages, logs, calls, metrics))["bad"]["report_text"]
    lines = text.split("\n")
    assert lines[0] == "=" * 70 and lines[1] == "  ETL PIPELINE INCIDENT REPORT"
    assert "  ✗ ingestion    | failed       | in=   10 out=    0 | ERR: Schema validation errors" in lines
    i = lines.index("ERRORS DETECTED")
    assert lines[i + 1:i + 3] == ["  [ERROR] [ingestion] missing region", "  [CRITICAL] [ingestion] stop"]
    assert lines[lines.index("REMEDIATION APPLIED") + 1] == "  None required"


def test_stage_metrics_one_stage_and_unknown_name(tables):
    _, stages, _, _, metrics = tables
    m = L.stage_metrics(stages, metrics, "load")
    assert {r["stage_name"] for r in m.collect()} == {"load"} and m.count() == 4
    assert L.stage_metrics(stages, metrics, "ingestion").where("run_id = 'ok'").first()["total_rows"] == 10
    with pytest.raises(ValueError, match="available stages"):
        L.stage_metrics(stages, metrics, "publish")
