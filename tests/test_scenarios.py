"""Whole runs: every scenario, repaired by playbook, recorded and analysed."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stagewatch.functions.constants import SCENARIOS
from stagewatch.operators import history as H
from stagewatch.operators import report as K
from stagewatch.plans import scenarios as SC


@pytest.fixture(scope="module")
def runs(small_sources):
    return {name: SC.run_scenario(small_sources, name) for name in SCENARIOS}


def first_pass(run):
    return [s["status"] for s in run.stages if s["attempt"] == 1]


def test_first_pass_statuses(runs):
    assert first_pass(runs["healthy"]) == ["success", "success", "success"]
    assert first_pass(runs["schema_drift_new_column"]) == ["success", "success", "success"]
    assert first_pass(runs["schema_drift_type_change"]) == ["failed", "skipped", "skipped"]
    assert first_pass(runs["schema_drift_missing_column"]) == ["failed", "skipped", "skipped"]
    assert first_pass(runs["missing_source_file"]) == ["failed", "skipped", "skipped"]
    assert first_pass(runs["pk_constraint_violation"]) == ["success", "success", "failed"]
    assert first_pass(runs["data_quality_duplicates"]) == ["success", "success", "failed"]
    assert runs["data_quality_duplicates"].metrics["duplicate_count"] > 0


def test_outcomes_after_playbook(runs):
    out = {n: SC.history_outcome(r) for n, r in runs.items()}
    assert out["healthy"] == "HEALTHY"
    for n in ("schema_drift_new_column", "schema_drift_type_change", "schema_drift_missing_column",
              "data_quality_duplicates", "pk_constraint_violation"):
        assert out[n] == "RESOLVED", n
    assert out["missing_source_file"] == "UNRESOLVED"
    assert out["data_quality_nulls"] in ("HEALTHY", "RESOLVED")
    assert runs["schema_drift_type_change"].remediations[0] == "apply_schema_fix(fix_type_cast)"
    assert runs["pk_constraint_violation"].remediations[0] == "deduplicate_records(sales)"


def test_recorded_tables_feed_the_analytics(spark, runs, tmp_path):
    base = str(tmp_path / "tables")
    SC.record_runs(spark, list(runs.values()), base)
    t = SC.read_run_tables(spark, base)
    assert t["runs"].count() == len(SCENARIOS)
    outcome = {r["scenario_name"]: r["history_outcome"] for r in
               K.run_outcome(t["runs"], t["stage_results"], t["log_entries"], t["remediations"],
                             t["quality_metrics"]).collect()}
    assert outcome == {n: SC.history_outcome(r) for n, r in runs.items()}
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None) + dt.timedelta(minutes=5)
    trend = {r["failure_type_filter"]: r for r in H.failure_trend(t["run_history"], now).collect()}
    assert trend["all"]["total_runs"] == len(SCENARIOS)
    assert trend["all"]["failed_count"] == 1          # the missing source stays unresolved
    text = K.incident_report_text(t["runs"], t["stage_results"], t["log_entries"], t["remediations"],
                                  t["quality_metrics"])
    miss = text.join(t["runs"].where(F.col("scenario_name") == "missing_source_file"), "run_id").first()
    assert "product_catalog" in miss["report_text"] and "OUTCOME      : UNRESOLVED" in miss["report_text"]


def test_bucketed_run_tables_join_without_shuffle(spark, runs, tmp_path):
    import contextlib
    import io
    base = str(tmp_path / "bucketed")
    SC.record_runs(spark, list(runs.values()), base, bucketed=True)
    t = SC.read_run_tables(spark, base, bucketed=True)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = t["stage_results"].join(t["quality_metrics"], "run_id")
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            j.explain()
        assert "SortMergeJoin" in buf.getvalue() and "Exchange" not in buf.getvalue()
        assert j.count() == t["stage_results"].count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    outcome = {r["scenario_name"]: r["history_outcome"] for r in
               K.run_outcome(t["runs"], t["stage_results"], t["log_entries"], t["remediations"],
                             t["quality_metrics"]).collect()}
    assert outcome == {n: SC.history_outcome(r) for n, r in runs.items()}


def test_log_filter_pushes_down_on_recorded_tables(spark, runs, tmp_path):
    import contextlib
    import io

    from stagewatch.operators import runlog as L
    base = str(tmp_path / "plain")
    SC.record_runs(spark, list(runs.values()), base)
    logs = SC.read_run_tables(spark, base)["log_entries"]
    q = L.log_filter(logs, level="error", stage="ingestion")
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        q.explain()
    assert "EqualTo(level,error)" in buf.getvalue() and "EqualTo(stage,ingestion)" in buf.getvalue()
    assert q.count() >= 1


def test_cli_rejects_unknown_scenarios():
    with pytest.raises(SystemExit):
        SC.main(["--sf-dir", "/nowhere", "--out", "/nowhere", "not_a_scenario"])
