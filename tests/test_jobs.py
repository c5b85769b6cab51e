"""Scenario tests: one run per corruption, on a small fixture of our own."""

import datetime as dt

import pytest

from stagewatch.operators import faults as I
from stagewatch.operators import repair as R
from stagewatch.plans import jobs


@pytest.fixture(scope="module")
def sources(spark):
    sales = spark.createDataFrame(
        [(f"TXN{i:03d}", f"C{i % 10}", f"P{i % 5}", 1 + i % 3, 10.0 + i, ["USD", "EUR", "GBP"][i % 3],
          dt.date(2024, 1, 1 + i % 10), ["North", "South"][i % 2], "completed") for i in range(40)],
        "transaction_id string, customer_id string, product_id string, quantity int, unit_price double, "
        "currency string, transaction_date date, region string, status string")
    customers = spark.createDataFrame(
        [(f"C{i}", f"Name {i}", f"c{i}@x.com", "gold", "US", dt.date(2020, 1, 1), 10.0) for i in range(10)],
        "customer_id string, name string, email string, tier string, country string, signup_date date, "
        "lifetime_value double")
    products = spark.createDataFrame([(f"P{i}", f"Prod {i}") for i in range(5)], "product_id string, name string")
    return jobs.Sources(sales, customers, products)


def statuses(run):
    return [run.stage(s)["status"] for s in ("ingestion", "transform", "load")]


def test_healthy(sources):
    run = jobs.run_pipeline(sources)
    assert statuses(run) == ["success", "success", "success"]
    assert run.stage("ingestion")["rows_out"] == 55 and not run.has_failures
    assert run.daily.count() == 10


def test_new_column_warns_but_succeeds(sources):
    run = jobs.run_pipeline(sources.replace(sales=I.inject_new_column(sources.sales)))
    assert statuses(run) == ["success", "success", "success"]
    assert run.metrics["extra_columns"] == ["loyalty_points"]
    assert any(l["level"] == "warning" for l in run.logs)


def test_type_change_fails_ingestion_and_skips_downstream(sources):
    run = jobs.run_pipeline(sources.replace(sales=I.inject_type_change(sources.sales)))
    assert statuses(run) == ["failed", "skipped", "skipped"]
    assert run.stage("ingestion")["rows_in"] == 55 and run.stage("ingestion")["rows_out"] == 0


def test_missing_column_fails(sources):
    run = jobs.run_pipeline(sources.replace(sales=I.inject_missing_column(sources.sales)))
    assert statuses(run) == ["failed", "skipped", "skipped"]
    assert run.metrics["schema_violations"] == ["Missing required column: 'region'"]


def test_missing_source(sources):
    run = jobs.run_pipeline(sources.replace(products=None, missing=["product_catalog"]))
    assert statuses(run) == ["failed", "skipped", "skipped"]
    assert "product_catalog" in run.stage("ingestion")["error_message"]
    assert [l["level"] for l in run.logs][0] == "critical"


def test_duplicates_fail_load_then_repair(sources):
    from pyspark.sql import functions as F
    dup = sources.replace(sales=I.inject_duplicates(sources.sales, selector=F.col("quantity") == 1))
    run = jobs.run_pipeline(dup)
    assert statuses(run) == ["success", "success", "failed"]
    assert run.metrics["duplicate_count"] == 14
    fixed = dup.replace(sales=R.dedup_first(dup.sales, "transaction_id", ["transaction_id"]))
    jobs.rerun_stage(fixed, run, "transform")
    jobs.rerun_stage(fixed, run, "load")
    assert statuses(run) == ["success", "success", "success"] and not run.has_failures
    assert run.stage("load")["attempt"] == 2


def test_pk_violation_samples(sources):
    run = jobs.run_pipeline(sources.replace(sales=I.inject_pk_violation(sources.sales)))
    assert statuses(run) == ["success", "success", "failed"]
    assert run.stage("load")["error_message"] == (
        "PK constraint violation: 5 duplicate transaction_ids (e.g. ['TXN000', 'TXN001', 'TXN002'])")


def test_type_change_repaired_then_rerun(sources, tmp_path):
    bad = sources.replace(sales=I.inject_type_change(sources.sales))
    run = jobs.run_pipeline(bad)
    fixed = bad.replace(sales=R.fix_type_cast(bad.sales))
    for s in ("ingestion", "transform", "load"):
        jobs.rerun_stage(fixed, run, s, target=str(tmp_path / "fact"))
    assert statuses(run) == ["success", "success", "success"]
    assert run.remediations == ["rerun_stage(ingestion)", "rerun_stage(transform)", "rerun_stage(load)"]
    written = run.stage("load")["rows_out"]
    assert written == 40 and run.stages[-1]["rows_out"] == written
    spark = sources.sales.sparkSession
    assert spark.read.parquet(str(tmp_path / "fact")).where(f"run_id = '{run.run_id}'").count() == 40
    other = jobs.run_pipeline(sources, target=str(tmp_path / "fact"))
    jobs.rollback_stage(run, "load", str(tmp_path / "fact"))
    assert run.stage("load")["status"] == "skipped"
    left = {r["run_id"] for r in spark.read.parquet(str(tmp_path / "fact")).select("run_id").distinct().collect()}
    assert left == {other.run_id}
    with pytest.raises(ValueError):
        jobs.rollback_stage(run, "ingestion")


def test_duplicate_lookup_keys_fail_transform(sources):
    dup_c = sources.customers.unionByName(sources.customers.limit(1))
    run = jobs.run_pipeline(sources.replace(customers=dup_c))
    assert statuses(run) == ["success", "failed", "skipped"]
    assert "not unique" in run.stage("transform")["error_message"]


def test_healthy_produces_enriched_data(sources):
    run = jobs.run_pipeline(sources)
    cols = run.enriched.columns
    assert {"unit_price_usd", "revenue_usd", "customer_name", "customer_tier"} <= set(cols)
    assert run.enriched.count() == 40 and run.run_id


def test_failed_run_without_repair_is_failed(small_sources):
    from stagewatch.plans import scenarios as SC
    run = SC.run_scenario(small_sources, "schema_drift_missing_column", remediate=False)
    assert SC.history_outcome(run) == "FAILED" and run.remediations == []


def test_rerun_replaces_all_partitions_of_the_run(sources, tmp_path):
    target = str(tmp_path / "fact")
    run = jobs.run_pipeline(sources, target=target)
    fewer = sources.replace(sales=sources.sales.where("transaction_date = date '2024-01-03'"))
    for s in ("ingestion", "transform", "load"):
        jobs.rerun_stage(fewer, run, s, target=target)
    table = sources.sales.sparkSession.read.parquet(target)
    assert {str(r["transaction_date"]) for r in table.select("transaction_date").distinct().collect()} == {"2024-01-03"}
    assert run.stage("load")["rows_out"] == table.count() == 4


def test_any_error_makes_a_failed_stage(sources):
    broken = sources.replace(customers=sources.customers.drop("tier"))
    run = jobs.run_pipeline(broken)
    assert statuses(run) == ["success", "failed", "skipped"]
    assert "tier" in run.stage("transform")["error_message"] and run.has_failures
    assert any(l["level"] == "error" and l["stage"] == "transform" for l in run.logs)


def test_ingestion_log_has_samples_and_percentages(sources):
    import json
    bad = sources.replace(sales=I.inject_type_change(sources.sales),
                          customers=I.inject_nulls(sources.customers, "email", selector=sources.customers.customer_id == "C1"))
    run = jobs.run_pipeline(bad)
    details = {l["message"][:10]: json.loads(l["details"]) for l in run.logs}
    assert details["Type misma"]["sample_values"] == ["10.0_USD", "11.0_USD", "12.0_USD"]
    assert details["Null email"]["null_pct"] == 10.0


def test_out_of_range_values_are_counted(sources):
    from pyspark.sql import functions as F
    low = sources.replace(sales=sources.sales.withColumn("quantity", F.when(F.col("transaction_id") < "TXN003", 0)
                                                         .otherwise(F.col("quantity"))))
    run = jobs.run_pipeline(low)
    assert run.metrics["out_of_range_count"] == 3


def test_column_profile(sources):
    got = {(r["dataset"], r["column_name"]): (r["null_count"], r["null_pct"]) for r in jobs.column_profile(
        sources.replace(customers=I.inject_nulls(sources.customers, "email",
                                                 selector=sources.customers.customer_id.isin("C1", "C2", "C3")))).collect()}
    assert got["customers", "email"] == (3, 30.0) and got["sales", "region"] == (0, 0.0) and len(got) == 18
