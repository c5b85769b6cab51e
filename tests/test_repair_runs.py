"""Repair of all runs in one plan equals the per-run repairs."""

from pyspark.sql import functions as F

from stagewatch.operators import repair as R
from stagewatch.operators import repair_runs as RR

COLUMNS = ["transaction_id", "customer_id", "product_id", "quantity", "unit_price", "currency", "transaction_date", "region",
           "status"]
ORDER = ["transaction_id", "quantity", "unit_price"]


def landed(spark):
    rows = []
    for run in range(6):
        for i in range(12):
            price = f"{10 + i}.5_USD" if run == 0 else ("n/a" if (run, i) == (5, 3) else f"{10 + i}.5")
            rows.append((run, f"T{i // (2 if run in (2, 4) else 1)}", "C1", "P1", i, price, "USD", "2024-01-01",
                         None if run == 1 or i == 7 else "North", None if run == 4 and i % 3 == 0 else "completed", i))
    return spark.createDataFrame(rows, "run_id int, transaction_id string, customer_id string, product_id string, "
                                       "quantity int, unit_price string, currency string, transaction_date string, "
                                       "region string, status string, loyalty_points int")


def plan(spark):
    return spark.createDataFrame([
        (0, RR.CAST, ["unit_price"]), (0, "rerun_stage(ingestion)", None), (1, RR.ADD, ["region"]),
        (2, "deduplicate_records(sales)", None), (3, RR.DROP, None), (4, "fill_null_defaults(sales.status)", ["status"]),
        (4, "deduplicate_records(sales)", None), (4, "deduplicate_records(sales)", None), (99, RR.CAST, ["unit_price"])],
        "run_id int, action string, columns array<string>")


def test_one_plan_equals_the_per_run_functions(spark):
    rows = landed(spark).repartition(4)
    got = RR.repair_runs(rows, plan(spark), order_by=ORDER).select("run_id", *COLUMNS, "loyalty_points")
    want = []
    for run in range(6):
        one = rows.where(F.col("run_id") == run).drop("run_id")
        if run == 0:
            one = R.fix_type_cast(one)
        if run == 1:
            one = R.add_missing_columns(one.drop("region"))
        if run == 3:
            one = R.drop_extra_columns(one).withColumn("loyalty_points", F.lit(None).cast("int"))
        if run == 4:
            one = R.fill_nulls(one, "status")
        one = one.withColumn("unit_price", F.col("unit_price").try_cast("double")).withColumn(
            "transaction_date", F.col("transaction_date").cast("date"))
        if run in (2, 4):
            one = R.dedup_first(one, "transaction_id", ORDER)
        want += one.select(F.lit(run).alias("run_id"), *COLUMNS, "loyalty_points").collect()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want)))


def test_effects(spark):
    rows = landed(spark)
    fixed = RR.repair_runs(rows, plan(spark), order_by=ORDER)
    got = {r.run_id: r for r in RR.repair_effects(rows, fixed, ["region", "status"]).collect()}
    assert (got[2].rows_before, got[2].rows_after) == (12, 6) and got[1].region_nulls_after == 0
    assert got[4].status_nulls_before == 4 and got[4].status_nulls_after == 0 and got[0].rows_after == 12


def test_empty_tables(spark):
    rows = landed(spark)
    assert RR.repair_runs(rows.limit(0), plan(spark)).count() == 0
    assert RR.repair_runs(rows, plan(spark).limit(0)).count() == rows.count()
