"""Operator unit tests on small literal DataFrames."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from stagewatch.operators import contracts as C
from stagewatch.operators import faults as I
from stagewatch.operators import profile as Q
from stagewatch.operators import repair as R
from stagewatch.operators import transform as tr


def test_null_profile_counts_nan_and_skips_clean_columns(spark):
    df = spark.createDataFrame([(1, None, float("nan")), (2, "x", 1.0), (3, None, None)],
                               "id int, s string, v double")
    rows = {r["column_name"]: r for r in Q.null_profile(df, "t").collect()}
    assert set(rows) == {"s", "v"}
    assert rows["s"]["null_count"] == 2 and rows["v"]["null_count"] == 2
    assert math.isclose(rows["s"]["null_pct"], 200 / 3)


def test_duplicate_count_null_keys_form_one_group(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "k string")
    r = Q.duplicate_count(df, "k").first()
    assert r["duplicate_count"] == 2 and r["distinct_keys"] == 3


def test_pk_violation_samples_repeat_non_first_occurrences(spark):
    df = spark.createDataFrame([("a",), ("a",), ("a",), ("b",), ("b",), ("c",)], "transaction_id string")
    r = Q.pk_violations(df).first()
    assert r["duplicate_count"] == 3
    assert r["sample_ids"] == "a, a, b"
    assert r["message"] == "PK constraint violation: 3 duplicate transaction_ids (e.g. ['a', 'a', 'b'])"
    clean = spark.createDataFrame([("a",), ("b",)], "transaction_id string")
    c = Q.pk_violations(clean).first()
    assert c["violated"] is False and c["sample_ids"] is None and c["message"] is None
    assert c["duplicate_count"] == 0


def test_fix_type_cast_extracts_first_number(spark):
    df = spark.createDataFrame([("29.99_USD",), ("abc",), ("1.2.3",), ("-5.0",), (None,)], "unit_price string")
    got = [r[0] for r in R.fix_type_cast(df).collect()]
    assert got[0] == 29.99 and got[1] is None and got[2] is None and got[3] == 5.0 and got[4] is None
    num = spark.createDataFrame([(1.5,)], "unit_price double")
    assert R.fix_type_cast(num) is num


def test_fill_nulls_type_checked(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0)], "id int, v double")
    with pytest.raises(R.RepairError):
        R.fill_nulls(df, "v", "UNKNOWN")
    with pytest.raises(R.RepairError):
        R.fill_nulls(df, "missing", "0")
    assert [r[1] for r in R.fill_nulls(df, "v", 0).orderBy("id").collect()] == [0.0, 3.0]
    eff = R.fill_nulls_effect(df, "v", 0).first()
    assert (eff["nulls_before"], eff["nulls_after"], eff["rows_fixed"]) == (1, 0, 1)


def test_fx_convert_rates_and_defaults(spark):
    df = spark.createDataFrame([("t1", 10, 2, "EUR"), ("t2", 10, 1, "XYZ"), ("t3", 10, 1, None)],
                               "transaction_id string, unit_price int, quantity int, currency string")
    out = {r["transaction_id"]: r for r in tr.fx_convert(df).collect()}
    assert float(out["t1"]["unit_price_usd"]) == 10.8 and float(out["t1"]["revenue_usd"]) == 21.6
    assert float(out["t2"]["unit_price_usd"]) == 10.0 and float(out["t3"]["unit_price_usd"]) == 10.0
    no_cur = df.drop("currency")
    assert float(tr.fx_convert(no_cur).first()["unit_price_usd"]) == 10.0
    rates = spark.createDataFrame([("EUR", 2.0)], "currency string, rate double")
    assert float(tr.fx_convert(df, rates).where("transaction_id = 't1'").first()["unit_price_usd"]) == 20.0
    with pytest.raises(tr.TransformError):
        tr.fx_convert(df.withColumn("unit_price", F.lit("1_USD")))


def test_enrichment_defaults_only_for_unmatched(spark):
    sales = spark.createDataFrame([("t1", 1), ("t2", 2)], "transaction_id string, customer_id int")
    cust = spark.createDataFrame([(1, None, "gold")], "customer_id int, name string, tier string")
    out = {r["transaction_id"]: r for r in tr.enrich_customers(sales, cust).collect()}
    assert out["t1"]["customer_name"] is None and out["t1"]["customer_tier"] == "gold"
    assert out["t2"]["customer_name"] == "Unknown" and out["t2"]["customer_tier"] == "unknown"


def test_daily_aggregation_semantics(spark):
    d1 = dt.date(2024, 1, 15)
    df = spark.createDataFrame(
        [("a", d1, 100.0), ("a", d1, 50.0), ("b", d1, None), ("c", None, 10.0)],
        "transaction_id string, transaction_date date, revenue_usd double")
    rows = tr.daily_aggregation(df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert r["total_revenue"] == 150.0 and r["transaction_count"] == 2 and r["avg_order_value"] == 75.0
    assert tr.daily_aggregation(df.drop("transaction_date")).count() == 0


def test_dedup_first_keeps_first_in_order(spark):
    df = spark.createDataFrame([("k", 3, "c"), ("k", 1, "a"), ("j", 2, "b")], "key string, o int, v string")
    got = {r["key"]: r["v"] for r in R.dedup_first(df, "key", ["o"]).collect()}
    assert got == {"k": "a", "j": "b"}
    eff = R.dedup_effect(df, "key", "t").first()
    assert (eff["rows_before"], eff["rows_after"], eff["rows_removed"]) == (3, 2, 1)


def test_inject_pk_violation_maps_last_rows_to_first_keys(spark):
    df = spark.createDataFrame([(f"T{i:03d}", i) for i in range(10)], "transaction_id string, v int")
    out = {r["v"]: r["transaction_id"] for r in I.inject_pk_violation(df).collect()}
    assert [out[i] for i in range(5, 10)] == ["T000", "T001", "T002", "T003", "T004"]
    assert Q.duplicate_count(I.inject_pk_violation(df), "transaction_id").first()["duplicate_count"] == 5
    small = df.limit(5)
    assert Q.duplicate_count(I.inject_pk_violation(small), "transaction_id").first()["duplicate_count"] == 0


def test_injectors(spark):
    df = spark.createDataFrame([("t1", 59.98, 1)], "transaction_id string, unit_price double, quantity int")
    assert I.inject_new_column(df).first()["loyalty_points"] == 599
    assert I.inject_type_change(df).first()["unit_price"] == "59.98_USD"
    assert "unit_price" not in I.inject_missing_column(df, "unit_price").columns
    c = spark.range(100).withColumn("email", F.lit("x"))
    assert I.inject_nulls(c, "email", selector=I.key_fraction("id", 0.3)).where("email is null").count() == 30
    assert I.inject_duplicates(c, selector=I.key_fraction("id", 0.15)).count() == 115


def test_schema_drift_variants(spark):
    base = spark.createDataFrame([("t", 1, 2, 3, 1.0, "USD", dt.date(2024, 1, 1), "North", "completed")],
                                 "transaction_id string, customer_id int, product_id int, quantity int, "
                                 "unit_price double, currency string, transaction_date date, region string, "
                                 "status string")
    variants = {"ok": ("sales", base), "new": ("sales", I.inject_new_column(base)),
                "typed": ("sales", I.inject_type_change(base)), "missing": ("sales", base.drop("region"))}
    res = {r["dataset"]: r for r in C.schema_drift(C.all_datasets_schema(spark, variants),
                                                    C.contract_table(spark)).collect()}
    assert not res["ok"]["drift_detected"]
    assert res["new"]["extra_columns"] == "loyalty_points"
    assert res["typed"]["type_issue_columns"] == "unit_price"
    assert res["missing"]["missing_columns"] == "region"
    samples = {r["dataset"]: r["sample_values"] for r in
               C.type_issue_samples(variants, ["transaction_id"]).collect()}
    assert samples == {"typed": "1.0_USD"}


def test_rule_violations(spark):
    df = spark.createDataFrame([(0, "USD"), (5, "XXX"), (None, None)], "quantity int, currency string")
    got = {(r["column_name"], r["rule"]): r["violations"] for r in C.rule_violations(df, "sales").collect()}
    assert got[("quantity", "range")] == 1
    assert got[("currency", "allowed")] == 1
    assert got[("quantity", "required")] == 1


def test_dedup_conflicts_separates_copies_from_lost_rows(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 5)], "k string, v int")
    r = R.dedup_conflicts(df, "k", ["v"], "t").first()
    assert (r["rows_before"], r["rows_after"]) == (4, 2)
    assert (r["removed_identical"], r["removed_conflicting"], r["conflicting_keys"]) == (1, 1, 1)


def test_dedup_conflicts_equal_the_row_by_row_count(spark):
    import random
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", "c", None]) if i % 3 else "hot", rnd.choice([None, 1, 2]),
             rnd.choice([None, float("nan"), 0.0, -0.0, 2.5]), rnd.choice([None, "", "x"])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v int, w double, t string")
    kept = {r["k"]: r for r in R.dedup_first(df, "k", ["v"]).collect()}
    text = lambda r: tuple("nan" if c != c else c for c in r)
    same = [text(r) == text(kept[r["k"]]) for r in df.collect()]
    lost = {r["k"] for r, s in zip(df.collect(), same) if not s}
    got = R.dedup_conflicts(df, "k", ["v"], "t").first()
    assert (got["rows_before"], got["rows_after"], got["removed_identical"], got["removed_conflicting"],
            got["conflicting_keys"]) == (300, len(kept), sum(same) - len(kept), 300 - sum(same), len(lost))
    assert tuple(R.dedup_conflicts(df.limit(0), "k").first())[1:] == (0, 0, 0, 0, 0)


def test_repair_dispatchers(spark):
    df = spark.createDataFrame([("t1", "1.5_USD", 9), ("t1", "2.0_USD", 9)],
                               "transaction_id string, unit_price string, loyalty_points int")
    assert R.apply_schema_fix(df, "fix_type_cast").schema["unit_price"].dataType.simpleString() == "double"
    assert "loyalty_points" not in R.apply_schema_fix(df, "drop_extra_columns").columns
    assert "region" in R.apply_schema_fix(df, "add_missing_column_default").columns
    with pytest.raises(R.RepairError, match="Unknown fix_type"):
        R.apply_schema_fix(df, "rename")
    assert R.deduplicate(df, "sales").count() == 1
    no_key = df.drop("transaction_id")
    assert R.deduplicate(no_key.unionByName(no_key), "sales").count() == 2      # whole-row fallback
    with pytest.raises(R.RepairError):
        R.deduplicate(df, "orders")


def test_inject_pk_violation_keeps_equal_rows_apart(spark):
    df = spark.createDataFrame([(f"T{i:03d}", i) for i in range(8)] + [("T900", 9)] * 5, "transaction_id string, v int")
    out = I.inject_pk_violation(df).collect()
    assert len(out) == 13 and sorted(r["transaction_id"] for r in out if r["v"] == 9) == [f"T{i:03d}" for i in range(5)]


def test_rates_table_is_joined_on_a_unique_key(spark):
    df = spark.createDataFrame([("t1", 10, 1, "EUR", dt.date(2024, 1, 1)), ("t2", 10, 1, "EUR", dt.date(2024, 1, 2)),
                                ("t3", 10, 1, "EUR", dt.date(2024, 1, 3))],
                               "transaction_id string, unit_price int, quantity int, currency string, transaction_date date")
    rates = spark.createDataFrame([("EUR", dt.date(2024, 1, 1), 2.0), ("EUR", dt.date(2024, 1, 2), 3.0)],
                                  "currency string, transaction_date date, rate double")
    got = {r["transaction_id"]: float(r["unit_price_usd"]) for r in tr.fx_convert(df, rates).collect()}
    assert got == {"t1": 20.0, "t2": 30.0, "t3": 10.0}
    with pytest.raises(tr.TransformError, match="not unique"):
        tr.fx_convert(df, rates.drop("transaction_date"))


def test_column_names_with_dots(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "a", "2")], "`a.b` int, `c.d` string, e string")
    assert {r["column_name"]: r["null_count"] for r in Q.null_profile(df, "t").collect()} == {"c.d": 1}
    assert Q.duplicate_count(df, "a.b").first()["duplicate_count"] == 1
    assert Q.type_mismatch_counts(df, ["c.d", "e"]).count() == 2
    rules = [("a.b", "integer", True, False, 2, None, None), ("e", "integer", False, False, None, None, None)]
    got = {(r["column_name"], r["rule"]): r["violations"] for r in C.rule_violations(df, "t", rules).collect()}
    assert got == {("a.b", "required"): 0, ("a.b", "range"): 2, ("e", "type"): 1}
    assert {r["column_name"]: r["violations"] for r in C.uniqueness_violations(df, ["a.b", "c.d"], "t").collect()} == {
        "a.b": 1, "c.d": 0}


def test_long_names_are_never_cut(spark):
    from stagewatch.operators import report as K
    r = spark.createDataFrame([("reconciliation_stage",), ("load",)], "n string").select(K._padded("n").alias("p"))
    assert [x["p"] for x in r.collect()] == ["reconciliation_stage", "load        "]
