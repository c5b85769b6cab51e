"""Types found from data and keys published before."""

import pytest
from pyspark.sql import functions as F

from stagewatch.operators import found_types as D
from stagewatch.operators.key_index import KeyIndex, blocks_for


def rules(spark, *rows):
    return spark.createDataFrame([("t", *r) for r in rows], "dataset string, column_name string, expected_type string")


def test_lattice(spark):
    columns = {"i": ["1", "-20", " 3 ", None], "f": ["1", "2.5", "-.5e3", "7."], "d": ["2024-02-29", "1999-12-31", None, ""],
               "b": ["true", "FALSE", "True", None], "mixed": ["1", "true", "2024-01-01", "x"], "none": [None, "", " ", None],
               "bad day": ["2024-02-30", "2024-01-01", None, None], "long": ["1" * 19, "1", None, None]}
    frame = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"`{c}` string" for c in columns)).repartition(3)
    found = {r.column_name: r.t for r in D.type_counts(frame, "t").select("column_name", D.found_type().alias("t")).collect()}
    assert found == {"i": "integer", "f": "float", "d": "date", "b": "boolean", "mixed": "string", "none": "none",
                     "bad day": "string", "long": "float"}
    declared = rules(spark, ("i", "float"), ("f", "integer"), ("d", "date"), ("mixed", "string"), ("none", "integer"),
                     ("bad day", "date"), ("b", "float"), ("absent", "date"))
    got = {r.column_name: (r.conforms, r.n_bad, r.counterexample) for r in
           D.type_conformance(D.type_counts(frame, "t"), declared).collect()}
    assert got == {"i": (True, 0, None), "f": (False, 3, "-.5e3"), "d": (True, 0, None), "mixed": (True, 0, None),
                   "none": (True, 0, None), "bad day": (False, 1, "2024-02-30"), "b": (False, 3, "FALSE")}


def test_values_are_not_sorted(spark):
    frame = spark.range(1000).select(F.col("id").alias("a.b"), F.when(F.col("id") > 5, F.col("id") / 4).alias("f"))
    found = D.type_counts(frame, "t")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Sort [" not in plan and "Generate explode" not in plan
    assert {r.column_name: (r.n_values, r.n_integer, r.not_integer, r.n_float) for r in found.collect()} == {
        "a.b": (1000, 1000, None, 1000), "f": (994, 0, "1.5", 994)}
    assert D.type_counts(frame.limit(0), "t").count() == 0
    nulls = D.type_counts(spark.createDataFrame([(None, " ")] * 3, "x int, y string"), "t")
    assert [(r.column_name, r.n_values, r.n_date, r.not_date) for r in nulls.collect()] == [("x", 0, 0, None), ("y", 0, 0, None)]


def test_profiles_of_loads_merge(spark):
    frame = spark.range(100).select(F.when(F.col("id") == 77, "x").otherwise(F.col("id").cast("string")).alias("a"),
                                    F.col("id").alias("b"))
    parts = [D.type_counts(frame.where(F.col("id") % 3 == k), "t") for k in range(3)]
    assert sorted(D.merge_type_counts(parts).collect()) == sorted(D.type_counts(frame, "t").collect())


@pytest.mark.parametrize("blocks", [1, 7, 1 << 16])
def test_keys_of_earlier_loads(spark, tmp_path, blocks):
    index = KeyIndex(str(tmp_path / "keys"), blocks)
    frame = lambda low, high: spark.range(low, high).select(F.col("id").alias("k"))
    assert index.repeated(frame(0, 10), "k").count() == 0
    index.add(frame(0, 100), "k", "a")
    index.add(frame(90, 150).unionByName(frame(90, 95)), "k", "b")
    new = frame(80, 200).unionByName(frame(85, 88)).unionByName(spark.createDataFrame([(None,), (None,)], "k long"))
    got = {int(r.key): (r.n_rows, r.first_load, r.loads) for r in index.repeated(new, "k", "c").collect()}
    assert got == {k: (2 if 85 <= k < 88 else 1, "a" if k < 100 else "b", 2 if 90 <= k < 100 else 1) for k in range(80, 150)}
    index.add(frame(80, 200), "k", "c")
    assert {int(r.key) for r in index.repeated(new, "k", "c").collect()} == set(range(80, 150))     # not its own
    index.add(frame(500, 510), "k", "c")                                                            # done again
    assert index.repeated(frame(160, 200), "k", "d").count() == 0
    assert index.repeated(frame(495, 520), "k", "d").count() == 10


def test_filters_turn_strange_keys_away(spark, tmp_path):
    index = KeyIndex(str(tmp_path / "keys"), blocks_for(20_000))
    index.add(spark.range(20_000).select(F.col("id").alias("k")), "k", "a")
    assert index.filters(spark).count() == 100
    strange = index._counted(spark.range(50_000, 70_000).select(F.col("id").alias("k")), "k")
    from stagewatch.operators.key_index import _may_hold
    f = index.filters(spark).select(F.col("block").alias("b"), "bits")
    passed = strange.join(f, (F.col("block") == F.col("b")) & _may_hold(F.col("bits"), F.col("key")), "left_semi").count()
    assert passed < 1200


def test_stream_finds_keys_of_earlier_batches(spark, tmp_path):
    from stagewatch.streaming.monitor import start_quality_stream
    source, schema = str(tmp_path / "in"), "transaction_id string, unit_price double"
    index = KeyIndex(str(tmp_path / "keys"), 16)

    def run():
        start_quality_stream(spark, source, schema, str(tmp_path / "metrics"), str(tmp_path / "ckpt"),
                             key_index=index).awaitTermination()

    spark.createDataFrame([("a", 1.0), ("b", 2.0)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    spark.createDataFrame([("b", 1.0), ("b", 2.0), ("c", 3.0)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    got = {r.batch_id: (r.value, r.total_rows) for r in spark.read.parquet(str(tmp_path / "metrics"))
           .where("metric = 'repeated_keys'").collect()}
    assert got == {0: (0, 2), 1: (2, 3)}
