"""File sources and sinks: CSV/JSON reads, contracts, arrival, writes, history."""

import datetime as dt
import json

import pytest

from pyspark.sql import functions as F

from stagewatch.functions.constants import SALES_RULES
from stagewatch.operators import contracts as C
from stagewatch.sources import files as S

CSV = """transaction_id,customer_id,product_id,quantity,unit_price,currency,transaction_date,region,status
TXN001,C001,P001,2,29.99,USD,2024-01-15,North,completed
TXN002,C002,P002,1,NA,EUR,2024-01-15,South,completed
TXN003,C003,P003,3,5.00_USD,,2024-01-16,n/a,refunded
"""


def test_csv_text_read_normalises_na_tokens(spark, tmp_path):
    p = tmp_path / "sales.csv"
    p.write_text(CSV)
    raw = S.read_csv(spark, str(p))
    assert all(f.dataType.simpleString() == "string" for f in raw.schema.fields)
    rows = {r["transaction_id"]: r for r in raw.collect()}
    assert rows["TXN002"]["unit_price"] is None and rows["TXN003"]["region"] is None
    assert rows["TXN003"]["currency"] is None
    # the text read exposes the drifted value; a typed read would hide it as null
    assert C.rule_violations(raw, "sales", kinds=("range",)).where("column_name = 'unit_price'").first()["violations"] == 0
    typed = S.read_csv(spark, str(p), S.contract_schema(SALES_RULES))
    assert typed.schema["quantity"].dataType.simpleString() == "bigint"
    assert typed.where("transaction_id = 'TXN003'").first()["unit_price"] is None
    assert typed.where("transaction_id = 'TXN003'").first()["region"] is None


def test_json_array_needs_multiline(spark, tmp_path):
    p = tmp_path / "customers.json"
    p.write_text(json.dumps([{"customer_id": f"C{i}", "email": None if i == 1 else f"c{i}@x"} for i in range(3)],
                            indent=2))
    df = S.read_json(spark, str(p))
    assert df.count() == 3 and "_corrupt_record" not in df.columns
    assert df.where("email is null").count() == 1


def test_read_contract_file(spark, tmp_path):
    p = tmp_path / "contract.json"
    p.write_text(json.dumps({"name": "sales", "columns": {
        "transaction_id": {"type": "string", "required": True, "unique": True},
        "quantity": {"type": "integer", "required": True, "min": 1, "max": 10000},
        "currency": {"type": "string", "allowed_values": ["USD", "EUR"]}}}))
    rows = S.read_contract(spark, str(p), "sales").orderBy("ordinal").collect()
    assert [r["column_name"] for r in rows] == ["transaction_id", "quantity", "currency"]
    assert rows[0]["is_unique"] and rows[1]["min_value"] == 1.0 and rows[1]["max_value"] == 10000.0
    assert rows[2]["allowed_values"] == ["USD", "EUR"] and rows[2]["required"] is False


def test_resolve_sources_and_arrival(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a"))
    found, missing = S.resolve_sources(spark, {"b": spark.range(1)},
                                       {"a": (str(tmp_path / "a"), "parquet"), "b": (str(tmp_path / "nope"), "parquet"),
                                        "c": (str(tmp_path / "nope2"), "parquet")})
    assert set(found) == {"a", "b"} and missing == ["c"]
    arr = {r["source"]: r for r in S.source_arrival(spark, {"a": str(tmp_path / "a"),
                                                            "c": str(tmp_path / "nope2")}).collect()}
    assert arr["a"]["landed"] and arr["a"]["row_count"] == 3
    assert not arr["c"]["landed"] and arr["c"]["message"] == "Source file for 'c' not found in data lake."


def test_partitioned_write_replaces_only_its_partitions(spark, tmp_path):
    out = str(tmp_path / "fact")
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    S.write_partitioned(spark.createDataFrame([(1, d1), (2, d2)], "v int, day date"), out, ["day"])
    S.write_partitioned(spark.createDataFrame([(9, d1)], "v int, day date"), out, ["day"], cluster_by=["v"])
    got = sorted((r["v"], str(r["day"])) for r in spark.read.parquet(out).collect())
    assert got == [(2, "2024-01-02"), (9, "2024-01-01")]


def test_history_store(spark, tmp_path):
    path = str(tmp_path / "history")
    assert S.read_history(spark, path).count() == 0
    rec = spark.createDataFrame([("r1", "healthy", None, dt.datetime(2024, 1, 1, 10), "HEALTHY", 1.5, [], [],
                                  (200, 0, 0, []))], S.HISTORY_SCHEMA)
    S.append_history(rec, path)
    S.append_history(rec.withColumn("run_id", F.lit("r2")), path)
    h = S.read_history(spark, path)
    assert h.count() == 2 and h.first()["data_quality"]["total_rows"] == 200
    bad = tmp_path / "broken"
    (bad / "run_date=2024-01-01").mkdir(parents=True)
    (bad / "run_date=2024-01-01" / "part-0.parquet").write_bytes(b"not a parquet file")
    with pytest.raises(Exception):                   # an unreadable file is an error, not an empty history
        S.read_history(spark, str(bad)).count()


def test_history_lookback_prunes_date_partitions(spark, tmp_path):
    import contextlib
    import io

    from stagewatch.operators import history as H
    path = str(tmp_path / "h")
    recs = [(f"r{i}", "s", None, dt.datetime(2024, 1, 1 + i, 12), "HEALTHY", 1.0, [], [], (10, 0, 0, []))
            for i in range(5)]
    S.append_history(spark.createDataFrame(recs, S.HISTORY_SCHEMA), path)
    h = S.read_history(spark, path)
    win = H.within(h, "2024-01-05 18:00:00", 24)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        win.explain()
    assert "PartitionFilters: [isnotnull(run_date" in buf.getvalue()
    assert [r["run_id"] for r in win.collect()] == ["r4"]


def test_contract_file_drives_rule_evaluation(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"name": "t", "columns": {
        "qty": {"type": "integer", "required": True, "min": 1, "max": 5},
        "cur": {"type": "string", "allowed_values": ["USD"]}}}))
    rules = C.rules_from_contract(S.read_contract(spark, str(p), "t"))
    assert [r[0] for r in rules] == ["qty", "cur"]
    df = spark.createDataFrame([(0, "USD"), (3, "EUR"), (None, None)], "qty int, cur string")
    got = {(r["column_name"], r["rule"]): r["violations"] for r in C.rule_violations(df, "t", rules).collect()}
    assert got == {("qty", "required"): 1, ("qty", "range"): 1, ("cur", "allowed"): 1}


def test_json_lines_and_small_helpers(spark, tmp_path):
    from stagewatch.operators import runlog as L
    p = tmp_path / "c.jsonl"
    p.write_text("\n".join(json.dumps({"id": i}) for i in range(4)))
    df = S.read_json(spark, str(p), multiline=False)
    assert df.count() == 4
    logs = spark.createDataFrame([("r", 0, "warning"), ("r", 1, "error")], "run_id string, seq bigint, level string")
    assert [r["seq"] for r in L.warning_logs(logs).collect()] == [0]


def test_csv_quotes_newlines_and_corrupt_records(spark, tmp_path):
    p = tmp_path / "q.csv"
    p.write_text('id,say\n1,"he said ""hi"""\n2,"two\nlines"\nx,plain\n')
    rows = [tuple(r) for r in S.read_csv(spark, str(p)).collect()]
    assert rows == [("1", 'he said "hi"'), ("2", "two\nlines"), ("x", "plain")]
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("say", T.StringType())])
    bad = S.corrupt_records(spark, str(p), schema).collect()
    assert len(bad) == 1 and "plain" in bad[0]["_corrupt_record"]


def test_arrival_counts_records_not_lines(spark, tmp_path):
    c, j = tmp_path / "c.csv", tmp_path / "j.json"
    c.write_text('id,say\n1,a\n2,"b\nb"\n3,c\n')
    j.write_text(json.dumps([{"id": 1}, {"id": 2}], indent=2))
    assert S.source_arrival(spark, {"c": str(c)}, "csv").first()["row_count"] == 3
    assert S.source_arrival(spark, {"j": str(j)}, "json").first()["row_count"] == 2
    found, _ = S.resolve_sources(spark, {}, {"c": (str(c), "csv")})
    assert found["c"].columns == ["id", "say"]


def test_a_table_is_read_as_it_is_now(spark, tmp_path):
    from stagewatch.sources.tables import read_table
    spark.range(5).write.parquet(str(tmp_path / "t.parquet"))
    assert read_table(spark, str(tmp_path), "t").count() == 5
    spark.range(5).write.mode("append").parquet(str(tmp_path / "t.parquet"))
    assert read_table(spark, str(tmp_path), "t").count() == 10


def test_checkpoint_folder_needs_a_shared_name_on_a_cluster(spark):
    from stagewatch.session import ensure_checkpoint_dir

    class Conf:
        def __init__(self, named):
            self.named = named

        def get(self, key, default=None):
            return self.named or default

    class Context:
        master = "spark://host:7077"
        folder = None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        def __init__(self, named):
            self.conf, self.sparkContext = Conf(named), Context()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session(None))
    named = Session("hdfs:///shared")
    assert ensure_checkpoint_dir(named) == "hdfs:///shared" == named.sparkContext.folder
