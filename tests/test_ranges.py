"""Large files cut into ranges: the same records as a one-task read, in more than one task."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from stagewatch.sources import files as S
from stagewatch.sources import ranges as R


@pytest.fixture()
def small_splits(spark):
    """Splits of a few hundred bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "600b", "spark.sql.files.openCostInBytes": "1b"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def csv_rows(n, seed=1):
    rnd = random.Random(seed)
    parts = ["plain", "two\nlines", 'say "x"', "a,b", "", "\n\n", '"', "é\nü", "x" * 50, "line\r\nend", "NA", " y "]
    rows = [[str(i), "".join(rnd.choice(parts) for _ in range(rnd.randrange(4))), f"{rnd.randrange(1000) / 8}"]
            for i in range(n)]
    rows[n // 2][1] = "long\n\"quoted\"\n" * 200              # a record longer than several ranges
    return rows


def write_csv(path, rows, header, newline="\n"):
    with open(path, "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f, lineterminator=newline)
        out.writerow(header)
        out.writerows(rows)


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_csv_equals_the_one_task_read(spark, small_splits, tmp_path, newline):
    rows = csv_rows(300)
    write_csv(tmp_path / "a.csv", rows, ["id", "note", "price"], newline)
    path = str(tmp_path / "a.csv")
    got = S.read_csv(spark, path)
    assert R.segments(spark, path, R.CSV).rdd.getNumPartitions() > 5
    want = [(a, b if b not in S.NA_TOKENS else None, c) for a, b, c in rows]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: int(r[0])) == want
    # Spark's own reader takes the line end of the file for one inside a field
    one = S.read_csv(spark, path, parallel=False)
    plain = [tuple(v.replace("\r\n", "\n") if v and newline == "\r\n" else v for v in w) for w in want]
    assert sorted(map(tuple, one.collect()), key=lambda r: int(r[0])) == plain


def test_csv_columns_by_header_name(spark, small_splits, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write_csv(folder / "a.csv", [["2.5", f"{i}", "x"] for i in range(60)], ["price", "id", "more"])
    write_csv(folder / "b.csv", [[f"{i}", "1.5"] for i in range(60, 90)], ["id", "price"])
    write_csv(folder / "c.csv", [[f"{i}"] for i in range(90, 95)], ["id"])
    schema = "id string, price double"
    for parallel in (True, False):
        paths = [str(folder)] if parallel else [str(folder / f"{x}.csv") for x in "abc"]
        got = {}
        for p in paths:
            got |= {int(r.id): r.price for r in S.read_csv(spark, p, schema, parallel=parallel).collect()}
        assert got == {**{i: 2.5 for i in range(60)}, **{i: 1.5 for i in range(60, 90)}, **{i: None for i in range(90, 95)}}
    assert sorted(S.read_csv(spark, str(folder)).columns) == ["id", "more", "price"]
    drift = {r.file[-5:]: (r.missing, r.extra, r.reordered) for r in S.header_drift(spark, str(folder), schema).collect()}
    assert drift == {"a.csv": ([], ["more"], True), "c.csv": (["price"], [], False)}


def test_csv_corrupt_records_and_odd_files(spark, tmp_path):
    schema = S.T.StructType.fromDDL("id int, price double")
    write_csv(tmp_path / "a.csv", [["1", "2.5"], ["x", "3"], ["3", "y\nz"]], ["price", "id"])
    assert S.corrupt_records(spark, str(tmp_path / "a.csv"), schema).count() == 3
    write_csv(tmp_path / "b.csv", [["1", "2.5"], ["7", "3\n4"]], ["id", "price"])
    assert [r[S.CORRUPT] for r in S.corrupt_records(spark, str(tmp_path / "b.csv"), schema).collect()] == ['7,"3\n4"']
    (tmp_path / "head.csv").write_text("id,price\n")
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "blank.csv").write_text("﻿id,price\n\n1,2\n\n  \n3,4")
    assert S.read_csv(spark, str(tmp_path / "head.csv"), schema).count() == 0
    assert S.read_csv(spark, str(tmp_path / "none.csv"), schema).columns == ["id", "price"]
    assert sorted(map(tuple, S.read_csv(spark, str(tmp_path / "blank.csv"), schema).collect())) == [(1, 2.0), (3, 4.0)]


def json_rows(n, seed=2):
    rnd = random.Random(seed)
    parts = ["}", "{", "[", "]", '"', "\\", '\\"', "},{", "plain", "\n", "é", "\\\\", ","]
    rows = [{"id": i, "note": "".join(rnd.choice(parts) for _ in range(rnd.randrange(9))),
             "deep": {"a": [{"x": rnd.randrange(9)}, {"x": 1}], "s": rnd.choice(parts)}} for i in range(n)]
    rows[n // 3]["note"] = "}{\"]" * 400
    return rows


@pytest.mark.parametrize("indent", [None, 1])
def test_json_equals_the_one_task_read(spark, small_splits, tmp_path, indent):
    rows = json_rows(200)
    path = str(tmp_path / "a.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rows, f, indent=indent, ensure_ascii=False)
    assert R.segments(spark, path, R.JSON).rdd.getNumPartitions() > 5
    for got in (S.read_json(spark, path), S.read_json(spark, path, schema=(
            "id long, note string, deep struct<a:array<struct<x:long>>,s:string>"))):
        found = sorted((r.asDict(recursive=True) for r in got.select("id", "note", "deep").collect()), key=lambda r: r["id"])
        assert found == rows
    one = spark.read.option("multiLine", True).json(path)
    assert sorted(one.select("id", "note").collect()) == sorted(S.read_json(spark, path).select("id", "note").collect())


def test_json_lines_and_odd_arrays(spark, small_splits, tmp_path):
    rows = json_rows(50)
    (tmp_path / "l.json").write_text("\n".join(json.dumps(r) for r in rows))
    schema = "id long, note string"
    assert sorted(r.id for r in S.read_json(spark, str(tmp_path / "l.json"), schema=schema).collect()) == list(range(50))
    for name, text in (("empty", "[]"), ("blank", " [ \n ] \n"), ("none", "")):
        (tmp_path / f"{name}.json").write_text(text)
        assert S.read_json(spark, str(tmp_path / f"{name}.json"), schema=schema).count() == 0
    (tmp_path / "one.json").write_text('{"id": 1, "note": "[}"}')
    assert [tuple(r) for r in S.read_json(spark, str(tmp_path / "one.json"), schema=schema).collect()] == [(1, "[}")]


def test_no_text_is_shuffled_but_what_hangs_over(spark, small_splits, tmp_path):
    write_csv(tmp_path / "a.csv", [[str(i), "x"] for i in range(2000)], ["id", "note"])
    rows = R.segments(spark, str(tmp_path / "a.csv"), R.CSV)
    states = R.range_states(rows, R.CSV)
    found = R.records(rows, states, R.CSV)
    assert found.count() == 2001 and found.where(F.col("first")).count() == 1
    assert states.count() > 10 and states.where("inside").count() == 0


def test_many_ranges_are_joined_by_sorting(spark, small_splits, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "MOST_BROADCAST_RANGES", 0)
    rows = csv_rows(200, 5)
    write_csv(tmp_path / "a.csv", rows, ["id", "note", "price"])
    got = S.read_csv(spark, str(tmp_path / "a.csv"))
    assert sorted(int(r.id) for r in got.collect()) == list(range(200))
