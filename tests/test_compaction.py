"""Compacted dates hold the same rows in few files, whatever fails or is appended meanwhile."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from stagewatch.sources import compaction as K
from stagewatch.sources import files as S


def records(spark, load, days=3, per_day=40):
    rows = [(f"{load}-{d}-{i}", "s" if i % 3 else "hot", None if i % 2 else "schema_drift",
             dt.datetime(2024, 1, 1 + d, i % 24), "FAILED", None if i % 5 == 0 else 1.5, ["a"] if i % 4 == 0 else [], None,
             (i, None, 0, []) if i % 7 else None) for d in range(days) for i in range(per_day)]
    rows.append((f"{load}-open", "s", None, dt.datetime(2024, 2, 1), "HEALTHY", 0.0, [], [], None))
    rows.append((f"{load}-none", "s", None, None, "HEALTHY", 0.0, [], [], None))
    return spark.createDataFrame(rows + rows[:2], S.HISTORY_SCHEMA).repartition(3)          # with repeated rows


def contents(spark, path):
    return sorted(str(r) for r in S.read_history(spark, path).collect())


def test_same_rows_in_bounded_files(spark, tmp_path):
    path = str(tmp_path / "h")
    assert K.compact_history(spark, path, "2024-01-31") == 0                # no store
    for load in range(4):
        S.append_history(records(spark, load), path)
    before = contents(spark, path)
    files = K.history_files(spark, path)
    assert min(len(files[f"2024-01-0{d}"]) for d in (1, 2, 3)) >= 4
    assert K.compact_history(spark, path, "2024-01-31", rows_per_file=100) == 3
    assert contents(spark, path) == before                                  # replaced files still lie there
    files = K.history_files(spark, path)
    assert {d: len(n) <= 2 for d, n in files.items() if d < "2024-01-31"} == {f"2024-01-0{d}": True for d in (1, 2, 3)}
    assert len(files["2024-02-01"]) >= 4                                    # an open date is left alone
    assert K.sweep_history(spark, path) > 0
    assert contents(spark, path) == before
    assert K.compact_history(spark, path, "2024-01-31", rows_per_file=100) == 0
    # a late record of a closed date is seen, and joins it at the next compaction
    S.append_history(records(spark, 9, days=1, per_day=3), path)
    late = contents(spark, path)
    assert len(late) == len(before) + 7
    assert K.compact_history(spark, path, "2024-01-31") == 1
    assert contents(spark, path) == late and len(K.history_files(spark, path)["2024-01-01"]) == 1
    K.sweep_history(spark, path)
    assert contents(spark, path) == late
    on_disk = [f for _, _, names in os.walk(tmp_path / "h" / "run_date=2024-01-01") for f in names if f.endswith(".parquet")]
    assert not on_disk


def test_failures_change_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "h")
    for load in range(2):
        S.append_history(records(spark, load), path)
    before = contents(spark, path)
    proofs = []

    def broken(rows):
        proofs.append(rows)
        return true_proof(rows.limit(5) if len(proofs) % 2 == 0 else rows)  # the second look, at the rewritten rows
    true_proof = K._proof
    monkeypatch.setattr(K, "_proof", broken)
    with pytest.raises(K.CompactionError):
        K.compact_history(spark, path, "2024-01-31")
    monkeypatch.setattr(K, "_proof", true_proof)
    assert contents(spark, path) == before
    # an executor or driver lost after the rewrite and before the record
    left = f"{path}/{K.COMPACTED}/swap=sdead"
    S.read_history(spark, path).where("run_date = '2024-01-01'").write.partitionBy("run_date").parquet(left)
    assert contents(spark, path) == before
    assert K.compact_history(spark, path, "2024-01-31") == 3
    assert contents(spark, path) == before and not os.path.exists(left)


def test_appends_beside_a_compaction_stay(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "h")
    for load in range(2):
        S.append_history(records(spark, load), path)
    true_proof, more = K._proof, records(spark, 7, days=1, per_day=2)

    def appending(rows):
        if not contents_added:
            contents_added.append(True)
            S.append_history(more, path)
        return true_proof(rows)
    contents_added = []
    monkeypatch.setattr(K, "_proof", appending)
    want = sorted([*contents(spark, path)] + [str(r) for r in more.withColumn("run_date", F.to_date("ts")).collect()])
    assert K.compact_history(spark, path, "2024-01-31") == 3
    assert contents(spark, path) == want


def test_lookback_prunes_dates_of_a_compacted_store(spark, tmp_path):
    import contextlib
    import io

    from stagewatch.operators import history as H
    path = str(tmp_path / "h")
    for load in range(2):
        S.append_history(records(spark, load), path)
    K.compact_history(spark, path, "2024-01-31")
    K.sweep_history(spark, path)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        H.within(S.read_history(spark, path), "2024-01-03 12:00:00", 24).explain()
    assert buf.getvalue().count("isnotnull(run_date") >= 2 and "Join" not in buf.getvalue()
