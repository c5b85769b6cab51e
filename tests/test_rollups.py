"""Trends at many moments from hourly roll-ups equal the direct scan; stage graphs against a plain walk."""

import datetime as dt
import random

from pyspark.sql import functions as F

from stagewatch.operators import history as H
from stagewatch.operators import rollups as U
from stagewatch.operators import runlog as L
from stagewatch.operators import stage_graph as G
from stagewatch.sources import files as S

HISTORY = "run_id string, scenario_name string, failure_type string, ts timestamp_ntz, outcome string, duration_seconds double"


def history(spark, n=600, seed=4):
    rnd = random.Random(seed)
    start = dt.datetime(2024, 3, 1)
    rows = []
    for i in range(n):
        at = start + dt.timedelta(seconds=rnd.choice([rnd.randrange(10 * 86400), 3600 * rnd.randrange(240)]))
        rows.append((str(i), "s", rnd.choice(["a", "b", "", None]), at if i % 50 else None,
                     rnd.choice(["FAILED", "RESOLVED", "UNRESOLVED", "HEALTHY"]), rnd.choice([None, 0.0, 1.5, 0.1, 7.25])))
    return spark.createDataFrame(rows, HISTORY).repartition(5)


MOMENTS = ["2024-02-29 00:00:00", "2024-03-01 00:00:00", "2024-03-02 05:30:00", "2024-03-04 07:00:00",
           "2024-03-04 07:00:00.000001", "2024-03-04 06:59:59.999999", "2024-03-09 23:15:10", "2024-03-20 00:00:00"]


def test_moments_equal_the_direct_scan(spark):
    h = history(spark).cache()
    parts = [U.hourly_rollup(h.where(F.col("run_id").cast("int") % 3 == k)) for k in range(3)]      # three loads
    rollups = parts[0].unionByName(parts[1]).unionByName(parts[2])
    for hours in (24, 1, 72):
        got = sorted(tuple(r) for r in U.trend_at(rollups, h, MOMENTS, hours).collect())
        want = []
        for m in MOMENTS:
            direct = H.failure_trend(h.where(F.col("ts") <= F.lit(m).cast("timestamp_ntz")), m, hours)
            want += [(dt.datetime.fromisoformat(m), *r) for r in direct.collect() if r.total_runs]
        assert got == sorted(want)
    assert U.trend_at(rollups.limit(0), h.limit(0), MOMENTS).count() == 0


def test_history_reads_only_edge_hours(spark):
    h = history(spark)
    seen = U.trend_at(U.hourly_rollup(h), h, ["2024-03-04 07:30:00"])
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_rollups_are_appended_with_the_history(spark, tmp_path):
    h = history(spark, 100).select("*", F.array().cast("array<string>").alias("remediation_applied"),
                                   F.array().cast("array<string>").alias("failed_stages"), F.lit(None).cast(
        S.HISTORY_SCHEMA["data_quality"].dataType).alias("data_quality")).where("ts is not null")
    for k in range(2):
        S.append_history(h.where(F.col("run_id").cast("int") % 2 == k), str(tmp_path / "h"), str(tmp_path / "hourly"))
    stored = U.merge_rollups(spark.read.parquet(str(tmp_path / "hourly")))
    assert sorted(map(tuple, stored.collect()), key=str) == sorted(map(tuple, U.hourly_rollup(h).collect()), key=str)


EDGES = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d"), ("f", "x"), ("g", "h"), ("h", "i"), ("i", "g"), ("j", "i"),
         ("d", "b"), (None, "a"), ("k", "k")]


def reachable(edges):
    out = {(u, s) for s, u in edges if s and u}
    while True:
        more = out | {(a, d) for a, b in out for c, d in out if b == c}
        if more == out:
            return out
        out = more


def test_closure_with_branches_and_cycles(spark):
    got = {(r.upstream, r.stage): r.cyclic for r in G.closure(spark.createDataFrame(EDGES, "stage string, depends_on string")).collect()}
    want = reachable(EDGES)
    assert got == {p: p[::-1] in want for p in want}
    assert G.closure(spark.createDataFrame([], "stage string, depends_on string")).count() == 0


def test_gates_and_roots(spark):
    rnd = random.Random(8)
    names = sorted({x for e in EDGES for x in e if x})
    rows = [(r, s, rnd.choice(["failed", "success", "success", "skipped"])) for r in range(60) for s in names]
    reach = G.closure(spark.createDataFrame(EDGES, "stage string, depends_on string"))
    table = spark.createDataFrame(rows, "run_id int, stage_name string, status string")
    paths = reachable(EDGES)
    strict = {p for p in paths if p[::-1] not in paths}
    failed = {(r, s) for r, s, x in rows if x == "failed"}
    for g in G.gate(table, reach).collect():
        above = sorted(u for u in names if (u, g.stage_name) in strict and (g.run_id, u) in failed)
        assert g.blocked_by == ",".join(above)
        assert g.effective_status == ("skipped" if above else g.status) and g.gate_ok == (not above or g.status == "skipped")
    got = {g.run_id: (g.root_stages, g.downstream_impact) for g in G.root_causes(table, reach).collect()}
    want = {}
    for run in {r for r, _ in failed}:
        roots = {s for s in names if (run, s) in failed and not any((u, s) in strict and (run, u) in failed for u in names)}
        down = {s for s in names if any((u, s) in paths for u in roots)} - roots
        want[run] = (",".join(sorted(roots)), ",".join(sorted(down)))
    assert got == want


def test_few_stages_are_met_where_the_runs_are(spark):
    rnd = random.Random(9)
    names = sorted({x for e in EDGES for x in e if x})
    rows = [(r, s, rnd.choice(["failed", "success", None])) for r in [*range(40), None, 3] for s in [*names, "apart", None]]
    rows += [(50, None, "failed"), (51, "apart", "failed"), (51, "apart", "failed"), (52, "a", "success")]
    table = spark.createDataFrame(rows, "run_id int, stage_name string, status string")
    for edges in (EDGES, []):
        reach = G.closure(spark.createDataFrame(edges, "stage string, depends_on string"))
        for f in (G.root_causes, G.gate):
            both = [sorted(map(tuple, f(table, reach, most_pairs=n).collect()), key=str) for n in (10_000, 0 if edges else -1)]
            assert both[0] == both[1]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")       # as for runs that are many
    try:
        reach = G.closure(spark.createDataFrame(EDGES, "stage string, depends_on string"))
        plans = [f(table, reach)._jdf.queryExecution().executedPlan().toString() for f in (G.root_causes, G.gate)]
        assert "Join" not in plans[0]
        assert plans[1].count("SortMergeJoin") == 1 and "BroadcastHashJoin" in plans[1]        # by run, not by stage
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_three_stage_chain_stays_equal(spark):
    chain = G.closure(spark.createDataFrame([("transform", "ingestion"), ("load", "transform")], "stage string, depends_on string"))
    rows = []
    for run, bad in enumerate([None, "ingestion", "transform", "load"]):
        state = "success"
        for i, s in enumerate(("ingestion", "transform", "load"), 1):
            state = "skipped" if state in ("failed", "skipped") else "failed" if s == bad else "success"
            rows.append((run, s, i, 1, state, "broken" if state == "failed" else None))
    stages = spark.createDataFrame(rows, "run_id int, stage_name string, stage_ordinal int, attempt int, status string, error_message string")
    logs = spark.createDataFrame([], "run_id int, seq long, ts timestamp_ntz, level string, stage string, message string, details string")
    old = {r.run_id: (r.root_stage, r.downstream_impact) for r in L.root_cause(stages, logs).collect() if r.root_stage}
    new = {r.run_id: (r.root_stages, ",".join(sorted(r.downstream_impact.split(",")))) for r in G.root_causes(stages, chain).collect()}
    assert {k: (a, ",".join(sorted(b.split(",")))) for k, (a, b) in old.items()} == new
    assert G.gate(stages, chain).where("not gate_ok").count() == 0 and L.stage_gate(stages).where("not gate_ok").count() == 0
