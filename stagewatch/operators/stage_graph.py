"""J4 / J7 for any stage graph: gates, root causes and downstream impact over dependency edges.

The graph's closure is found by joining it with itself until it no longer
grows (twice as far each round; a cycle ends it like any path).  It has a row
per pair of stages, whatever the number of runs.  Few stages would make few and
huge groups of runs, so a closure of up to ``MOST_PAIRS`` pairs goes to where
the runs are; a larger one is joined by stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

FAILED, SKIPPED = "failed", "skipped"
#: Pairs of a closure that is sent to every task.
MOST_PAIRS = 100_000


def closure(edges: DataFrame) -> DataFrame:
    """``upstream, stage, cyclic`` of every pair joined by a path of ``edges`` (``stage, depends_on``).

    ``cyclic``: a path leads back as well (also from a stage to itself).
    Repeated edges and null ends change nothing.
    """
    reach = cut_lineage(edges.where("stage is not null and depends_on is not null")
                        .select(F.col("depends_on").alias("upstream"), "stage").distinct())
    n = reach.count()
    while True:
        on = reach.select(F.col("upstream").alias("stage"), F.col("stage").alias("further"))
        reach = cut_lineage(reach.unionByName(reach.join(on, "stage").select(
            "upstream", F.col("further").alias("stage"))).distinct())
        grown = reach.count()
        if grown == n:
            break
        n = grown
    back = reach.select(F.col("stage").alias("upstream"), F.col("upstream").alias("stage"), F.lit(True).alias("back"))
    return cut_lineage(reach.join(back, ["upstream", "stage"], "left").select(
        "upstream", "stage", F.coalesce("back", F.lit(False)).alias("cyclic")))


def _few(reach: DataFrame, most_pairs: int) -> bool:
    return reach.limit(most_pairs + 1).count() <= most_pairs


def gate(stages: DataFrame, reach: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """``run_id, stage_name, status, blocked_by, effective_status, gate_ok`` of every stage of every run.

    ``stages``: ``run_id, stage_name, status``, one row per run and stage.  A
    stage is blocked by the failed stages upstream of it; a blocked stage that
    did not fail itself counts as skipped, and its gate is right only if its
    status says so.  Stages of a cycle do not block each other.
    """
    failed = stages.where(F.col("status") == FAILED).select("run_id", F.col("stage_name").alias("upstream"))
    strict = reach.where("not cyclic")
    blocked = failed.join(F.broadcast(strict) if _few(reach, most_pairs) else strict, "upstream")
    blocks = blocked.groupBy("run_id", F.col("stage").alias("stage_name")).agg(
        F.array_join(F.sort_array(F.collect_set("upstream")), ",").alias("blocked_by"))     # stages of one graph
    j = stages.join(blocks, ["run_id", "stage_name"], "left")
    blocked = F.col("blocked_by").isNotNull()
    return j.select("run_id", "stage_name", "status", F.coalesce("blocked_by", F.lit("")).alias("blocked_by"),
                    F.when(blocked, SKIPPED).otherwise(F.col("status")).alias("effective_status"),
                    (~blocked | (F.col("status") == SKIPPED)).alias("gate_ok"))


def _by_stage(pairs: DataFrame, stage: str, other: str) -> Column:
    """A map from each ``stage`` of the pairs to its ``other`` stages, sent to every task as one value."""
    each = pairs.groupBy(F.col(stage).alias("k")).agg(F.collect_set(other).alias("v"))
    return each.agg(F.map_from_entries(F.collect_list(F.struct("k", "v")))).scalar()


def root_causes(stages: DataFrame, reach: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """``run_id, root_stages, downstream_impact`` of every run with a failed stage.

    A root is a failed stage with no failed stage strictly upstream; the impact
    is every stage that a root reaches and that is no root itself.  Failed
    stages of one cycle are roots together.
    """
    failed = stages.where(F.col("status") == FAILED)
    if not _few(reach, most_pairs):
        return _root_causes_by_join(failed, reach)
    runs = failed.groupBy("run_id").agg(F.collect_set("stage_name").alias("failed")).select(      # stages of one graph
        "*", _by_stage(reach.where("not cyclic"), "stage", "upstream").alias("above"),
        _by_stage(reach, "upstream", "stage").alias("below"))
    explained = lambda s: F.coalesce(F.arrays_overlap("failed", F.try_element_at("above", s)), F.lit(False))
    found = runs.select("run_id", "below", F.when(F.col("run_id").isNull(), F.col("failed")).otherwise(   # as in a join
        F.filter("failed", lambda s: ~explained(s))).alias("roots"))
    reached = F.flatten(F.transform("roots", lambda s: F.coalesce(
        F.try_element_at("below", s), F.array().cast("array<string>"))))
    listed = lambda a: F.array_join(F.sort_array(a), ",")
    return found.select("run_id", listed(F.col("roots")).alias("root_stages"),
                        listed(F.array_except(reached, F.col("roots"))).alias("downstream_impact"))


def _root_causes_by_join(failed: DataFrame, reach: DataFrame) -> DataFrame:
    """``root_causes`` for a closure too large to be sent around."""
    failed = failed.select("run_id", F.col("stage_name").alias("stage")).distinct()
    above = failed.select("run_id", F.col("stage").alias("upstream")).join(reach.where("not cyclic"), "upstream").select(
        "run_id", "stage")
    roots = failed.join(above, ["run_id", "stage"], "left_anti")
    reached = roots.select("run_id", F.col("stage").alias("upstream")).join(reach, "upstream").select(
        "run_id", "stage", F.lit(False).alias("root"))
    both = roots.withColumn("root", F.lit(True)).unionByName(reached).groupBy("run_id", "stage").agg(F.max("root").alias("root"))

    def listed(which: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_list(F.when(which, F.col("stage")))), ",")

    return both.groupBy("run_id").agg(listed(F.col("root")).alias("root_stages"),
                                      listed(~F.col("root")).alias("downstream_impact"))
