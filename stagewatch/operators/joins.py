"""Lookup joins.

Literal tables (exchange rates, contracts, playbooks, the 25-row nation
table) are broadcast where they are joined: their size is bounded by
construction.  Every other lookup is left to the planner, which broadcasts
only under its own size estimate (``spark.sql.autoBroadcastJoinThreshold``;
AQE checks actual sizes) and otherwise sorts, merges and splits skewed
partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def lookup_join(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Left outer lookup join; the planner picks the strategy from sizes."""
    return left.join(right, on, "left")
