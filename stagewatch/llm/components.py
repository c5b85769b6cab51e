"""Connected components by alternating large-star and small-star rounds (all links stay in tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """``node, root`` (the smallest node reachable) of every node of ``links(a, b)``.

    Each round replaces links by links to smaller nodes; it ends when every
    node points at its root.  The number of rounds grows with the logarithm
    of the longest path.  The links of a hot node are never gathered: its
    minimum is a partial aggregate, and the join that hands it out can be
    split.  No links give no rows; repeated links and loops change nothing.
    """
    stars = cut(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .distinct(), "links")
    while True:
        both = stars.union(stars.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = large.where("a != b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(small_least, "a")
                 .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                           F.struct(F.col("a"), F.col("m").alias("b")))).alias("l"))
                 .select("l.a", "l.b").where("a != b").distinct())
        after = cut(small, "links")
        # every node once, and no root is itself below another: the stars are final
        nodes, points = after.agg(F.count_distinct("a"), F.count(F.lit(1))).first()
        if nodes == points and after.join(after.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
        stars = after
    found = after.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found.union(found.select("root", "root").distinct())
