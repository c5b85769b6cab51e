"""Skew-safe "how many earlier matching rows" counts.

Question: for every row, how many rows with the same key and a matching
predicate fall in ``[t - lookback, t)`` (or in all of ``(-inf, t)``)?

The answer depends on (key, t) alone, so rows are first reduced to one point
per key and distinct time, with map-side combine: any number of rows at one
time cost one point.  Each point asks for the count before t, and before
t - lookback; points and questions lie in one line per key, cut into time
buckets.  A count is the sum of

1. the earlier points of its time bucket (a window over one bucket of one
   key: at most as many rows as a bucket has distinct times and questions), and
2. the earlier buckets of its key (a window over one row per bucket).

count(window) = before(t) - before(t - lookback).  The answers go back to the
rows by an equi-join whose answer side is unique, so a hot time is split like
any skewed join.  No pairs are formed, no job runs while the plan is built,
and nothing depends on how rows lie in partitions.

A key is one struct, which is never null and whose null fields are equal, so
joins are plain equalities and reuse the partitioning of the windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import micros_since_epoch, quoted

BUCKET_US = 3_600_000_000           # an hour


def prior_counts(df: DataFrame, id_col: str, keys: list[str], ts_col: str, match: Column,
                 lookback_us: int | None = None, bucket_us: int = BUCKET_US, carry: list[str] | None = None) -> DataFrame:
    """``(id_col, prior_count)``: rows with equal ``keys`` (null-safe), ``match``
    true and time in ``[t - lookback, t)`` (all earlier rows without lookback).
    Rows without a time are left out.

    With ``carry`` those columns stand between the two, and rows without a time
    stay, with a null count: the caller needs no join back to ``df``.
    """
    carried = [f"_c{i}" for i in range(len(carry or []))]
    base = df.select(quoted(id_col).alias("_id"), *[quoted(c).alias(n) for c, n in zip(carry or [], carried)],
                     F.struct(*[quoted(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("_k"),
                     micros_since_epoch(quoted(ts_col)).alias("_t"), match.alias("_m"))
    times = base.where("_t is not null").groupBy("_k", "_t").agg(F.count_if("_m").alias("_n"))
    asked = [F.struct(F.col("_t").alias("p"), F.col("_n").alias("n"), F.lit(1).alias("sign"))]
    if lookback_us is not None:
        asked.append(F.struct((F.col("_t") - F.lit(lookback_us)).alias("p"), F.lit(0).cast("bigint").alias("n"),
                              F.lit(-1).alias("sign")))
    line = times.select("_k", "_t", F.explode(F.array(*asked)).alias("_x")).select(
        "_k", "_t", "_x.*").withColumn("_b", F.floor(F.col("p") / F.lit(bucket_us)))
    earlier_here = Window.partitionBy("_k", "_b").orderBy("p").rangeBetween(Window.unboundedPreceding, -1)
    inside = line.withColumn("_in", F.coalesce(F.sum("n").over(earlier_here), F.lit(0)))
    earlier_buckets = Window.partitionBy("_bk").orderBy("_bb").rowsBetween(Window.unboundedPreceding, -1)
    buckets = line.groupBy(F.col("_k").alias("_bk"), F.col("_b").alias("_bb")).agg(F.sum("n").alias("_n")).select(
        "_bk", "_bb", F.coalesce(F.sum("_n").over(earlier_buckets), F.lit(0)).alias("_before"))
    answers = (inside.join(buckets, (F.col("_k") == F.col("_bk")) & (F.col("_b") == F.col("_bb")))
               .groupBy(F.col("_k").alias("_ak"), F.col("_t").alias("_at"))
               .agg(F.sum(F.col("sign") * (F.col("_in") + F.col("_before"))).cast("bigint").alias("prior_count")))
    out = base.join(answers, (F.col("_k") == F.col("_ak")) & (F.col("_t") == F.col("_at")),
                    "inner" if carry is None else "left")
    return out.select(F.col("_id").alias(id_col), *[F.col(n).alias(c) for c, n in zip(carry or [], carried)], "prior_count")


def prior_sums(df: DataFrame, id_col: str, keys: list[str], ts_col: str, sums: dict[str, Column],
               carry: list[str], bucket_us: int = BUCKET_US) -> DataFrame:
    """``(id_col, *carry, *sums)``: each sum over all rows with equal ``keys`` (null-safe) and a strictly
    earlier time; 0 where there are none, null for rows without a time (which add nothing either).

    The same steps as ``prior_counts`` without a look-back: a point per key
    and distinct time, a window inside each time bucket, a window over buckets.
    """
    names, carried = [f"_s{i}" for i in range(len(sums))], [f"_c{i}" for i in range(len(carry))]
    base = df.select(quoted(id_col).alias("_id"), *[quoted(c).alias(n) for c, n in zip(carry, carried)],
                     F.struct(*[quoted(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("_k"),
                     micros_since_epoch(quoted(ts_col)).alias("_t"),
                     *[c.alias(n) for c, n in zip(sums.values(), names)])
    points = (base.where("_t is not null").groupBy("_k", "_t").agg(*[F.sum(n).alias(n) for n in names])
              .withColumn("_b", F.floor(F.col("_t") / F.lit(bucket_us))))
    here = Window.partitionBy("_k", "_b").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("_bk").orderBy("_bb").rowsBetween(Window.unboundedPreceding, -1)
    inside = points.select("_k", "_t", "_b", *[F.coalesce(F.sum(n).over(here), F.lit(0)).alias(f"_in{n}") for n in names])
    buckets = (points.groupBy(F.col("_k").alias("_bk"), F.col("_b").alias("_bb")).agg(*[F.sum(n).alias(n) for n in names])
               .select("_bk", "_bb", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before{n}") for n in names]))
    answers = inside.join(buckets, (F.col("_k") == F.col("_bk")) & (F.col("_b") == F.col("_bb"))).select(
        F.col("_k").alias("_ak"), F.col("_t").alias("_at"),
        *[(F.col(f"_in{n}") + F.col(f"_before{n}")).cast("bigint").alias(o) for n, o in zip(names, sums)])
    out = base.join(answers, (F.col("_k") == F.col("_ak")) & (F.col("_t") == F.col("_at")), "left")
    return out.select(F.col("_id").alias(id_col), *[F.col(n).alias(c) for c, n in zip(carry, carried)], *sums)
