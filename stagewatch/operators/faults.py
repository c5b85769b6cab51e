"""Input builders (I1-I6): deterministic corrupted copies of any table.

Used by tests, queries and scenarios as inputs of the quality rules.  Every selection is a pure function of
row content (a hash or a key modulus), never ``rand()``, so a recomputed
partition after an executor loss selects exactly the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def inject_new_column(df: DataFrame) -> DataFrame:
    """Unexpected ``loyalty_points = trunc(unit_price * quantity * 10)``."""
    return df.withColumn("loyalty_points",
                         (F.col("unit_price") * F.col("quantity") * F.lit(10)).cast("bigint"))


def inject_type_change(df: DataFrame, column: str = "unit_price", suffix: str = "_USD") -> DataFrame:
    """Numbers become text with a suffix (``29.99_USD``).

    Decimals are rendered without exponent notation.
    """
    return df.withColumn(column, F.concat(F.col(column).cast("string"), F.lit(suffix)))


def inject_missing_column(df: DataFrame, column: str = "region") -> DataFrame:
    """Drop a required column."""
    return df.drop(column)


def hash_fraction(cols: list[str], fraction: float, seed: int = 42) -> Column:
    """True for about ``fraction`` of rows, chosen by a content hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in cols]), F.lit(10000)) < int(round(fraction * 10000))


def key_fraction(key: str, fraction: float) -> Column:
    """True for exactly ``fraction`` of each run of 100 consecutive integer keys."""
    return F.pmod(F.col(key), F.lit(100)) < int(round(fraction * 100))


def inject_nulls(df: DataFrame, column: str = "email", selector: Column | None = None,
                 fraction: float = 0.30, key: str = "customer_id") -> DataFrame:
    """I4: null out ``column`` on a deterministic ~``fraction`` of rows."""
    sel = selector if selector is not None else hash_fraction([key], fraction)
    return df.withColumn(column, F.when(sel, F.lit(None).cast(df.schema[column].dataType))
                         .otherwise(F.col(column)))


def inject_duplicates(df: DataFrame, selector: Column | None = None, fraction: float = 0.15) -> DataFrame:
    """Append a deterministic ~``fraction`` of rows again (bag union).

    The copy is chosen by ``selector`` (default: a content hash); each
    selected row is emitted twice in the same scan (no union, so the input
    is computed once), with no global ranking and no single task.
    """
    sel = selector if selector is not None else hash_fraction(df.columns, fraction)
    # one scan: a selected row is emitted twice (explode of a 1- or 2-element array)
    copies = F.explode(F.when(sel, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return df.select("*", copies.alias("_copy")).drop("_copy")


def inject_pk_violation(df: DataFrame, key: str = "transaction_id", order_by: list[str] | None = None,
                        n: int = 5) -> DataFrame:
    """The last ``n`` rows take the keys of the first ``n`` rows.

    "First/last" follow an explicit total order (``order_by``, then all other
    columns, then a row id given once and checkpointed, so equal rows stay
    apart).  Both ends are bounded top-``n`` selections; the ``n``-row key map
    is broadcast back onto the table.  The ``k``-th of the last ``n`` rows
    receives the ``k``-th first key.  Needs more than ``n`` rows, otherwise
    the input is returned unchanged.
    """
    order_by = list(order_by or [key])
    cols = order_by + [c for c in df.columns if c not in order_by] + ["_row"]
    rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
    asc = [F.col(c).asc_nulls_first() for c in cols]
    desc = [F.col(c).desc_nulls_last() for c in cols]
    # n+1 first rows: their count also tells whether the table has more than n rows
    head = rows.orderBy(*asc).limit(n + 1).select(F.col(key).alias("_new_key"),
                                                  F.row_number().over(_w(asc)).alias("_pos"),
                                                  F.count(F.lit(1)).over(_all()).alias("_head_rows"))
    first = head.where((F.col("_pos") <= n) & (F.col("_head_rows") > n))
    last = (rows.orderBy(*desc).limit(n).select(F.col("_row").alias("_last_row"),
                                                (F.lit(n + 1) - F.row_number().over(_w(desc))).alias("_pos")))
    remap = last.join(first, "_pos").select("_last_row", "_new_key")
    j = rows.join(F.broadcast(remap), F.col("_row") == F.col("_last_row"), "left")
    return j.select(*[F.when(F.col("_last_row").isNotNull(), F.col("_new_key")).otherwise(F.col(key)).alias(key)
                      if c == key else F.col(c) for c in df.columns])


def _w(order):
    return Window.orderBy(*order)          # over at most n+1 rows (after a limit)


def _all():
    return Window.partitionBy()            # the whole (n+1)-row head
