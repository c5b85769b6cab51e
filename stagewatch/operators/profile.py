"""Single-pass quality profiles: nulls, duplicates, key checks, bad values.

C3 (text values that are not numbers), C6-C8 (null profiles), C9/C10/W4
(duplicate keys, PK check and samples), A1 (row counts), L1 (bad samples).

Every profile is one aggregate over the data (one scan, partial aggregation
before any shuffle); only the single-row or per-column result is small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import is_null, merge_rows, pct, quoted


def null_profile(df: DataFrame, dataset: str, prefix: str = "", nonzero_only: bool = True) -> DataFrame:
    """Per-column null counts (NaN counts as null) in one aggregate.

    Returns ``(dataset, column_name, null_count, total_rows, null_pct)``;
    ``prefix`` is prepended to the column name (``customers.`` for the
    merged null-concentration map, C8).
    """
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("__rows")]
    aggs += [F.sum(F.when(is_null(df, c), 1).otherwise(0)).cast("bigint").alias(f"n{i}")
             for i, c in enumerate(cols)]
    wide = df.agg(*aggs)
    # one (column name, count) struct per column, exploded to long form
    long = wide.select(
        F.col("__rows").alias("total_rows"),
        F.explode(F.array(*[F.struct(F.lit(prefix + c).alias("column_name"),
                                     F.col(f"n{i}").alias("null_count"))
                            for i, c in enumerate(cols)])).alias("p"))
    out = long.select(F.lit(dataset).alias("dataset"), "p.column_name", "p.null_count",
                      "total_rows", pct(F.col("p.null_count"), F.col("total_rows")).alias("null_pct"))
    return out.where(F.col("null_count") > 0) if nonzero_only else out


def null_concentration(frames: dict[str, DataFrame]) -> DataFrame:
    """Null profile of several datasets merged into one long table.

    The first dataset's columns keep their bare names, the others are
    prefixed with ``<dataset>.``.
    """
    parts = []
    for i, (name, df) in enumerate(frames.items()):
        parts.append(null_profile(df, name, prefix="" if i == 0 else f"{name}."))
    return reduce(lambda a, b: a.unionByName(b), parts)


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows per key (null keys form one group, as in a pandas duplicate test)."""
    return df.groupBy(quoted(key)).agg(F.count(F.lit(1)).alias("n"))


def duplicate_count(df: DataFrame, key: str, dataset: str = "sales") -> DataFrame:
    """Rows beyond the first per key, in one shuffle with map-side combine."""
    kc = key_counts(df, key)
    return kc.agg(
        F.lit(dataset).alias("dataset"), F.lit(key).alias("key_column"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_rows"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_count"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, 1).otherwise(0)), F.lit(0)).cast("bigint")
        .alias("duplicated_keys"))


def pk_violations(df: DataFrame, key: str = "transaction_id", samples: int = 3) -> DataFrame:
    """PK check with the first ``samples`` duplicate ids in key order.

    A key seen ``n`` times contributes ``n-1`` entries to the sample list
    (each non-first occurrence), like a duplicate mask over ordered rows.
    The key counts are computed once and feed both the count and the
    samples (one shuffle).
    """
    kc = key_counts(df, key).where(F.col("n") > 1)
    total = kc.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_count"))
    # the smallest keys, each repeated n-1 times, capped at ``samples`` entries per key
    smallest = (kc.orderBy(F.col(key).asc_nulls_first()).limit(samples)
                .select(F.explode(F.array_repeat(F.col(key).cast("string"),
                                                 F.least(F.col("n") - 1, F.lit(samples)).cast("int")))
                        .alias("k"), F.col(key).alias("_o")))
    sample = (smallest.agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct(
        F.col("_o").alias("o"), F.col("k").alias("k")))), lambda s: s["k"]), 1, samples)
        .alias("ids")))
    ids_text = F.concat(F.lit("["), F.concat_ws(", ", F.transform(
        F.col("ids"), lambda x: F.concat(F.lit("'"), x, F.lit("'")))), F.lit("]"))
    return merge_rows([total, sample]).select(
        F.lit(key).alias("key_column"),
        "duplicate_count",
        (F.col("duplicate_count") > 0).alias("violated"),
        F.when(F.size("ids") > 0, F.concat_ws(", ", F.col("ids"))).alias("sample_ids"),
        F.when(F.col("duplicate_count") > 0, F.concat(
            F.lit("PK constraint violation: "), F.col("duplicate_count").cast("string"),
            F.lit(f" duplicate {key}s (e.g. "), ids_text, F.lit(")"))).alias("message"))


def not_numeric(c: Column) -> Column:
    """Text that is present but does not parse as a number."""
    return c.isNotNull() & (c).try_cast("double").isNull()


def type_mismatch_counts(df: DataFrame, expected_numeric: list[str], dataset: str = "sales") -> DataFrame:
    """Per expected-numeric column, how many values are not numbers.

    Works on an all-text read (trap: a typed read would silently null the
    bad values).  One aggregate for all columns.
    """
    present = [c for c in expected_numeric if c in df.columns]
    if not present:
        return df.sparkSession.createDataFrame(
            [], "dataset string, column_name string, actual_type string, bad_count bigint, total_rows bigint")
    aggs = [F.count(F.lit(1)).alias("__rows")]
    aggs += [F.sum(F.when(not_numeric(quoted(c).cast("string")), 1).otherwise(0)).cast("bigint").alias(f"b{i}")
             for i, c in enumerate(present)]
    wide = df.agg(*aggs)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("actual_type"),
                 F.col(f"b{i}").alias("bad_count")) for i, c in enumerate(present)])).alias("m"),
        F.col("__rows").alias("total_rows")) \
        .select(F.lit(dataset).alias("dataset"), "m.column_name", "m.actual_type", "m.bad_count", "total_rows")


def bad_value_samples(df: DataFrame, column: str, order_by: list[str], n: int = 3) -> DataFrame:
    """L1: the first ``n`` non-numeric values of ``column`` in an explicit order."""
    c = quoted(column).cast("string")
    return (df.where(not_numeric(c)).select(*order_by, c.alias("bad_value"))
            .orderBy(*order_by, "bad_value").limit(n))


def quality_flags(metrics: DataFrame) -> DataFrame:
    """Any nulls, duplicates, schema violations, type mismatches or
    out-of-range values flag a run.  Extra columns alone do not."""
    nv, nt = F.size("schema_violations"), F.size("type_mismatches")
    flag = ((F.col("null_count") > 0) | (F.col("duplicate_count") > 0) | (nv > 0) | (nt > 0)
            | (F.col("out_of_range_count") > 0))
    return metrics.select("run_id", flag.alias("has_quality_issues"), "null_count", "duplicate_count",
                          nv.cast("bigint").alias("n_schema_violations"),
                          nt.cast("bigint").alias("n_type_mismatches"),
                          F.size("extra_columns").cast("bigint").alias("n_extra_columns"), "out_of_range_count")


def reconcile(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Key-level reconciliation of a source and a processed table.

    Both sides are reduced to per-key counts first (map-side combine), so
    the full outer join sees at most one row per key per side.
    """
    s = key_counts(source, key).withColumnRenamed("n", "sn")
    t = key_counts(target, key).withColumnRenamed("n", "tn")
    j = s.join(t, s[key].eqNullSafe(t[key]), "full_outer")
    sn, tn = F.col("sn"), F.col("tn")
    return j.agg(
        F.coalesce(F.sum(sn), F.lit(0)).cast("bigint").alias("source_rows"),
        F.coalesce(F.sum(tn), F.lit(0)).cast("bigint").alias("target_rows"),
        F.count(sn).alias("source_keys"), F.count(tn).alias("target_keys"),
        F.sum(F.when(tn.isNull(), 1).otherwise(0)).cast("bigint").alias("missing_in_target"),
        F.sum(F.when(sn.isNull(), 1).otherwise(0)).cast("bigint").alias("extra_in_target"),
        F.sum(F.when(sn.isNotNull() & tn.isNotNull() & (sn != tn), 1).otherwise(0)).cast("bigint")
        .alias("count_mismatch_keys"))


def select_present(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Project the wanted columns that exist, in the wanted order."""
    return df.select(*[quoted(c) for c in wanted if c in df.columns])


def first_rows(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """L2: the first ``n`` rows under an explicit total order (bounded top-n)."""
    cols = list(order_by or []) + [c for c in df.columns if c not in (order_by or [])]
    return df.orderBy(*[quoted(c).asc_nulls_first() for c in cols]).limit(n)
