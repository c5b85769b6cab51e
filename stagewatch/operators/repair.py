"""Repairs: schema fixes (P4-P6), null filling (P7), de-duplication.

Each repair is a pure ``DataFrame -> DataFrame`` function; its *effect*
(rows before/after, nulls fixed) is a separate one-pass aggregate, so a job
can record the effect without materialising the repaired table twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import FILL_DEFAULT, NUMBER_PATTERN, RULES_BY_DATASET
from ..functions.exprs import is_null, quoted

_SPARK_TYPE = {"string": "string", "integer": "bigint", "float": "double", "date": "date",
               "boolean": "boolean"}


class RepairError(ValueError):
    """A repair was asked for something it cannot do (unknown column, bad default)."""


def contract_columns(dataset: str) -> list[str]:
    return [r[0] for r in RULES_BY_DATASET[dataset]]


def drop_extra_columns(df: DataFrame, dataset: str = "sales") -> DataFrame:
    """Keep the contract's columns only (in the table's order)."""
    keep = set(contract_columns(dataset))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in keep])


def extract_number(c: Column) -> Column:
    """First run of digits/dots, as double; no match or a malformed number -> null.

    ``regexp_extract`` returns '' when nothing matches, hence the ``nullif``;
    ``try_cast`` keeps ANSI mode from failing on values like ``1.2.3``.
    """
    return F.nullif(F.regexp_extract(c, NUMBER_PATTERN, 1), F.lit("")).try_cast("double")


def fix_type_cast(df: DataFrame, column: str = "unit_price") -> DataFrame:
    """P5: turn a text price like ``29.99_USD`` back into a number.

    Only a text column is touched; a numeric one is returned unchanged.
    """
    if column not in df.columns or not isinstance(df.schema[column].dataType, T.StringType):
        return df
    return df.withColumn(column, extract_number(F.col(column)))


def add_missing_columns(df: DataFrame, dataset: str = "sales") -> DataFrame:
    """Add each absent contract column.

    Text columns get ``'UNKNOWN'``; other types get a typed null so the
    repair does not create a new type mismatch.
    """
    out = df
    for name, typ, *_ in RULES_BY_DATASET[dataset]:
        if name not in out.columns:
            t = _SPARK_TYPE.get(typ, "string")
            val = F.lit(FILL_DEFAULT) if t == "string" else F.lit(None).cast(t)
            out = out.withColumn(name, val)
    return out


def _typed_default(df: DataFrame, column: str, default) -> Column:
    if column not in df.columns:
        raise RepairError(f"Column '{column}' not found; available: {df.columns}")
    dt = df.schema[column].dataType
    if isinstance(dt, T.StringType):
        return F.lit(str(default))
    try:
        if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            value = int(default)
        elif isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
            value = float(default)
        elif isinstance(dt, T.BooleanType):
            value = str(default).lower() in ("1", "true", "yes")
        else:
            value = default
    except (TypeError, ValueError) as exc:
        raise RepairError(f"Default {default!r} does not fit column '{column}' of type "
                          f"{dt.simpleString()}") from exc
    return F.lit(value).cast(dt)


def fill_nulls(df: DataFrame, column: str, default=FILL_DEFAULT) -> DataFrame:
    """Replace nulls (and NaN) in one column by a type-checked default."""
    d = _typed_default(df, column, default)
    return df.withColumn(column, F.when(is_null(df, column), d).otherwise(F.col(column)))


def fill_nulls_effect(df: DataFrame, column: str, default=FILL_DEFAULT) -> DataFrame:
    """P7 effect: nulls before and after the fill and rows fixed, in one pass."""
    d = _typed_default(df, column, default)
    before = is_null(df, column)
    after_val = F.when(before, d).otherwise(F.col(column))
    after = after_val.isNull()
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        after = after | F.isnan(after_val)
    agg = df.agg(F.sum(F.when(before, 1).otherwise(0)).cast("bigint").alias("nulls_before"),
                 F.sum(F.when(after, 1).otherwise(0)).cast("bigint").alias("nulls_after"))
    return agg.select(F.lit(column).alias("column_name"), F.lit(str(default)).alias("default_value"),
                      F.coalesce("nulls_before", F.lit(0)).alias("nulls_before"),
                      F.coalesce("nulls_after", F.lit(0)).alias("nulls_after"),
                      (F.coalesce("nulls_before", F.lit(0)) - F.coalesce("nulls_after", F.lit(0)))
                      .alias("rows_fixed"))


def dedup_first(df: DataFrame, key: str | list[str], order_by: list[str] | None = None) -> DataFrame:
    """Keep the first row per key under an explicit total order.

    ``order_by`` names the columns that define "first"; the remaining
    columns break ties so the survivor is deterministic.  Planned as
    ``row_number() = 1``, which Spark executes with a partial
    ``WindowGroupLimit`` before the shuffle: each map task forwards at most
    one row per key, so a hot key cannot flood one reducer.

    ``key`` may be several columns.  Keying by the columns the input is
    already hash-partitioned on (e.g. the parts of an id that a sort-merge
    join produced) lets the window reuse that partitioning: no new shuffle.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order_by = [c for c in (order_by or []) if c not in keys]
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in order_by + rest])
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def dedup_full_row(df: DataFrame) -> DataFrame:
    """Drop exact duplicate rows (any survivor is the same row)."""
    return df.dropDuplicates()


def dedup_effect(df: DataFrame, key: str | None, dataset: str) -> DataFrame:
    """W1 effect: rows before/after/removed without materialising the result."""
    if key is None:
        kc = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    else:
        kc = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return kc.agg(F.lit(dataset).alias("dataset"),
                  F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows_before"),
                  F.count(F.lit(1)).alias("rows_after")) \
        .withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))


def dedup_conflicts(df: DataFrame, key: str, order_by: list[str] | None = None,
                    dataset: str = "sales") -> DataFrame:
    """What a keep-first de-duplication would really remove.

    Splits the removed rows into exact copies of their key's survivor and
    rows that differ from it (genuine data lost, e.g. after key overwrites).
    Equal rows are counted first (map-side combine), so a key meets its distinct
    rows only; the least of them in the order of ``dedup_first`` is the survivor.
    One read of the input and no join.
    """
    first = [c for c in (order_by or []) if c != key]
    order = first + [c for c in df.columns if c != key and c not in first]
    counted = df.groupBy(*[quoted(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    row = F.struct(*[quoted(c).alias(f"o{i}") for i, c in enumerate(order)], F.col("_copies").alias("copies"))
    per_key = counted.groupBy(quoted(key).alias("_key")).agg(
        F.sum("_copies").alias("n"), F.min(row)["copies"].alias("eq"))
    return per_key.agg(
        F.lit(dataset).alias("dataset"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
        F.coalesce(F.sum(F.col("eq") - 1), F.lit(0)).cast("bigint").alias("removed_identical"),
        F.coalesce(F.sum(F.col("n") - F.col("eq")), F.lit(0)).cast("bigint").alias("removed_conflicting"),
        F.coalesce(F.sum(F.when(F.col("n") > F.col("eq"), 1).otherwise(0)), F.lit(0)).cast("bigint")
        .alias("conflicting_keys"))


SCHEMA_FIXES = ("drop_extra_columns", "fix_type_cast", "add_missing_column_default")
DEDUP_KEYS = {"sales": "transaction_id", "customers": "customer_id"}


def apply_schema_fix(df: DataFrame, fix_type: str, dataset: str = "sales") -> DataFrame:
    """P4/P5/P6 by name; an unknown fix type is an error naming the valid ones."""
    if fix_type == "drop_extra_columns":
        return drop_extra_columns(df, dataset)
    if fix_type == "fix_type_cast":
        return fix_type_cast(df)
    if fix_type == "add_missing_column_default":
        return add_missing_columns(df, dataset)
    raise RepairError(f"Unknown fix_type: '{fix_type}'. Use one of {', '.join(SCHEMA_FIXES)}.")


def deduplicate(df: DataFrame, dataset: str, order_by: list[str] | None = None) -> DataFrame:
    """W1-W3 by dataset: keep-first on the dataset's key, or whole-row
    de-duplication when the key column is absent."""
    if dataset not in DEDUP_KEYS:
        raise RepairError(f"Unknown dataset: '{dataset}'")
    key = DEDUP_KEYS[dataset]
    if key not in df.columns:
        return dedup_full_row(df)
    return dedup_first(df, key, order_by or [key])
