"""Repair of all runs at once: playbook steps joined to runs and applied as one plan keyed by run.

``repair`` mends one run's table; here one table holds the rows of many runs,
and a plan says which steps each run needs.  A run's steps become flags of its
rows, every repair is an expression under its flag, and only rows of runs that
are de-duplicated are shuffled by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import FILL_DEFAULT, RULES_BY_DATASET
from ..functions.exprs import quoted
from .repair import _SPARK_TYPE, extract_number

CAST, ADD, DROP = (f"apply_schema_fix({x})" for x in ("fix_type_cast", "add_missing_column_default", "drop_extra_columns"))
DEDUPLICATE, FILL = "deduplicate_records", "fill_null_defaults"


def run_flags(plan: DataFrame) -> DataFrame:
    """``run_id`` and what its steps ask for: one row per run of ``plan`` (``run_id, action, columns``).

    ``columns`` names what a step is about (a column to add, cast or fill;
    null: none).  Steps that re-run stages are no repairs and pass by.
    """
    def asked(action: str) -> Column:
        own = F.when(F.split_part("action", F.lit("("), F.lit(1)).isin(action) | (F.col("action") == action),
                     F.coalesce("columns", F.array().cast("array<string>")))
        return F.array_distinct(F.flatten(F.collect_list(own)))            # a run has a handful of steps

    return plan.groupBy(F.col("run_id").alias("planned_run")).agg(
        asked(CAST).alias("cast_columns"), asked(ADD).alias("add_columns"), asked(FILL).alias("fill_columns"),
        F.bool_or(F.col("action") == DROP).alias("drop_extra"),
        F.bool_or(F.startswith("action", F.lit(DEDUPLICATE))).alias("deduplicate"))


def repair_runs(rows: DataFrame, plan: DataFrame, dataset: str = "sales", key: str = "transaction_id",
                order_by: list[str] | None = None, default: str = FILL_DEFAULT) -> DataFrame:
    """``rows`` (``run_id``, the dataset's columns as they landed, others) with every run's planned steps applied.

    A text column to cast becomes a number where asked, and in other runs a
    number wherever its text is one.  A column to add gets its typed default
    (text: ``UNKNOWN``) in that run's rows; a column to fill gets ``default``
    where it is null.  Extra columns are null in runs that drop them.  Of rows
    that share run and key the first by ``order_by`` stays where asked.  Runs
    without a plan keep their rows; plans without rows change nothing.
    """
    declared = {r[0]: _SPARK_TYPE.get(r[1], "string") for r in RULES_BY_DATASET[dataset]}
    j = rows.join(run_flags(plan), F.col("run_id") == F.col("planned_run"), "left")
    out = [F.col("run_id")]
    for field in rows.schema.fields:
        name, c = field.name, quoted(field.name)
        if name == "run_id":
            continue
        if name not in declared:
            out.append(F.when(~F.coalesce("drop_extra", F.lit(False)), c).alias(name))
            continue
        kind, text = declared[name], isinstance(field.dataType, T.StringType)
        if text and kind in ("double", "bigint"):
            plain = F.trim(c).try_cast("double")
            c = F.when(_listed("cast_columns", name), F.coalesce(plain, extract_number(c))).otherwise(plain).cast(kind)
        elif text and kind != "string":
            c = c.try_cast(kind)
        if kind == "string":
            c = F.when(_listed("add_columns", name), F.lit(FILL_DEFAULT)).when(
                _listed("fill_columns", name) & c.isNull(), F.lit(default)).otherwise(c)
        out.append(c.alias(name))
    mended = j.select(*out, F.coalesce("deduplicate", F.lit(False)).alias("_once"))
    order = [quoted(c).asc_nulls_first() for c in order_by or rows.columns if c != "run_id"]
    first = F.row_number().over(Window.partitionBy("run_id", key).orderBy(*order))
    once = mended.where("_once").withColumn("_n", first).where("_n = 1").drop("_n")
    return mended.where("not _once").unionByName(once).drop("_once")


def _listed(flags: str, name: str) -> Column:
    return F.coalesce(F.array_contains(flags, name), F.lit(False))


def repair_effects(rows: DataFrame, repaired: DataFrame, columns: list[str]) -> DataFrame:
    """``run_id, rows_before, rows_after`` and per column the nulls before and after: one aggregate a side."""
    def side(table: DataFrame, suffix: str) -> DataFrame:
        return table.groupBy("run_id").agg(F.count(F.lit(1)).alias(f"rows_{suffix}"), *[
            F.count_if(quoted(c).isNull()).alias(f"{c}_nulls_{suffix}") for c in columns])

    return side(rows, "before").join(side(repaired, "after"), "run_id", "left")
