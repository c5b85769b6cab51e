"""Column contracts: schema drift (C1, C2, C4, C5), declared rules (C13) and
the ingestion verdict (C11).

A contract is data: one row per (dataset, column) with type, required,
unique, min, max and allowed values.  Schemas of the tables being checked
become rows too, so drift for many datasets (or many daily drops of one
dataset) is one join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import DRIFT_TYPES, RULES_BY_DATASET
from ..functions.exprs import quoted

CONTRACT_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("expected_type", T.StringType()),
    T.StructField("required", T.BooleanType()),
    T.StructField("is_unique", T.BooleanType()),
    T.StructField("min_value", T.DoubleType()),
    T.StructField("max_value", T.DoubleType()),
    T.StructField("allowed_values", T.ArrayType(T.StringType())),
    T.StructField("ordinal", T.IntegerType()),
])

RULES = RULES_BY_DATASET


def contract_table(spark: SparkSession, datasets: list[str] | None = None) -> DataFrame:
    """The declared contracts as rows (a literal table; tiny)."""
    rows = []
    for ds, rules in RULES.items():
        if datasets is not None and ds not in datasets:
            continue
        for i, (col, typ, req, uniq, lo, hi, allowed) in enumerate(rules):
            rows.append((ds, col, typ, req, uniq, lo, hi, allowed, i))
    return spark.createDataFrame(rows, CONTRACT_SCHEMA)


def type_family(dt: T.DataType) -> str:
    """Contract type name of a Spark type."""
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, T.DateType):
        return "date"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    return "string"


def schema_table(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """Actual schemas as rows ``(dataset, column_name, actual_type, ordinal)``."""
    rows = [(name, f.name, type_family(f.dataType), i)
            for name, df in frames.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "dataset string, column_name string, actual_type string, ordinal int")


def schema_drift(actual: DataFrame, contract: DataFrame) -> DataFrame:
    """Missing, extra and pinned-type columns per dataset.

    ``actual`` rows are ``(dataset, contract_dataset, column_name,
    actual_type)`` so several variants of one dataset can be checked against
    the same contract.  Output: one row per dataset with the sorted column
    lists, a drift flag and the recommendation text.
    """
    c = contract.select(F.col("dataset").alias("contract_dataset"), "column_name", "expected_type")
    pinned = F.create_map(*[x for k, v in DRIFT_TYPES.items()
                            for x in (F.lit(k), F.lit({"int64": "integer", "float64": "float"}[v]))])
    # expected columns per checked variant, full-outer-joined to the actual ones
    variants = actual.select("dataset", "contract_dataset").distinct()
    expected = variants.join(c, "contract_dataset")
    a = actual.select("dataset", "contract_dataset", "column_name", "actual_type")
    m = expected.join(a, ["dataset", "contract_dataset", "column_name"], "full_outer")
    pin = F.try_element_at(pinned, F.col("column_name"))
    flagged = m.select(
        "dataset", "column_name",
        (F.col("actual_type").isNull()).alias("is_missing"),
        (F.col("expected_type").isNull()).alias("is_extra"),
        (pin.isNotNull() & F.col("actual_type").isNotNull() & (F.col("actual_type") != pin))
        .alias("is_type_issue"),
        "actual_type", pin.alias("pinned_type"))

    def names(flag: str):
        return F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col(flag), F.col("column_name")))))
    out = flagged.groupBy("dataset").agg(
        names("is_missing").alias("missing_columns"),
        names("is_extra").alias("extra_columns"),
        names("is_type_issue").alias("type_issue_columns"),
        F.sum(F.col("is_missing").cast("int")).cast("bigint").alias("n_missing"),
        F.sum(F.col("is_extra").cast("int")).cast("bigint").alias("n_extra"),
        F.sum(F.col("is_type_issue").cast("int")).cast("bigint").alias("n_type_issues"))
    drift = (F.col("n_missing") + F.col("n_extra") + F.col("n_type_issues")) > 0
    return out.withColumn("drift_detected", drift).withColumn(
        "recommendation", F.when(drift, F.lit("Apply schema fix to handle drift"))
        .otherwise(F.lit("Schema matches expected definition")))


def range_test(df: DataFrame, name: str, lo: float | None, hi: float | None) -> Column:
    """True for a non-null value of ``name`` outside ``[lo, hi]`` (text values are read as numbers)."""
    c = quoted(name)
    v = c.try_cast("double") if isinstance(df.schema[name].dataType, T.StringType) else c.cast("double")
    bad = F.lit(False)
    if lo is not None:
        bad = bad | (v < F.lit(lo))
    if hi is not None:
        bad = bad | (v > F.lit(hi))
    return v.isNotNull() & bad


def range_tests(df: DataFrame, dataset: str) -> list[Column]:
    """The range tests that the contract of ``dataset`` declares for the columns of ``df``."""
    return [range_test(df, name, lo, hi) for name, _t, _r, _u, lo, hi, _a in RULES[dataset]
            if name in df.columns and (lo is not None or hi is not None)]


def rule_violations(df: DataFrame, dataset: str, rules: list | None = None,
                    kinds: tuple[str, ...] = ("required", "type", "range", "allowed")) -> DataFrame:
    """Evaluate declared row rules in ONE aggregate over ``df``.

    Returns ``(dataset, column_name, rule, violations, total_rows)`` for
    every rule that applies to a column present in ``df``.  Range tests
    count non-null values outside ``[min, max]``; allowed-value tests count
    non-null values outside the set; required tests count nulls; type tests
    count the non-null values of text columns that do not read as the
    declared type (columns of another type than text fit or fail as a whole,
    which ``schema_drift`` reports).
    """
    rules = RULES[dataset] if rules is None else rules
    checks = []
    for name, _typ, required, _uniq, lo, hi, allowed in rules:
        if name not in df.columns:
            continue
        c = quoted(name)
        if "required" in kinds and required:
            checks.append((name, "required", c.isNull()))
        cast = {"integer": "bigint", "float": "double", "date": "date", "boolean": "boolean"}.get(_typ)
        if "type" in kinds and cast and isinstance(df.schema[name].dataType, T.StringType):
            checks.append((name, "type", c.isNotNull() & c.try_cast(cast).isNull()))
        if "range" in kinds and (lo is not None or hi is not None):
            checks.append((name, "range", range_test(df, name, lo, hi)))
        if "allowed" in kinds and allowed:
            checks.append((name, "allowed", c.isNotNull() & ~c.cast("string").isin(*allowed)))
    if not checks:
        return df.sparkSession.createDataFrame(
            [], "dataset string, column_name string, rule string, violations bigint, total_rows bigint")
    wide = df.agg(F.count(F.lit(1)).alias("__rows"),
                  *[F.sum(F.when(b, 1).otherwise(0)).cast("bigint").alias(f"v{i}")
                    for i, (_, _, b) in enumerate(checks)])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(col).alias("column_name"), F.lit(rule).alias("rule"), F.col(f"v{i}").alias("violations"))
        for i, (col, rule, _) in enumerate(checks)])).alias("r"), F.col("__rows").alias("total_rows")) \
        .select(F.lit(dataset).alias("dataset"), "r.column_name", "r.rule", "r.violations", "total_rows")


def uniqueness_violations(df: DataFrame, columns: list[str], dataset: str) -> DataFrame:
    """C13 ``unique``: rows beyond the first per value, for each unique column.

    One scan for all columns: every row is exploded into one
    ``(column, value)`` pair per checked column and counted in a single
    shuffle with map-side combine.  Values compare as text; nulls count as
    one value, matching a pandas duplicate test.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), quoted(c).cast("string").alias("_v"))
                                for c in columns]))
    kc = (df.select(pairs.alias("_p")).groupBy("_p._c", "_p._v").agg(F.count(F.lit(1)).alias("n")))
    return kc.groupBy(F.col("_c").alias("column_name")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("violations"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_rows")) \
        .select(F.lit(dataset).alias("dataset"), "column_name", "violations", "total_rows")


def unique_columns(dataset: str, df: DataFrame) -> list[str]:
    """Columns the contract declares unique that ``df`` has."""
    return [r[0] for r in RULES[dataset] if r[3] and r[0] in df.columns]


def all_datasets_schema(spark: SparkSession, variants: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """Schema rows for named variants: ``{variant: (contract_dataset, df)}``."""
    tables = []
    for name, (cds, df) in variants.items():
        st = schema_table(spark, {name: df}).withColumn("contract_dataset", F.lit(cds))
        tables.append(st)
    return reduce(lambda a, b: a.unionByName(b), tables)


def mistyped_columns(df: DataFrame) -> list[str]:
    """Pinned columns whose actual type family differs from the pinned one."""
    want = {"int64": "integer", "float64": "float"}
    return [c for c, t in DRIFT_TYPES.items()
            if c in df.columns and type_family(df.schema[c].dataType) != want[t]]


def type_issue_samples(variants: dict[str, tuple[str, DataFrame]], order_by: list[str],
                       n: int = 3) -> DataFrame | None:
    """C4 samples: the first ``n`` values of each mistyped column, per variant.

    Each sample is a bounded top-``n`` (no full sort, no collect).
    Returns ``(dataset, sample_values)``.
    """
    parts = []
    for name, (_cds, df) in variants.items():
        for col in mistyped_columns(df):
            keys = [c for c in order_by if c in df.columns]
            top = (df.select(*keys, F.col(col).cast("string").alias("_v"))
                   .orderBy(*keys, "_v").limit(n))
            parts.append(top.agg(F.concat_ws(", ", F.transform(
                F.array_sort(F.collect_list(F.struct(*keys, "_v"))), lambda s: s["_v"]))
                .alias("sample_values")).select(F.lit(name).alias("dataset"), "sample_values"))
    if not parts:
        spark = next(iter(variants.values()))[1].sparkSession
        return spark.createDataFrame([], "dataset string, sample_values string")
    return reduce(lambda a, b: a.unionByName(b), parts)


def rules_from_contract(contract: DataFrame, dataset: str | None = None) -> list[tuple]:
    """Rule tuples for ``rule_violations`` from contract rows (e.g. a contract
    file read by ``sources.files.read_contract``).  Contract rows are metadata
    — one per declared column — so they are brought to the driver to build
    the single profiling aggregate."""
    rows = contract if dataset is None else contract.where(F.col("dataset") == dataset)
    out = []
    for r in rows.orderBy("ordinal").collect():           # bounded: one row per declared column
        out.append((r["column_name"], r["expected_type"], bool(r["required"]), bool(r["is_unique"]),
                    r["min_value"], r["max_value"], list(r["allowed_values"]) if r["allowed_values"] else None))
    return out
