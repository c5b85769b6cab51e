"""File sources and sinks.

* CSV with a header and a declared schema, plus an all-text read used for
  drift detection (a typed read would silently null bad values).
* JSON arrays and JSON Lines; one large file of either kind is read by many tasks.
* Source arrival: which expected sources are present, and their row counts.
* Partitioned Parquet writes with dynamic partition overwrite, and the
  append-only run history.
"""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import MISSING_SOURCE_MSG
from . import ranges

# pandas' default missing-value tokens that Spark's CSV reader does not treat as null
NA_TOKENS = ["", "NA", "N/A", "n/a", "NaN", "nan", "null", "NULL", "None", "<NA>", "-NaN", "-nan",
             "#N/A", "#NA", "#N/A N/A", "-1.#IND", "-1.#QNAN", "1.#IND", "1.#QNAN"]


def normalise_na(df: DataFrame) -> DataFrame:
    """Turn the usual missing-value tokens of text columns into nulls."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(c.isin(*NA_TOKENS), F.lit(None).cast("string")).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


CORRUPT = "_corrupt_record"
_CSV_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true"}


def _header(head: str) -> list[str]:
    """The column names of a header; a repeated or empty name gets its position."""
    names = next(csv.reader([head.lstrip("\ufeff").rstrip("\r\n")]), [])
    return [n if n and names.count(n) == 1 else f"{n or '_c'}{i}" for i, n in enumerate(names)]


def _parsed_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | None,
                corrupt: bool = False) -> DataFrame:
    """The records below ``path``, read by the names in each file's own header."""
    records, heads = ranges.csv_records(spark, path)
    out = None
    for head in heads:
        names = _header(head)
        declared = {f.name: f.dataType for f in schema.fields} if schema is not None else {}
        fields = [T.StructField(n, declared.get(n, T.StringType())) for n in names]
        options = dict(_CSV_OPTIONS)
        if corrupt:
            fields.append(T.StructField(CORRUPT, T.StringType()))
            options["columnNameOfCorruptRecord"] = CORRUPT
        shape = T.StructType(fields)
        row = F.from_csv("value", F.lit(shape.toDDL()), options).alias("row")
        part = (records.where(F.col("head") == head) if len(heads) > 1 else records).select(row)
        wanted = [*(f.name for f in schema.fields), *([CORRUPT] if corrupt else [])] if schema is not None else names
        types = {**declared, CORRUPT: T.StringType()}
        part = part.select(*[(F.col("row")[n] if n in shape.names else F.lit(None).cast(types[n])).alias(n)
                             for n in wanted])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        return spark.createDataFrame([], schema or T.StructType([]))
    return out


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None,
             parallel: bool = True) -> DataFrame:
    """CSV with a header.  With ``schema`` the read is typed (no inference
    pass); without it every column is text (for drift profiling).  Columns are
    matched by the names in each file's header: a declared column that a file
    lacks is null there, one that is not declared is left out (``header_drift``
    tells).  Either way the usual missing-value tokens in text columns become
    nulls.  ``corrupt_records`` counts what a typed read cannot parse.

    Fields may hold line feeds.  Files are cut into ranges (``sources.ranges``),
    which takes one more scan when the table is made; ``parallel=False`` reads
    each file in one task, which also takes quotes inside bare fields.
    """
    schema = _struct(schema)
    if parallel:
        return normalise_na(_parsed_csv(spark, path, schema))
    text = spark.read.options(**_CSV_OPTIONS).option("header", True).option("inferSchema", False)
    if schema is None:
        return normalise_na(text.csv(path))
    found = text.csv(path)                                  # all text, so that names decide, then cast
    out = [(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in found.columns
            else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]
    return normalise_na(found.select(*out))


def _struct(schema: T.StructType | str | None) -> T.StructType | None:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def header_drift(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """``file, missing, extra, reordered`` of every CSV file whose header is not the declared column list."""
    names = [f.name for f in _struct(schema).fields]
    first = ranges.range_states(ranges.segments(spark, path, ranges.CSV), ranges.CSV).where("block = 0")
    plain = F.regexp_replace("head", "^\ufeff|[\r\n]+$", "")
    found = F.transform(F.split(plain, ","), lambda n: F.regexp_replace(F.trim(n), '^"|"$', ""))
    want = F.array(*map(F.lit, names))
    both = F.array_intersect("found", want)
    return first.select("file", found.alias("found")).select(
        "file", F.array_except(want, "found").alias("missing"), F.array_except("found", want).alias("extra"),
        (both != F.array_intersect(want, "found")).alias("reordered")).where(
        (F.size("missing") > 0) | (F.size("extra") > 0) | F.col("reordered"))


def corrupt_records(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """Records of a typed CSV or JSON read that do not fit ``schema`` (their bad values read as null), as they are."""
    if fmt == "csv":
        rows = _parsed_csv(spark, path, schema, corrupt=True)
    else:
        wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        rows = ranges.json_records(spark, path).select(
            F.from_json("value", wide, {"columnNameOfCorruptRecord": CORRUPT}).alias("row")).select("row.*")
    return rows.where(F.col(CORRUPT).isNotNull())


def read_json(spark: SparkSession, path: str | list[str], multiline: bool = True,
              schema: T.StructType | str | None = None) -> DataFrame:
    """JSON array files (``multiline``; cut into ranges, so one file is read by many tasks) or JSON Lines."""
    if not multiline:
        return (spark.read.schema(schema) if schema is not None else spark.read).json(path)
    found = ranges.json_records(spark, path)
    if schema is not None:
        return found.select(F.from_json("value", _struct(schema)).alias("row")).select("row.*")
    # Spark infers the columns from the records, as from lines
    texts = getattr(found._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(spark._jsparkSession.read().json(texts), spark)


_CONTRACT_RULE = ("struct<type:string, required:boolean, unique:boolean, min:double, max:double, "
                  "allowed_values:array<string>>")
_SPARK_TYPES = {"string": T.StringType(), "integer": T.LongType(), "float": T.DoubleType(),
                "date": T.DateType(), "boolean": T.BooleanType(), "timestamp": T.TimestampNTZType()}


def read_contract(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """A JSON contract file (``{"name":..., "columns": {col: {rules}}}``)
    as contract rows ``(dataset, column_name, expected_type, required,
    is_unique, min_value, max_value, allowed_values, ordinal)``.

    The file text is parsed straight into a map (schema inference would sort
    the columns), so any column set works and the position is the
    declaration order.
    """
    raw = spark.read.text(path, wholetext=True)
    doc = F.from_json(F.col("value"), f"struct<name:string, columns:map<string, {_CONTRACT_RULE}>>")
    return raw.select(F.posexplode(doc["columns"]).alias("ordinal", "column_name", "r")).select(
        F.lit(dataset).alias("dataset"), "column_name", F.col("r.type").alias("expected_type"),
        F.coalesce("r.required", F.lit(False)).alias("required"),
        F.coalesce("r.unique", F.lit(False)).alias("is_unique"),
        F.col("r.min").alias("min_value"), F.col("r.max").alias("max_value"),
        F.col("r.allowed_values").alias("allowed_values"), F.col("ordinal").cast("int").alias("ordinal"))


def contract_schema(rules: list) -> T.StructType:
    """A typed read schema from rule tuples ``(column, type, ...)``."""
    return T.StructType([T.StructField(r[0], _SPARK_TYPES.get(r[1], T.StringType())) for r in rules])


def try_read(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    """The table at ``path``, or None when the path does not exist.

    ``csv`` and ``json`` are read as ``read_csv`` and ``read_json`` read them
    (``jsonl``: JSON Lines); other formats by Spark's reader of that name.
    """
    readers = {"csv": read_csv, "json": read_json, "jsonl": lambda s, p: read_json(s, p, multiline=False)}
    try:
        return readers[fmt](spark, path) if fmt in readers else spark.read.format(fmt).load(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def resolve_sources(spark: SparkSession, supplied: dict[str, DataFrame | None],
                    defaults: dict[str, tuple[str, str]]) -> tuple[dict[str, DataFrame], list[str]]:
    """S3: each dataset is the supplied table, else its default location
    ``(path, format)``; datasets found nowhere are returned as missing."""
    found, missing = {}, []
    for name, (path, fmt) in defaults.items():
        df = supplied.get(name)
        if df is None:
            df = try_read(spark, path, fmt)
        if df is None:
            missing.append(name)
        else:
            found[name] = df
    return found, missing


def source_arrival(spark: SparkSession, expected: dict[str, str], fmt: str = "parquet") -> DataFrame:
    """One row per expected source: landed or not, rows, status, message.

    Existence is a metadata check in the driver; the row counts of landed
    sources are Spark aggregates (footer-only for bare Parquet scans).
    """
    parts = []
    for name, path in expected.items():
        df = try_read(spark, path, fmt)
        if df is None:
            parts.append(spark.range(1).select(
                F.lit(name).alias("source"), F.lit(False).alias("landed"),
                F.lit(0).cast("bigint").alias("row_count"), F.lit("failed").alias("status"),
                F.lit(MISSING_SOURCE_MSG.format(name)).alias("message")))
        else:
            parts.append(df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("source"), F.lit(True).alias("landed"), "row_count",
                F.lit("success").alias("status"), F.lit(None).cast("string").alias("message")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def write_partitioned(df: DataFrame, path: str, partition_by: list[str], cluster_by: list[str] | None = None,
                      fmt: str = "parquet", observation=None, replace_all: bool = False) -> None:
    """Publish a table, replacing the partitions present in ``df``, or all below ``path`` with ``replace_all``.

    Dynamic partition overwrite makes a re-run of one day idempotent and
    leaves other days untouched.  With ``cluster_by`` the rows are
    range-partitioned on (partition columns, cluster columns): each task
    writes few partition folders, and a hot partition value is split over
    several tasks by the cluster columns instead of landing in one.
    Without it the write keeps the input partitioning (no shuffle).
    ``observation`` (a ``pyspark.sql.Observation``) receives the number of
    rows written, counted by the write itself.
    """
    out = df
    if cluster_by:
        out = df.repartitionByRange(*[F.col(c) for c in partition_by + list(cluster_by)])
    if observation is not None:
        # observed after the repartition: the range sampling job does not count
        out = out.observe(observation, F.count(F.lit(1)).alias("rows"))
    (out.write.mode("overwrite").option("partitionOverwriteMode", "static" if replace_all else "dynamic")
     .partitionBy(*partition_by).format(fmt).save(path))


def run_partition(path: str, run_id: str) -> str:
    """The folder of one run in a table partitioned by ``run_id``."""
    return f"{path.rstrip('/')}/run_id={run_id}"


def delete_path(spark: SparkSession, path: str) -> bool:
    """Delete a folder in whatever store it is; False when there is none."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


RUN_TABLE_BUCKETS = 64


def run_table_name(base: str, name: str) -> str:
    """Catalog name of a bucketed run table stored under ``base``."""
    import hashlib
    return f"stagewatch_{name}_{hashlib.sha1(base.encode()).hexdigest()[:10]}"


def append_run_table(df: DataFrame, base: str, name: str, bucketed: bool = False,
                     buckets: int = RUN_TABLE_BUCKETS) -> None:
    """Append rows to one run table (``base/name``).

    With ``bucketed`` the table is an external catalog table bucketed and
    sorted by ``run_id``; all run tables then share the bucketing, so joins
    between them on ``run_id`` need no shuffle.
    """
    w = df.write.mode("append").format("parquet").option("path", f"{base}/{name}")
    if bucketed:
        w.bucketBy(buckets, "run_id").sortBy("run_id").saveAsTable(run_table_name(base, name))
    else:
        w.save()


def read_run_table(spark: SparkSession, base: str, name: str, bucketed: bool = False) -> DataFrame:
    """Read one run table written by ``append_run_table``."""
    if bucketed:
        return spark.table(run_table_name(base, name))
    return spark.read.parquet(f"{base}/{name}")


HISTORY_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("scenario_name", T.StringType()),
    T.StructField("failure_type", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("duration_seconds", T.DoubleType()),
    T.StructField("remediation_applied", T.ArrayType(T.StringType())),
    T.StructField("failed_stages", T.ArrayType(T.StringType())),
    T.StructField("data_quality", T.StructType([
        T.StructField("total_rows", T.LongType()),
        T.StructField("total_nulls", T.LongType()),
        T.StructField("duplicate_count", T.LongType()),
        T.StructField("schema_violations", T.ArrayType(T.StringType())),
    ])),
])


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The run history, compacted dates included (``sources.compaction``).  A
    missing store is an empty history; a file that cannot be read is an error
    when the history is used, never skipped."""
    from .compaction import visible_history
    found = visible_history(spark, path)
    return spark.createDataFrame([], HISTORY_SCHEMA) if found is None else found


def append_history(records: DataFrame, path: str, rollup_path: str | None = None) -> None:
    """Append records (a true append; nothing is rewritten).  With
    ``rollup_path`` their hourly roll-up (``operators.rollups``) is appended there."""
    (records.withColumn("run_date", F.to_date("ts")).write.mode("append")
     .partitionBy("run_date").parquet(path))
    if rollup_path is not None:
        from ..operators.rollups import hourly_rollup
        hourly_rollup(records).coalesce(1).write.mode("append").parquet(rollup_path)
