"""Continuous quality monitoring with Structured Streaming.

The batch operators (null profile, duplicate keys, contract rules) are
applied to every micro-batch of newly landed files through ``foreachBatch``;
each batch appends one set of metric rows tagged with its ``batch_id``.
Writes go to a partition per batch id with dynamic overwrite, so a batch
replayed after a failure replaces its own output instead of duplicating it
(the checkpoint location makes the stream itself exactly-once).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import contracts as C
from ..operators import profile as Q
from ..operators.key_index import KeyIndex

METRIC_SCHEMA = "dataset string, column_name string, metric string, value bigint, total_rows bigint"


def batch_metrics(batch: DataFrame, dataset: str, key: str | None) -> DataFrame:
    """Long-form quality metrics of one batch: nulls, rule violations, duplicates."""
    nulls = Q.null_profile(batch, dataset, nonzero_only=False).select(
        "dataset", "column_name", F.lit("nulls").alias("metric"),
        F.col("null_count").alias("value"), "total_rows")
    rules = C.rule_violations(batch, dataset, kinds=("range", "allowed")).select(
        "dataset", "column_name", F.concat(F.lit("violations_"), F.col("rule")).alias("metric"),
        F.col("violations").alias("value"), "total_rows")
    parts = [nulls, rules]
    if key and key in batch.columns:
        d = Q.duplicate_count(batch, key, dataset).select(
            "dataset", F.col("key_column").alias("column_name"), F.lit("duplicates").alias("metric"),
            F.col("duplicate_count").alias("value"), "total_rows")
        parts.append(d)
    return reduce(lambda a, b: a.unionByName(b), parts)


def start_quality_stream(spark: SparkSession, source_dir: str, schema: T.StructType | str,
                         metrics_path: str, checkpoint: str, dataset: str = "sales",
                         key: str | None = "transaction_id", fmt: str = "parquet",
                         available_now: bool = True, max_files_per_trigger: int = 1000,
                         key_index: KeyIndex | None = None) -> StreamingQuery:
    """Profile every micro-batch of files landing in ``source_dir``.

    With ``key_index`` a batch also reports the rows whose key an earlier batch
    (or load) has published, metric ``repeated_keys``, and adds its own keys;
    a batch that is replayed replaces its keys and does not meet them.

    ``max_files_per_trigger`` bounds each micro-batch; the batch is persisted
    while its three profiles run (one read of the files instead of three)
    and released afterwards.
    """
    stream = (spark.readStream.schema(schema).format(fmt)
              .option("maxFilesPerTrigger", max_files_per_trigger).load(source_dir))

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            metrics = batch_metrics(batch, dataset, key)
            if key_index is not None and key:
                load = f"{dataset}-{batch_id:012d}"
                again = key_index.repeated(batch, key, load).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("value"))
                metrics = metrics.unionByName(again.select(
                    F.lit(dataset).alias("dataset"), F.lit(key).alias("column_name"), F.lit("repeated_keys").alias("metric"),
                    "value", F.lit(batch.count()).cast("bigint").alias("total_rows")))
                key_index.add(batch, key, load)
            (metrics.withColumn("batch_id", F.lit(batch_id))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("batch_id").parquet(metrics_path))
        finally:
            batch.unpersist()

    w = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


HISTORY_RECORD_SCHEMA = ("run_id string, scenario_name string, failure_type string, ts timestamp, "
                         "outcome string, duration_seconds double")


def trend_windows(records: DataFrame, window_hours: int = 24, slide_hours: int = 1,
                  late_hours: int = 24) -> DataFrame:
    """Sliding-window failure trend over a stream of run-history records.

    The batch trend (A5) looks back ``window_hours`` from one moment; the
    stream keeps that look-back for every hour.  The watermark bounds the
    state: records later than ``late_hours`` are dropped from their window,
    and a window is emitted once the watermark passes its end.
    """
    from ..operators.history import DURATION_TYPE, failure_label
    dur_ok = ((F.col("outcome") == "RESOLVED") & F.col("duration_seconds").isNotNull()
              & (F.col("duration_seconds") != 0))
    d = F.when(dur_ok, F.col("duration_seconds").cast(DURATION_TYPE))
    return (records.withWatermark("ts", f"{late_hours} hours")
            .groupBy(F.window("ts", f"{window_hours} hours", f"{slide_hours} hours"),
                     failure_label(F.col("failure_type")).alias("failure_type"))
            .agg(F.count(F.lit(1)).alias("total_runs"),
                 F.sum(F.when(F.col("outcome").isin("FAILED", "UNRESOLVED"), 1).otherwise(0)).alias("failed_count"),
                 F.sum(F.when(F.col("outcome") == "RESOLVED", 1).otherwise(0)).alias("resolved_count"),
                 F.sum(d).alias("_dsum"), F.count(d).alias("_dn"))
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    "failure_type", "total_runs", "failed_count", "resolved_count",
                    F.try_divide(F.col("_dsum").cast("double"), F.col("_dn").cast("double")).alias("mttr_seconds")))


def start_trend_stream(spark: SparkSession, history_dir: str, out_path: str, checkpoint: str,
                       window_hours: int = 24, slide_hours: int = 1, late_hours: int = 24,
                       available_now: bool = True) -> StreamingQuery:
    """Run ``trend_windows`` over history files landing in ``history_dir``
    into a Parquet sink (append mode: each window is written once, when final;
    the file sink with a checkpoint is exactly-once)."""
    records = spark.readStream.schema(HISTORY_RECORD_SCHEMA).option("maxFilesPerTrigger", 1000).parquet(history_dir)
    w = (trend_windows(records, window_hours, slide_hours, late_hours).writeStream
         .outputMode("append").format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
