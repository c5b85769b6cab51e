"""Shared pieces: scratch tables in the cluster's shared folder, text slices of Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

SLICE_BYTES = 8_000_000
_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """The one object that this Python worker keeps from task to task; asking for another name lets it go.

    Workers are used again by later stages: without this they would hold the
    caches of every operator that ever ran in them.
    """
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder, marked as this application's."""
    return (f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}"
            f"-{name}-{uuid.uuid4().hex}")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Cuts the lineage: the result survives lost executors and is not computed
    again by later jobs.  (``checkpoint()`` would compute the rows twice.)
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables; results that still read them become invalid.

    For the job that is done with all its results: other jobs' tables in the folder stay.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, f"llm-{spark.sparkContext.applicationId}-*")) or []:
        fs.delete(status.getPath(), True)


def quoted(name: str) -> Column:
    """The top-level column ``name``, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(name: str) -> Column:
    return F.coalesce(quoted(name).cast("string"), F.lit(""))


def documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) of any table: other columns go, null texts become empty."""
    return docs.select(quoted(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of about ``limit`` bytes of ``column`` (one row at least)."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column)
        ends = np.frombuffer(texts.buffers()[1], np.int32, batch.num_rows + 1, texts.offset * 4).astype(np.int64)
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(ends, ends[begin] + limit, "right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``group_no``, ``group_size`` and ``place`` (from 0, by ``order``, nulls first) within ``group``.

    ``group_no`` ascends with ``group`` (a null group comes first).  Rows are
    sorted by range, so a group of any size is spread over tasks; what is
    summed up per group is one row per partition that holds some of it.
    Rows equal in all of ``order`` follow each other in any order.
    """
    spread = rows.withColumn("row_no", F.monotonically_increasing_id())       # parts rows that are all alike
    by = [F.col(c).asc_nulls_first() for c in (group, *order, "row_no")]
    placed = cut(spread.repartitionByRange(*by).sortWithinPartitions(*by)
                 .withColumn("row_no", F.monotonically_increasing_id()), name)
    part = F.shiftright("row_no", 33)
    own = Window.partitionBy("in_group")
    parts = placed.groupBy(part.alias("part"), F.col(group).alias("in_group")).agg(
        F.min("row_no").alias("first_no"), F.count(F.lit(1)).alias("n"))
    parts = parts.select("part", "in_group", "first_no", F.min("first_no").over(own).alias("group_no"),
                         F.sum("n").over(own).alias("group_size"),
                         (F.sum("n").over(own.orderBy("part")) - F.col("n")).alias("before"))
    joined = placed.join(parts, (part == F.col("part")) & F.col(group).eqNullSafe(F.col("in_group")))
    return joined.withColumn("place", F.col("before") + F.col("row_no") - F.col("first_no")).drop(
        "row_no", "part", "in_group", "first_no", "before")
