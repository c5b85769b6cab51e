"""Token ids as Parquet list columns, in id order, with controlled encodings, row groups and pages.

``ids`` is a dictionary-encoded list column (a token id takes 16 bits or
less), ``doc_id``, ``n_tokens`` and ``start_in_file`` are delta-encoded
(version 2 pages); page indexes are written by default.  Rows are sorted, so a
reader that asks for some ``doc_id`` skips files, row groups and pages; one
that asks for metadata never touches the ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, slices
from .tokens import encoder

DELTA_COLUMNS = ("doc_id", "n_tokens", "start_in_file")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, row_group_bytes: int = 32 << 20,
                 page_bytes: int = 256 << 10, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write every document's ids and ``end_id`` below ``path``, in ascending ``doc_id`` order over the files.

    Columns: ``doc_id, n_tokens, start_in_file, ids``.  A null text counts as
    empty (its end id alone is written); null ids come last; rows with equal
    ids follow each other in the order in which they are read; an empty table
    gives files without rows; other columns are ignored.
    """
    rows = documents(docs, id_col, text_col)
    # the number of the row parts rows with equal ids; the ranges are found without reading a text
    order = [F.col("doc_id").asc_nulls_last(), F.col("row_no").asc()]
    ranged = (rows.withColumn("row_no", F.monotonically_increasing_id()).repartitionByRange(*order)
              .sortWithinPartitions(*order).drop("row_no"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, at = encoder(tokenizer), 0
        for batch in slices(batches):
            ids, counts = codes.encode(batch.column("text"))
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id).astype(np.int32)
            ends, counts = ends + np.arange(1, len(ends) + 1), counts + 1
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts), pa.array(at + ends - counts), lists],
                ["doc_id", "n_tokens", "start_in_file", "ids"])
            at += int(ends[-1])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    writer = (ranged.mapInArrow(run, f"doc_id {id_type}, n_tokens long, start_in_file long, ids array<int>")
              .write.option("parquet.writer.version", "v2").option("parquet.block.size", row_group_bytes)
              .option("parquet.page.size", page_bytes).option("parquet.enable.dictionary", "true"))
    for column in DELTA_COLUMNS:
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, n_tokens, start`` (ids of all documents before it); the ids column is not read.

    A row for every row written: null ids come last, repeated ids and rows each have theirs, an empty text has
    the end id alone, an empty store gives no rows.
    """
    rows = spark.read.parquet(path).select("doc_id", "n_tokens", "start_in_file", *_file())
    return _with_start(spark, path, rows)


def read_tokens(spark: SparkSession, path: str, first_id=None, last_id=None) -> DataFrame:
    """``doc_id, start, n_tokens, ids``, of the ids from ``first_id`` to ``last_id`` only where these are given.

    Rows as in ``read_metadata``; a range leaves null ids out.
    """
    rows = spark.read.parquet(path)
    if first_id is not None:
        rows = rows.where(F.col("doc_id") >= first_id)
    if last_id is not None:
        rows = rows.where(F.col("doc_id") <= last_id)
    return _with_start(spark, path, rows.select("doc_id", "n_tokens", "start_in_file", *_file(), "ids"))


def _file() -> list:
    return [F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long").alias("file_no")]


def _with_start(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    # one row per file of this table, so the window and the broadcast are as large as the list of files
    totals = spark.read.parquet(path).select("n_tokens", *_file()).groupBy("file_no").agg(F.sum("n_tokens").alias("t"))
    before = totals.select("file_no", (F.sum("t").over(Window.orderBy("file_no")) - F.col("t")).alias("before"))
    return (rows.join(F.broadcast(before), "file_no").withColumn("start", F.col("before") + F.col("start_in_file"))
            .drop("file_no", "before", "start_in_file"))


def checksums(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of what ``read_tokens`` gives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("ids")
            raw = memoryview(lists.values.to_numpy().astype("<i4", copy=False)).cast("B")
            bounds = lists.offsets.to_numpy().astype(np.int64) * 4
            crc = [zlib.crc32(raw[b:e]) for b, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])

    id_type = tokens.schema["doc_id"].dataType.simpleString()
    return (tokens.select("doc_id", "start", "n_tokens", "ids")
            .mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long"))
