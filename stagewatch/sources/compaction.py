"""A run history that stays small in files (S7, S8): closed dates are rewritten, proved, and then swapped in.

Every append leaves a file per date.  ``compact_history`` rewrites the dates
that have too many into a folder of their own below ``_compacted``, proves
rows and checksum of each date against what it read, and only then records
which files the new ones replace.  Readers leave recorded files out, so a
compaction that fails at any point changes nothing, and files appended while
it ran are in no record and stay visible.  Replaced files are deleted by the
next compaction (or ``sweep_history``), so that readers of before can finish.
One compaction of a store runs at a time; appends may run beside it.
"""

from __future__ import annotations

import math
import re
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import HISTORY_SCHEMA, delete_path

COMPACTED, REPLACED, SWEPT = "_compacted", "_replaced", "_swept"
REPLACED_SCHEMA = "swap string, file string"
UNDATED = "__HIVE_DEFAULT_PARTITION__"  # Spark's folder of records without a date


class CompactionError(RuntimeError):
    """The rewritten rows are not those that were read; the store is as it was."""


def _read(spark: SparkSession, path: str, schema) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _swaps(spark: SparkSession, path: str) -> tuple[set[str], set[str]]:
    """The recorded swaps, and those of them whose replaced files are gone (a name per compaction)."""
    names = []
    for table, schema in ((REPLACED, REPLACED_SCHEMA), (SWEPT, "swap string")):
        rows = _read(spark, f"{path}/{table}", schema)
        names.append(set() if rows is None else {r.swap for r in rows.select("swap").distinct().collect()})
    return names[0], names[1]


def _sides(spark: SparkSession, path: str) -> list[DataFrame]:
    """The appended and the compacted records, replaced and unfinished ones included, with ``run_date`` and ``_file``."""
    found = [_read(spark, p, HISTORY_SCHEMA) for p in (path, f"{path}/{COMPACTED}")]
    # one task writes files of one name into many dates: a file is known by its date and name
    named = F.concat(F.coalesce(F.col("run_date").cast("string"), F.lit(UNDATED)), F.lit("/"), F.col("_metadata.file_name"))
    return [p.select("*", named.alias("_file")) for p in found if p is not None and "run_date" in p.columns]


def _key(path: str) -> str:
    """Date and name of a listed file, as ``_file`` has them."""
    date, name = path.rsplit("/", 2)[1:]
    return f"{date.removeprefix('run_date=')}/{name}"


def visible_history(spark: SparkSession, path: str) -> DataFrame | None:
    """The records of a store, each once: appended ones, and compacted ones in place of what they replace.

    Files are listed between two looks at the swaps, so no swap can fall in
    between.  None where there is no store.
    """
    path = path.rstrip("/")
    while True:
        before = _swaps(spark, path)
        sides = _sides(spark, path)
        if _swaps(spark, path) == before:
            break
    swaps, swept = before
    parts = [p if "swap" not in p.columns else p.where(F.col("swap").isin(sorted(swaps))) for p in sides]
    pending = sorted(swaps - swept)
    if pending:                                         # replaced files that still lie there
        gone = _read(spark, f"{path}/{REPLACED}", REPLACED_SCHEMA).where(F.col("swap").isin(pending)).select(
            F.col("file").alias("_replaced_file"))
        parts = [p.join(gone, F.col("_file") == F.col("_replaced_file"), "left_anti") for p in parts]
    kept = [p.select(*HISTORY_SCHEMA.names, "run_date") for p in parts]
    return reduce(DataFrame.unionByName, kept) if kept else None


def _proof(rows: DataFrame) -> DataFrame:
    """``run_date, n_rows, checksum``: a sum of row hashes, which no order of rows changes."""
    return rows.groupBy("run_date").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.xxhash64(
        *HISTORY_SCHEMA.names).cast("decimal(38,0)")).alias("checksum"))


def history_files(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The visible files of every date (Spark's own listing; no data is read)."""
    path = path.rstrip("/")
    swaps, swept = _swaps(spark, path)
    replaced = set()
    if swaps - swept:
        rows = _read(spark, f"{path}/{REPLACED}", REPLACED_SCHEMA).where(F.col("swap").isin(sorted(swaps - swept)))
        replaced = {r.file for r in rows.collect()}     # names of files, as the listing itself
    found: dict[str, list[str]] = {}
    for part in _sides(spark, path):
        for name in part.inputFiles():
            swap, date = re.search(r"/swap=([^/]+)/", name), re.search(r"/run_date=([^/]+)/", name)
            if date and (swap is None or swap.group(1) in swaps) and _key(name) not in replaced:
                found.setdefault(date.group(1), []).append(name)
    return found


def compact_history(spark: SparkSession, path: str, before: str, max_files: int = 1,
                    rows_per_file: int = 5_000_000) -> int:
    """Rewrite the dates before ``before`` that have over ``max_files`` files (and more than their rows need): the number of dates.

    A date gets at most one file per ``rows_per_file`` rows, dealt by row
    hash, so a date of any size is written by as many tasks.  Records without a
    time have no date to close and stay as they are.
    """
    path = path.rstrip("/")
    sweep_history(spark, path)
    files = history_files(spark, path)
    many = {d: names for d, names in files.items() if re.match(r"\d", d) and d < str(before) and len(names) > max_files}
    if not many:
        return 0
    # the rows of the listed files alone: what is appended from here on is not touched
    wanted = spark.createDataFrame([(_key(n),) for names in many.values() for n in names], "_wanted string")
    rows = reduce(DataFrame.unionByName, [
        p.where(F.col("run_date").isin(sorted(many))).join(wanted, F.col("_file") == F.col("_wanted"), "left_semi")
        .select(*HISTORY_SCHEMA.names, "run_date") for p in _sides(spark, path)])
    proof = {str(r.run_date): (r.n_rows, r.checksum) for r in _proof(rows).collect()}        # a row per date
    slices = spark.createDataFrame([(d, math.ceil(n / rows_per_file)) for d, (n, _) in proof.items()]
                                   or [("", 1)], "_date string, _slices int")
    many = {d: names for d, names in many.items() if len(names) > math.ceil(proof.get(d, (0, 0))[0] / rows_per_file)}
    if not many:
        return 0
    swap = f"s{uuid.uuid4().hex}"
    target = f"{path}/{COMPACTED}/swap={swap}"
    dealt = rows.where(F.col("run_date").isin(sorted(many))).join(slices, F.col("run_date").cast("string") == F.col("_date"))
    (dealt.repartition("run_date", F.pmod(F.xxhash64(*HISTORY_SCHEMA.names), F.col("_slices")))
     .drop("_date", "_slices").write.partitionBy("run_date").parquet(target))
    written = _read(spark, target, HISTORY_SCHEMA)
    again = {str(r.run_date): (r.n_rows, r.checksum) for r in _proof(written).collect()} if written is not None else {}
    if again != {d: proof[d] for d in many if d in proof}:
        delete_path(spark, target)
        raise CompactionError(f"rewritten dates of {path} differ from what was read")
    record = [(swap, _key(n)) for names in many.values() for n in names]
    spark.createDataFrame(record, REPLACED_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/{REPLACED}")
    return len(many)


def sweep_history(spark: SparkSession, path: str) -> int:
    """Delete files that earlier compactions replaced, and what unfinished ones left: the number of files and folders."""
    path = path.rstrip("/")
    swaps, swept = _swaps(spark, path)
    pending = sorted(swaps - swept)
    names = [n for p in _sides(spark, path) for n in p.inputFiles()]
    folders = {m.group(1) for m in (re.search(r"/swap=([^/]+)/", n) for n in names) if m}
    left = sorted(folders - swaps)
    for swap in left:
        delete_path(spark, f"{path}/{COMPACTED}/swap={swap}")
    if not pending:
        return len(left)
    gone = {r.file for r in _read(spark, f"{path}/{REPLACED}", REPLACED_SCHEMA).where(
        F.col("swap").isin(pending)).collect()}         # names of files, as the listing itself
    doomed = [n for n in names if _key(n) in gone]
    for name in doomed:
        delete_path(spark, name)
    spark.createDataFrame([(s,) for s in pending], "swap string").coalesce(1).write.mode("append").parquet(f"{path}/{SWEPT}")
    return len(doomed) + len(left)
