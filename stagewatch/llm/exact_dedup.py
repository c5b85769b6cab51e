"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when they are identical after deleting white space.  Each
level looks closer at what the level before left over: rows whose normalised
length is unique drop out, then rows whose (length, prefix hash) is unique;
only the others' texts are read again and hashed in full.  Between the levels
move a few numbers per row.  Groups are reduced to one row by partial
aggregation, so a group of any size costs a row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, quoted, text_or_empty

SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def _keys(text: Column, prefix: int) -> list[Column]:
    norm = normalised(text)
    return [F.length(text).alias("n_points"), F.length(norm).alias("n"),
            F.xxhash64(F.substring(norm, 1, prefix)).alias("prefix")]


def full_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 256) -> DataFrame:
    """``doc_id, n_points, n, prefix, full_hash`` of every row: length, refinement keys and SHA-256 of its text."""
    rows = documents(docs, id_col, text_col)
    return rows.select("doc_id", *_keys(F.col("text"), prefix),
                       F.sha2(F.encode(normalised(F.col("text")), "UTF-8"), 256).alias("full_hash"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 256) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, n_points, n, prefix, full_hash``.

    Of equal texts the row with the most code points in the original text
    stays, then the smallest id (a null id is the largest).  ``full_hash`` is
    null where the refinement ended before it.  A null text counts as empty;
    all empty and white-space-only texts form one group.  Of repeated rows
    (same id, same text) each counts in ``group_size`` and one is kept.  An
    empty table gives no rows; other columns are ignored.
    """
    rows = documents(docs, id_col, text_col)
    keys = cut(rows.select("doc_id", *_keys(F.col("text"), prefix)), "exact-keys")
    again = F.count(F.lit(1)) > 1
    lengths = keys.groupBy("n").agg(again.alias("again")).where("again").select("n")
    prefixes = (keys.join(lengths, "n", "left_semi").groupBy("n", "prefix").agg(again.alias("again")).where("again"))
    levels = keys.join(prefixes, ["n", "prefix"], "left")
    alone = levels.where("again is null")

    left = levels.where("again").select(F.col("doc_id").alias("left_id")).distinct()
    read = rows.join(left, F.col("doc_id").eqNullSafe(F.col("left_id")), "left_semi")
    # repeated rows become one with their number; a row whose id survived through another row is a group of its own
    hashed = cut(full_hashes(read, prefix=prefix).groupBy("full_hash", "n", "prefix", "doc_id", "n_points")
                 .agg(F.count(F.lit(1)).alias("copies"))
                 .join(prefixes.select("n", "prefix"), ["n", "prefix"], "left_semi"), "exact-hashes")
    best = F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id")
    groups = hashed.groupBy("n", "full_hash").agg(F.sum("copies").alias("group_size"), F.min(best).alias("best"))
    same = hashed.join(groups, ["n", "full_hash"]).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    chosen = (F.col("best")["doc_id"].eqNullSafe(F.col("doc_id")) & (F.col("best")["less"] == -F.col("n_points"))
              & (F.col("copy") == 1))
    same = same.select("doc_id", F.col("best")["doc_id"].alias("keep_id"), "group_size", chosen.alias("kept"),
                       "n_points", "n", "prefix", "full_hash")
    single = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                          F.lit(True).alias("kept"), "n_points", "n", "prefix",
                          F.lit(None).cast("string").alias("full_hash"))
    return single.unionByName(same)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 256) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows one.

    Null texts count as empty, so one of all null, empty and white-space-only
    texts stays; null ids are an id like any other (the largest); an empty
    table gives no rows; columns may have any names.
    """
    groups = cut(exact_groups(docs, id_col, text_col, prefix), "exact-groups")
    kept = groups.where("kept").select(F.col("doc_id").alias("keep_id"), "n_points", "n", "prefix")
    twice = (groups.groupBy("doc_id").agg((F.count(F.lit(1)) > 1).alias("twice")).where("twice")
             .select(F.col("doc_id").alias("twice_id")))
    names = docs.columns
    marked = docs.select(F.struct(*[quoted(c) for c in names]).alias("row"), quoted(id_col).alias("row_id"),
                         *_keys(text_or_empty(text_col), prefix))
    stay = marked.join(kept, F.col("row_id").eqNullSafe(F.col("keep_id"))
                       & (marked["n"] == kept["n"]) & (marked["prefix"] == kept["prefix"])
                       & (marked["n_points"] == kept["n_points"]), "left_semi")
    repeated = F.col("row_id").eqNullSafe(F.col("twice_id"))
    once = stay.join(twice, repeated, "left_anti")
    others = (stay.join(twice, repeated, "left_semi")
              .withColumn("norm", F.sha2(normalised(F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))), 256))
              .dropDuplicates(["row_id", "n_points", "norm"]))
    return once.select("row.*").unionByName(others.select("row.*"))

