"""Reconciliation of the contents of a source and a processed table by a hash tree.

Rows are dealt by a hash of their key into the leaves of a tree; a leaf's
digest adds up the hashes of its rows, so it does not depend on their order and
is summed where the rows are read.  Only rows below leaves that differ are
looked at again, by key and column: both sides are shuffled by key as they are
(their hashes would not compress) and compared where they meet.  Two tables
that agree cost one scan each and a shuffle of one row per leaf and task; a
difference costs the rows of its leaf, once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import quoted
from ..session import cut_lineage

#: Leaves of the tree, and children of an inner node.  The list of leaves that differ is at most this long.
LEAVES, FAN_OUT = 1 << 16, 256
MISSING, EXTRA, ROWS, CHANGED = "missing", "extra", "row_count", "changed"


def _value(name: str) -> Column:
    """64 bits of a column's value as text: the same for equal values of different types, another for null."""
    text = quoted(name).cast("string")
    return F.when(text.isNull(), F.xxhash64(F.lit(1), F.lit("null"))).otherwise(F.xxhash64(F.lit(0), text))


def _added(h: Column) -> Column:
    """An aggregate that does not depend on order, and to which a repeated row adds again."""
    return F.sum(h.cast("decimal(20,0)"))


def _halves(h: Column) -> list[Column]:
    """The upper and lower 32 bits of a hash, whose sums need no decimals: two sums of hashes differ if these do not agree."""
    return [F.shiftright(h, 32), h.bitwiseAND(0xFFFFFFFF)]


def _leaf(key: str, leaves: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("leaf"), quoted(key).cast("string")), F.lit(leaves)).cast("int")


def hash_tree(table: DataFrame, key: str, columns: list[str], leaves: int = LEAVES) -> DataFrame:
    """``leaf, n_rows, digest, second`` of every leaf that holds rows: small enough to be kept with the table."""
    row = F.struct(*[_value(c) for c in [key, *columns]])
    return table.groupBy(_leaf(key, leaves).alias("leaf")).agg(
        F.count(F.lit(1)).alias("n_rows"), _added(F.xxhash64(row)).alias("digest"),
        _added(F.xxhash64(F.lit(7), row)).alias("second"))


def differing_leaves(source: DataFrame, target: DataFrame, leaves: int = LEAVES) -> DataFrame:
    """``leaf`` of every leaf that differs between two trees, from the top: equal inner nodes are not opened."""
    def inner(tree: DataFrame) -> DataFrame:
        return tree.groupBy(F.expr(f"leaf div {FAN_OUT}").alias("leaf")).agg(
            F.sum("n_rows").alias("n_rows"), F.sum("digest").alias("digest"), F.sum("second").alias("second"))

    def differ(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.toDF("leaf", "n2", "d2", "s2")
        same = F.col("n_rows").eqNullSafe(F.col("n2")) & F.col("digest").eqNullSafe(F.col("d2")) & F.col(
            "second").eqNullSafe(F.col("s2"))
        return a.join(b, "leaf", "full_outer").where(~same).select("leaf")

    tops = differ(inner(source), inner(target)).select(F.col("leaf").alias("top"))
    opened = [t.join(F.broadcast(tops), F.expr(f"leaf div {FAN_OUT}") == F.col("top"), "left_semi")
              for t in (source, target)]                      # at most leaves / FAN_OUT nodes
    return differ(*opened)


def content_differences(source: DataFrame, target: DataFrame, key: str, columns: list[str],
                        leaves: int = LEAVES) -> DataFrame:
    """Every key whose rows differ: ``key, status, source_rows, target_rows, changed_columns``.

    ``status``: ``missing`` (no row in the target), ``extra`` (none in the
    source), ``row_count`` (other numbers of rows) or ``changed`` (as many
    rows, other values).  ``changed_columns`` lists the columns whose values
    differ, in the order given, for ``changed`` keys.  A null key is a key;
    nulls equal nulls; values are compared as text, so a column may have
    another type in the target.
    """
    # both in one plan: what the two sides have in common is read and shuffled once
    trees = cut_lineage(reduce(DataFrame.unionByName, [
        hash_tree(t, key, columns, leaves).withColumn("side", F.lit(i)) for i, t in enumerate((source, target))]))
    opened = cut_lineage(differing_leaves(*[trees.where(F.col("side") == i).drop("side") for i in (0, 1)]))  # ``leaves`` at most
    names = [f"v{i}" for i in range(len(columns))]
    sides = [t.join(F.broadcast(opened), _leaf(key, leaves) == F.col("leaf"), "left_semi").select(
        quoted(key).cast("string").alias("key"), *[quoted(c).alias(n) for n, c in zip(names, columns)])
        for t in (source, target)]
    kinds = [[f.dataType for f in t.schema.fields] for t in sides]
    as_text = {n for n, a, b in zip(names, kinds[0][1:], kinds[1][1:]) if a != b}
    rows = reduce(DataFrame.unionByName, [t.select("key", F.lit(sign).cast("tinyint").alias("sign"), *[
        F.col(n).cast("string").alias(n) if n in as_text else F.col(n) for n in names]) for t, sign in zip(sides, (1, -1))])
    # hashes of the source less those of the target: all of a row first, then of each column
    hashed = rows.repartition("key").select("key", "sign", F.xxhash64(F.struct(*[_value(n) for n in names])).alias("h"),
                                            *[_value(n).alias(n) for n in names])
    both = hashed.groupBy("key").agg(
        F.count_if(F.col("sign") > 0).alias("source_rows"), F.count_if(F.col("sign") < 0).alias("target_rows"),
        *[F.sum(F.col("sign") * half).alias(f"{n}_{i}") for n in ["h", *names] for i, half in enumerate(_halves(F.col(n)))])

    def differs(n: str) -> Column:
        return (F.col(f"{n}_0") != 0) | (F.col(f"{n}_1") != 0)

    changed = F.concat_ws(",", *[F.when(differs(n), F.lit(c)) for n, c in zip(names, columns)])
    status = (F.when(F.col("target_rows") == 0, MISSING).when(F.col("source_rows") == 0, EXTRA)
              .when(F.col("source_rows") != F.col("target_rows"), ROWS).when(differs("h"), CHANGED))
    return both.select("key", status.alias("status"), "source_rows", "target_rows",
                       F.when(status == CHANGED, changed).otherwise("").alias("changed_columns")).where("status is not null")


def difference_summary(differences: DataFrame) -> DataFrame:
    """``status, column_name, n_keys``: keys per status, and per changed column."""
    columns = F.explode(F.concat(F.array(F.lit("")), F.when(
        F.col("changed_columns") != "", F.split("changed_columns", ",")).otherwise(F.array().cast("array<string>"))))
    return differences.select("status", columns.alias("column_name")).groupBy("status", "column_name").agg(
        F.count(F.lit(1)).alias("n_keys"))


def difference_samples(source: DataFrame, target: DataFrame, differences: DataFrame, key: str, columns: list[str],
                       per_status: int = 5) -> DataFrame:
    """The rows of both sides of the first ``per_status`` keys of each status: ``status, key, side, values``.

    ``values`` are the columns as text, joined by ``|`` (null: an empty place).
    The keys are the least by text; every row of such a key is shown.
    """
    first = Window.partitionBy("status").orderBy(F.col("key").asc_nulls_first())
    keys = cut_lineage(differences.select("status", "key").withColumn("n", F.row_number().over(first))
                       .where(F.col("n") <= per_status).drop("n"))             # a few rows per status

    def rows(table: DataFrame, side: str) -> DataFrame:
        shown = F.array_join(F.array(*[F.coalesce(quoted(c).cast("string"), F.lit("")) for c in columns]), "|")
        some = table.select(quoted(key).cast("string").alias("row_key"), shown.alias("values"))
        return some.join(F.broadcast(keys), F.col("row_key").eqNullSafe(F.col("key"))).select(
            "status", "key", F.lit(side).alias("side"), "values")

    return reduce(DataFrame.unionByName, [rows(source, "source"), rows(target, "target")])
