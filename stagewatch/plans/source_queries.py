"""Queries over files and over two versions of a table: sources read in parallel (S1, S2), contents reconciled."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import reconcile as R
from ..session import ensure_checkpoint_dir
from ..sources import files as S
from ..sources import views as V
from ..sources.tables import read_table
from .catalog import register
from .oracle_views import with_views


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("csv_source_profile", """
SELECT lang, count(*) AS n_rows, count(*) - count(t) AS null_texts, cast(sum(length(t)) AS bigint) AS chars,
       max(sha256(t)) AS greatest_hash, cast(sum(doc_id) AS bigint) AS ids
FROM (SELECT *, CASE WHEN trim(text) IN ('', 'NA', 'null', 'None') THEN NULL ELSE text END AS t FROM documents) d
GROUP BY lang""")
def csv_source_profile(spark, d):
    """Whole documents written as CSV (line feeds and quotes inside fields), read back by ranges and header names."""
    path = _folder(spark, "csv")
    docs = read_table(spark, d, "documents", "doc_id", "lang", "text")
    docs.write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False,
                       ignoreTrailingWhiteSpace=False).csv(path)
    read = S.read_csv(spark, path, "text string, lang string, doc_id long")
    return read.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) - F.count("text")).alias("null_texts"),
        F.sum(F.length("text")).alias("chars"), F.max(F.sha2("text", 256)).alias("greatest_hash"),
        F.sum("doc_id").alias("ids"))


@register("json_source_profile", """
SELECT role, count(*) AS n_rows, count(DISTINCT conv_id) AS conversations, cast(sum(length(text)) AS bigint) AS chars,
       max(sha256(text)) AS greatest_hash, cast(sum(turn) AS bigint) AS turns
FROM conversations GROUP BY role""")
def json_source_profile(spark, d):
    """Conversations written as nested JSON objects, read back by ranges (brackets and strings tracked)."""
    path = _folder(spark, "json")
    turns = read_table(spark, d, "conversations", "conv_id", "turn", "role", "text")
    turns.select("conv_id", F.struct("turn", F.array(F.struct("role", "text")).alias("said")).alias("body")).write.json(path)
    read = S.read_json(spark, path, schema="conv_id long, body struct<turn:long, said:array<struct<role:string, text:string>>>")
    return read.select("conv_id", "body.turn", F.explode("body.said").alias("s")).groupBy(F.col("s.role").alias("role")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("conv_id").alias("conversations"),
        F.sum(F.length("s.text")).alias("chars"), F.max(F.sha2("s.text", 256)).alias("greatest_hash"),
        F.sum("turn").alias("turns"))


COLUMNS = ["customer_id", "product_id", "quantity", "unit_price", "currency", "transaction_date", "status"]

#: The processed table: some orders lost, some booked twice, new keys, prices and states that changed, a null currency.
_TWO_SIDES = """
src AS (SELECT * FROM sales_nr),
moved AS (SELECT *, cast(split_part(transaction_id, '-', 1) AS bigint) AS k FROM src),
tgt AS (SELECT transaction_id, customer_id, product_id, quantity,
               CASE WHEN k % 103 = 0 THEN unit_price + 1 ELSE unit_price END AS unit_price,
               CASE WHEN k % 109 = 0 THEN NULL ELSE currency END AS currency, transaction_date,
               CASE WHEN k % 103 = 0 OR k % 89 = 0 THEN 'fixed' ELSE status END AS status
        FROM moved WHERE k % 97 <> 0
        UNION ALL SELECT transaction_id || '+', customer_id, product_id, quantity, unit_price, currency,
                         transaction_date, status FROM moved WHERE k % 101 = 0
        UNION ALL SELECT transaction_id, customer_id, product_id, quantity, unit_price, currency,
                         transaction_date, status FROM moved WHERE k % 107 = 0 AND k % 97 <> 0),
sides AS (SELECT transaction_id AS key, 's' AS side, * EXCLUDE (transaction_id) FROM src
          UNION ALL SELECT transaction_id, 't', * EXCLUDE (transaction_id) FROM tgt),
diff AS (
  SELECT key, count(*) FILTER (side = 's') AS source_rows, count(*) FILTER (side = 't') AS target_rows, {lists},
         list_sort(list(cast(row({cols}) AS varchar)) FILTER (side = 's')) AS s_all,
         list_sort(list(cast(row({cols}) AS varchar)) FILTER (side = 't')) AS t_all
  FROM sides GROUP BY key),
stated AS (
  SELECT key, source_rows, target_rows,
         CASE WHEN target_rows = 0 THEN 'missing' WHEN source_rows = 0 THEN 'extra'
              WHEN source_rows <> target_rows THEN 'row_count' WHEN s_all <> t_all THEN 'changed' END AS status,
         concat_ws(',', {changed}) AS columns
  FROM diff)""".format(
    cols=", ".join(COLUMNS),
    lists=", ".join(f"list_sort(list(coalesce(cast({c} AS varchar), '~')) FILTER (side = '{s}')) AS {s}_{c}"
                    for c in COLUMNS for s in "st"),
    changed=", ".join(f"CASE WHEN s_{c} <> t_{c} THEN '{c}' END" for c in COLUMNS))


def _two_sides(spark, d):
    src = V.sales(spark, d, with_region=False, with_keys=True)
    k = F.col("order_key")
    price = F.when(k % 103 == 0, F.col("unit_price") + 1).otherwise(F.col("unit_price")).cast("decimal(12,2)")
    # every booking of an order's line from one pass over the sales, which both sides then share: moved, new, twice
    booked = src.withColumn("booking", F.explode(F.array(F.lit("moved"), F.lit("new"), F.lit("twice"))))
    kind = F.col("booking")
    booked = booked.where(((kind == "moved") & (k % 97 != 0)) | ((kind == "new") & (k % 101 == 0)) | (
        (kind == "twice") & (k % 107 == 0) & (k % 97 != 0)))
    moved = lambda to, c: F.when(kind == "moved", to).otherwise(F.col(c)).alias(c)
    changes = {"unit_price": price, "currency": F.when(k % 109 != 0, F.col("currency")),
               "status": F.when((k % 103 == 0) | (k % 89 == 0), "fixed").otherwise(F.col("status"))}
    target = booked.select(
        F.when(kind == "new", F.concat("transaction_id", F.lit("+"))).otherwise(F.col("transaction_id")).alias("transaction_id"),
        *[moved(changes[c], c) if c in changes else F.col(c) for c in COLUMNS])
    return src.select("transaction_id", *COLUMNS), target


@register("content_differences", with_views(f"""
WITH {_TWO_SIDES}
SELECT key, status, source_rows, target_rows, CASE WHEN status = 'changed' THEN columns ELSE '' END AS changed_columns
FROM stated WHERE status IS NOT NULL""", "sales_nr"))
def content_differences(spark, d):
    """Every key whose contents differ between source and processed sales, with the changed columns."""
    return R.content_differences(*_two_sides(spark, d), "transaction_id", COLUMNS)


@register("content_summary", with_views(f"""
WITH {_TWO_SIDES}
SELECT status, column_name, count(*) AS n_keys
FROM (SELECT status, unnest(list_concat([''], CASE WHEN status = 'changed' THEN string_split(columns, ',') ELSE [] END))
             AS column_name FROM stated WHERE status IS NOT NULL) t
GROUP BY status, column_name""", "sales_nr"))
def content_summary(spark, d):
    """Differing keys per status and per changed column."""
    return R.difference_summary(R.content_differences(*_two_sides(spark, d), "transaction_id", COLUMNS))


@register("content_samples", with_views(f"""
WITH {_TWO_SIDES},
first AS (SELECT status, key FROM (
            SELECT status, key, row_number() OVER (PARTITION BY status ORDER BY key) AS n FROM stated
            WHERE status IS NOT NULL) t WHERE n <= 5)
SELECT f.status, f.key, CASE s.side WHEN 's' THEN 'source' ELSE 'target' END AS side,
       array_to_string([{", ".join(f"coalesce(cast(s.{c} AS varchar), '')" for c in COLUMNS)}], '|') AS values
FROM first f JOIN sides s ON s.key = f.key""", "sales_nr"))
def content_samples(spark, d):
    """The source and processed rows of five keys per kind of difference."""
    source, target = _two_sides(spark, d)
    differences = R.content_differences(source, target, "transaction_id", COLUMNS)
    return R.difference_samples(source, target, differences, "transaction_id", COLUMNS)
