"""Queries on what the data itself shows: types found (C4, C13), keys published before."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.constants import RULES_BY_DATASET
from ..operators import found_types as D
from ..operators.contracts import contract_table
from ..operators.key_index import KeyIndex, blocks_for
from ..session import ensure_checkpoint_dir
from ..sources import views as V
from ..sources.compaction import compact_history
from ..sources.files import append_history, read_history
from .catalog import register
from .oracle_views import with_views

#: Bad values among good ones: (dataset, column, divisor of the row's number, bad text).
BAD = [("sales", "quantity", 211, "12x"), ("sales", "unit_price", 223, "29.99_USD"), ("sales", "transaction_date", 227, "2024-13-40"),
       ("customers", "lifetime_value", 101, "n/a"), ("customers", "signup_date", 103, "2024/01/05"),
       ("products", "is_active", 107, "maybe"), ("products", "stock_quantity", 109, "7.5")]
NUMBERS = {"sales": "transaction_id", "customers": "customer_id", "products": "product_id"}


def _columns_sql(dataset: str) -> str:
    number = f"cast(split_part(cast({NUMBERS[dataset]} AS varchar), '-', 1) AS bigint)"
    out = []
    for rule in RULES_BY_DATASET[dataset]:
        name, kind = rule[0], rule[1]
        value = f"cast({name} AS varchar)"
        for _, column, by, bad in [b for b in BAD if b[:2] == (dataset, name)]:
            value = f"CASE WHEN {number} % {by} = 0 THEN '{bad}' ELSE {value} END"
        out.append(f"SELECT '{dataset}' AS dataset, '{name}' AS column_name, '{kind}' AS expected_type, {value} AS v FROM {dataset}")
    return " UNION ALL ".join(out)


@register("found_types", with_views(f"""
WITH whole_products AS (
  SELECT p_partkey AS product_id, p_name AS name, p_type AS category, p_retailprice AS unit_price,
         round(p_retailprice * 0.6, 2) AS cost_price, p_partkey % 100 AS supplier_id, p_size AS stock_quantity,
         p_size / 10.0 AS weight_kg, p_partkey % 10 <> 0 AS is_active FROM part),
cells AS ({_columns_sql("sales")} UNION ALL {_columns_sql("customers")}
          UNION ALL {_columns_sql("products").replace("FROM products", "FROM whole_products")}),
seen AS (SELECT dataset, column_name, expected_type, nullif(trim(v), '') AS v FROM cells),
marked AS (SELECT *, regexp_matches(v, '^[+-]?[0-9]{{1,18}}$') AS i,
                  regexp_matches(v, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') AS f,
                  regexp_matches(v, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AND try_cast(v AS date) IS NOT NULL AS d,
                  lower(v) IN ('true', 'false') AS b FROM seen),
told AS (SELECT *, CASE expected_type WHEN 'integer' THEN i WHEN 'float' THEN f WHEN 'date' THEN d WHEN 'boolean' THEN b
                        ELSE true END AS ok FROM marked)
SELECT dataset, column_name, expected_type,
       CASE WHEN count(v) = 0 THEN 'none' WHEN bool_and(i) THEN 'integer' WHEN bool_and(f) THEN 'float'
            WHEN bool_and(d) THEN 'date' WHEN bool_and(b) THEN 'boolean' ELSE 'string' END AS found_type,
       coalesce(bool_and(ok), true) AS conforms, count(v) AS n_values,
       count(v) FILTER (NOT ok) AS n_bad, min(v) FILTER (NOT ok) AS counterexample
FROM told GROUP BY dataset, column_name, expected_type""", "sales", "customers"))
def found_types(spark, d):
    """The type that each text column's values have, against its declared type, with a counterexample."""
    tables = {"sales": V.sales(spark, d), "customers": V.customers(spark, d), "products": V.products(spark, d)}
    profiles = []
    for dataset, table in tables.items():
        number = F.split_part(F.col(NUMBERS[dataset]).cast("string"), F.lit("-"), F.lit(1)).cast("bigint")
        bad = {c: F.when(number % by == 0, text) for ds, c, by, text in BAD if ds == dataset}
        names = [r[0] for r in RULES_BY_DATASET[dataset]]
        texts = table.select(*[(F.coalesce(bad[c], F.col(c).cast("string")) if c in bad else F.col(c).cast("string")).alias(c)
                               for c in names])
        profiles.append(D.type_counts(texts, dataset))
    return D.type_conformance(D.merge_type_counts(profiles), contract_table(spark))


@register("cross_load_keys", with_views("""
WITH loads AS (SELECT transaction_id AS key, CASE WHEN quantity % 3 = 0 THEN 'load-1' WHEN quantity % 3 = 1 THEN 'load-2'
                                                  ELSE 'load-3' END AS load FROM sales_nr)
SELECT n.key, n.n_rows, o.first_load, o.loads
FROM (SELECT key, count(*) AS n_rows FROM loads WHERE load = 'load-3' GROUP BY key) n
JOIN (SELECT key, min(load) AS first_load, count(DISTINCT load) AS loads FROM loads WHERE load <> 'load-3' GROUP BY key) o
  USING (key)""", "sales_nr"))
def cross_load_keys(spark, d):
    """Keys of a load that earlier loads have published, through the key index."""
    sales = V.sales(spark, d, with_region=False).select("transaction_id", (F.col("quantity") % 3).alias("third"))
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/keys-{uuid.uuid4().hex}"
    index = KeyIndex(root, blocks_for(sales.count()))
    for third, load in ((0, "load-1"), (1, "load-2")):
        index.add(sales.where(F.col("third") == third), "transaction_id", load)
    return index.repeated(sales.where(F.col("third") == 2), "transaction_id", "load-3")


@register("compacted_history", with_views("""
SELECT strftime(run_history.ts, '%Y-%m-%d') AS run_date, scenario_name, count(*) AS n_runs,
       count(*) FILTER (outcome = 'FAILED') AS n_failed, cast(sum(total_rows) AS bigint) AS total_rows
FROM run_history WHERE run_history.ts IS NOT NULL GROUP BY ALL""", "run_history"))
def compacted_history(spark, d):
    """The history of three loads, its closed dates compacted, read back: runs per date and scenario."""
    h = V.run_history(spark, d).where("ts is not null")
    none = F.array().cast("array<string>")
    records = h.select(
        F.col("run_id").cast("string").alias("run_id"), "scenario_name", "failure_type", "ts", "outcome",
        "duration_seconds", none.alias("remediation_applied"), none.alias("failed_stages"),
        F.struct("total_rows", F.col("total_nulls"), "duplicate_count", none.alias("schema_violations")).alias("data_quality"))
    store = f"{ensure_checkpoint_dir(spark).rstrip('/')}/history-{uuid.uuid4().hex}"
    for load in range(3):
        append_history(records.where(F.col("run_id").cast("bigint") % 3 == load), store)
    compact_history(spark, store, before="2024-01-30")
    return read_history(spark, store).groupBy(F.date_format("run_date", "yyyy-MM-dd").alias("run_date"), "scenario_name").agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_if(F.col("outcome") == "FAILED").alias("n_failed"),
        F.sum("data_quality.total_rows").cast("bigint").alias("total_rows"))
