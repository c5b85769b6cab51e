"""Registered quality and repair queries (C*, P4-P7, W*); corrupted inputs are built by ``faults``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts as C
from ..operators import faults as I
from ..operators import profile as Q
from ..operators import repair as R
from ..sources import views as V
from .catalog import register
from .oracle_views import with_views
from ..functions.exprs import merge_rows

SALES_NR_COLS = ["transaction_id", "customer_id", "product_id", "quantity", "unit_price",
                 "currency", "transaction_date", "status"]
DEDUP_ORDER = ["product_id", "quantity", "unit_price"]


def _sales_sql_cols(alias="", region=True):
    p = f"{alias}." if alias else ""
    cols = [f"{p}transaction_id", f"{p}customer_id", f"{p}product_id",
            f"cast({p}quantity AS bigint) AS quantity", f"cast({p}unit_price AS double) AS unit_price",
            f"{p}currency", f"strftime({p}transaction_date, '%Y-%m-%d') AS transaction_date"]
    if region:
        cols.append(f"{p}region")
    cols.append(f"{p}status")
    return ", ".join(cols)


def customers_with_null_emails(spark, d):
    """I4 in parity mode: 30 of every 100 consecutive customer ids lose their email."""
    c = V.customers(spark, d)
    return I.inject_nulls(c, "email", selector=I.key_fraction("customer_id", 0.30))


_CUST_NULL_SQL = """cust_nulls AS (
  SELECT customer_id, name, CASE WHEN customer_id % 100 < 30 THEN NULL ELSE email END AS email,
         tier, country, signup_date, lifetime_value FROM customers)"""

# ---------------------------------------------------------------------------
# de-duplication W1-W3
# ---------------------------------------------------------------------------


@register("dedup_sales", with_views(f"""
SELECT {_sales_sql_cols()} FROM (
  SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY
    product_id ASC NULLS FIRST, quantity ASC NULLS FIRST, unit_price ASC NULLS FIRST,
    customer_id ASC NULLS FIRST, currency ASC NULLS FIRST, transaction_date ASC NULLS FIRST,
    region ASC NULLS FIRST, status ASC NULLS FIRST) AS rn
  FROM sales) t WHERE rn = 1""", "sales"))
def dedup_sales(spark, d):
    """First row per transaction_id (explicit order, deterministic survivor)."""
    s = V.sales(spark, d, with_keys=True)        # the key's parts: the join's partitioning serves the window
    return R.dedup_first(s, ["order_key", "line_no"], DEDUP_ORDER).drop("order_key", "line_no")


@register("dedup_effect", with_views("""
SELECT 'sales' AS dataset, count(*) AS rows_before, count(DISTINCT transaction_id)
       + max(CASE WHEN transaction_id IS NULL THEN 1 ELSE 0 END) AS rows_after,
       count(*) - count(DISTINCT transaction_id) - max(CASE WHEN transaction_id IS NULL THEN 1 ELSE 0 END) AS rows_removed
FROM sales_nr""", "sales_nr"))
def dedup_effect(spark, d):
    """W1 effect: rows before / after / removed, one aggregate."""
    return R.dedup_effect(V.sales(spark, d, with_region=False), "transaction_id", "sales")


def _cust_dupes(spark, d):
    c = V.customers(spark, d)
    return I.inject_duplicates(c, selector=I.key_fraction("customer_id", 0.15))


@register("dedup_customers", with_views("""
SELECT customer_id, name, email, tier, country, strftime(signup_date, '%Y-%m-%d') AS signup_date,
       lifetime_value
FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY name NULLS FIRST, email NULLS FIRST,
        tier NULLS FIRST, country NULLS FIRST, signup_date NULLS FIRST, lifetime_value NULLS FIRST) AS rn
      FROM (SELECT * FROM customers UNION ALL SELECT * FROM customers WHERE customer_id % 100 < 15) u) t
WHERE rn = 1""", "customers"))
def dedup_customers(spark, d):
    """First row per customer_id after injecting copies."""
    return R.dedup_first(_cust_dupes(spark, d), "customer_id", ["name"])


_DUP_SEL_SQL = "(product_id * 7 + quantity) % 100 < 15"


def _sales_dup_selector():
    return F.pmod(F.col("product_id") * 7 + F.col("quantity"), F.lit(100)) < 15


@register("dedup_full_row", with_views(f"""
SELECT DISTINCT {_sales_sql_cols(region=False)}
FROM (SELECT * FROM sales_nr UNION ALL SELECT * FROM sales_nr WHERE {_DUP_SEL_SQL}) u""", "sales_nr"))
def dedup_full_row(spark, d):
    """Whole-row de-duplication of a table with injected exact copies."""
    s = V.sales(spark, d, with_region=False)
    return R.dedup_full_row(I.inject_duplicates(s, selector=_sales_dup_selector()))


# ---------------------------------------------------------------------------
# duplicates / PK C9, C10, W4
# ---------------------------------------------------------------------------


@register("duplicate_count", with_views("""
SELECT 'sales' AS dataset, 'transaction_id' AS key_column, cast(sum(n) AS bigint) AS total_rows,
       count(*) AS distinct_keys, cast(sum(n - 1) AS bigint) AS duplicate_count,
       cast(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS bigint) AS duplicated_keys
FROM (SELECT transaction_id, count(*) AS n FROM sales_nr GROUP BY transaction_id) k""", "sales_nr"))
def duplicate_count(spark, d):
    """Rows beyond the first per transaction_id."""
    return Q.duplicate_count(V.sales(spark, d, with_region=False), "transaction_id")


@register("pk_violations", with_views("""
WITH k AS (SELECT transaction_id, count(*) AS n FROM sales_nr GROUP BY transaction_id HAVING count(*) > 1),
top AS (SELECT transaction_id, n FROM k ORDER BY transaction_id NULLS FIRST LIMIT 3),
rep AS (SELECT t.transaction_id, g.i FROM top t, generate_series(1, 3) g(i) WHERE g.i <= least(t.n - 1, 3)),
ids AS (SELECT list(transaction_id ORDER BY transaction_id NULLS FIRST, i)[1:3] AS l FROM rep),
tot AS (SELECT coalesce(cast(sum(n - 1) AS bigint), 0) AS duplicate_count FROM k)
SELECT 'transaction_id' AS key_column, duplicate_count, duplicate_count > 0 AS violated,
       array_to_string(l, ', ') AS sample_ids,
       CASE WHEN duplicate_count > 0 THEN 'PK constraint violation: ' || cast(duplicate_count AS varchar)
            || ' duplicate transaction_ids (e.g. [' || array_to_string(list_transform(l, lambda x: '''' || x || ''''), ', ')
            || '])' END AS message
FROM tot, ids""", "sales_nr"))
def pk_violations(spark, d):
    """PK check on transaction_id with the first three duplicate ids."""
    return Q.pk_violations(V.sales(spark, d, with_region=False), "transaction_id")


# ---------------------------------------------------------------------------
# null profiles C6-C8
# ---------------------------------------------------------------------------

def _null_rows_sql(table, dataset, cols, prefix=""):
    parts = [f"SELECT '{dataset}' AS dataset, '{prefix}{c}' AS column_name, "
             f"cast(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS bigint) AS null_count, "
             f"count(*) AS total_rows FROM {table}" for c in cols]
    return " UNION ALL ".join(parts)


_CUST_COLS = ["customer_id", "name", "email", "tier", "country", "signup_date", "lifetime_value"]
_SALES_COLS = SALES_NR_COLS[:7] + ["region", "status"]


@register("null_profile", with_views(f"""
WITH {_CUST_NULL_SQL},
p AS ({_null_rows_sql('sales', 'sales', _SALES_COLS)} UNION ALL {_null_rows_sql('cust_nulls', 'customers', _CUST_COLS)})
SELECT dataset, column_name, null_count, total_rows, null_count * 100.0 / total_rows AS null_pct
FROM p WHERE null_count > 0""", "sales", "customers"))
def null_profile(spark, d):
    """Non-zero null counts per column, one aggregate per dataset."""
    from functools import reduce
    parts = [Q.null_profile(V.sales(spark, d), "sales"),
             Q.null_profile(customers_with_null_emails(spark, d), "customers")]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("null_concentration", with_views(f"""
WITH {_CUST_NULL_SQL},
p AS ({_null_rows_sql('sales', 'sales', _SALES_COLS)} UNION ALL {_null_rows_sql('cust_nulls', 'customers', _CUST_COLS, 'customers.')})
SELECT dataset, column_name, null_count, total_rows, null_count * 100.0 / total_rows AS null_pct
FROM p WHERE null_count > 0""", "sales", "customers"))
def null_concentration(spark, d):
    """Sales and customer null summaries merged (customer keys prefixed)."""
    return Q.null_concentration({"sales": V.sales(spark, d),
                                 "customers": customers_with_null_emails(spark, d)})


# ---------------------------------------------------------------------------
# type drift C3, L1, P5
# ---------------------------------------------------------------------------

_TYPED_SQL = """typed AS (
  SELECT transaction_id, customer_id, product_id, quantity,
         cast(unit_price AS varchar) || '_USD' AS unit_price, currency, transaction_date, status
  FROM sales_nr)"""


@register("type_mismatch_counts", with_views(f"""
WITH {_TYPED_SQL}
SELECT 'sales' AS dataset, 'quantity' AS column_name, 'int' AS actual_type,
       cast(sum(CASE WHEN quantity IS NOT NULL AND try_cast(cast(quantity AS varchar) AS double) IS NULL THEN 1 ELSE 0 END) AS bigint) AS bad_count,
       count(*) AS total_rows FROM typed
UNION ALL
SELECT 'sales', 'unit_price', 'string',
       cast(sum(CASE WHEN unit_price IS NOT NULL AND try_cast(unit_price AS double) IS NULL THEN 1 ELSE 0 END) AS bigint),
       count(*) FROM typed""", "sales_nr"))
def type_mismatch_counts(spark, d):
    """Values of expected-numeric columns that are not numbers (after I2)."""
    s = I.inject_type_change(V.sales(spark, d, with_region=False))
    return Q.type_mismatch_counts(s, ["quantity", "unit_price"])


@register("bad_value_samples", with_views(f"""
WITH {_TYPED_SQL}
SELECT transaction_id, product_id, unit_price AS bad_value FROM typed
WHERE unit_price IS NOT NULL AND try_cast(unit_price AS double) IS NULL
ORDER BY transaction_id NULLS FIRST, product_id NULLS FIRST, bad_value NULLS FIRST LIMIT 3""", "sales_nr"))
def bad_value_samples(spark, d):
    """L1: first three bad prices in transaction order (top-k, not head)."""
    s = I.inject_type_change(V.sales(spark, d, with_region=False))
    return Q.bad_value_samples(s, "unit_price", ["transaction_id", "product_id"])


@register("fix_type_cast", with_views(f"""
WITH {_TYPED_SQL}
SELECT transaction_id, product_id,
       try_cast(nullif(regexp_extract(unit_price, '([\\d.]+)', 1), '') AS double) AS unit_price
FROM typed""", "sales_nr"))
def fix_type_cast(spark, d):
    """P5: repair ``29.99_USD``-style prices back to numbers."""
    s = I.inject_type_change(V.sales(spark, d, with_region=False))
    return R.fix_type_cast(s).select("transaction_id", "product_id", "unit_price")


# ---------------------------------------------------------------------------
# schema fixes P4, P6, P7
# ---------------------------------------------------------------------------


@register("fix_drop_extra", with_views(f"""
SELECT {_sales_sql_cols()} FROM sales""", "sales"))
def fix_drop_extra(spark, d):
    """Drop the injected ``loyalty_points`` column (I1 then P4)."""
    return R.drop_extra_columns(I.inject_new_column(V.sales(spark, d)))


@register("fix_add_missing", with_views(f"""
SELECT {_sales_sql_cols(region=False)}, 'UNKNOWN' AS region FROM sales_nr""", "sales_nr"))
def fix_add_missing(spark, d):
    """Re-add the dropped ``region`` column with its default (I3 then P6)."""
    return R.add_missing_columns(I.inject_missing_column(V.sales(spark, d)))


@register("fill_nulls", with_views(f"""
WITH {_CUST_NULL_SQL}
SELECT customer_id, coalesce(email, 'UNKNOWN') AS email FROM cust_nulls""", "customers"))
def fill_nulls(spark, d):
    """Fill null emails with the default."""
    return R.fill_nulls(customers_with_null_emails(spark, d), "email").select("customer_id", "email")


@register("fill_nulls_effect", with_views(f"""
WITH {_CUST_NULL_SQL}
SELECT 'email' AS column_name, 'UNKNOWN' AS default_value,
       cast(sum(CASE WHEN email IS NULL THEN 1 ELSE 0 END) AS bigint) AS nulls_before,
       count(*) - count(coalesce(email, 'UNKNOWN')) AS nulls_after,
       cast(sum(CASE WHEN email IS NULL THEN 1 ELSE 0 END) AS bigint) AS rows_fixed
FROM cust_nulls""", "customers"))
def fill_nulls_effect(spark, d):
    """P7 effect: nulls before/after and rows fixed, one pass."""
    return R.fill_nulls_effect(customers_with_null_emails(spark, d), "email")


# ---------------------------------------------------------------------------
# contracts C1-C5, C11-C13; sources S4, J8, L2
# ---------------------------------------------------------------------------

def _drift_variants(spark, d):
    s, narrow = V.sales(spark, d), V.sales(spark, d, with_region=False)
    return {
        "sales": ("sales", s),
        "sales_new_column": ("sales", I.inject_new_column(s)),
        # the one variant whose rows are read (for samples) gets its region without the customer join
        "sales_type_change": ("sales", I.inject_type_change(narrow.withColumn("region", F.lit(None).cast("string")))),
        "sales_missing_column": ("sales", I.inject_missing_column(s)),
        "customers": ("customers", V.customers(spark, d)),
        "products": ("products", V.products(spark, d)),
    }


@register("schema_drift", with_views("""
WITH expected(contract, column_name) AS (
  SELECT 'sales', unnest(['transaction_id', 'customer_id', 'product_id', 'quantity', 'unit_price', 'currency',
                          'transaction_date', 'region', 'status'])
  UNION ALL SELECT 'customers', unnest(['customer_id', 'name', 'email', 'tier', 'country', 'signup_date',
                                        'lifetime_value'])
  UNION ALL SELECT 'products', unnest(['product_id', 'name', 'category', 'unit_price', 'cost_price', 'supplier_id',
                                       'stock_quantity', 'weight_kg', 'is_active'])),
one AS (SELECT * FROM sales LIMIT 1),
shown AS (   -- the columns and types that each variant really has, read off a row of it
  SELECT 'sales' AS dataset, 'sales' AS contract, unnest(json_keys(to_json(one))) AS column_name,
         typeof(one.quantity) AS q, typeof(one.unit_price) AS u FROM one
  UNION ALL SELECT 'sales_new_column', 'sales', unnest(json_keys(to_json(v))), typeof(v.quantity), typeof(v.unit_price)
  FROM (SELECT *, trunc(unit_price * quantity * 10) AS loyalty_points FROM one) v
  UNION ALL SELECT 'sales_type_change', 'sales', unnest(json_keys(to_json(v))), typeof(v.quantity), typeof(v.unit_price)
  FROM (SELECT * REPLACE (cast(unit_price AS varchar) || '_USD' AS unit_price) FROM one) v
  UNION ALL SELECT 'sales_missing_column', 'sales', unnest(json_keys(to_json(v))), typeof(v.quantity), typeof(v.unit_price)
  FROM (SELECT * EXCLUDE (region) FROM one) v
  UNION ALL SELECT 'customers', 'customers', unnest(json_keys(to_json(c))), 'INTEGER', 'DOUBLE'
  FROM (SELECT * FROM customers LIMIT 1) c
  UNION ALL SELECT 'products', 'products', unnest(json_keys(to_json(p))), 'INTEGER', typeof(p.unit_price)
  FROM (SELECT p_partkey AS product_id, p_name AS name, p_type AS category, p_retailprice AS unit_price,
               p_retailprice AS cost_price, p_partkey AS supplier_id, p_size AS stock_quantity, p_size AS weight_kg,
               true AS is_active FROM part LIMIT 1) p),
kinds AS (SELECT DISTINCT dataset, contract FROM shown),
wanted AS (SELECT k.dataset, e.column_name FROM kinds k JOIN expected e ON e.contract = k.contract),
flags AS (
  SELECT coalesce(w.dataset, h.dataset) AS dataset, coalesce(w.column_name, h.column_name) AS column_name,
         h.column_name IS NULL AS missing, w.column_name IS NULL AS extra,
         (h.column_name = 'quantity' AND h.q NOT LIKE '%INT%')
         OR (h.column_name = 'unit_price' AND h.u NOT LIKE 'DECIMAL%' AND h.u NOT IN ('DOUBLE', 'FLOAT')) AS typed
  FROM wanted w FULL JOIN shown h ON w.dataset = h.dataset AND w.column_name = h.column_name),
summary AS (
  SELECT dataset, coalesce(string_agg(column_name, ',' ORDER BY column_name) FILTER (missing), '') AS missing_columns,
         coalesce(string_agg(column_name, ',' ORDER BY column_name) FILTER (extra), '') AS extra_columns,
         coalesce(string_agg(column_name, ',' ORDER BY column_name) FILTER (typed), '') AS type_issue_columns,
         count(*) FILTER (missing) AS n_missing, count(*) FILTER (extra) AS n_extra,
         count(*) FILTER (typed) AS n_type_issues
  FROM flags GROUP BY dataset),
samples AS (
  SELECT 'sales_type_change' AS dataset,
         string_agg(v, ', ' ORDER BY transaction_id NULLS FIRST, product_id NULLS FIRST, v NULLS FIRST) AS sample_values
  FROM (SELECT transaction_id, product_id, cast(unit_price AS varchar) || '_USD' AS v
        FROM sales ORDER BY transaction_id NULLS FIRST, product_id NULLS FIRST, v NULLS FIRST LIMIT 3) t)
SELECT s.dataset, s.missing_columns, s.extra_columns, s.type_issue_columns,
       cast(s.n_missing AS bigint) AS n_missing, cast(s.n_extra AS bigint) AS n_extra,
       cast(s.n_type_issues AS bigint) AS n_type_issues,
       (s.n_missing + s.n_extra + s.n_type_issues) > 0 AS drift_detected,
       CASE WHEN (s.n_missing + s.n_extra + s.n_type_issues) > 0 THEN 'Apply schema fix to handle drift'
            ELSE 'Schema matches expected definition' END AS recommendation,
       p.sample_values
FROM summary s LEFT JOIN samples p ON s.dataset = p.dataset""", "sales", "customers"))
def schema_drift(spark, d):
    """Drift of each dataset variant against its contract,
    with the first three values of each mistyped column."""
    variants = _drift_variants(spark, d)
    summary = C.schema_drift(C.all_datasets_schema(spark, variants), C.contract_table(spark))
    samples = C.type_issue_samples(variants, order_by=["transaction_id", "product_id"])
    return merge_rows([summary, samples], key="dataset").where(F.col("drift_detected").isNotNull())


@register("range_violations", with_views("""
SELECT 'sales' AS dataset, 'quantity' AS column_name, 'range' AS rule,
       cast(sum(CASE WHEN quantity IS NOT NULL AND (quantity < 1 OR quantity > 10000) THEN 1 ELSE 0 END) AS bigint) AS violations,
       count(*) AS total_rows FROM sales_nr
UNION ALL SELECT 'sales', 'unit_price', 'range',
       cast(sum(CASE WHEN unit_price IS NOT NULL AND (cast(unit_price AS double) < 0.01 OR cast(unit_price AS double) > 100000.0) THEN 1 ELSE 0 END) AS bigint),
       count(*) FROM sales_nr
UNION ALL SELECT 'customers', 'lifetime_value', 'range',
       cast(sum(CASE WHEN lifetime_value IS NOT NULL AND lifetime_value < 0.0 THEN 1 ELSE 0 END) AS bigint),
       count(*) FROM customers
UNION ALL SELECT 'products', 'unit_price', 'range',
       cast(sum(CASE WHEN p_retailprice IS NOT NULL AND p_retailprice < 0.01 THEN 1 ELSE 0 END) AS bigint), count(*) FROM part
UNION ALL SELECT 'products', 'cost_price', 'range',
       cast(sum(CASE WHEN p_retailprice IS NOT NULL AND round(p_retailprice * 0.6, 2) < 0.0 THEN 1 ELSE 0 END) AS bigint), count(*) FROM part
UNION ALL SELECT 'products', 'stock_quantity', 'range',
       cast(sum(CASE WHEN p_size IS NOT NULL AND p_size < 0 THEN 1 ELSE 0 END) AS bigint), count(*) FROM part
UNION ALL SELECT 'products', 'weight_kg', 'range',
       cast(sum(CASE WHEN p_size IS NOT NULL AND p_size / 10.0 < 0.0 THEN 1 ELSE 0 END) AS bigint), count(*) FROM part""",
    "sales_nr", "customers"))
def range_violations(spark, d):
    """C13 min/max rules, one aggregate per dataset."""
    from functools import reduce
    parts = [C.rule_violations(V.sales(spark, d, with_region=False), "sales", kinds=("range",)),
             C.rule_violations(V.customers(spark, d), "customers", kinds=("range",)),
             C.rule_violations(V.products(spark, d), "products", kinds=("range",))]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("allowed_value_violations", with_views("""
SELECT 'sales' AS dataset, 'currency' AS column_name, 'allowed' AS rule,
       cast(sum(CASE WHEN currency IS NOT NULL AND currency NOT IN ('USD', 'EUR', 'GBP', 'CAD', 'AUD') THEN 1 ELSE 0 END) AS bigint) AS violations,
       count(*) AS total_rows FROM sales
UNION ALL SELECT 'sales', 'region', 'allowed',
       cast(sum(CASE WHEN region IS NOT NULL AND region NOT IN ('North', 'South', 'East', 'West') THEN 1 ELSE 0 END) AS bigint), count(*) FROM sales
UNION ALL SELECT 'sales', 'status', 'allowed',
       cast(sum(CASE WHEN status IS NOT NULL AND status NOT IN ('completed', 'refunded', 'pending', 'failed') THEN 1 ELSE 0 END) AS bigint), count(*) FROM sales
UNION ALL SELECT 'customers', 'tier', 'allowed',
       cast(sum(CASE WHEN tier IS NOT NULL AND tier NOT IN ('bronze', 'silver', 'gold', 'platinum') THEN 1 ELSE 0 END) AS bigint), count(*) FROM customers
UNION ALL SELECT 'products', 'category', 'allowed',
       cast(sum(CASE WHEN category IS NOT NULL AND category NOT IN ('Hardware', 'Electronics', 'Software', 'Consumables', 'Accessories', 'Services') THEN 1 ELSE 0 END) AS bigint), count(*) FROM products""",
    "sales", "customers", "products"))
def allowed_value_violations(spark, d):
    """C13 allowed-value rules, one aggregate per dataset."""
    from functools import reduce
    parts = [C.rule_violations(V.sales(spark, d), "sales", kinds=("allowed",)),
             C.rule_violations(V.customers(spark, d), "customers", kinds=("allowed",)),
             C.rule_violations(V.products(spark, d), "products", kinds=("allowed",))]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _uniq_sql(table, dataset, col):
    return (f"SELECT '{dataset}' AS dataset, '{col}' AS column_name, cast(sum(n - 1) AS bigint) AS violations, "
            f"cast(sum(n) AS bigint) AS total_rows FROM (SELECT {col}, count(*) AS n FROM {table} GROUP BY {col}) k")


@register("uniqueness_violations", with_views(" UNION ALL ".join([
    _uniq_sql("sales_nr", "sales", "transaction_id"), _uniq_sql("customers", "customers", "customer_id"),
    _uniq_sql("customers", "customers", "email"), _uniq_sql("products", "products", "product_id")]),
    "sales_nr", "customers", "products"))
def uniqueness_violations(spark, d):
    """C13 unique rules: rows beyond the first per declared-unique column."""
    from functools import reduce
    s, c, p = V.sales(spark, d, with_region=False), V.customers(spark, d), V.products(spark, d)
    parts = [C.uniqueness_violations(s, C.unique_columns("sales", s), "sales"),
             C.uniqueness_violations(c, C.unique_columns("customers", c), "customers"),
             C.uniqueness_violations(p, C.unique_columns("products", p), "products")]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("ingestion_metrics", with_views("""
WITH s AS (SELECT count(*) AS sales_rows,
                  cast(sum((CASE WHEN transaction_id IS NULL THEN 1 ELSE 0 END) + (CASE WHEN customer_id IS NULL THEN 1 ELSE 0 END)
                     + (CASE WHEN product_id IS NULL THEN 1 ELSE 0 END) + (CASE WHEN quantity IS NULL THEN 1 ELSE 0 END)
                     + (CASE WHEN unit_price IS NULL THEN 1 ELSE 0 END) + (CASE WHEN currency IS NULL THEN 1 ELSE 0 END)
                     + (CASE WHEN transaction_date IS NULL THEN 1 ELSE 0 END) + (CASE WHEN region IS NULL THEN 1 ELSE 0 END)
                     + (CASE WHEN status IS NULL THEN 1 ELSE 0 END)) AS bigint) AS sales_null_cells
           FROM sales),
oor AS (SELECT count(*) FILTER (quantity < 1 OR quantity > 10000)
               + count(*) FILTER (unit_price < 0.01 OR unit_price > 100000) AS out_of_range_count FROM sales),
k AS (SELECT cast(sum(n - 1) AS bigint) AS duplicate_count FROM (SELECT transaction_id, count(*) AS n FROM sales GROUP BY 1) t),
c AS (SELECT count(*) AS customer_rows, cast(sum(CASE WHEN email IS NULL THEN 1 ELSE 0 END) AS bigint) AS email_nulls,
             count(*) - count(DISTINCT customer_id) AS customer_duplicates FROM customers),
p AS (SELECT count(*) AS product_rows FROM part)
SELECT sales_rows, customer_rows, product_rows, sales_rows + customer_rows + product_rows AS total_rows_in,
       cast(0 AS bigint) AS n_missing_columns, cast(0 AS bigint) AS n_type_mismatches,
       sales_null_cells, email_nulls, duplicate_count, out_of_range_count, customer_duplicates, 'success' AS status,
       sales_rows + customer_rows + product_rows AS rows_out
FROM s, k, c, p, oor""", "sales", "customers"))
def ingestion_metrics(spark, d):
    """A1/C11: the ingestion stage's metrics row and verdict for the sources."""
    from ..plans import jobs
    return jobs.ingestion_metrics(jobs.Sources.from_views(spark, d))


@register("quality_flags", with_views("""
SELECT run_id,
       (null_count > 0 OR duplicate_count > 0 OR n_schema_violations > 0 OR n_type_mismatches > 0
        OR out_of_range_count > 0) AS has_quality_issues,
       cast(null_count AS bigint) AS null_count, cast(duplicate_count AS bigint) AS duplicate_count,
       cast(n_schema_violations AS bigint) AS n_schema_violations,
       cast(n_type_mismatches AS bigint) AS n_type_mismatches,
       cast(n_extra_columns AS bigint) AS n_extra_columns, cast(out_of_range_count AS bigint) AS out_of_range_count
FROM quality_metrics""", "quality_metrics"))
def quality_flags(spark, d):
    """The has-issues flag per run (extra columns alone do not count)."""
    return Q.quality_flags(V.quality_metrics(spark, d))


@register("missing_sources", """
SELECT * FROM (VALUES ('sales_lines', true, (SELECT count(*) FROM lineitem), 'success', NULL),
                      ('sales_orders', true, (SELECT count(*) FROM orders), 'success', NULL),
                      ('customers', true, (SELECT count(*) FROM customer), 'success', NULL),
                      ('products', true, (SELECT count(*) FROM part), 'success', NULL),
                      ('product_catalog', false, 0, 'failed',
                       'Source file for ''product_catalog'' not found in data lake.'))
  t(source, landed, row_count, status, message)""")
def missing_sources(spark, d):
    """Arrival check of the expected sources (one is absent)."""
    from ..sources.files import source_arrival
    from ..sources.tables import table_path
    expected = {"sales_lines": table_path(d, "lineitem"), "sales_orders": table_path(d, "orders"),
                "customers": table_path(d, "customer"), "products": table_path(d, "part"),
                "product_catalog": table_path(d, "product_catalog")}
    return source_arrival(spark, expected)


@register("source_target_reconcile", with_views("""
WITH src AS (SELECT transaction_id, count(*) AS n FROM sales_nr GROUP BY 1),
tgt AS (SELECT transaction_id, count(*) AS n FROM (
          SELECT DISTINCT transaction_id FROM sales_nr
          EXCEPT SELECT transaction_id FROM sales_nr WHERE status = 'failed'
          UNION ALL SELECT 'ORD' || cast(o_orderkey AS varchar) FROM orders WHERE o_orderpriority LIKE '1%') t
        GROUP BY 1),
j AS (SELECT coalesce(s.transaction_id, t.transaction_id) AS k, s.n AS sn, t.n AS tn
      FROM src s FULL OUTER JOIN tgt t ON s.transaction_id = t.transaction_id)
SELECT cast(coalesce(sum(sn), 0) AS bigint) AS source_rows, cast(coalesce(sum(tn), 0) AS bigint) AS target_rows,
       count(sn) AS source_keys, count(tn) AS target_keys,
       cast(sum(CASE WHEN tn IS NULL THEN 1 ELSE 0 END) AS bigint) AS missing_in_target,
       cast(sum(CASE WHEN sn IS NULL THEN 1 ELSE 0 END) AS bigint) AS extra_in_target,
       cast(sum(CASE WHEN sn IS NOT NULL AND tn IS NOT NULL AND sn <> tn THEN 1 ELSE 0 END) AS bigint) AS count_mismatch_keys
FROM j""", "sales_nr"))
def source_target_reconcile(spark, d):
    """Source sales vs a processed table, by key.

    The target is one row per key, lacks the keys that have a failed sale and
    holds adjustment rows per urgent order, so every count can differ from 0.
    """
    from ..sources.tables import read_table
    src = V.sales(spark, d, with_region=False)
    keys = src.groupBy("transaction_id").agg(F.max(F.col("status") == "failed").alias("failed"))
    extra = read_table(spark, d, "orders", "o_orderkey", "o_orderpriority").where(
        F.col("o_orderpriority").startswith("1")).select(
        F.concat(F.lit("ORD"), F.col("o_orderkey").cast("string")).alias("transaction_id"))
    target = keys.where(~F.coalesce("failed", F.lit(False))).select("transaction_id").unionByName(extra)
    return Q.reconcile(src, target, "transaction_id")


@register("sample_rows", with_views(f"""
SELECT {_sales_sql_cols()} FROM sales
ORDER BY transaction_id NULLS FIRST, customer_id NULLS FIRST, product_id NULLS FIRST, quantity NULLS FIRST,
         unit_price NULLS FIRST, currency NULLS FIRST, transaction_date NULLS FIRST, region NULLS FIRST,
         status NULLS FIRST LIMIT 5""", "sales"))
def sample_rows(spark, d):
    """L2: the first five rows in an explicit total order (top-k)."""
    s = V.sales(spark, d)
    return s.orderBy(*[F.col(c).asc_nulls_first() for c in s.columns]).limit(5)


PROCESSED_SAMPLE_COLUMNS = ["transaction_id", "customer_id", "unit_price", "unit_price_usd", "revenue_usd",
                            "customer_tier"]


@register("processed_sample", with_views("""
WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY
             product_id ASC NULLS FIRST, quantity ASC NULLS FIRST, unit_price ASC NULLS FIRST,
             customer_id ASC NULLS FIRST, currency ASC NULLS FIRST, transaction_date ASC NULLS FIRST,
             region ASC NULLS FIRST, status ASC NULLS FIRST) AS rn FROM sales) t WHERE rn = 1),
e AS (SELECT d.transaction_id, d.customer_id, cast(d.unit_price AS double) AS unit_price,
             cast(d.unit_price * cast(CASE d.currency WHEN 'USD' THEN 1.0 WHEN 'EUR' THEN 1.08 WHEN 'GBP' THEN 1.27
               WHEN 'CAD' THEN 0.74 WHEN 'AUD' THEN 0.65 ELSE 1.0 END AS decimal(8,4)) AS double) AS unit_price_usd,
             cast(d.unit_price * cast(CASE d.currency WHEN 'USD' THEN 1.0 WHEN 'EUR' THEN 1.08 WHEN 'GBP' THEN 1.27
               WHEN 'CAD' THEN 0.74 WHEN 'AUD' THEN 0.65 ELSE 1.0 END AS decimal(8,4))
               * cast(d.quantity AS decimal(10,0)) AS double) AS revenue_usd,
             CASE WHEN c.customer_id IS NULL THEN 'unknown' ELSE c.tier END AS customer_tier
      FROM d LEFT JOIN customers c ON d.customer_id = c.customer_id)
SELECT * FROM e ORDER BY transaction_id NULLS FIRST LIMIT 5""", "sales", "customers"))
def processed_sample(spark, d):
    """The first five processed rows, projected to the columns present."""
    from ..operators import transform as tr
    target = tr.enrich_customers(tr.fx_convert(R.dedup_first(V.sales(spark, d), "transaction_id", DEDUP_ORDER)),
                                 V.customers(spark, d))
    return Q.first_rows(Q.select_present(target, PROCESSED_SAMPLE_COLUMNS), 5, ["transaction_id"])


def _conflicts_sql(source_sql: str) -> str:
    cols = ["transaction_id", "customer_id", "product_id", "quantity", "unit_price", "currency",
            "transaction_date", "region", "status"]
    order = ", ".join(f"{c} ASC NULLS FIRST" for c in ["product_id", "quantity", "unit_price", "customer_id",
                                                      "currency", "transaction_date", "region", "status"])
    same = " AND ".join(f"r.{c} IS NOT DISTINCT FROM s.{c}" for c in cols)
    return f"""
WITH r AS ({source_sql}),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY {order}) AS rn FROM r) t
      WHERE rn = 1),
k AS (SELECT r.transaction_id, count(*) AS n, sum(CASE WHEN {same} THEN 1 ELSE 0 END) AS eq
      FROM r JOIN s ON r.transaction_id IS NOT DISTINCT FROM s.transaction_id GROUP BY r.transaction_id)
SELECT 'sales' AS dataset, cast(sum(n) AS bigint) AS rows_before, count(*) AS rows_after,
       cast(sum(eq - 1) AS bigint) AS removed_identical, cast(sum(n - eq) AS bigint) AS removed_conflicting,
       cast(sum(CASE WHEN n > eq THEN 1 ELSE 0 END) AS bigint) AS conflicting_keys
FROM k"""


@register("dedup_conflicts", with_views(_conflicts_sql(
    f"SELECT * FROM sales UNION ALL SELECT * FROM sales WHERE {_DUP_SEL_SQL}"), "sales"))
def dedup_conflicts(spark, d):
    """Removed rows split into exact copies (injected) and genuine conflicts (natural id clashes)."""
    s = V.sales(spark, d)
    return R.dedup_conflicts(I.inject_duplicates(s, selector=_sales_dup_selector()), "transaction_id", DEDUP_ORDER)


@register("required_violations", with_views(" UNION ALL ".join(
    [f"SELECT 'sales' AS dataset, '{c}' AS column_name, 'required' AS rule, count(*) - count({c}) AS violations, "
     f"count(*) AS total_rows FROM sales" for c in _SALES_COLS]
    + [f"SELECT 'customers', '{c}', 'required', count(*) - count({c}), count(*) FROM cust_nulls" for c in _CUST_COLS])
    .join([f"WITH {_CUST_NULL_SQL} ", ""]), "sales", "customers"))
def required_violations(spark, d):
    """C13 required rules: nulls of required columns, one aggregate per dataset."""
    return C.rule_violations(V.sales(spark, d), "sales", kinds=("required",)).unionByName(
        C.rule_violations(customers_with_null_emails(spark, d), "customers", kinds=("required",)))


@register("type_violations", with_views("""
SELECT 'sales' AS dataset, column_name, 'type' AS rule, violations, total_rows FROM (
  SELECT 'quantity' AS column_name,
         count(*) FILTER (quantity IS NOT NULL AND quantity % 7 = 0) AS violations, count(*) AS total_rows FROM sales_nr
  UNION ALL SELECT 'unit_price', count(*) FILTER (unit_price IS NOT NULL), count(*) FROM sales_nr) t""", "sales_nr"))
def type_violations(spark, d):
    """C13 type rules on text columns: every price has a suffix, every seventh quantity a unit."""
    s = I.inject_type_change(V.sales(spark, d, with_region=False)).withColumn(
        "quantity", F.when(F.col("quantity") % 7 == 0, F.concat(F.col("quantity").cast("string"), F.lit(" pcs")))
        .otherwise(F.col("quantity").cast("string")))
    return C.rule_violations(s.select("quantity", "unit_price"), "sales", kinds=("type",))


@register("column_profile", with_views(f"""
WITH {_CUST_NULL_SQL},
p AS ({_null_rows_sql('sales', 'sales', _SALES_COLS)} UNION ALL {_null_rows_sql('cust_nulls', 'customers', _CUST_COLS)})
SELECT dataset, column_name, null_count, total_rows,
       cast(round(cast(null_count AS decimal(18,0)) * 100 / total_rows, 1) AS double) AS null_pct
FROM p""", "sales", "customers"))
def column_profile(spark, d):
    """B1: null counts of every column of a run's sources, percentages to one place."""
    from ..plans import jobs
    src = jobs.Sources(V.sales(spark, d), customers_with_null_emails(spark, d), None)
    return jobs.column_profile(src)


#: Runs of fifty orders each; every run but one in four is damaged: text prices, no region, or repeated rows.
_RUNS_SQL = """
placed AS (SELECT cast(split_part(transaction_id, '-', 1) AS bigint) // 50 AS run_id,
                  cast(split_part(transaction_id, '-', 2) AS bigint) AS line, * FROM sales),
"""


@register("repair_all_runs", with_views(f"""
WITH {_RUNS_SQL}
kept AS (SELECT * FROM placed WHERE run_id % 4 <> 2
         UNION ALL BY NAME SELECT * EXCLUDE (n) FROM (
           SELECT *, row_number() OVER (PARTITION BY run_id, transaction_id ORDER BY customer_id, product_id, quantity,
                    unit_price, currency NULLS FIRST, transaction_date, region NULLS FIRST, status) AS n
           FROM placed WHERE run_id % 4 = 2) t WHERE n = 1)
SELECT run_id, transaction_id, cast(quantity AS bigint) AS quantity, cast(unit_price AS double) AS unit_price,
       CASE WHEN run_id % 4 = 1 THEN 'UNKNOWN' ELSE region END AS region, status FROM kept""", "sales"))
def repair_all_runs(spark, d):
    """A table of many damaged runs, repaired by the playbook's steps in one plan."""
    from ..operators import repair_runs as RR
    sales = V.sales(spark, d, with_keys=True)
    run, turn = F.expr("order_key div 50"), F.expr("(order_key div 50) % 4")
    price = F.col("unit_price").cast("string")
    twice = F.explode(F.array_repeat(F.lit(0), F.when((turn == 2) & (F.col("line_no") % 2 == 1), 2).otherwise(1)))
    landed = sales.select(
        run.alias("run_id"), "transaction_id", "customer_id", "product_id", "quantity",
        F.when(turn == 0, F.concat(price, F.lit("_USD"))).otherwise(price).alias("unit_price"), "currency",
        "transaction_date", F.when(turn != 1, F.col("region")).alias("region"), "status", twice.alias("copy")).drop("copy")
    step = F.when(turn == 0, F.struct(F.lit(RR.CAST).alias("action"), F.array(F.lit("unit_price")).alias("columns"))).when(
        turn == 1, F.struct(F.lit(RR.ADD).alias("action"), F.array(F.lit("region")).alias("columns"))).when(
        turn == 2, F.struct(F.lit("deduplicate_records(sales)").alias("action"), F.array().cast("array<string>").alias("columns")))
    plan = sales.select(run.alias("run_id"), step.alias("s")).where("s is not null").select("run_id", "s.*").distinct()
    fixed = RR.repair_runs(landed, plan, order_by=["customer_id", "product_id", "quantity", "unit_price", "currency",
                                                   "transaction_date", "region", "status"])
    return fixed.select("run_id", "transaction_id", "quantity", "unit_price", "region", "status")
