"""Registered queries (one per operator of the inventory) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import transform as tr
from ..sources import views as V
from .catalog import register
from .oracle_views import with_views

# ---------------------------------------------------------------------------
# transform: P1, P2, J1, J3, A2
# ---------------------------------------------------------------------------

_FX_SQL = ("CASE currency WHEN 'USD' THEN 1.0 WHEN 'EUR' THEN 1.08 WHEN 'GBP' THEN 1.27 "
           "WHEN 'CAD' THEN 0.74 WHEN 'AUD' THEN 0.65 ELSE 1.0 END")


@register("daily_revenue", with_views(f"""
SELECT strftime(transaction_date, '%Y-%m-%d') AS transaction_date,
       coalesce(cast(sum(rev) AS double), 0.0) AS total_revenue,
       count(DISTINCT transaction_id) AS transaction_count,
       cast(sum(rev) AS double) / count(rev) AS avg_order_value
FROM (SELECT transaction_date, transaction_id,
             unit_price * cast({_FX_SQL} AS decimal(8,4)) * cast(quantity AS decimal(10,0)) AS rev
      FROM sales_nr) s
WHERE transaction_date IS NOT NULL
GROUP BY transaction_date""", "sales_nr"))
def daily_revenue(spark, d):
    """Flagship: FX conversion + daily revenue / transaction count / mean."""
    s = V.sales(spark, d, with_region=False, with_keys=True).drop("transaction_id")
    return tr.daily_aggregation(tr.fx_convert(s), distinct_on=["order_key", "line_no"])


def _fx_usd_sql(price="unit_price"):
    return f"{price} * cast({_FX_SQL} AS decimal(8,4))"


@register("fx_convert", with_views(f"""
SELECT transaction_id, customer_id, product_id, cast(quantity AS bigint) AS quantity,
       cast(unit_price AS double) AS unit_price, currency,
       strftime(transaction_date, '%Y-%m-%d') AS transaction_date, status,
       cast({_fx_usd_sql()} AS double) AS unit_price_usd,
       cast({_fx_usd_sql()} * cast(quantity AS decimal(10,0)) AS double) AS revenue_usd
FROM sales_nr""", "sales_nr"))
def fx_convert(spark, d):
    """USD price and revenue per sale (inline rate lookup, no join)."""
    return tr.fx_convert(V.sales(spark, d, with_region=False))


@register("enrich_customers", with_views("""
SELECT s.transaction_id, s.customer_id,
       CASE WHEN c.customer_id IS NULL THEN 'Unknown' ELSE c.name END AS customer_name,
       CASE WHEN c.customer_id IS NULL THEN 'unknown' ELSE c.tier END AS customer_tier
FROM sales_nr s
LEFT JOIN customers c ON s.customer_id = c.customer_id""",
    "sales_nr", "customers"))
def enrich_customers(spark, d):
    """Customer name and tier, defaults only for unmatched ids."""
    s = V.sales(spark, d, with_region=False).select("transaction_id", "customer_id")
    return tr.enrich_customers(s, V.customers(spark, d))


#: A day's rates, computed from the orders of the day before: from 0.00003 to about 1.3, ten places.
_DAILY_RATES_SQL = """
days AS (SELECT DISTINCT transaction_date AS day FROM sales_nr WHERE transaction_date IS NOT NULL),
rates AS (SELECT c AS currency, day, cast(CASE c WHEN 'EUR' THEN 1.05 + (date_diff('day', DATE '1990-01-01', day) % 250) / 1000.0
                 ELSE 0.0000301234 + (date_diff('day', DATE '1990-01-01', day) % 97) / 10000000.0 END AS decimal(14,10)) AS rate
          FROM days, (VALUES ('EUR'), ('GBP')) t(c) WHERE date_diff('day', DATE '1990-01-01', day) % 11 <> 0)"""


@register("fx_daily_rates", with_views(f"""
WITH {_DAILY_RATES_SQL}
SELECT s.currency, count(*) AS n_sales, count(r.rate) AS n_rated,
       cast(sum(unit_price * coalesce(r.rate, 1)) AS double) AS price_usd,
       cast(sum(unit_price * coalesce(r.rate, 1) * cast(quantity AS decimal(10,0))) AS double) AS revenue_usd
FROM sales_nr s LEFT JOIN rates r ON r.currency = s.currency AND r.day = s.transaction_date
GROUP BY s.currency""", "sales_nr"))
def fx_daily_rates(spark, d):
    """J3 with a rates table by currency and day: small rates keep their scale, days without a rate use 1."""
    s = V.sales(spark, d, with_region=False)
    n = F.datediff("transaction_date", F.lit("1990-01-01").cast("date"))
    days = s.select("transaction_date").where("transaction_date is not null").distinct().withColumn("n", n)
    euro = F.lit("1.05").cast("decimal(14,10)") + (F.col("n") % 250) / F.lit(1000).cast("decimal(14,0)")
    small = F.lit("0.0000301234").cast("decimal(14,10)") + (F.col("n") % 97) / F.lit(10_000_000).cast("decimal(14,0)")
    rates = days.where(F.col("n") % 11 != 0).select("transaction_date", F.explode(F.array(
        F.struct(F.lit("EUR").alias("currency"), euro.cast("decimal(14,10)").alias("rate")),
        F.struct(F.lit("GBP").alias("currency"), small.cast("decimal(14,10)").alias("rate")))).alias("r")).select(
        "r.currency", "transaction_date", "r.rate")
    out = tr.fx_convert(s, rates)
    return out.groupBy("currency").agg(
        F.count(F.lit(1)).alias("n_sales"),
        F.count_if((F.col("currency").isin("EUR", "GBP")) & (n % 11 != 0)).alias("n_rated"),
        F.sum("unit_price_usd").alias("price_usd"), F.sum("revenue_usd").alias("revenue_usd"))
