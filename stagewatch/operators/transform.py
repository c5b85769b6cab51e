"""Transform stage operators: currency conversion, enrichment, daily aggregate.

P1-P3 (conversion, revenue, type guard), J1-J3 (lookups), A2 (daily totals).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import UNKNOWN_NAME, UNKNOWN_TIER
from ..functions.exprs import fx_rate, is_numeric, rate_type
from .joins import lookup_join


class TransformError(ValueError):
    """Raised in the driver when a stage gate or type guard fails."""


def check_price_type(sales: DataFrame) -> None:
    """The price must be numeric (a text price means upstream drift)."""
    if not is_numeric(sales, "unit_price"):
        raise TransformError("Revenue computation failed — unit_price type invalid")


def fx_convert(sales: DataFrame, rates: dict[str, float] | DataFrame | None = None) -> DataFrame:
    """``unit_price_usd`` and ``revenue_usd``.

    ``rates`` is a dict (inline CASE, no join) or a DataFrame ``(currency,
    rate)``, with one rate per currency, or ``(currency, transaction_date,
    rate)``, with one per currency and day.  A rates table that repeats a
    key is rejected: it would multiply sales.  An unknown or null currency
    (or a day without a rate) uses rate 1.0; an absent currency column means
    USD.  Rates keep their own scale: small ones do not become zero.
    """
    check_price_type(sales)
    cur = F.col("currency") if "currency" in sales.columns else F.lit("USD")
    if isinstance(rates, DataFrame):
        keys = [c for c in ("currency", "transaction_date") if c in rates.columns]
        repeated = rates.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
        if repeated:
            raise TransformError(f"rates table is not unique on {', '.join(keys)}")
        kind = rate_type(rates.schema["rate"].dataType)
        r = rates.select(F.col("currency").alias("_fx_cur"), F.col("rate").cast(kind).alias("_fx_rate"),
                         *([F.col("transaction_date").alias("_fx_day")] if "transaction_date" in keys else []))
        on = cur == F.col("_fx_cur")
        if "transaction_date" in keys:
            on = on & (F.col("transaction_date") == F.col("_fx_day"))
        df = lookup_join(sales, r, on)
        rate = F.coalesce(F.col("_fx_rate"), F.lit(1).cast(kind))
    else:
        df, rate = sales, fx_rate(cur, rates)
    price = F.col("unit_price")
    if not str(sales.schema["unit_price"].dataType).startswith("Decimal"):
        price = price.cast("decimal(18,4)")
    usd = (price * rate)
    out = df.withColumn("unit_price_usd", usd) \
        .withColumn("revenue_usd", F.col("unit_price_usd") * F.col("quantity").cast("decimal(10,0)"))
    return out.drop("_fx_cur", "_fx_rate", "_fx_day") if isinstance(rates, DataFrame) else out


def enrich_customers(sales: DataFrame, customers: DataFrame) -> DataFrame:
    """Add ``customer_name`` and ``customer_tier``.

    Defaults apply only when no customer matches; a matched customer whose
    name is null keeps the null.  The lookup side must be unique on
    ``customer_id`` (J2); ``profile.duplicate_count`` checks it.
    """
    lk = customers.select(F.col("customer_id").alias("_ck"), F.col("name").alias("_cn"),
                          F.col("tier").alias("_ct"), F.lit(True).alias("_cm"))
    j = lookup_join(sales, lk, F.col("customer_id") == F.col("_ck"))
    matched = F.col("_cm").isNotNull()
    return (j.withColumn("customer_name", F.when(matched, F.col("_cn")).otherwise(F.lit(UNKNOWN_NAME)))
             .withColumn("customer_tier", F.when(matched, F.col("_ct")).otherwise(F.lit(UNKNOWN_TIER)))
             .drop("_ck", "_cn", "_ct", "_cm"))


def daily_aggregation(enriched: DataFrame, distinct_on: list[str] | None = None) -> DataFrame:
    """A2: per ``transaction_date`` total revenue, distinct transactions and
    the mean revenue per row.  Rows with a null date are dropped; an
    all-null revenue group sums to 0 and averages to null.  Without a date
    column the result is empty.

    ``distinct_on`` names columns that identify a transaction exactly as
    ``transaction_id`` does (e.g. its numeric parts): counting those avoids
    building and shuffling a string key per row, and when the input is
    already hash-partitioned on the first of them (a sort-merge join on the
    order key) the first aggregation level needs no extra shuffle.
    """
    if "transaction_date" not in enriched.columns:
        return enriched.sparkSession.createDataFrame(
            [], "transaction_date date, total_revenue double, transaction_count bigint, "
                "avg_order_value double")
    rev = F.col("revenue_usd")
    agg = (enriched.where(F.col("transaction_date").isNotNull())
           .groupBy("transaction_date")
           .agg(F.sum(rev).alias("_s"), F.count(rev).alias("_n"),
                F.count_distinct(*(distinct_on or ["transaction_id"])).alias("transaction_count")))
    return agg.select(
        "transaction_date",
        F.coalesce(F.col("_s").cast("double"), F.lit(0.0)).alias("total_revenue"),
        "transaction_count",
        F.try_divide(F.col("_s").cast("double"), F.col("_n").cast("double")).alias("avg_order_value"),
    )
