"""Logical tables of the monitored ETL system, derived from the test tables.

The monitored system keeps three source tables (sales, customers, products)
and four run tables (runs, stage results, log entries, run history).  Here
each one is a lazy DataFrame built with Spark from the TPC-H-style parquet
tables, so every operator runs over data whose size grows with the scale
factor.  Derivation rules (documented in the README):

* sales      = lineitem JOIN orders (+ customer -> nation for ``region``)
* customers  = customer JOIN nation
* products   = part
* run_history, log_entries = events
* runs, stage_results, remediations, quality_metrics = orders

Only fixed-size dimension tables (nation: 25 rows) are broadcast explicitly;
every fact-to-fact join is left to the planner (sort-merge or a size-checked
broadcast by ``autoBroadcastJoinThreshold`` / AQE).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import SCENARIOS, SCHEMA_FAIL_MSG
from .tables import read_table

REGIONS = ["North", "South", "East", "West"]           # by n_regionkey; key 4 -> null
STATUS_BY_CODE = {"F": "completed", "O": "pending", "P": "failed"}
CURRENCY_BY_FLAG = {"N": "USD", "R": "EUR", "A": "GBP"}
LOG_STAGES = ["ingestion", "transform", "load", "remediation"]
AS_OF = "2024-01-31 00:00:00"                           # "now" for the events history


def _case(col: Column, mapping: dict) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr


def pick(values: list[str], index: Column) -> Column:
    """``values[index]`` (0-based) as a literal-array lookup; out of range -> null."""
    return F.try_element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


# ---------------------------------------------------------------------------
# source tables
# ---------------------------------------------------------------------------

def customer_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, region): customer -> nation (25 rows, broadcast)."""
    nation = read_table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    cust = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    return (cust.join(F.broadcast(nation), cust.c_nationkey == nation.n_nationkey, "left")
            .select("c_custkey", pick(REGIONS, F.col("n_regionkey")).alias("region")))


def sales(spark: SparkSession, sf_dir: str, with_region: bool = True, with_keys: bool = False) -> DataFrame:
    """The ``sales`` table.  ``with_region=False`` skips the customer join;
    ``with_keys=True`` also keeps the numeric parts of ``transaction_id``
    (``order_key``, ``line_no``) for operators that only need identity.

    The order side is enriched first (orders are a quarter of line items),
    so the line items are shuffled once, on ``l_orderkey``.
    """
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey",
                    "l_quantity", "l_extendedprice", "l_returnflag")
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus",
                   "o_orderdate")
    if with_region:
        geo = customer_region(spark, sf_dir)
        o = o.join(geo, o.o_custkey == geo.c_custkey, "left").drop("c_custkey")
    s = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    cols = [
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"),
                 F.col("l_linenumber").cast("string")).alias("transaction_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("unit_price"),
        _case(F.col("l_returnflag"), CURRENCY_BY_FLAG).alias("currency"),
        F.col("o_orderdate").cast("date").alias("transaction_date"),
    ]
    if with_region:
        cols.append(F.col("region"))
    cols.append(_case(F.col("o_orderstatus"), STATUS_BY_CODE).alias("status"))
    if with_keys:
        cols += [F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_no")]
    return s.select(*cols)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``customers`` table: customer JOIN nation (broadcast, 25 rows)."""
    nation = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey",
                   "c_acctbal", "c_mktsegment")
    return (c.join(F.broadcast(nation), c.c_nationkey == nation.n_nationkey, "left")
            .select(F.col("c_custkey").alias("customer_id"),
                    F.col("c_name").alias("name"),
                    F.concat(F.lower(F.regexp_replace("c_name", "#", ".")),
                             F.lit("@example.com")).alias("email"),
                    F.lower("c_mktsegment").alias("tier"),
                    F.col("n_name").alias("country"),
                    F.date_add(F.lit("2020-01-01").cast("date"),
                               (F.col("c_custkey") % 1000).cast("int")).alias("signup_date"),
                    F.col("c_acctbal").alias("lifetime_value")))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``products`` table from ``part``."""
    p = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_size",
                   "p_retailprice")
    return p.select(F.col("p_partkey").alias("product_id"),
                    F.col("p_name").alias("name"),
                    F.initcap("p_type").alias("category"),
                    F.col("p_retailprice").alias("unit_price"),
                    F.round(F.col("p_retailprice") * 0.6, 2).alias("cost_price"),
                    (F.col("p_partkey") % 100).alias("supplier_id"),
                    F.col("p_size").alias("stock_quantity"),
                    (F.col("p_size") / 10.0).alias("weight_kg"),
                    (F.col("p_partkey") % 10 != 0).alias("is_active"))


# ---------------------------------------------------------------------------
# run tables
# ---------------------------------------------------------------------------

def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One history record per event (flattened ``data_quality`` struct)."""
    e = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    et = F.col("event_type")
    failure_type = (F.when(et == "error", "schema_drift").when(et == "view", "data_quality")
                    .when(et == "click", "pipeline_failure"))
    outcome = (F.when(et == "error", "FAILED").when(et == "view", "RESOLVED")
               .when(et == "click", F.when(F.col("event_id") % 2 == 0, "RESOLVED")
                     .otherwise("UNRESOLVED"))
               .otherwise("HEALTHY"))
    return e.select(
        F.col("event_id").alias("run_id"),
        pick(SCENARIOS, F.col("user_id") % 8).alias("scenario_name"),
        failure_type.alias("failure_type"),
        F.col("ts"),
        outcome.alias("outcome"),
        F.col("value").alias("duration_seconds"),
        (F.lit(100) + F.col("event_id") % 900).alias("total_rows"),
        (F.col("event_id") % 7).alias("total_nulls"),
        (F.col("event_id") % 3).alias("duplicate_count"),
    )


def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries: ten consecutive events form one run's log."""
    e = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "props")
    et = F.col("event_type")
    level = (F.when(et == "error", "error").when(et == "signup", "critical")
             .when(et == "view", "warning").otherwise("info"))
    stage = pick(LOG_STAGES, F.col("user_id") % 4)
    return e.select(
        F.expr("event_id div 10").alias("run_id"),
        F.col("event_id").alias("seq"),
        F.col("ts"),
        level.alias("level"),
        stage.alias("stage"),
        F.concat(stage, F.lit(": "), et, F.lit(" #"), F.col("event_id").cast("string"))
        .alias("message"),
        F.col("props").alias("details"),
    )


def _orders_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus",
                   "o_orderdate")
    k = F.col("o_orderkey")
    ing_failed = (F.col("o_orderstatus") == "F") & (k % 3 == 0)
    load_failed = ~ing_failed & (k % 7 == 0)
    return o.select(
        k.alias("run_id"), F.col("o_custkey"), F.col("o_orderdate").alias("run_start"),
        (F.lit(100) + k % 900).alias("n_rows"),
        ing_failed.alias("ing_failed"), load_failed.alias("load_failed"),
        (F.col("o_custkey") % 2 == 0).alias("repaired"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run headers (one per order)."""
    r = _orders_runs(spark, sf_dir)
    failure_type = (F.when(F.col("ing_failed"), "schema_drift")
                    .when(F.col("load_failed"), "data_quality"))
    return r.select(
        "run_id",
        F.lit("sales_etl").alias("pipeline_name"),
        pick(SCENARIOS, F.col("o_custkey") % 8).alias("scenario_name"),
        F.col("run_start").alias("started_at"),
        (F.col("run_start") + F.make_dt_interval(secs=F.lit(30) + F.col("run_id") % 60)
         ).alias("finished_at"),
        failure_type.isNotNull().alias("failure_injected"),
        failure_type.alias("failure_type"),
    )


def stage_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only stage attempts: three first-pass rows per run, plus re-runs.

    First pass follows the stage gate: transform is skipped after a failed
    ingestion, load after a failed or skipped transform.  Repaired runs
    (``o_custkey`` even) get attempt 2 rows for the failed stage and every
    later stage, all successful.
    """
    r = _orders_runs(spark, sf_dir)
    n = F.col("n_rows")
    ing, ld, rep = F.col("ing_failed"), F.col("load_failed"), F.col("repaired")
    pk_msg = F.concat(F.lit("PK constraint violation: "), (n * 15 / 100).cast("bigint").cast("string"),
                      F.lit(" duplicate transaction_ids"))

    def att(stage, ordinal, attempt, status, rows_in, rows_out, error, when):
        return F.when(when, F.struct(
            F.lit(stage).alias("stage_name"), F.lit(ordinal).alias("stage_ordinal"),
            F.lit(attempt).alias("attempt"), status.alias("status"),
            rows_in.cast("bigint").alias("rows_in"), rows_out.cast("bigint").alias("rows_out"),
            error.cast("string").alias("error_message")))

    null = F.lit(None).cast("string")
    ing_status = F.when(ing, "failed").otherwise("success")
    tr_status = F.when(ing, "skipped").otherwise("success")
    ld_status = F.when(ing, "skipped").when(ld, "failed").otherwise("success")
    entries = F.array(
        att("ingestion", 1, 1, ing_status, n, F.when(ing, 0).otherwise(n),
            F.when(ing, F.lit(SCHEMA_FAIL_MSG)), F.lit(True)),
        att("transform", 2, 1, tr_status, F.when(ing, 0).otherwise(n),
            F.when(ing, 0).otherwise(n), null, F.lit(True)),
        att("load", 3, 1, ld_status, F.when(ing, 0).otherwise(n),
            F.when(ing | ld, 0).otherwise(n), F.when(ld, pk_msg), F.lit(True)),
        att("ingestion", 1, 2, F.lit("success"), n, n, null, ing & rep),
        att("transform", 2, 2, F.lit("success"), n, n, null, ing & rep),
        att("load", 3, 2, F.lit("success"), n, n, null, (ing | ld) & rep),
    )
    x = r.select("run_id", "run_start", F.explode(F.filter(entries, lambda s: s.isNotNull())).alias("s"))
    start = F.col("run_start") + F.make_dt_interval(
        secs=(F.col("s.attempt") - 1) * 600 + (F.col("s.stage_ordinal") - 1) * 10)
    skipped = F.col("s.status") == "skipped"
    return x.select(
        "run_id", "s.stage_name", "s.stage_ordinal", "s.attempt", "s.status",
        "s.rows_in", "s.rows_out",
        F.when(~skipped, start).alias("started_at"),
        F.when(~skipped, start + F.make_dt_interval(secs=F.lit(1) + F.col("run_id") % 9))
        .alias("finished_at"),
        "s.error_message",
    )


def remediations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw remediation calls in call order; a repeated call appears twice."""
    r = _orders_runs(spark, sf_dir).where(F.col("repaired") & (F.col("ing_failed") | F.col("load_failed")))
    ing = F.col("ing_failed")
    schema_fix = F.when(F.col("run_id") % 2 == 0, "apply_schema_fix(fix_type_cast)") \
        .otherwise("apply_schema_fix(add_missing_column_default)")
    calls = F.when(ing, F.array(schema_fix, F.lit("rerun_stage(ingestion)"), schema_fix,
                                F.lit("rerun_stage(transform)"), F.lit("rerun_stage(load)"))) \
        .otherwise(F.array(F.lit("deduplicate_records(sales)"), F.lit("rerun_stage(transform)"),
                           F.lit("deduplicate_records(sales)"), F.lit("rerun_stage(load)")))
    return r.select("run_id", F.posexplode(calls).alias("seq", "action")) \
        .select("run_id", F.col("seq").cast("bigint").alias("seq"), "action")


def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingestion quality metrics, one row per run (dataset ``sales``)."""
    r = _orders_runs(spark, sf_dir)
    k = F.col("run_id")
    ing, ld = F.col("ing_failed"), F.col("load_failed")
    missing = ing & (k % 2 == 0)
    typed = ing & (k % 2 == 1)
    return r.select(
        "run_id",
        F.col("n_rows").alias("total_rows"),
        F.when(F.col("o_custkey") % 5 == 0, (F.col("o_custkey") % 17).cast("bigint"))
        .otherwise(F.lit(0).cast("bigint")).alias("null_count"),
        F.when(ld, (F.col("n_rows") * 15 / 100).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        .alias("duplicate_count"),
        F.when(k % 97 == 0, 2).otherwise(0).cast("bigint").alias("out_of_range_count"),
        F.when(missing, F.array(F.lit("Missing required column: 'region'")))
        .otherwise(F.array().cast("array<string>")).alias("schema_violations"),
        F.when(typed, F.create_map(F.lit("unit_price"), F.lit("expected float, got object")))
        .otherwise(F.create_map().cast("map<string,string>")).alias("type_mismatches"),
        F.when(F.col("o_custkey") % 11 == 0, F.array(F.lit("loyalty_points")))
        .otherwise(F.array().cast("array<string>")).alias("extra_columns"),
    )
