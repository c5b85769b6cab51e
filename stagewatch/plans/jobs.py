"""Batch jobs B1-B5: ingestion -> transform -> load for one run.

Each stage builds lazy DataFrames; the driver only ever receives one-row
metric results (the ingestion profile, the PK check) to decide the stage
status.  Stage results and log lines are returned as small Python records
and appended to the run tables by ``record_run``.
"""

from __future__ import annotations

import datetime as _dt
import functools
import uuid
from decimal import ROUND_HALF_UP, Decimal
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import (LOG_MESSAGES as MSG, MISSING_COLUMN_MSG, MISSING_SOURCE_MSG,
                                   REVENUE_FAIL_MSG, SALES_COLUMNS, SCHEMA_FAIL_MSG)
from ..functions.exprs import is_null, is_numeric, merge_rows
from ..operators import profile as Q
from ..operators.contracts import range_tests
from ..operators import transform as tr
from ..session import cut_lineage
from ..sources import views as V


@dataclass
class Sources:
    """The three inputs of a run; ``missing`` names sources that did not land."""
    sales: DataFrame | None
    customers: DataFrame | None
    products: DataFrame | None
    missing: list[str] = field(default_factory=list)

    @classmethod
    def from_views(cls, spark: SparkSession, sf_dir: str) -> "Sources":
        return cls(V.sales(spark, sf_dir), V.customers(spark, sf_dir), V.products(spark, sf_dir))

    def replace(self, **kw) -> "Sources":
        d = dict(sales=self.sales, customers=self.customers, products=self.products,
                 missing=list(self.missing))
        d.update(kw)
        return Sources(**d)


def ingestion_metrics(src: Sources) -> DataFrame:
    """The ingestion profile and verdict as ONE row.

    Sales rows, null cells and duplicate keys come from ONE key-count
    aggregate (a single shuffle with map-side combine); customers and
    products are one aggregate each; schema checks are metadata.  The
    single-row results are merged by a union and a one-row aggregate.
    """
    s, c, p = src.sales, src.customers, src.products
    missing = [col for col in SALES_COLUMNS if col not in s.columns]
    mistyped = [] if is_numeric(s, "unit_price") or "unit_price" not in s.columns else ["unit_price"]
    null_cells = sum((F.when(is_null(s, col), 1).otherwise(0) for col in s.columns), F.lit(0))
    outside = sum((F.when(bad, 1).otherwise(0) for bad in range_tests(s, "sales")), F.lit(0))
    if "transaction_id" in s.columns:
        # one shuffle: per-key row, null-cell and range counts (map-side combined), then totals
        per_key = s.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n"),
                                                  F.sum(null_cells).alias("nc"), F.sum(outside).alias("oc"))
        sa = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("sales_rows"),
                         F.coalesce(F.sum("nc"), F.lit(0)).cast("bigint").alias("sales_null_cells"),
                         F.coalesce(F.sum("oc"), F.lit(0)).cast("bigint").alias("out_of_range_count"),
                         F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_count"))
    else:
        sa = s.agg(F.count(F.lit(1)).alias("sales_rows"),
                   F.coalesce(F.sum(null_cells), F.lit(0)).cast("bigint").alias("sales_null_cells"),
                   F.coalesce(F.sum(outside), F.lit(0)).cast("bigint").alias("out_of_range_count"),
                   F.lit(0).cast("bigint").alias("duplicate_count"))
    email = F.when(is_null(c, "email"), 1).otherwise(0) if "email" in c.columns else F.lit(0)
    if "customer_id" in c.columns:
        # the lookup side must be unique on customer_id (J2): same one-shuffle shape
        ck = c.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"), F.sum(email).alias("en"))
        ca = ck.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("customer_rows"),
                    F.coalesce(F.sum("en"), F.lit(0)).cast("bigint").alias("email_nulls"),
                    F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("customer_duplicates"))
    else:
        ca = c.agg(F.count(F.lit(1)).alias("customer_rows"),
                   F.coalesce(F.sum(email), F.lit(0)).cast("bigint").alias("email_nulls"),
                   F.lit(0).cast("bigint").alias("customer_duplicates"))
    pa = p.agg(F.count(F.lit(1)).alias("product_rows"))
    failed = len(missing) + len(mistyped) > 0
    total = F.col("sales_rows") + F.col("customer_rows") + F.col("product_rows")
    return merge_rows([sa, ca, pa]).select(
        "sales_rows", "customer_rows", "product_rows", total.alias("total_rows_in"),
        F.lit(len(missing)).cast("bigint").alias("n_missing_columns"),
        F.lit(len(mistyped)).cast("bigint").alias("n_type_mismatches"),
        "sales_null_cells", "email_nulls", "duplicate_count", "out_of_range_count", "customer_duplicates",
        F.lit("failed" if failed else "success").alias("status"),
        (F.lit(0) if failed else total).cast("bigint").alias("rows_out"))


def column_profile(src: Sources) -> DataFrame:
    """B1: ``(dataset, column_name, null_count, total_rows, null_pct)`` of every column of the sources,
    the percentage to one place (rounded as a decimal)."""
    parts = [Q.null_profile(df, name, nonzero_only=False)
             for name, df in (("sales", src.sales), ("customers", src.customers), ("products", src.products))
             if df is not None]
    out = functools.reduce(lambda a, b: a.unionByName(b), parts)
    exact = F.col("null_count").cast("decimal(18,0)") * 100 / F.col("total_rows").cast("decimal(18,0)")
    return out.withColumn("null_pct", F.round(exact, 1).cast("double"))


# ---------------------------------------------------------------------------
# one run, end to end
# ---------------------------------------------------------------------------

def _now() -> _dt.datetime:
    return _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)


@dataclass
class RunResult:
    run_id: str
    scenario_name: str
    failure_type: str | None
    started_at: _dt.datetime
    finished_at: _dt.datetime | None = None
    stages: list[dict] = field(default_factory=list)
    logs: list[dict] = field(default_factory=list)
    metrics: dict = field(default_factory=dict)
    remediations: list[str] = field(default_factory=list)
    enriched: DataFrame | None = None
    daily: DataFrame | None = None

    def log(self, level: str, stage: str, message: str, **details) -> None:
        import json
        self.logs.append(dict(run_id=self.run_id, seq=len(self.logs), ts=_now(), level=level,
                              stage=stage, message=message, details=json.dumps(details, default=str)))

    def stage(self, name: str) -> dict | None:
        for s in reversed(self.stages):
            if s["stage_name"] == name:
                return s
        return None

    def set_stage(self, name: str, ordinal: int, status: str, rows_in: int = 0, rows_out: int = 0,
                  error: str | None = None, started: _dt.datetime | None = None) -> dict:
        prev = self.stage(name)
        rec = dict(run_id=self.run_id, stage_name=name, stage_ordinal=ordinal,
                   attempt=(prev["attempt"] + 1) if prev else 1, status=status, rows_in=rows_in,
                   rows_out=rows_out, started_at=started, finished_at=_now() if started else None,
                   error_message=error)
        self.stages.append(rec)
        return rec

    @property
    def has_failures(self) -> bool:
        latest = {}
        for s in self.stages:
            latest[s["stage_name"]] = s
        return any(s["status"] == "failed" for s in latest.values())


def _guarded(name: str, ordinal: int):
    """A stage that ends in an error of any kind is FAILED, with the message, and the run goes on to its gates."""
    def deco(stage):
        @functools.wraps(stage)
        def guarded(first, *args, **kw):
            run = first if isinstance(first, RunResult) else args[0]
            t0 = _now()
            try:
                return stage(first, *args, **kw)
            except Exception as exc:  # noqa: BLE001  (recorded, not swallowed)
                message = str(exc).strip().splitlines()[0] if str(exc).strip() else type(exc).__name__
                run.set_stage(name, ordinal, "failed", run.metrics.get("sales_rows", 0), 0, message, t0)
                run.log("error", name, message, error=type(exc).__name__)
                return None
        return guarded
    return deco


@_guarded("ingestion", 1)
def run_ingestion(src: Sources, run: RunResult) -> Sources | None:
    """B1: arrival, schema, types, profile; FAILED on violations."""
    t0 = _now()
    if src.missing:
        msg = MISSING_SOURCE_MSG.format(src.missing[0])
        run.set_stage("ingestion", 1, "failed", 0, 0, msg, t0)
        run.log("critical", "ingestion", msg)
        return None
    m = ingestion_metrics(src).first().asDict()        # one row
    run.metrics = m
    missing = [c for c in SALES_COLUMNS if c not in src.sales.columns]
    extra = [c for c in src.sales.columns if c not in SALES_COLUMNS]
    for c in missing:
        run.log("error", "ingestion", MSG["missing_columns"].format({c}),
                missing_columns=[c])
    m["schema_violations"] = [MISSING_COLUMN_MSG.format(c) for c in missing]
    m["extra_columns"] = extra
    if extra:
        run.log("warning", "ingestion", MSG["extra_columns"].format(set(extra)), extra_columns=extra)
    if m["n_type_mismatches"]:
        samples = [r["bad_value"] for r in Q.bad_value_samples(      # three rows
            src.sales, "unit_price", [c for c in ("transaction_id",) if c in src.sales.columns]).collect()]
        run.log("error", "ingestion", MSG["price_type"], column="unit_price", sample_values=samples)
    if m["email_nulls"]:
        share = Decimal(m["email_nulls"]) * 100 / Decimal(m["customer_rows"])
        run.log("warning", "ingestion", MSG["null_emails"].format(m["email_nulls"], m["customer_rows"], share),
                null_count=m["email_nulls"], null_pct=float(share.quantize(Decimal("0.1"), ROUND_HALF_UP)))
    if m["duplicate_count"]:
        run.log("warning", "ingestion", MSG["duplicates"].format(m["duplicate_count"]),
                duplicate_count=m["duplicate_count"])
    if m["status"] == "failed":
        run.set_stage("ingestion", 1, "failed", m["total_rows_in"], 0, SCHEMA_FAIL_MSG, t0)
        return src
    run.set_stage("ingestion", 1, "success", m["total_rows_in"], m["total_rows_in"], None, t0)
    run.log("info", "ingestion", MSG["ingestion_done"].format(m["total_rows_in"]))
    return src


@_guarded("transform", 2)
def run_transform(src: Sources | None, run: RunResult) -> None:
    """B2: gate (J4), type guard (P3), conversion, enrichment, daily aggregate."""
    ing = run.stage("ingestion")
    if src is None or ing is None or ing["status"] == "failed":
        run.set_stage("transform", 2, "skipped")
        run.log("warning", "transform", MSG["transform_skipped"])
        return
    t0 = _now()
    n = run.metrics.get("sales_rows", 0)
    if run.metrics.get("customer_duplicates", 0):
        msg = (f"Transform error: customer lookup is not unique "
               f"({run.metrics['customer_duplicates']} duplicate customer_id rows)")
        run.log("error", "transform", msg)
        run.set_stage("transform", 2, "failed", n, 0, msg, t0)
        return
    try:
        enriched = tr.enrich_customers(tr.fx_convert(src.sales), src.customers)
    except tr.TransformError:
        run.log("error", "transform", MSG["revenue_type"])
        run.set_stage("transform", 2, "failed", n, 0, REVENUE_FAIL_MSG, t0)
        return
    run.enriched = enriched
    run.daily = tr.daily_aggregation(enriched)
    run.set_stage("transform", 2, "success", n, n, None, t0)
    run.log("info", "transform", MSG["transform_done"].format(n))


@_guarded("load", 3)
def run_load(run: RunResult, target: str | None = None, retain: bool = False) -> None:
    """Gate, PK check (C10), then a publication of a new attempt.

    With ``retain`` earlier attempts are kept, for reads as of a time and roll-backs to them.
    """
    tr_stage = run.stage("transform")
    if tr_stage is None or tr_stage["status"] in ("failed", "skipped") or run.enriched is None:
        run.set_stage("load", 3, "skipped")
        run.log("warning", "load", MSG["load_skipped"])
        return
    t0 = _now()
    n = run.metrics.get("sales_rows", 0)
    if target:
        # the PK check and the write both read the enriched table: materialise it
        # once in the shared checkpoint folder instead of recomputing the joins
        run.enriched = cut_lineage(run.enriched)
    pk = Q.pk_violations(run.enriched, "transaction_id").first()   # one row
    if pk["violated"]:
        run.set_stage("load", 3, "failed", n, 0, pk["message"], t0)
        run.log("error", "load", pk["message"])
        return
    written = n
    if target:
        from ..sources.published import publish
        # an attempt of its own: the rows of the last one stay readable until these are complete
        _, written = publish(run.enriched, target, run.run_id, ["transaction_date"], cluster_by=["transaction_id"],
                             retain=retain)
    run.set_stage("load", 3, "success", n, written, None, t0)
    run.log("info", "load", MSG["load_done"].format(written))


def run_pipeline(src: Sources, scenario_name: str = "healthy", failure_type: str | None = None,
                 target: str | None = None, run_id: str | None = None) -> RunResult:
    """One full first pass; the verdict is K1 over the stage records."""
    run = RunResult(run_id or uuid.uuid4().hex, scenario_name, failure_type, _now())
    checked = run_ingestion(src, run)
    run_transform(checked, run)
    run_load(run, target)
    run.finished_at = _now()
    return run


def rerun_stage(src: Sources, run: RunResult, stage: str, target: str | None = None,
                retain: bool = False) -> RunResult:
    """Re-execute one stage on repaired inputs; appends a new attempt."""
    if stage not in ("ingestion", "transform", "load"):
        raise ValueError(f"Invalid stage '{stage}'. Must be one of: ingestion, transform, load")
    run.log("info", "remediation", MSG["rerun"].format(stage))
    if stage == "ingestion":
        run_ingestion(src, run)
    elif stage == "transform":
        run_transform(src, run)
    else:
        run_load(run, target, retain)
    action = f"rerun_stage({stage})"
    if action not in run.remediations:
        run.remediations.append(action)
    return run


def rollback_stage(run: RunResult, stage: str, target: str | None = None,
                   spark: SparkSession | None = None, retain: bool = False) -> RunResult:
    """Mark a transform/load stage skipped and drop its outputs (T6): for
    load the rows that the run published below ``target`` (with ``retain`` they
    are kept, but no longer published)."""
    if stage not in ("transform", "load"):
        raise ValueError("Only transform and load can be rolled back")
    if stage == "transform":
        run.enriched, run.daily = None, None
    elif target:
        from ..sources.published import roll_back
        roll_back(spark or SparkSession.getActiveSession(), target, run.run_id, retain=retain)
    ordinal = {"transform": 2, "load": 3}[stage]
    run.set_stage(stage, ordinal, "skipped")
    run.log("warning", "remediation", MSG["rolled_back"].format(stage))
    action = f"rollback_stage({stage})"
    if action not in run.remediations:
        run.remediations.append(action)
    return run


def record_run(spark: SparkSession, run: RunResult, base: str, bucketed: bool = False) -> None:
    """Append the run's stage attempts, logs and remediations to the run tables."""
    from ..sources.files import append_run_table
    if run.stages:
        append_run_table(spark.createDataFrame(run.stages, schema=(
            "run_id string, stage_name string, stage_ordinal int, attempt int, status string, "
            "rows_in bigint, rows_out bigint, started_at timestamp_ntz, finished_at timestamp_ntz, "
            "error_message string")), base, "stage_results", bucketed)
    if run.logs:
        # never bucketed: a run's log is unbounded, and a bucket cannot be split for
        # skew; logs are aggregated per run (map-side combined) before any join anyway
        append_run_table(spark.createDataFrame(run.logs, schema=(
            "run_id string, seq bigint, ts timestamp_ntz, level string, stage string, message string, "
            "details string")), base, "log_entries", False)
    if run.remediations:
        append_run_table(spark.createDataFrame([(run.run_id, i, a) for i, a in enumerate(run.remediations)],
                                               "run_id string, seq bigint, action string"),
                         base, "remediations", bucketed)
