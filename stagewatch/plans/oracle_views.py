"""The logical tables of ``sources.views`` written as DuckDB SQL.

Used only by the independent oracle check (``oracle_sql``): each registered
query is re-stated in plain SQL over the same parquet tables so another
engine can confirm the Spark result.
"""

from __future__ import annotations

SCEN = ("['healthy', 'schema_drift_new_column', 'schema_drift_type_change', "
        "'schema_drift_missing_column', 'data_quality_nulls', 'data_quality_duplicates', "
        "'missing_source_file', 'pk_constraint_violation']")

VIEWS = {
    "geo": """geo AS (
  SELECT c.c_custkey, (['North', 'South', 'East', 'West'])[n.n_regionkey + 1] AS region
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)""",
    "sales_nr": """sales_nr AS (
  SELECT cast(l.l_orderkey AS varchar) || '-' || cast(l.l_linenumber AS varchar) AS transaction_id,
         o.o_custkey AS customer_id, l.l_partkey AS product_id,
         cast(trunc(l.l_quantity) AS integer) AS quantity,
         cast(l.l_extendedprice AS decimal(12,2)) AS unit_price,
         CASE l.l_returnflag WHEN 'N' THEN 'USD' WHEN 'R' THEN 'EUR' WHEN 'A' THEN 'GBP' END AS currency,
         cast(o.o_orderdate AS date) AS transaction_date,
         CASE o.o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' WHEN 'P' THEN 'failed' END AS status
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)""",
    "sales": """sales AS (
  SELECT cast(l.l_orderkey AS varchar) || '-' || cast(l.l_linenumber AS varchar) AS transaction_id,
         o.o_custkey AS customer_id, l.l_partkey AS product_id,
         cast(trunc(l.l_quantity) AS integer) AS quantity,
         cast(l.l_extendedprice AS decimal(12,2)) AS unit_price,
         CASE l.l_returnflag WHEN 'N' THEN 'USD' WHEN 'R' THEN 'EUR' WHEN 'A' THEN 'GBP' END AS currency,
         cast(o.o_orderdate AS date) AS transaction_date,
         g.region,
         CASE o.o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' WHEN 'P' THEN 'failed' END AS status
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN geo g ON o.o_custkey = g.c_custkey)""",
    "customers": """customers AS (
  SELECT c.c_custkey AS customer_id, c.c_name AS name,
         lower(replace(c.c_name, '#', '.')) || '@example.com' AS email,
         lower(c.c_mktsegment) AS tier, n.n_name AS country,
         date '2020-01-01' + cast(c.c_custkey % 1000 AS integer) AS signup_date,
         c.c_acctbal AS lifetime_value
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)""",
    "products": """products AS (
  SELECT p_partkey AS product_id, p_name AS name,
         upper(p_type[1]) || lower(p_type[2:]) AS category,
         p_retailprice AS unit_price, p_size AS stock_quantity
  FROM part)""",
    "run_history": f"""run_history AS (
  SELECT event_id AS run_id,
         ({SCEN})[cast(user_id % 8 AS integer) + 1] AS scenario_name,
         CASE event_type WHEN 'error' THEN 'schema_drift' WHEN 'view' THEN 'data_quality'
              WHEN 'click' THEN 'pipeline_failure' END AS failure_type,
         ts,
         CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'RESOLVED'
              WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'RESOLVED' ELSE 'UNRESOLVED' END
              ELSE 'HEALTHY' END AS outcome,
         value AS duration_seconds,
         100 + event_id % 900 AS total_rows,
         event_id % 7 AS total_nulls,
         event_id % 3 AS duplicate_count
  FROM events)""",
    "log_entries": """log_entries AS (
  SELECT event_id // 10 AS run_id, event_id AS seq, ts,
         CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'critical'
              WHEN 'view' THEN 'warning' ELSE 'info' END AS level,
         (['ingestion', 'transform', 'load', 'remediation'])[cast(user_id % 4 AS integer) + 1] AS stage,
         (['ingestion', 'transform', 'load', 'remediation'])[cast(user_id % 4 AS integer) + 1]
           || ': ' || event_type || ' #' || cast(event_id AS varchar) AS message,
         props AS details
  FROM events)""",
    "oruns": """oruns AS (
  SELECT o_orderkey AS run_id, o_custkey, o_orderdate AS run_start,
         100 + o_orderkey % 900 AS n_rows,
         (o_orderstatus = 'F' AND o_orderkey % 3 = 0) AS ing_failed,
         (NOT (o_orderstatus = 'F' AND o_orderkey % 3 = 0) AND o_orderkey % 7 = 0) AS load_failed,
         (o_custkey % 2 = 0) AS repaired
  FROM orders)""",
    "runs": f"""runs AS (
  SELECT run_id, 'sales_etl' AS pipeline_name,
         ({SCEN})[cast(o_custkey % 8 AS integer) + 1] AS scenario_name,
         run_start AS started_at,
         run_start + to_seconds(cast(30 + run_id % 60 AS bigint)) AS finished_at,
         (ing_failed OR load_failed) AS failure_injected,
         CASE WHEN ing_failed THEN 'schema_drift' WHEN load_failed THEN 'data_quality' END AS failure_type
  FROM oruns)""",
    "stage_results": """stage_results_raw AS (
  SELECT run_id, run_start, 'ingestion' AS stage_name, 1 AS stage_ordinal, 1 AS attempt,
         CASE WHEN ing_failed THEN 'failed' ELSE 'success' END AS status,
         n_rows AS rows_in, CASE WHEN ing_failed THEN 0 ELSE n_rows END AS rows_out,
         CASE WHEN ing_failed THEN 'Schema validation errors — see logs for details' END AS error_message
  FROM oruns
  UNION ALL
  SELECT run_id, run_start, 'transform', 2, 1,
         CASE WHEN ing_failed THEN 'skipped' ELSE 'success' END,
         CASE WHEN ing_failed THEN 0 ELSE n_rows END, CASE WHEN ing_failed THEN 0 ELSE n_rows END,
         NULL
  FROM oruns
  UNION ALL
  SELECT run_id, run_start, 'load', 3, 1,
         CASE WHEN ing_failed THEN 'skipped' WHEN load_failed THEN 'failed' ELSE 'success' END,
         CASE WHEN ing_failed THEN 0 ELSE n_rows END,
         CASE WHEN ing_failed OR load_failed THEN 0 ELSE n_rows END,
         CASE WHEN load_failed THEN 'PK constraint violation: '
              || cast(cast(trunc(n_rows * 15 / 100) AS bigint) AS varchar) || ' duplicate transaction_ids' END
  FROM oruns
  UNION ALL
  SELECT run_id, run_start, 'ingestion', 1, 2, 'success', n_rows, n_rows, NULL
  FROM oruns WHERE ing_failed AND repaired
  UNION ALL
  SELECT run_id, run_start, 'transform', 2, 2, 'success', n_rows, n_rows, NULL
  FROM oruns WHERE ing_failed AND repaired
  UNION ALL
  SELECT run_id, run_start, 'load', 3, 2, 'success', n_rows, n_rows, NULL
  FROM oruns WHERE (ing_failed OR load_failed) AND repaired),
stage_results AS (
  SELECT run_id, stage_name, stage_ordinal, attempt, status, rows_in, rows_out,
         CASE WHEN status <> 'skipped' THEN run_start + to_seconds(cast((attempt - 1) * 600 + (stage_ordinal - 1) * 10 AS bigint)) END AS started_at,
         CASE WHEN status <> 'skipped' THEN run_start + to_seconds(cast((attempt - 1) * 600 + (stage_ordinal - 1) * 10 + 1 + run_id % 9 AS bigint)) END AS finished_at,
         error_message
  FROM stage_results_raw)""",
    "remediations": """remediations AS (
  SELECT run_id, cast(pos - 1 AS bigint) AS seq, action
  FROM (
    SELECT run_id,
           unnest(CASE WHEN ing_failed THEN
                    [CASE WHEN run_id % 2 = 0 THEN 'apply_schema_fix(fix_type_cast)' ELSE 'apply_schema_fix(add_missing_column_default)' END,
                     'rerun_stage(ingestion)',
                     CASE WHEN run_id % 2 = 0 THEN 'apply_schema_fix(fix_type_cast)' ELSE 'apply_schema_fix(add_missing_column_default)' END,
                     'rerun_stage(transform)', 'rerun_stage(load)']
                  ELSE ['deduplicate_records(sales)', 'rerun_stage(transform)',
                        'deduplicate_records(sales)', 'rerun_stage(load)'] END) AS action,
           unnest(CASE WHEN ing_failed THEN [1, 2, 3, 4, 5] ELSE [1, 2, 3, 4] END) AS pos
    FROM oruns WHERE repaired AND (ing_failed OR load_failed)))""",
    "quality_metrics": """quality_metrics AS (
  SELECT run_id, n_rows AS total_rows,
         CASE WHEN o_custkey % 5 = 0 THEN o_custkey % 17 ELSE 0 END AS null_count,
         CASE WHEN load_failed THEN cast(trunc(n_rows * 15 / 100) AS bigint) ELSE 0 END AS duplicate_count,
         CASE WHEN run_id % 97 = 0 THEN 2 ELSE 0 END AS out_of_range_count,
         CASE WHEN ing_failed AND run_id % 2 = 0 THEN 1 ELSE 0 END AS n_schema_violations,
         CASE WHEN ing_failed AND run_id % 2 = 0 THEN 'Missing required column: ''region''' ELSE '' END AS schema_violations_text,
         CASE WHEN ing_failed AND run_id % 2 = 1 THEN 1 ELSE 0 END AS n_type_mismatches,
         CASE WHEN o_custkey % 11 = 0 THEN 1 ELSE 0 END AS n_extra_columns
  FROM oruns)""",
}

DEPENDS = {
    "sales": ["geo"],
    "runs": ["oruns"],
    "stage_results": ["oruns"],
    "remediations": ["oruns"],
    "quality_metrics": ["oruns"],
}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs it needs (dependencies first)."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        return body
    head = "WITH " + ",\n".join(VIEWS[n] for n in order)
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return head + ",\n" + stripped[5:]
    return head + "\n" + body
