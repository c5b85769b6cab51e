"""Fixed values that must equal the monitored system's for results to agree.

Everything in this module is a plain value (names, rates, thresholds,
messages).  Logic lives in the operator modules.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Static exchange rates to USD; unknown or null currency -> 1.0
# ---------------------------------------------------------------------------
FX_RATES = {"USD": 1.0, "EUR": 1.08, "GBP": 1.27, "CAD": 0.74, "AUD": 0.65}
FX_DEFAULT_RATE = 1.0

# ---------------------------------------------------------------------------
# The sales contract column set, in declaration order
# ---------------------------------------------------------------------------
SALES_COLUMNS = [
    "transaction_id", "customer_id", "product_id", "quantity", "unit_price",
    "currency", "transaction_date", "region", "status",
]
# The two dtypes the drift check pins (column -> expected)
DRIFT_TYPES = {"quantity": "int64", "unit_price": "float64"}

# ---------------------------------------------------------------------------
# Declared rule sets per dataset
# (column, type, required, unique, min, max, allowed values)
# ---------------------------------------------------------------------------
SALES_RULES = [
    ("transaction_id", "string", True, True, None, None, None),
    ("customer_id", "string", True, False, None, None, None),
    ("product_id", "string", True, False, None, None, None),
    ("quantity", "integer", True, False, 1.0, 10000.0, None),
    ("unit_price", "float", True, False, 0.01, 100000.0, None),
    ("currency", "string", True, False, None, None, ["USD", "EUR", "GBP", "CAD", "AUD"]),
    ("transaction_date", "date", True, False, None, None, None),
    ("region", "string", True, False, None, None, ["North", "South", "East", "West"]),
    ("status", "string", True, False, None, None, ["completed", "refunded", "pending", "failed"]),
]
CUSTOMER_RULES = [
    ("customer_id", "string", True, True, None, None, None),
    ("name", "string", True, False, None, None, None),
    ("email", "string", True, True, None, None, None),
    ("tier", "string", True, False, None, None, ["bronze", "silver", "gold", "platinum"]),
    ("country", "string", True, False, None, None, None),
    ("signup_date", "date", True, False, None, None, None),
    ("lifetime_value", "float", True, False, 0.0, None, None),
]
PRODUCT_RULES = [
    ("product_id", "string", True, True, None, None, None),
    ("name", "string", True, False, None, None, None),
    ("category", "string", True, False, None, None,
     ["Hardware", "Electronics", "Software", "Consumables", "Accessories", "Services"]),
    ("unit_price", "float", True, False, 0.01, None, None),
    ("cost_price", "float", True, False, 0.0, None, None),
    ("supplier_id", "string", True, False, None, None, None),
    ("stock_quantity", "integer", True, False, 0.0, None, None),
    ("weight_kg", "float", True, False, 0.0, None, None),
    ("is_active", "boolean", True, False, None, None, None),
]

# ---------------------------------------------------------------------------
# Stages, statuses, severities
# ---------------------------------------------------------------------------
STAGES = ["ingestion", "transform", "load"]
STAGE_STATUSES = ["pending", "running", "success", "failed", "skipped", "remediated"]
ERROR_LEVELS = ["error", "critical"]
STATUS_ICONS = {"success": "✓", "failed": "✗", "skipped": "↷",
                "remediated": "⟳", "pending": "?", "running": "►"}

# The eight scenario names, in registry order
SCENARIOS = [
    "healthy", "schema_drift_new_column", "schema_drift_type_change",
    "schema_drift_missing_column", "data_quality_nulls", "data_quality_duplicates",
    "missing_source_file", "pk_constraint_violation",
]

# ---------------------------------------------------------------------------
# History thresholds
# ---------------------------------------------------------------------------
ANOMALY_THRESHOLD = 0.05          # absolute rate delta, strict >
KNOWN_FAILURE_MIN = 2             # occurrences within the look-back
LOOKBACK_HOURS = 24
FAILED_OUTCOMES = ["FAILED", "UNRESOLVED"]
KNOWN_FAILURE_OUTCOMES = ["FAILED", "UNRESOLVED", "RESOLVED"]

# ---------------------------------------------------------------------------
# Recommendation texts, in the order they are emitted
# ---------------------------------------------------------------------------
REC_SCHEMA = "Implement schema version pinning in the ingestion contract."
REC_TYPES = "Add explicit type validation and casting at ingestion boundary."
REC_DUPES = "Enable upstream deduplication or add unique constraint monitoring."
REC_NULLS = "Define and enforce NOT NULL constraints for critical fields."
REC_ARRIVAL = "Implement file arrival SLA checks before pipeline trigger."
REC_NONE = "Continue monitoring. No significant issues detected."

# Enrichment defaults when a customer id has no match
UNKNOWN_NAME = "Unknown"
UNKNOWN_TIER = "unknown"
FILL_DEFAULT = "UNKNOWN"

# Text of the failure messages
MISSING_SOURCE_MSG = "Source file for '{}' not found in data lake."
MISSING_COLUMN_MSG = "Missing required column: '{}'"
SCHEMA_FAIL_MSG = "Schema validation errors — see logs for details"
REVENUE_FAIL_MSG = "Revenue computation failed — unit_price type invalid"

# ---------------------------------------------------------------------------
# Log message texts, in stage order ({} = run-specific value)
# ---------------------------------------------------------------------------
LOG_MESSAGES = {
    "missing_columns": "Schema validation failed: missing columns {}",
    "extra_columns": "Unexpected columns detected: {}",
    "price_type": "Type mismatch: 'unit_price' expected float, got string",
    "null_emails": "Null emails in customer_profiles: {}/{} ({:.1f}%)",
    "duplicates": "Duplicate transaction_ids detected: {} rows",
    "ingestion_done": "Ingestion complete: {} rows loaded",
    "transform_skipped": "Transform skipped — ingestion stage failed",
    "revenue_type": "Cannot compute revenue: unit_price has wrong type",
    "transform_done": "Transform complete: {} records enriched",
    "load_skipped": "Load skipped — transform stage did not succeed",
    "load_done": "Load complete: {} rows written to sales_fact_table",
    "rerun": "Re-running stage: {}",
    "rolled_back": "Stage '{}' rolled back to SKIPPED state",
}

# The pattern that finds the number inside a drifted text price
NUMBER_PATTERN = r"([\d.]+)"

# ---------------------------------------------------------------------------
# Incident report layout, top to bottom
# ---------------------------------------------------------------------------
REPORT_RULE = "=" * 70
REPORT_TITLE = "  ETL PIPELINE INCIDENT REPORT"
REPORT_LABELS = {
    "report_id": "  Report ID : ",
    "generated": "  Generated : ",
    "pipeline": "PIPELINE     : ",
    "run_id": "RUN ID       : ",
    "scenario": "SCENARIO     : ",
    "health": "HEALTH       : ",
    "severity": "SEVERITY     : ",
    "failure_type": "FAILURE TYPE : ",
    "outcome": "OUTCOME      : ",
    "started": "  Started  : ",
    "finished": "  Finished : ",
}
REPORT_SECTIONS = {
    "timeline": "TIMELINE",
    "stages": "STAGE SUMMARY",
    "errors": "ERRORS DETECTED",
    "warnings": "WARNINGS",
    "remediation": "REMEDIATION APPLIED",
    "recommendations": "RECOMMENDATIONS",
}
REPORT_NO_REMEDIATION = "  None required"
REPORT_NO_FAILURE_TYPE = "N/A"
REPORT_BULLET = "  • "
REPORT_WARN_TAG = "WARN"
REPORT_STAGE_WIDTH = 12
REPORT_COUNT_FORMAT = "in=%5d out=%5d"
REPORT_ERR_PREFIX = " | ERR: "

# declared rule sets by dataset name
RULES_BY_DATASET = {"sales": SALES_RULES, "customers": CUSTOMER_RULES, "products": PRODUCT_RULES}
