"""Ticket schema, defaults and vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

_STR, _INT, _DBL, _BOOL, _TS = (
    T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)
_STRS = T.ArrayType(T.StringType())

_FIELDS = {
    _STR: """ticket_id customer_id organization_id agent_id product product_version
        product_module environment category subcategory priority severity
        customer_sentiment business_impact subject description error_logs stack_trace
        resolution feedback_text escalation_reason customer_tier language region channel
        resolution_code resolution_template_used agent_specialization data_split""",
    _TS: "created_at updated_at resolved_at ingested_at",
    _INT: """product_version_age_days previous_tickets account_age_days
        resolution_attempts satisfaction_score agent_experience_months transferred_count
        response_count similar_issues_last_30_days ticket_text_length attachments_count
        affected_users""",
    _DBL: "account_monthly_value resolution_time_hours",
    _BOOL: """resolution_helpful escalated contains_error_code contains_stack_trace
        weekend_ticket after_hours known_issue bug_report_filed
        auto_suggestion_accepted""",
    _STRS: """agent_actions tags related_tickets kb_articles_viewed kb_articles_helpful
        auto_suggested_solutions""",
}

TICKET = T.StructType(
    [T.StructField(n, t) for t, names in _FIELDS.items() for n in names.split()]
)
TICKET_TYPES = {f.name: f.dataType for f in TICKET.fields}

_STR_MAP, _DBL_MAP = T.MapType(_STR, _STR), T.MapType(_STR, _DBL)


def _struct(groups: dict) -> T.StructType:
    return T.StructType([T.StructField(n, t) for t, names in groups.items() for n in names.split()])


SYSTEM_EVENT = _struct({
    _STR: """event_id event_type ticket_id agent_id model_name model_version
        predicted_category retrieval_method corrected_category component status
        error_message""",
    _TS: "timestamp",
    _DBL: "confidence latency_ms top_result_score quality_score",
    _INT: "n_results_returned satisfaction_score",
    _BOOL: "resolution_accepted",
    _DBL_MAP: "quality_dimensions",
    _STR_MAP: "metadata",
})

PREDICTION_LOG = _struct({
    _STR: "ticket_id predicted_category model_name model_version true_category",
    _TS: "timestamp",
    _DBL: "confidence",
    _STR_MAP: "feature_values",
    _BOOL: "was_corrected",
})

SIGNAL_COLUMNS = [
    "signal_type", "severity", "metric_name", "current_value", "reference_value",
    "threshold", "description", "dimensions", "recommended_action",
]

# ---- fixed values: these must equal the specification --------------------------

REQUIRED_COLUMNS = ["ticket_id", "created_at", "category", "description"]

INPUT_DEFAULTS = {
    "previous_tickets": 0,
    "account_age_days": 0,
    "account_monthly_value": 0.0,
    "similar_issues_last_30_days": 0,
    "product_version_age_days": 0,
    "affected_users": 1,
    "attachments_count": 0,
    "response_count": 1,
    "contains_error_code": False,
    "contains_stack_trace": False,
    "weekend_ticket": False,
    "after_hours": False,
    "business_impact": "medium",
}

SENTIMENT_SCORE = {
    "angry": 1.0, "frustrated": 2.0, "anxious": 2.5, "confused": 3.0,
    "neutral": 3.5, "satisfied": 5.0,
}
SENTIMENT_SCORE_OTHER = 3.0

PRIORITY_ADJACENCY = {
    "critical": {"critical": 1.0, "high": 0.7, "medium": 0.3, "low": 0.1},
    "high": {"critical": 0.7, "high": 1.0, "medium": 0.5, "low": 0.2},
    "medium": {"critical": 0.3, "high": 0.5, "medium": 1.0, "low": 0.5},
    "low": {"critical": 0.1, "high": 0.2, "medium": 0.5, "low": 1.0},
}
PRIORITY_ADJACENCY_OTHER = 0.5

SUBCATEGORIES = {
    "Account Management": [
        "Access Control", "Billing", "License", "Subscription", "Upgrade"],
    "Compliance / Security": [
        "Audit Trail", "Authentication", "Compliance", "Data Privacy", "Encryption"],
    "Data Issue": [
        "Corruption", "Data Loss", "Import/Export", "Sync Error", "Validation"],
    "Feature Request": [
        "API Extension", "Integration", "New Feature", "UI Enhancement"],
    "How-To / Guidance": [
        "Best Practice", "Configuration", "Documentation", "Setup Help"],
    "Outage / Downtime": [
        "Degraded Performance", "Full Outage", "Intermittent", "Regional"],
    "Technical Issue": [
        "Crash/Bug", "Error Handling", "Performance", "Scalability"],
}
PRIORITIES = ["critical", "high", "medium", "low"]
SENTIMENTS = ["frustrated", "angry", "neutral", "satisfied", "confused", "grateful"]

DRIFT_FEATURES = [
    "ticket_text_length", "previous_tickets", "account_age_days",
    "account_monthly_value", "similar_issues_last_30_days",
    "product_version_age_days", "affected_users",
]
DRIFT_CATEGORIES = ["product", "customer_tier", "channel", "priority"]

PSI_STEPS = [(0.25, "severe"), (0.2, "moderate"), (0.1, "minor")]
CONFIDENCE_STEPS = [(0.15, "severe"), (0.10, "moderate"), (0.05, "minor")]
CORRECTION_STEPS = [(0.30, "severe"), (0.20, "moderate"), (0.10, "minor")]

SEVERITY_RANK = {
    "severe": 0, "critical": 0,
    "moderate": 1, "warning": 1,
    "minor": 2, "info": 2,
}

CLASSIFIER_CATEGORICAL = [
    "product", "product_module", "customer_tier", "severity", "channel",
    "environment", "region", "business_impact",
]
CLASSIFIER_NUMERIC = [
    "previous_tickets", "account_age_days", "account_monthly_value",
    "similar_issues_last_30_days", "product_version_age_days",
    "ticket_text_length", "affected_users", "attachments_count", "response_count",
]
CLASSIFIER_BOOLEAN = [
    "contains_error_code", "contains_stack_trace", "weekend_ticket", "after_hours",
]
CLASSIFIER_TASKS = {
    "category": "category", "subcategory": "subcategory",
    "priority": "priority", "sentiment": "customer_sentiment",
}

HOURS_CATEGORICAL = ["priority", "severity", "customer_tier", "channel", "product"]
HOURS_NUMERIC = [
    "previous_tickets", "account_age_days", "account_monthly_value",
    "similar_issues_last_30_days", "ticket_text_length", "affected_users",
]
HOURS_BOOLEAN = [
    "contains_error_code", "contains_stack_trace", "weekend_ticket", "after_hours",
]

# ---------------------------------------------------------------------------------


def with_columns(df: DataFrame, names) -> DataFrame:
    """Supply absent ticket columns as typed NULLs."""
    missing = [n for n in names if n not in df.columns]
    return df.withColumns(
        {n: F.lit(None).cast(TICKET_TYPES.get(n, _STR)) for n in missing}
    ) if missing else df


def lookup(mapping: dict, key: Column) -> Column:
    """Literal dictionary lookup, NULL for an unknown key."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def severity_rank(severity: Column) -> Column:
    return F.coalesce(lookup(SEVERITY_RANK, severity), F.lit(3))
