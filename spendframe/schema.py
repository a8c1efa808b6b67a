"""Table schemas. Dates are naive UTC wall-clock values, hence TIMESTAMP_NTZ."""

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
PROVIDERS = ["AWS", "Azure", "GCP", "Other"]
CURRENCIES = ["USD", "EUR", "GBP", "INR", "JPY", "CNY"]
BUDGET_PERIODS = ["monthly", "quarterly", "annual"]
SCOPE_TYPES = ["global", "service", "resource_group"]
SEVERITIES = ["low", "medium", "high"]
ANOMALY_STATUSES = ["new", "acknowledged", "resolved", "ignored"]
DEFAULT_THRESHOLDS = [50, 80, 100]
DEFAULT_PAGE_SIZE = 50
MAX_PAGE_SIZE = 100
SORT_FIELDS = ["usage_start_date", "usage_end_date", "cost", "service_name", "provider", "created_at"]
REQUIRED_FIELDS = ["provider", "service_name", "cost", "usage_start_date", "usage_end_date"]
# ----------------------------------------------------------------------------

START_MONTH = "start_month"  # mark of a billing_period that its writer derived from usage_start_date

_tags = T.MapType(T.StringType(), T.StringType())

COST_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("provider", T.StringType()),
    T.StructField("cloud_account_id", T.StringType()),
    T.StructField("service_name", T.StringType()),
    T.StructField("resource_id", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("usage_quantity", T.DoubleType()),
    T.StructField("usage_unit", T.StringType()),
    T.StructField("cost", T.DoubleType()),
    T.StructField("currency", T.StringType()),
    T.StructField("usage_start_date", T.TimestampNTZType()),
    T.StructField("usage_end_date", T.TimestampNTZType()),
    T.StructField("billing_period", T.StringType()),
    T.StructField("tags", _tags),
    T.StructField("metadata", _tags),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

ANOMALY_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("service_name", T.StringType()),
    T.StructField("detected_value", T.DoubleType()),
    T.StructField("expected_value", T.DoubleType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("deviation_percentage", T.DoubleType()),
    T.StructField("severity", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("detected_at", T.DateType()),
    T.StructField("type", T.StringType()),
    T.StructField("recommendation", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("acknowledged_at", T.TimestampNTZType()),
    T.StructField("resolved_at", T.TimestampNTZType()),
])

BUDGET_SCHEMA = T.StructType([
    T.StructField("budget_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("period", T.StringType()),
    T.StructField("scope", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("value", T.StringType()),
    ])),
    T.StructField("thresholds", T.ArrayType(T.DoubleType())),
])
