"""Anomaly rules, storage, listing and status changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import fixed
from .features import RECENT_DAYS

# --- fixed values -----------------------------------------------------------
SPIKE_RATIO = 5.0
DROP_RATIO = 0.15
MIN_COST = 1.0
MIN_DEVIATION_PCT = 25.0
HIGH_DEVIATION_PCT = 100.0
STORED_TYPE = "ml_pattern"
INGEST_TYPE = "ingestion"
RECOMMENDATION = "Investigate anomalous spending pattern detected by ML."
# ----------------------------------------------------------------------------


def with_rule_flag(rows: DataFrame, model_flag: Column, include_drops: bool = False) -> DataFrame:
    """``flagged``: the model says so, or the 7-day ratio is extreme."""
    flagged = model_flag | (F.col("cost_ratio_7") >= SPIKE_RATIO)
    if include_drops:
        flagged = flagged | (F.col("cost_ratio_7") <= DROP_RATIO)
    return rows.withColumn("flagged", flagged)


def reportable(rows: DataFrame, include_drops: bool = False, score: str | None = None, days: int = RECENT_DAYS) -> DataFrame:
    """Flagged rows of the last 7 (or ``days``) days that matter, as anomaly records.

    ``rows`` carries user_id, service_name, category, date, latest, cost,
    rolling_mean_7 and flagged (and provider when drops are included).
    """
    cost, expected = F.col("cost"), F.col("rolling_mean_7")
    deviation = F.when(expected > 0, (cost - expected) / expected * F.lit(100.0)).otherwise(
        F.when(cost > 0, F.lit(100.0)).otherwise(F.lit(0.0))
    )
    size = F.floor(F.abs(F.col("deviation")) + F.lit(0.5)).cast("string")
    if include_drops:
        direction = F.when(cost > expected, F.lit("Spike")).otherwise(F.lit("Drop"))
        message = F.concat(
            direction, F.lit(" detected in "), F.col("category"), F.lit(" ("),
            F.coalesce("provider", F.lit("unknown")), F.lit("): "), size, F.lit("% deviation"),
        )
    else:
        message = F.concat(
            F.lit("Spike detected: based on "), F.col("category"), F.lit(" patterns ("), size, F.lit("% above expected)")
        )
    kept = (
        rows.where(F.col("flagged") & (F.col("date") >= F.date_sub("latest", days)) & (cost >= MIN_COST))
        .withColumn("deviation", deviation)
        .where(F.abs(F.col("deviation")) >= MIN_DEVIATION_PCT)
    )
    if not include_drops:
        kept = kept.where(cost > expected)
    extra = [F.col(score).alias("anomaly_score")] if score else []
    return kept.select(
        "user_id", "service_name",
        cost.alias("detected_value"), expected.alias("expected_value"), expected.alias("threshold"),
        fixed("deviation").alias("deviation_percentage"),
        F.when(F.abs(F.col("deviation")) > HIGH_DEVIATION_PCT, "high").otherwise("medium").alias("severity"),
        *extra,
        message.alias("message"),
        F.col("date").alias("detected_at"),
    )


def purge_decreases(stored: DataFrame) -> DataFrame:
    """Stored anomalies without those whose value does not exceed the expectation."""
    return stored.where(~F.coalesce(F.col("detected_value") <= F.col("expected_value"), F.lit(False)))


def new_anomalies(
    detected: DataFrame, stored: DataFrame, kind: str = STORED_TYPE, match_type: bool = True
) -> DataFrame:
    """Detected anomalies not stored yet for the same tenant, service and day, ready to append.

    Within one run the first of a key stays: the earliest, then the most expensive.
    """
    known = stored.where(F.col("type") == kind) if match_type else stored
    day = F.to_date("detected_at")
    first = Window.partitionBy("user_id", "service_name", day).orderBy("detected_at", F.desc("detected_value"))
    unique = (
        detected.withColumn("__day", day).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    )
    keys = known.select("user_id", "service_name", day.alias("__day")).distinct()
    return (
        unique.join(keys, ["user_id", "service_name", "__day"], "left_anti").drop("__day")
        .withColumn("type", F.lit(kind))
        .withColumn("recommendation", F.lit(RECOMMENDATION if kind == STORED_TYPE else None).cast("string"))
        .withColumn("status", F.lit("new"))
        .withColumn("acknowledged_at", F.lit(None).cast("timestamp_ntz"))
        .withColumn("resolved_at", F.lit(None).cast("timestamp_ntz"))
    )


def list_anomalies(
    stored: DataFrame, status: str | None = None, severity: str | None = None, limit: int = 50
) -> DataFrame:
    """The tenant's newest increases, optionally of one status or severity."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be between 1 and 200")
    rows = stored.where(F.col("detected_value") > F.col("expected_value"))
    if status:
        rows = rows.where(F.col("status") == status)
    if severity:
        rows = rows.where(F.col("severity") == severity)
    newest = Window.partitionBy("user_id").orderBy(F.desc("detected_at"), "service_name")
    return rows.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= limit)


def apply_status(stored: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Stored anomalies after a batch of status changes (keys, status, changed_at).

    The latest change sets the status; the latest acknowledgement and
    resolution set their times.
    """
    def latest(status: str) -> Column:
        return F.max(F.when(F.col("new_status") == status, F.col("changed_at")))

    folded = changes.withColumnRenamed("status", "new_status").groupBy(*keys).agg(
        F.max_by("new_status", F.struct("changed_at", "new_status")).alias("new_status"),
        latest("acknowledged").alias("new_acknowledged"),
        latest("resolved").alias("new_resolved"),
    )
    return (
        stored.join(folded, keys, "left")
        .withColumn("status", F.coalesce("new_status", "status"))
        .withColumn("acknowledged_at", F.coalesce("new_acknowledged", "acknowledged_at"))
        .withColumn("resolved_at", F.coalesce("new_resolved", "resolved_at"))
        .select(stored.columns)
    )
