"""Validation and building of cost records, batch corrections and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.parsing import canonical_provider, computed_once, empty_tags, parse_iso, parse_number
from ..schema import CURRENCIES, PROVIDERS, REQUIRED_FIELDS

_TEXT_DEFAULTS = {
    "cloud_account_id": "", "resource_id": "", "region": "us-east-1", "usage_unit": "", "currency": "USD",
}
CORRECTABLE = [
    "provider", "cloud_account_id", "service_name", "resource_id", "region", "usage_quantity", "usage_unit",
    "cost", "currency", "usage_start_date", "usage_end_date", "tags", "metadata",
]


MAX_AMOUNT = 1e18  # of a cost; billions of such rows still have an exact sum


def _is_text(df: DataFrame, name: str) -> bool:
    return name in df.columns and dict(df.dtypes)[name] == "string"


def _number(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("double")
    return parse_number(F.col(name)) if _is_text(df, name) else F.col(name).cast("double")


def _moment(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("timestamp_ntz")
    return parse_iso(F.col(name)) if _is_text(df, name) else F.col(name).cast("timestamp_ntz")


def _present(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(False)
    return F.col(name).isNotNull() & (F.col(name) != "") if _is_text(df, name) else F.col(name).isNotNull()


def with_validation(records: DataFrame) -> DataFrame:
    """Add ``error``: the message of the first failing rule, null for a valid record.

    Number and date fields may be text or typed. Infinite amounts, and others that a sum
    of many rows cannot hold, are not numbers here: one of them would spoil every sum it
    takes part in.
    """
    staged = computed_once(records, {
        "__cost": _number(records, "cost"), "__quantity": _number(records, "usage_quantity"),
        "__start": _moment(records, "usage_start_date"), "__end": _moment(records, "usage_end_date"),
    })
    cost, quantity, start, end = (F.col(name) for name in ("__cost", "__quantity", "__start", "__end"))
    finite = cost.isNotNull() & ~F.isnan(cost) & (F.abs(cost) <= F.lit(MAX_AMOUNT))
    quantity_given = F.col("usage_quantity").isNotNull() if "usage_quantity" in records.columns else F.lit(False)
    currency = F.coalesce(F.col("currency"), F.lit("USD")) if "currency" in records.columns else F.lit("USD")
    name = F.col("service_name") if "service_name" in records.columns else F.lit(None).cast("string")
    provider = F.col("provider") if "provider" in records.columns else F.lit(None).cast("string")

    rules = [(~_present(records, field), f"Field '{field}' is required") for field in REQUIRED_FIELDS]
    rules += [
        (~F.lower(F.trim(provider)).isin([p.lower() for p in PROVIDERS]),
         f"Provider must be one of: {', '.join(PROVIDERS)}"),
        (~finite, "Cost must be a valid number"),
        (cost < 0, "Cost must be greater than or equal to 0"),
        (quantity_given & (quantity.isNull() | F.isnan(quantity)), "Usage quantity must be a valid number"),
        (quantity_given & (quantity < 0), "Usage quantity must be greater than or equal to 0"),
        (start.isNull() | end.isNull(), "Invalid date format. Use ISO 8601 format (YYYY-MM-DDTHH:MM:SS)"),
        (start > end, "usage_start_date must be before or equal to usage_end_date"),
        (~currency.isin(CURRENCIES), f"Currency must be one of: {', '.join(CURRENCIES)}"),
        (F.length(F.trim(name)) < 1, "Service name cannot be empty"),
        (F.length(name) > 200, "Service name is too long (max 200 characters)"),
    ]
    error = F.when(*rules[0])
    for failed, message in rules[1:]:
        error = error.when(failed, message)
    return computed_once(staged, {"error": error}).drop("__cost", "__quantity", "__start", "__end")


def build_records(valid: DataFrame, created_at: str | None = None) -> DataFrame:
    """Valid records in the cost schema: canonical provider, defaults, month of the start date."""
    def text(name: str) -> Column:
        default = F.lit(_TEXT_DEFAULTS[name])
        return F.coalesce(F.col(name), default) if name in valid.columns else default

    def mapping(name: str) -> Column:
        return F.coalesce(F.col(name), empty_tags()) if name in valid.columns else empty_tags()

    start = _moment(valid, "usage_start_date")
    stamp = F.lit(created_at).cast("timestamp_ntz") if created_at else F.current_timestamp().cast("timestamp_ntz")
    passthrough = [F.col(name) for name in ("cost_id", "user_id") if name in valid.columns]
    return valid.select(
        *passthrough,
        canonical_provider(F.col("provider")).alias("provider"),
        text("cloud_account_id").alias("cloud_account_id"),
        F.trim(F.col("service_name")).alias("service_name"),
        text("resource_id").alias("resource_id"),
        text("region").alias("region"),
        F.coalesce(_number(valid, "usage_quantity"), F.lit(0.0)).alias("usage_quantity"),
        text("usage_unit").alias("usage_unit"),
        _number(valid, "cost").alias("cost"),
        text("currency").alias("currency"),
        start.alias("usage_start_date"),
        _moment(valid, "usage_end_date").alias("usage_end_date"),
        F.date_format(start, "yyyy-MM").alias("billing_period"),
        mapping("tags").alias("tags"),
        mapping("metadata").alias("metadata"),
        stamp.alias("created_at"),
        stamp.alias("updated_at"),
    )


def ingest(records: DataFrame, created_at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(cost records, rejects with ``error``)."""
    checked = with_validation(records)
    good = checked.where(F.col("error").isNull()).drop("error")
    return build_records(good, created_at), checked.where(F.col("error").isNotNull())


def normalized_to_records(normalized: DataFrame, user_id: Column, ingested_at: str | None = None) -> DataFrame:
    """(date, category, cost, provider) rows as record fields for :func:`ingest`."""
    category = F.trim(F.col("category"))
    key = F.lower(F.trim(F.col("provider")))
    marks = [F.lit("source"), F.lit("ingestion"), F.lit("aggregation"), F.lit("category_daily")]
    if ingested_at:
        marks += [F.lit("ingested_at"), F.lit(ingested_at)]
    return normalized.select(
        user_id.alias("user_id"),
        F.when(key == "aws", "AWS").when(key == "azure", "Azure").when(key == "gcp", "GCP")
        .otherwise("Other").alias("provider"),
        F.when(category.isNull() | (category == ""), "Other").otherwise(category).alias("service_name"),
        F.col("cost").alias("cost"),
        F.col("date").cast("timestamp_ntz").alias("usage_start_date"),
        F.col("date").cast("timestamp_ntz").alias("usage_end_date"),
        F.lit("global").alias("region"),
        F.create_map(*marks).alias("metadata"),
    )


SUPERSEDED = "Superseded by a later correction of the same record"


def apply_corrections(costs: DataFrame, updates: DataFrame, as_of: str, order_by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, rejected corrections).

    ``updates`` has ``cost_id``, ``user_id`` and any correctable fields; null
    keeps the old value. The merged row is validated again and keeps its old
    values when a rule fails. Of several corrections of one record the latest by
    ``order_by`` counts (ties and a missing column: the greatest by content); the
    others are rejected.
    """
    changed = [name for name in CORRECTABLE if name in updates.columns]
    content = F.to_json(F.struct(*[F.col(name) for name in changed])) if changed else F.lit("")
    latest = [F.col(order_by).desc_nulls_last()] if order_by else []
    ranked = updates.withColumn("__nth", F.row_number().over(Window.partitionBy("cost_id", "user_id").orderBy(*latest, content.desc())))
    extra = ranked.where(F.col("__nth") > 1).select("cost_id", "user_id", F.lit(SUPERSEDED).alias("error"))
    updates = ranked.where(F.col("__nth") == 1)
    renamed = updates.select(
        "cost_id", "user_id", F.lit(True).alias("__hit"), *[F.col(name).alias(f"__new_{name}") for name in changed]
    )
    joined = costs.join(renamed, ["cost_id", "user_id"], "left")
    merged = joined
    for name in changed:
        merged = merged.withColumn(f"__old_{name}", F.col(name)).withColumn(
            name, F.coalesce(F.col(f"__new_{name}").cast(costs.schema[name].dataType), F.col(name))
        )
    checked = with_validation(merged)
    accepted = F.col("__hit") & F.col("error").isNull()
    result = checked
    for name in changed:
        result = result.withColumn(name, F.when(accepted, F.col(name)).otherwise(F.col(f"__old_{name}")))
    if "updated_at" in costs.columns:
        result = result.withColumn(
            "updated_at", F.when(accepted, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("updated_at"))
        )
    result = result.withColumn("billing_period", F.date_format("usage_start_date", "yyyy-MM"))
    rejected = checked.where(F.col("__hit") & F.col("error").isNotNull()).select("cost_id", "user_id", "error")
    return result.select(costs.columns), rejected.unionByName(extra)


def apply_deletes(rows: DataFrame, tombstones: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a matching tombstone; ``keys`` = ids for records or ['user_id'] for whole users."""
    return rows.join(tombstones.select(*keys).distinct(), keys, "left_anti")
