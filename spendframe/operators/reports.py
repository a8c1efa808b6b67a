"""Report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.category import with_category
from ..functions.numeric import exact_sum, fixed, money, share_pct
from ..session import cut_lineage
from .filters import in_month, last_days

TOTAL = "TOTAL"


def monthly_detail(costs: DataFrame, month: str) -> DataFrame:
    """Cost rows of a month in date order, followed by the tenant's TOTAL row.

    The month's rows are written once, with the columns of the report only: the detail and
    the totals both read them there.
    """
    rows = cut_lineage(in_month(costs, month).select(
        "user_id", "usage_start_date", "service_name", "region", "cost", "currency", "provider", "resource_id"))
    detail = with_category(rows).select(
        "user_id", F.lit(0).alias("section"), F.date_format("usage_start_date", "yyyy-MM-dd").alias("date"),
        "service_name", "category", "region", fixed("cost").alias("cost"),
        F.coalesce("currency", F.lit("USD")).alias("currency"), "provider", "resource_id",
    )
    blank = F.lit("")
    total = rows.groupBy("user_id").agg(exact_sum("cost").alias("total")).select(
        "user_id", F.lit(1).alias("section"), F.lit(TOTAL).alias("date"), blank.alias("service_name"),
        blank.alias("category"), blank.alias("region"), money("total").alias("cost"), blank.alias("currency"),
        blank.alias("provider"), blank.alias("resource_id"),
    )
    return detail.unionByName(total).orderBy("user_id", "section", "date", "service_name", "resource_id", "cost")


def utilisation(costs: DataFrame) -> DataFrame:
    """Total, records and average per service and category, largest first, then the tenant's TOTAL row."""
    by_service = with_category(
        costs.groupBy("user_id", "service_name").agg(
            exact_sum("cost").alias("total"), F.count(F.lit(1)).alias("record_count"), F.min("provider").alias("provider")
        )
    )
    grouped = by_service.withColumn(
        "level", F.explode(F.array(F.lit(0), F.lit(1)))
    ).groupBy(
        "user_id", F.col("level").alias("section"),
        F.when(F.col("level") == 0, F.col("service_name")).otherwise(TOTAL).alias("service_name"),
        F.when(F.col("level") == 0, F.col("category")).otherwise("").alias("category"),
        F.when(F.col("level") == 0, F.col("provider")).otherwise("").alias("provider"),
    ).agg(F.sum("total").alias("total"), F.sum("record_count").alias("record_count"))
    return grouped.select(
        "user_id", "section", "service_name", "category", "provider", money("total").alias("total_cost"), "record_count",
        F.when(F.col("section") == 0, fixed(F.col("total").cast("double") / F.col("record_count"))).alias("average_cost"),
    ).orderBy("user_id", "section", F.desc("total_cost"), "service_name")


def anomaly_log(anomalies: DataFrame) -> DataFrame:
    """Anomalies newest first, with fallbacks for older field names and missing values."""
    def first(*names: str, default):
        return F.coalesce(*[F.col(n) for n in names if n in anomalies.columns], F.lit(default))

    day = F.date_format("detected_at", "yyyy-MM-dd")
    return (
        with_category(anomalies, out="mapped_category")
        .withColumn("category", F.coalesce(F.nullif("category", F.lit("")), "mapped_category") if "category" in anomalies.columns else F.col("mapped_category"))
        .select(
            "user_id", day.alias("detected_at"),
            (F.coalesce(F.date_format("date", "yyyy-MM-dd"), day) if "date" in anomalies.columns else day).alias("date"),
            "service_name", "category",
            fixed(first("detected_value", "actual_cost", "cost", default=0.0)).alias("actual_cost"),
            fixed(first("expected_value", "expected_cost", default=0.0)).alias("expected_cost"),
            fixed(first("deviation_percentage", default=0.0), 1).alias("deviation_pct"),
            first("severity", default="medium").alias("severity"),
            first("status", default="new").alias("status"),
        )
        .orderBy("user_id", F.desc("detected_at"), "service_name")
    )


def executive_overview(costs: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Last 90 days: one total row, one row per provider and one per category, with their shares."""
    base = with_category(
        last_days(costs, as_of, days).groupBy("user_id", "provider", "service_name").agg(
            exact_sum("cost").alias("total"), F.count(F.lit(1)).alias("record_count")
        )
    )
    sections = F.array(
        F.struct(F.lit("total").alias("section"), F.lit(TOTAL).alias("name")),
        F.struct(F.lit("provider").alias("section"), F.col("provider").alias("name")),
        F.struct(F.lit("category").alias("section"), F.col("category").alias("name")),
    )
    grouped = (
        base.select("user_id", "total", "record_count", F.explode(sections).alias("part"))
        .groupBy("user_id", "part.section", "part.name")
        .agg(F.sum("total").alias("total"), F.sum("record_count").alias("record_count"))
    )
    whole = F.max(F.when(F.col("section") == "total", F.col("total"))).over(Window.partitionBy("user_id"))
    return grouped.select(
        "user_id", "section", "name", money("total").alias("total_cost"), "record_count",
        share_pct(F.col("total"), whole, 1).alias("percentage"),
    ).orderBy("user_id", F.desc("section"), F.desc("total_cost"), "name")
