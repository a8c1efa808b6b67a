"""Listings, summaries, top resources, filter options, bounds and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numeric import exact_sum, fixed, money, share_pct
from ..schema import DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE, SORT_FIELDS

SUMMARY_FIELDS = {
    "provider": "provider", "service": "service_name", "region": "region", "billing_period": "billing_period",
}


def _page_order(sort_by: str, sort_order: str, ties: list[str]):
    field = sort_by if sort_by in SORT_FIELDS else "usage_start_date"
    first = F.col(field).desc() if sort_order == "desc" else F.col(field).asc()
    return [first, *[F.col(name).asc() for name in ties if name != field]]


def cost_page(
    costs: DataFrame, page: int = 1, page_size: int | None = None,
    sort_by: str = "usage_start_date", sort_order: str = "desc", ties: tuple[str, ...] = ("cost_id",),
) -> DataFrame:
    """One page of one tenant's (filtered) costs, ordered, ties broken by ``ties``."""
    size = min(page_size or DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE)
    return costs.orderBy(*_page_order(sort_by, sort_order, list(ties))).offset((page - 1) * size).limit(size)


def cost_page_per_user(
    costs: DataFrame, page: int = 1, page_size: int | None = None,
    sort_by: str = "usage_start_date", sort_order: str = "desc", ties: tuple[str, ...] = ("cost_id",),
) -> DataFrame:
    """The same page for every tenant, with ``position``.

    Spark keeps only the leading rows of each tenant per partition before the
    shuffle, so a tenant with most of the rows does not end up in one sort.
    """
    size = min(page_size or DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE)
    order = Window.partitionBy("user_id").orderBy(*_page_order(sort_by, sort_order, list(ties)))
    return (
        costs.withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= page * size)
        .where(F.col("position") > (page - 1) * size)
    )


def page_metadata(costs: DataFrame, page: int = 1, page_size: int | None = None) -> DataFrame:
    """Total count and page numbers per tenant."""
    size = min(page_size or DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE)
    pages = F.floor((F.col("total_count") + F.lit(size - 1)) / F.lit(size)).cast("bigint")
    return (
        costs.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_count"))
        .withColumn("page", F.lit(page).cast("bigint"))
        .withColumn("page_size", F.lit(size).cast("bigint"))
        .withColumn("total_pages", pages)
        .withColumn("has_next", F.lit(page) < F.col("total_pages"))
        .withColumn("has_prev", F.lit(page > 1))
    )


def cost_summary(costs: DataFrame, group_by: str = "provider") -> DataFrame:
    """Total, count, average, extremes and share of the tenant's total per group, largest first."""
    field = SUMMARY_FIELDS.get(group_by, "provider")
    groups = costs.groupBy("user_id", F.col(field).alias("name")).agg(
        exact_sum("cost").alias("total"),
        F.count(F.lit(1)).alias("record_count"),
        F.min("cost").alias("low"),
        F.max("cost").alias("high"),
    )
    grand = F.sum("total").over(Window.partitionBy("user_id"))
    return groups.select(
        "user_id",
        "name",
        money("total").alias("total_cost"),
        "record_count",
        fixed(F.col("total").cast("double") / F.col("record_count")).alias("avg_cost"),
        fixed("low").alias("min_cost"),
        fixed("high").alias("max_cost"),
        share_pct(F.col("total"), grand).alias("percentage"),
        money(grand).alias("grand_total"),
    ).orderBy("user_id", F.desc("total_cost"), "name")


def top_resources(costs: DataFrame, limit: int = 10) -> DataFrame:
    """The tenant's most expensive (service, resource, region) combinations."""
    totals = costs.groupBy("user_id", "service_name", "resource_id", "region").agg(
        exact_sum("cost").alias("total"), F.count(F.lit(1)).alias("record_count")
    )
    order = Window.partitionBy("user_id").orderBy(F.desc("total"), "service_name", "resource_id", "region")
    return (
        totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
        .select(
            "user_id", "rank", "service_name",
            F.when(F.col("resource_id").isNull() | (F.col("resource_id") == ""), "N/A")
            .otherwise(F.col("resource_id")).alias("resource_id"),
            "region", money("total").alias("total_cost"), "record_count",
        )
        .orderBy("user_id", "rank")
    )


def filter_options(costs: DataFrame) -> DataFrame:
    """Distinct non-empty filter values as rows (user_id, field, value).

    Rows rather than one array per tenant: a tenant may have any number of accounts.
    """
    fields = {
        "service": "service_name", "region": "region", "account": "cloud_account_id", "provider": "provider",
    }
    combinations = costs.select("user_id", *fields.values()).distinct()
    pairs = F.array(*[
        F.struct(F.lit(field).alias("field"), F.col(column).alias("value")) for field, column in fields.items()
    ])
    return (
        combinations.select("user_id", F.explode(pairs).alias("option"))
        .select("user_id", "option.field", "option.value")
        .where(F.col("value").isNotNull() & (F.col("value") != ""))
        .distinct()
        .orderBy("user_id", "field", "value")
    )


def date_bounds(costs: DataFrame) -> DataFrame:
    """First and last start date and row count per tenant."""
    return costs.groupBy("user_id").agg(
        F.min("usage_start_date").alias("min_date"),
        F.max("usage_start_date").alias("max_date"),
        F.count(F.lit(1)).alias("record_count"),
    )


def total_cost(costs: DataFrame) -> DataFrame:
    """One total per tenant."""
    return costs.groupBy("user_id").agg(exact_sum("cost").alias("total"))


def service_totals(costs: DataFrame) -> DataFrame:
    """One total per tenant and service."""
    return costs.groupBy("user_id", "service_name").agg(exact_sum("cost").alias("total"))


def distinct_values(costs: DataFrame, by: list[str], field: str) -> DataFrame:
    """The distinct values of ``field`` per group, one row each with its record count."""
    return costs.groupBy(*by, field).agg(F.count(F.lit(1)).alias("record_count"))


def distinct_count(costs: DataFrame, by: list[str], field: str) -> DataFrame:
    """Number of distinct values of ``field`` per group."""
    return costs.groupBy(*by).agg(F.countDistinct(field).alias("distinct_count"))


def top_of_totals(totals: DataFrame, limit: int = 5) -> DataFrame:
    """The tenant's ``limit`` most expensive services, from exact partial totals."""
    order = Window.partitionBy("user_id").orderBy(F.desc("total"), "service_name")
    return (
        totals.groupBy("user_id", "service_name").agg(F.sum("total").alias("total"))
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    )


def top_services(costs: DataFrame, limit: int = 5) -> DataFrame:
    """The tenant's ``limit`` most expensive services."""
    return top_of_totals(service_totals(costs), limit)


def costs_of_top_services(costs: DataFrame, limit: int = 5) -> DataFrame:
    """Cost rows of the tenant's most expensive services."""
    return costs.join(top_services(costs, limit).select("user_id", "service_name"), ["user_id", "service_name"], "left_semi")


def totals_of_top_services(costs: DataFrame, by: list[str], limit: int = 5) -> DataFrame:
    """Exact totals and record counts per ``by`` of the tenant's most expensive services.

    One aggregate serves both the choice of the services and their totals, so the costs are
    scanned and shuffled once; the choice also asks for the counts, to keep both uses alike.
    """
    named = costs.where(F.col("user_id").isNotNull() & F.col("service_name").isNotNull())  # the join's own filters, in both uses
    parts = named.groupBy("user_id", "service_name", *by).agg(exact_sum("cost").alias("total"), F.count(F.lit(1)).alias("record_count"))
    sums = parts.groupBy("user_id", "service_name").agg(F.sum("total").alias("all"), F.sum("record_count").alias("records"), *[F.count(c).alias(f"n_{c}") for c in by])
    order = Window.partitionBy("user_id").orderBy(F.desc("all"), "service_name")
    alike = F.col("records") >= 0
    for c in by:
        alike = alike & (F.col(f"n_{c}") >= 0)
    top = sums.where(alike).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("user_id", "service_name")
    return parts.join(top, ["user_id", "service_name"], "left_semi")


def ingest_summary(normalized: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows, distinct categories, date range and total of a normalised ingest."""
    return normalized.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("rows_ingested"),
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"),
        F.date_format(F.min("date"), "yyyy-MM-dd").alias("date_from"),
        F.date_format(F.max("date"), "yyyy-MM-dd").alias("date_to"),
        money(exact_sum("cost")).alias("total_cost"),
    )


def reject_counts(checked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Success and error counts of validated records."""
    return checked.groupBy(*(by or [])).agg(
        F.count(F.when(F.col("error").isNull(), 1)).alias("success_count"),
        F.count("error").alias("error_count"),
    )


def first_errors(checked: DataFrame, row_id: str, limit: int = 10) -> DataFrame:
    """The first rejected records by row id."""
    return checked.where(F.col("error").isNotNull()).select(row_id, "error").orderBy(row_id).limit(limit)
