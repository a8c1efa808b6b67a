"""Trends over time: daily, monthly, automatic granularity, shares, running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.category import CATEGORIES, with_category
from ..functions.numeric import carried_max, carried_min, change_pct, exact_sum, fixed, money, ratio, share_pct
from .filters import in_month, last_days, month_bounds, select_costs

BREAKDOWN_FIELDS = {
    "service": "service_name", "region": "region", "account": "cloud_account_id", "provider": "provider",
}
AUTO_DAILY_SPAN = 60
CATEGORY_ALERT_PCT = 40.0


def _day_text(column) -> F.Column:
    return F.date_format(column, "yyyy-MM-dd")


def daily_trend(costs: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Total and record count per tenant and day of the last ``days`` days."""
    return (
        last_days(costs, as_of, days)
        .groupBy("user_id", F.to_date("usage_start_date").alias("day"))
        .agg(exact_sum("cost").alias("total"), F.count(F.lit(1)).alias("record_count"))
        .select("user_id", _day_text("day").alias("date"), money("total").alias("total_cost"), "record_count")
    )


def daily_trend_summary(trend: DataFrame) -> DataFrame:
    """Sum of the rounded days and mean per present day."""
    total = exact_sum("total_cost")
    days = F.count(F.lit(1))
    return trend.groupBy("user_id").agg(
        money(total).alias("total_cost"),
        fixed(total.cast("double") / days).alias("average_daily_cost"),
        days.alias("days_count"),
    )


def monthly_trend(costs: DataFrame, as_of, months: int = 6) -> DataFrame:
    """Total, records and distinct services per month, with the change to the month before."""
    monthly = (
        last_days(costs, as_of, months * 31)
        .groupBy("user_id", F.col("billing_period").alias("month"))
        .agg(
            exact_sum("cost").alias("total"),
            F.count(F.lit(1)).alias("record_count"),
            F.countDistinct("service_name").alias("unique_services"),
        )
        .select("user_id", "month", money("total").alias("total_cost"), "record_count", "unique_services")
    )
    return with_change(monthly, "month")


def with_change(periods: DataFrame, period: str, value: str = "total_cost", first: float | None = None) -> DataFrame:
    """Percent change to the tenant's previous present period.

    Null for the first period; ``first`` replaces the null of later periods
    whose predecessor is not positive.
    """
    before = F.lag(value).over(Window.partitionBy("user_id").orderBy(period))
    change = fixed(change_pct(F.col(value), before))
    if first is not None:
        change = F.when(before.isNotNull(), F.coalesce(change, F.lit(first)))
    return periods.withColumn("change_percentage", change)


def _auto_daily(costs, breakdown_by, granularity, month, latest_month, filters) -> DataFrame:
    """Per tenant, day and item totals with the tenant's chosen period label."""
    item = BREAKDOWN_FIELDS.get(breakdown_by, "service_name")
    bounds = month_bounds(month)
    picked = in_month(select_costs(costs, **(filters or {})), month)
    calendar_month = F.date_format("usage_start_date", "yyyy-MM")
    daily = picked.groupBy(
        "user_id",
        F.to_date("usage_start_date").alias("day"),
        calendar_month.alias("calendar_month"),
        F.coalesce("billing_period", calendar_month).alias("month"),
        F.col(item).alias("item"),
    ).agg(
        exact_sum("cost").alias("total"),
        F.min("usage_start_date").alias("min_date"),
        F.max("usage_start_date").alias("last_start"),
        F.max("usage_end_date").alias("max_date"),
    )
    if latest_month and not month:
        # the latest month comes from all of the tenant's rows, not from the filtered ones
        latest = costs.groupBy("user_id").agg(
            F.date_format(F.max("usage_start_date"), "yyyy-MM").alias("calendar_month")
        )
        daily = daily.join(latest, ["user_id", "calendar_month"], "left_semi")
    if granularity in ("daily", "monthly"):
        label = _day_text("day") if granularity == "daily" else F.col("month")
        return daily.withColumn("period", label)
    rest = [c for c in daily.columns if c not in ("user_id", "min_date", "last_start")]
    span = daily.groupBy("user_id").agg(
        carried_min("min_date", "last_start", *rest).alias("first_start"),
        carried_max("last_start", "min_date", *rest).alias("final_start"),
    ).select(
        "user_id",
        (F.floor((F.unix_micros(F.col("final_start").cast("timestamp")) - F.unix_micros(F.col("first_start").cast("timestamp")))
                 / F.lit(86_400_000_000)) <= AUTO_DAILY_SPAN).alias("by_day"),
    )
    return daily.join(span, "user_id").withColumn(
        "period", F.when(F.col("by_day"), _day_text("day")).otherwise(F.col("month"))
    )


def auto_trend(
    costs: DataFrame, breakdown_by: str = "service", granularity: str | None = None,
    month: str | None = None, latest_month: bool = False, filters: dict | None = None,
) -> DataFrame:
    """Periods with total, date range and change; daily up to a 60-day span, else monthly, per tenant."""
    daily = _auto_daily(costs, breakdown_by, granularity, month, latest_month, filters)
    periods = daily.groupBy("user_id", "period").agg(
        F.sum("total").alias("total"), F.min("min_date").alias("first"), F.max("max_date").alias("last")
    ).select(
        "user_id", "period", money("total").alias("total_cost"),
        _day_text("first").alias("start"), _day_text("last").alias("end"),
    )
    return with_change(periods, "period", first=0.0)


def auto_trend_breakdown(
    costs: DataFrame, breakdown_by: str = "service", granularity: str | None = None,
    month: str | None = None, latest_month: bool = False, filters: dict | None = None,
) -> DataFrame:
    """Cost per period and item, with the item's position inside the period."""
    daily = _auto_daily(costs, breakdown_by, granularity, month, latest_month, filters)
    items = daily.groupBy("user_id", "period", "item").agg(F.sum("total").alias("total"))
    order = Window.partitionBy("user_id", "period").orderBy(F.desc("cost"), "item")
    return (
        items.select("user_id", "period", "item", money("total").alias("cost"))
        .withColumn("position", F.row_number().over(order))
    )


def nest_breakdown(periods: DataFrame, breakdown: DataFrame) -> DataFrame:
    """One row per period with its items as an array, most expensive first.

    An array holds the distinct items of one period; for accounts prefer the
    flat :func:`auto_trend_breakdown`.
    """
    entry = F.struct("position", F.struct(F.col("item").alias("service_name"), "cost").alias("entry"))
    arrays = breakdown.groupBy("user_id", "period").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["entry"]).alias("breakdown")
    )
    return periods.join(arrays, ["user_id", "period"])


def auto_trend_summary(periods: DataFrame) -> DataFrame:
    """Period count, total of the rounded periods and mean per period."""
    total, count = exact_sum("total_cost"), F.count(F.lit(1))
    return periods.groupBy("user_id").agg(
        count.alias("periods_count"),
        money(total).alias("total_cost"),
        fixed(total.cast("double") / count).alias("average_cost"),
    )


def auto_trend_overview(
    costs: DataFrame, breakdown_by: str = "service", granularity: str | None = None,
    month: str | None = None, latest_month: bool = False, filters: dict | None = None,
) -> DataFrame:
    """The summary of a tenant's trend with the dates it spans.

    ``start`` and ``end`` are the first and last start date of the rows that count. With
    ``latest_month`` and no month, ``detected_month`` is the month that was taken and
    ``full_start`` and ``full_end`` span all of the tenant's rows; otherwise they are null.
    """
    daily = _auto_daily(costs, breakdown_by, granularity, month, latest_month, filters)
    periods = daily.groupBy("user_id", "period").agg(
        F.sum("total").alias("total"), F.min("min_date").alias("first"), F.max("last_start").alias("last")
    ).withColumn("total_cost", money("total"))
    total, count = exact_sum("total_cost"), F.count(F.lit(1))
    summary = periods.groupBy("user_id").agg(
        count.alias("periods_count"), money(total).alias("total_cost"), fixed(total.cast("double") / count).alias("average_cost"),
        _day_text(F.min("first")).alias("start"), _day_text(F.max("last")).alias("end"))
    if not latest_month or month:
        nothing = F.lit(None).cast("string")
        return summary.withColumns({"detected_month": nothing, "full_start": nothing, "full_end": nothing})
    whole = costs.groupBy("user_id").agg(F.min("usage_start_date").alias("first"), F.max("usage_start_date").alias("last")).select(
        "user_id", F.date_format("last", "yyyy-MM").alias("detected_month"), _day_text("first").alias("full_start"), _day_text("last").alias("full_end"))
    return summary.join(whole, "user_id")


def item_totals(breakdown: DataFrame) -> DataFrame:
    """Total per item over a trend's breakdown and its share of the tenant's sum, largest first."""
    totals = breakdown.groupBy("user_id", F.col("item").alias("name")).agg(exact_sum("cost").alias("total"))
    whole = F.sum("total").over(Window.partitionBy("user_id"))
    return totals.select(
        "user_id", "name", money("total").alias("cost"), share_pct(F.col("total"), whole, 1).alias("share_pct")
    ).orderBy("user_id", F.desc("cost"), "name")


def month_over_month(costs: DataFrame) -> DataFrame:
    """Change of the tenant's latest calendar month to the present month before; no row below 2 months."""
    months = costs.groupBy("user_id", F.date_format("usage_start_date", "yyyy-MM").alias("month")).agg(
        exact_sum("cost").alias("total")
    )
    by_month = Window.partitionBy("user_id").orderBy(F.desc("month"))
    return (
        months.withColumn("previous", F.lead("total").over(by_month))
        .withColumn("recency", F.row_number().over(by_month))
        .where((F.col("recency") == 1) & (F.col("previous").cast("double") != 0))
        .select(
            "user_id", "month",
            money("total").alias("current_cost"), money("previous").alias("previous_cost"),
            fixed((ratio(F.col("total"), F.col("previous")) - 1) * F.lit(100.0), 1).alias("change_pct"),
            (F.col("total") >= F.col("previous")).alias("is_up"),
        )
    )


def search_services(totals: DataFrame, term: str, name: str = "name") -> DataFrame:
    """Rows whose service name contains the term, ignoring case."""
    return totals.where(F.contains(F.lower(F.col(name)), F.lit(term.lower())))


def service_drilldown(costs: DataFrame, service: str) -> DataFrame:
    """One service per tenant over all of the tenant's months, 0 where it has no cost."""
    wanted = F.col("service_name") == service
    return (
        costs.groupBy("user_id", F.col("billing_period").alias("period"))
        .agg(exact_sum(F.when(wanted, F.col("cost"))).alias("total"))
        .select("user_id", "period", F.lit(service).alias("service_name"),
                F.coalesce(money("total"), F.lit(0.0)).alias("total_cost"))
    )


def month_options(costs: DataFrame) -> DataFrame:
    """Every month between the tenant's first and last cost."""
    bounds = costs.groupBy("user_id").agg(
        F.min("usage_start_date").alias("first"), F.max("usage_start_date").alias("last")
    )
    months = F.sequence(F.trunc("first", "month"), F.trunc("last", "month"), F.expr("interval 1 month"))
    return bounds.select("user_id", F.explode(months).alias("month")).select(
        "user_id", F.date_format("month", "yyyy-MM").alias("value"), F.date_format("month", "MMM yyyy").alias("label")
    )


def cumulative_cost(costs: DataFrame) -> DataFrame:
    """Running total per tenant and service over months."""
    monthly = costs.groupBy("user_id", "service_name", F.col("billing_period").alias("period")).agg(
        exact_sum("cost").alias("total")
    )
    running = Window.partitionBy("user_id", "service_name").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return monthly.select(
        "user_id", "service_name", "period", money("total").alias("cost"),
        money(F.sum("total").over(running)).alias("cumulative_cost"),
    )


def category_daily(costs: DataFrame, month: str) -> DataFrame:
    """Cost per tenant, day and category of a month, with the percent deviation from the 7 days before.

    Reads the month and the 7 days before it; the average is over the days
    with cost among those 7.
    """
    bounds = month_bounds(month)
    if bounds is None:
        raise ValueError(f"month must look like 2026-01, got {month!r}")
    by_service = (
        in_month(costs, month, days_before=7)
        .groupBy("user_id", F.to_date("usage_start_date").alias("day"), "service_name")
        .agg(exact_sum("cost").alias("total"))
    )
    daily = with_category(by_service).groupBy("user_id", "category", "day").agg(F.sum("total").alias("total"))
    week = Window.partitionBy("user_id", "category").orderBy(F.unix_date("day")).rangeBetween(-7, -1)
    mean = F.sum("total").over(week).cast("double") / F.count("total").over(week)
    return (
        daily.withColumn("mean_7", mean)
        .where(F.col("day") >= F.lit(bounds[0]).cast("date"))
        .select(
            "user_id", _day_text("day").alias("date"), "category", money("total").alias("cost"),
            fixed(change_pct(F.col("total"), F.col("mean_7")), 1).alias("dev"),
        )
    )


def category_daily_pivot(daily: DataFrame) -> DataFrame:
    """One row per day, one cost and one ``<category>_dev`` column per category."""
    wide = daily.groupBy("user_id", "date").pivot("category", CATEGORIES).agg(
        F.first("cost").alias("cost"), F.first("dev").alias("dev")
    )
    return wide.select(
        "user_id", "date",
        *[column for label in CATEGORIES for column in (
            F.coalesce(F.col(f"{label}_cost"), F.lit(0.0)).alias(label), F.col(f"{label}_dev"),
        )],
    )


def category_alerts(daily: DataFrame) -> DataFrame:
    """Days on which a category is more than 40 % above its 7-day average."""
    return daily.where(F.col("dev") > CATEGORY_ALERT_PCT).select("user_id", "date", "category", "cost", "dev")
