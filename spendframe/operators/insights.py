"""Period comparison and dashboard insights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.category import with_category
from ..functions.numeric import change_pct, exact_sum, fixed, money, share_pct
from .filters import between_dates, moment


def _two_periods(costs: DataFrame, current: tuple, previous: tuple) -> DataFrame:
    """Per tenant and service: exact totals of both periods from one scan."""
    start = F.col("usage_start_date")
    in_current = start.between(moment(costs, current[0]), moment(costs, current[1]))
    in_previous = start.between(moment(costs, previous[0]), moment(costs, previous[1]))
    earliest = min(str(current[0]), str(previous[0]))
    latest = max(str(current[1]), str(previous[1]))
    zero = F.lit(0).cast("decimal(38,8)")
    return (
        between_dates(costs, earliest, latest).where(in_current | in_previous)
        .groupBy("user_id", "service_name")
        .agg(
            F.coalesce(exact_sum(F.when(in_current, F.col("cost"))), zero).alias("current"),
            F.coalesce(exact_sum(F.when(in_previous, F.col("cost"))), zero).alias("previous"),
        )
    )


def _compared(pairs: DataFrame) -> DataFrame:
    change = F.coalesce(
        change_pct(F.col("current"), F.col("previous")), F.when(F.col("current") > 0, F.lit(100.0)), F.lit(0.0)
    )
    return pairs.withColumn("change", change)


def compare_periods(costs: DataFrame, current: tuple, previous: tuple) -> DataFrame:
    """Per service: both totals, difference, change and status, largest difference first.

    A service that is missing in one period counts as 0 there; a new one has 100 % change.
    """
    return (
        _compared(_two_periods(costs, current, previous))
        .select(
            "user_id", "service_name",
            money("current").alias("current_cost"),
            money("previous").alias("previous_cost"),
            money(F.col("current") - F.col("previous")).alias("difference"),
            fixed("change").alias("change_percentage"),
            F.when(F.col("change") > 0, "increased").when(F.col("change") < 0, "decreased")
            .otherwise("stable").alias("status"),
        )
        .orderBy("user_id", F.desc(F.abs("difference")), "service_name")
    )


def join_periods(current: DataFrame, previous: DataFrame) -> DataFrame:
    """The same pairs from two separate cost frames: full outer join of their service totals."""
    def totals(frame: DataFrame, name: str) -> DataFrame:
        return frame.groupBy("user_id", "service_name").agg(exact_sum("cost").alias(name))

    return totals(current, "current").join(totals(previous, "previous"), ["user_id", "service_name"], "full_outer").select(
        "user_id", "service_name",
        F.coalesce(money("current"), F.lit(0.0)).alias("current_cost"),
        F.coalesce(money("previous"), F.lit(0.0)).alias("previous_cost"),
    )


def comparison_totals(costs: DataFrame, current: tuple, previous: tuple) -> DataFrame:
    """Totals of both periods per tenant; the change is 0 when nothing was spent before."""
    totals = _two_periods(costs, current, previous).groupBy("user_id").agg(
        F.sum("current").alias("current"), F.sum("previous").alias("previous")
    )
    return totals.select(
        "user_id",
        money("current").alias("current_total"),
        money("previous").alias("previous_total"),
        money(F.col("current") - F.col("previous")).alias("total_difference"),
        F.coalesce(fixed(change_pct(F.col("current"), F.col("previous"))), F.lit(0.0)).alias("total_change_percentage"),
    )


def trailing_windows(as_of: str, days: int = 30) -> tuple[tuple[str, str], tuple[str, str]]:
    """(current, previous): the ``days`` calendar days up to the day of ``as_of`` and the ``days`` before."""
    from datetime import date, timedelta

    last = date.fromisoformat(str(as_of)[:10])
    first = last - timedelta(days=days - 1)
    end = "23:59:59.999999"
    return (
        (f"{first}", f"{last} {end}"),
        (f"{first - timedelta(days=days)}", f"{first - timedelta(days=1)} {end}"),
    )


def spend_change(costs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Spend of the last ``days`` days against the ``days`` before."""
    totals = comparison_totals(costs, *trailing_windows(as_of, days))
    return totals.select(
        "user_id", F.col("current_total").alias("current_period"), F.col("previous_total").alias("previous_period"),
        F.col("total_change_percentage").alias("change_pct"),
    )


def top_driver(costs: DataFrame) -> DataFrame:
    """The tenant's most expensive service and its share of the total."""
    totals = costs.groupBy("user_id", "service_name").agg(exact_sum("cost").alias("total"))
    order = Window.partitionBy("user_id").orderBy(F.desc("total"), "service_name")
    return (
        totals.withColumn("grand", F.sum("total").over(Window.partitionBy("user_id")))
        .withColumn("rank", F.row_number().over(order)).where("rank = 1")
        .select("user_id", F.col("service_name").alias("service"), money("total").alias("cost"),
                share_pct(F.col("total"), F.col("grand"), 1).alias("percentage"))
    )


def fastest_growing(costs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """The service with the largest growth among those with cost in the window before."""
    pairs = _two_periods(costs, *trailing_windows(as_of, days)).where(F.col("previous") > 0)
    grown = pairs.withColumn("growth", change_pct(F.col("current"), F.col("previous")))
    order = Window.partitionBy("user_id").orderBy(F.desc("growth"), "service_name")
    return (
        grown.withColumn("rank", F.row_number().over(order)).where("rank = 1")
        .select("user_id", F.col("service_name").alias("service"), fixed("growth", 1).alias("growth_pct"))
    )


def category_distribution(costs: DataFrame) -> DataFrame:
    """Cost per tenant and category, with its share."""
    by_service = costs.groupBy("user_id", "service_name").agg(exact_sum("cost").alias("total"))
    by_category = with_category(by_service).groupBy("user_id", "category").agg(F.sum("total").alias("total"))
    whole = F.sum("total").over(Window.partitionBy("user_id"))
    return by_category.select(
        "user_id", "category", money("total").alias("cost"), share_pct(F.col("total"), whole, 1).alias("percentage")
    )


def anomaly_count(anomalies: DataFrame) -> DataFrame:
    """Number of listed anomalies (increases) per tenant."""
    return anomalies.where(F.col("detected_value") > F.col("expected_value")).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("anomaly_count")
    )
