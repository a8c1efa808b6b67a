"""Cost filters shared by the query operators."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import START_MONTH
from .quantiles import grouped_quantile

UNSET = "No Filters Applied"  # fixed value: the interface sends it for "no filter"


def moment(df: DataFrame, value, column: str = "usage_start_date") -> Column:
    """Literal of the column's own type, so the comparison reaches the file scan."""
    return F.lit(str(value)).cast(df.schema[column].dataType)


def _months(df: DataFrame, column: str, first=None, last=None) -> DataFrame:
    """Rows of the months from ``first`` to ``last``, only where the period is the start date's month for certain.

    That is so in frames of the cost table, whose writer derives its partitions; they carry
    the mark of ``START_MONTH``. Any other period may be null or a month of its own and
    bounds nothing.
    """
    if column != "usage_start_date" or "billing_period" not in df.columns or not df.schema["billing_period"].metadata.get(START_MONTH):
        return df
    if first is not None:
        df = df.where(F.col("billing_period") >= str(first)[:7])
    if last is not None:
        df = df.where(F.col("billing_period") <= str(last)[:7])
    return df


def between_dates(df: DataFrame, start=None, end=None, column: str = "usage_start_date") -> DataFrame:
    """Rows with start <= column <= end, either bound optional."""
    if start is not None:
        df = df.where(F.col(column) >= moment(df, start, column))
    if end is not None:
        df = df.where(F.col(column) <= moment(df, end, column))
    return _months(df, column, start, end)


def _half_open(df: DataFrame, first, following, column: str) -> DataFrame:
    """Rows with first <= column < following; both are days."""
    rows = df.where((F.col(column) >= moment(df, first, column)) & (F.col(column) < moment(df, following, column)))
    return _months(rows, column, first, date.fromisoformat(str(following)) - timedelta(days=1))


def last_days(df: DataFrame, as_of, days: int, column: str = "usage_start_date") -> DataFrame:
    """Rows of the ``days`` days up to ``as_of``, both ends included."""
    end = moment(df, as_of, column)
    rows = df.where((F.col(column) >= end - F.make_dt_interval(F.lit(days))) & (F.col(column) <= end))
    return _months(rows, column, date.fromisoformat(str(as_of)[:10]) - timedelta(days=days), as_of)


def in_month(df: DataFrame, month: str | None, column: str = "usage_start_date", days_before: int = 0) -> DataFrame:
    """Rows of one 'yyyy-MM' month and of the days before it, half open; text in any other form filters nothing."""
    bounds = month_bounds(month)
    if bounds is None:
        return df
    return _half_open(df, date.fromisoformat(bounds[0]) - timedelta(days=days_before), bounds[1], column)


def in_year(df: DataFrame, as_of, column: str = "usage_start_date") -> DataFrame:
    """Rows of the calendar year around ``as_of``, half open."""
    year = int(str(as_of)[:4])
    return _half_open(df, f"{year:04d}-01-01", f"{year + 1:04d}-01-01", column)


def month_bounds(month: str | None) -> tuple[str, str] | None:
    """First day of the month and of the next one, null for a bad month."""
    year, dash, number = (month or "").partition("-")
    if not dash or not year.isdigit() or not number.isdigit() or len(year) != 4 or not 1 <= int(number) <= 12:
        return None
    y, m = int(year), int(number)
    return f"{y:04d}-{m:02d}-01", f"{y + m // 12:04d}-{m % 12 + 1:02d}-01"


def select_costs(
    df: DataFrame, start=None, end=None, provider: str | None = None, service: str | None = None,
    region: str | None = None, account: str | None = None, user_id=None,
) -> DataFrame:
    """The listing filter: dates inclusive, service a case-insensitive regex, the rest exact."""
    given = {
        key: value
        for key, value in {"provider": provider, "service": service, "region": region, "account": account}.items()
        if value and value != UNSET
    }
    if user_id is not None:
        df = df.where(F.col("user_id") == user_id)
    df = between_dates(df, start, end)
    if "provider" in given:
        df = df.where(F.col("provider") == given["provider"])
    if "service" in given:
        df = df.where(F.col("service_name").rlike("(?i)" + given["service"]))
    if "region" in given:
        df = df.where(F.col("region") == given["region"])
    if "account" in given:
        df = df.where(F.col("cloud_account_id") == given["account"])
    return df


def select_for_forecast(
    df: DataFrame, service: str | None = None, region: str | None = None,
    environment: str | None = None, resource_group: str | None = None,
) -> DataFrame:
    """The forecast filter: exact service and region, tag values."""
    if service:
        df = df.where(F.col("service_name") == service)
    if region:
        df = df.where(F.col("region") == region)
    if environment:
        df = df.where(F.col("tags")["environment"] == environment)
    if resource_group:
        df = df.where(F.col("tags")["resource_group"] == resource_group)
    return df


def insight_rows(df: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Essential fields of the last days, oldest first."""
    return last_days(df, as_of, days).select(
        "user_id",
        F.date_format("usage_start_date", "yyyy-MM-dd").alias("date"),
        F.coalesce("service_name", F.lit("Unknown")).alias("service"),
        F.coalesce("region", F.lit("unknown")).alias("region"),
        F.coalesce("cost", F.lit(0.0)).alias("cost"),
        F.coalesce("provider", F.lit("Other")).alias("provider"),
        F.coalesce("usage_quantity", F.lit(0.0)).alias("usage_quantity"),
        F.coalesce("usage_unit", F.lit("")).alias("usage_unit"),
    ).orderBy("user_id", "date", "service", "cost")


def legacy_date(usage_start: Column, date_text: Column) -> Column:
    """Start date, else the legacy text date: ISO first, then its first 10 characters."""
    return F.coalesce(
        usage_start.cast("timestamp_ntz"),
        date_text.try_cast("timestamp").cast("timestamp_ntz"),
        F.try_to_timestamp(F.substring(date_text, 1, 10), F.lit("yyyy-MM-dd")).cast("timestamp_ntz"),
    )


def in_environment(df: DataFrame, environment: str) -> DataFrame:
    return df.where(F.col("tags")["environment"] == environment)


def this_month(df: DataFrame, as_of) -> DataFrame:
    return in_month(df, str(as_of)[:7])


def high_cost(df: DataFrame, quantile: float = 0.9) -> DataFrame:
    """Rows at or above the tenant's cost quantile (nearest rank)."""
    threshold = grouped_quantile(df, ["user_id"], "cost", quantile)
    return df.join(threshold, "user_id").where(F.col("cost") >= F.col("quantile_value")).withColumnRenamed("quantile_value", "cost_threshold")
