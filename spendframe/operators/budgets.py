"""Budget validation, period bounds, spend, projection and alerts."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import exact_sum, fixed, money
from ..schema import BUDGET_PERIODS, DEFAULT_THRESHOLDS
from .forecast import forecast, resample

SCOPE = ["user_id", "scope_type", "scope_value"]


def with_budget_validation(requests: DataFrame) -> DataFrame:
    """Defaults filled in, and ``error`` for requests that break a rule."""
    filled = (
        requests.withColumn("period", F.coalesce("period", F.lit("monthly")))
        .withColumn("scope", F.coalesce("scope", F.struct(F.lit("global").alias("type"), F.lit(None).cast("string").alias("value"))))
        .withColumn("thresholds", F.coalesce("thresholds", F.array(*[F.lit(float(t)) for t in DEFAULT_THRESHOLDS])))
    )
    error = (
        F.when(F.col("name").isNull(), "Budget name is required")
        .when(F.col("amount").isNull(), "Budget amount is required")
        .when(F.col("amount") <= 0, "Budget amount must be greater than 0")
        .when(~F.col("period").isin(BUDGET_PERIODS), "Invalid budget period")
    )
    return filled.withColumn("error", error)


def valid_budgets(requests: DataFrame) -> DataFrame:
    return with_budget_validation(requests).where(F.col("error").isNull()).drop("error")


def with_period(budgets: DataFrame, as_of: str) -> DataFrame:
    """Start and end of the budget period around ``as_of`` and the day counts inside it."""
    today = F.lit(str(as_of)[:10]).cast("date")
    unit = {"monthly": "month", "quarterly": "quarter", "annual": "year"}
    months = {"monthly": 1, "quarterly": 3, "annual": 12}

    def per_period(make) -> Column:
        chosen = F.lit(None)
        for period in BUDGET_PERIODS:
            chosen = F.when(F.col("period") == period, make(period)).otherwise(chosen)
        return chosen

    start = per_period(lambda p: F.trunc(today, unit[p]))
    end = per_period(lambda p: F.date_sub(F.add_months(F.trunc(today, unit[p]), months[p]), 1))
    return (
        budgets.withColumn("period_start", start).withColumn("period_end", end)
        .withColumn("days_in_period", F.datediff("period_end", "period_start") + 1)
        .withColumn("days_passed", F.datediff(today, F.col("period_start")) + 1)
        .withColumn("days_remaining", F.col("days_in_period") - F.col("days_passed"))
    )


def _scoped(budgets: DataFrame) -> DataFrame:
    kind = F.coalesce(F.col("scope.type"), F.lit("global"))
    known = kind.isin("service", "resource_group")
    return budgets.withColumn("scope_type", F.when(known, kind).otherwise("global")).withColumn(
        "scope_value", F.when(known, F.coalesce(F.col("scope.value"), F.lit(""))).otherwise("")
    )


def scope_daily(costs: DataFrame) -> DataFrame:
    """Daily totals of every budget scope: the tenant, each service, each resource group.

    Budgets then meet costs in an equi-join on the scope, whatever their
    number; one aggregate per day, service and group feeds all three scopes.
    """
    base = costs.groupBy(
        "user_id", "service_name", F.col("tags")["resource_group"].alias("resource_group"),
        F.to_date("usage_start_date").alias("day"),
    ).agg(exact_sum("cost").alias("total"))

    def scope(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("scope_type"), value.alias("scope_value"))

    scopes = F.array(
        scope("global", F.lit("")), scope("service", F.col("service_name")), scope("resource_group", F.col("resource_group"))
    )
    return (
        base.select("user_id", "day", "total", F.explode(scopes).alias("scope"))
        .where(F.col("scope.scope_value").isNotNull())
        .groupBy("user_id", "scope.scope_type", "scope.scope_value", "day").agg(F.sum("total").alias("total"))
    )


def _known_periods(as_of: str) -> list[tuple[str, str, str, int]]:
    """(period, first day, last day, days left after ``as_of``) of the three periods around ``as_of``."""
    today = date.fromisoformat(str(as_of)[:10])
    quarter = 3 * ((today.month - 1) // 3) + 1
    starts = {"monthly": (today.month, 1), "quarterly": (quarter, 3), "annual": (1, 12)}
    known = []
    for period, (month, length) in starts.items():
        after = date(today.year + (month + length - 1) // 12, (month + length - 1) % 12 + 1, 1)
        last = after - timedelta(days=1)
        known.append((period, str(date(today.year, month, 1)), str(last), (last - today).days))
    return known


def _unfold(df: DataFrame, columns: list[str], structs: list[Column], keys: list[str]) -> DataFrame:
    """One row per struct of every row."""
    return df.select(*keys, F.explode(F.array(*structs)).alias("part")).select(*keys, *[f"part.{c}" for c in columns])


def budget_spend(budgets: DataFrame, daily: DataFrame, as_of: str) -> DataFrame:
    """``actual_spend`` of every budget within its period; 0 without costs.

    At ``as_of`` all budgets of a kind share the same period, so each scope is
    summed once per kind and a budget meets one row, however many budgets and
    days a scope has.
    """
    sums = [
        F.sum(F.when(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")), F.col("total"))).alias(period)
        for period, first, last, _ in _known_periods(as_of)
    ]
    names = [period for period, *_ in _known_periods(as_of)]
    year = _known_periods(as_of)[-1]
    per_scope = (
        daily.where(F.col("day").between(F.lit(year[1]).cast("date"), F.lit(year[2]).cast("date"))).groupBy(*SCOPE).agg(*sums)
    )
    spend = _unfold(per_scope, ["period", "spend"], [
        F.struct(F.lit(name).alias("period"), F.col(name).cast("double").alias("spend")) for name in names
    ], SCOPE)
    return _scoped(budgets).join(spend, [*SCOPE, "period"], "left").withColumn(
        "actual_spend", F.coalesce("spend", F.lit(0.0))
    ).drop("spend")


def budget_projection(spent: DataFrame, daily: DataFrame, as_of: str, model: str = "linear") -> DataFrame:
    """``forecasted_remaining``: forecast of the remaining days under the budget's own scope.

    Each scope that has a budget is forecast once, from its completed days,
    and summed once per kind of period.
    """
    today = date.fromisoformat(str(as_of)[:10])
    history = daily.where(F.col("day") < F.lit(str(today)).cast("date")).join(
        spent.where(F.col("days_remaining") > 0).select(*SCOPE).distinct(), SCOPE, "left_semi"
    )
    known = _known_periods(as_of)
    horizon = max(left for *_, left in known)
    if horizon == 0:  # the last day of the year ends every period
        return spent.withColumn("forecasted_remaining", F.lit(0.0))
    points = resample(history, "daily", keys=SCOPE)
    ahead = forecast(points, horizon, "daily", model, keys=SCOPE, start_after=str(today - timedelta(days=1)))
    per_scope = ahead.groupBy(*SCOPE).agg(*[
        exact_sum(F.when(F.col("step") <= left, F.col("prediction"))).alias(period) for period, _, _, left in known
    ])
    remaining = _unfold(per_scope, ["period", "remaining"], [
        F.struct(F.lit(period).alias("period"), money(period).alias("remaining")) for period, *_ in known
    ], SCOPE)
    return spent.drop("forecasted_remaining").join(remaining, [*SCOPE, "period"], "left").withColumn(
        "forecasted_remaining", F.coalesce("remaining", F.lit(0.0))
    ).drop("remaining")


def budget_status(spent: DataFrame) -> DataFrame:
    """Percentages, remaining amount, alerts and status; without a projection it counts as 0."""
    if "forecasted_remaining" not in spent.columns:
        spent = spent.withColumn("forecasted_remaining", F.lit(0.0))
    amount, actual = F.col("amount"), F.col("actual_spend")
    with_totals = (
        spent.withColumn("total_projected", actual + F.col("forecasted_remaining"))
        .withColumn("consumed", actual / amount * F.lit(100.0))
        .withColumn("reached", F.filter(F.array_sort("thresholds"), lambda t: F.col("consumed") >= t))
    )
    over = F.col("total_projected") > amount
    whole = F.col("reached")
    threshold_text = F.transform(whole, lambda t: F.concat(
        F.lit("Exceeded "),
        F.when(t == F.floor(t), t.cast("bigint").cast("string")).otherwise(t.cast("string")),
        F.lit("% threshold ("), _tenths(F.col("consumed")), F.lit("%)"),
    ))
    breach = F.when(over, F.array(F.concat(
        F.lit("Forecasted to exceed budget by $"), _cents(F.col("total_projected") - amount)
    ))).otherwise(F.array().cast("array<string>"))
    return with_totals.select(
        "budget_id", "user_id", "name", "amount", "period", "scope_type", "scope_value",
        F.date_format("period_start", "yyyy-MM-dd").alias("period_start"),
        F.date_format("period_end", "yyyy-MM-dd").alias("period_end"),
        "days_remaining",
        fixed(actual).alias("actual_spend"), fixed("forecasted_remaining").alias("forecasted_remaining"),
        fixed("total_projected").alias("total_projected"),
        fixed("consumed", 1).alias("pct_consumed"),
        fixed(F.col("total_projected") / amount * F.lit(100.0), 1).alias("pct_projected"),
        fixed(amount - actual).alias("remaining_amount"),
        F.when(F.exists(whole, lambda t: t >= 90), "Critical")
        .when(F.exists(whole, lambda t: t >= 50) | over, "Warning").otherwise("Safe").alias("status"),
        F.concat(threshold_text, breach).alias("alerts"),
    )


def _tenths(value: Column) -> Column:
    n = F.floor(value * F.lit(10.0) + F.lit(0.5)).cast("bigint")
    return F.concat(F.floor(n / F.lit(10)).cast("string"), F.lit("."), (n % 10).cast("string"))


def _cents(value: Column) -> Column:
    n = F.floor(value * F.lit(100.0) + F.lit(0.5)).cast("bigint")
    return F.concat(F.floor(n / F.lit(100)).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))
