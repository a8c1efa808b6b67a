"""Cost forecasts: resampling, two models, summaries and backtests.

Cost rows are reduced to one value per series and calendar bucket first. The linear
model is fitted by grouped sums; an additive fit sees one series, which the calendar bounds.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import exact_sum, fixed, ratio
from . import linear_model
from .summaries import top_of_totals

ALL_SERVICES = "__all__"
SERIES = ["user_id", "series"]
# --- fixed values -----------------------------------------------------------
FREQUENCY = {"daily": "D", "weekly": "W", "monthly": "M"}
SEASON_DAYS = {"D": 7.0, "W": 52.0, "M": 12.0}
UNIT_LABEL = {"daily": "Day", "weekly": "Week", "monthly": "Month"}
CLIP_MIN_POINTS = 10
INTERVAL_FACTOR = 1.64
TREND_BAND = 0.05
CHANGEPOINT_SCALE = 0.05
MONTH_PERIOD, MONTH_ORDER = 30.5, 5
WEEK_PERIOD, WEEK_ORDER = 7.0, 3
# ----------------------------------------------------------------------------
CHANGEPOINTS, CHANGEPOINT_RANGE = 25, 0.8
INTERVAL_WIDTH = 0.80


def forecast_series(costs: DataFrame, top: int | None = None) -> DataFrame:
    """Exact daily totals of each tenant over all services and per service (or its ``top`` services)."""
    daily = costs.groupBy("user_id", "service_name", F.to_date("usage_start_date").alias("day")).agg(
        exact_sum("cost").alias("total")
    ).where(F.col("user_id").isNotNull() & F.col("day").isNotNull())
    # a row without a service counts in the tenant's total and has no series of its own
    series = F.explode(F.array_compact(F.array(F.lit(ALL_SERVICES), F.col("service_name"))))
    both = daily.select("user_id", series.alias("series"), "day", "total")
    both = both.groupBy("user_id", "series", "day").agg(F.sum("total").alias("total"))
    if top is None:
        return both
    kept = top_of_totals(daily.where(F.col("service_name").isNotNull()), top).select("user_id", F.col("service_name").alias("series"))
    overall = both.where(F.col("series") == ALL_SERVICES)
    return overall.unionByName(both.where(F.col("series") != ALL_SERVICES).join(kept, SERIES, "left_semi"))


def bucket_label(day: Column, granularity: str) -> Column:
    """Day itself, the Sunday that ends its week, or the last day of its month."""
    if granularity == "weekly":
        return F.date_add(day, 6 - F.weekday(day))
    if granularity == "monthly":
        return F.last_day(day)
    return day


def resample(series: DataFrame, granularity: str = "daily", as_of: str | None = None, keys: list[str] = SERIES) -> DataFrame:
    """Calendar buckets from first to last, 0 for gaps, as (keys, date, cost).

    With ``as_of`` the last daily bucket is left out when that day is not over.
    Series with fewer than 2 buckets are left out. Every bucket fills the gap up
    to the next one itself, so no calendar is joined and the input is read once.
    """
    sums = series.groupBy(*keys, bucket_label(F.col("day"), granularity).alias("date")).agg(F.sum("total").alias("total"))
    whole = Window.partitionBy(*keys)
    following = F.lead("date").over(whole.orderBy("date"))
    first, last = F.min("date").over(whole), F.max("date").over(whole)
    if granularity == "monthly":
        begin, end = F.trunc("date", "month"), F.add_months(F.trunc("following", "month"), -1)
        run = F.transform(F.sequence(begin, F.coalesce(end, begin), F.expr("interval 1 month")), F.last_day)
        buckets = F.months_between(F.trunc("last", "month"), F.trunc("first", "month")).cast("int") + 1
    else:
        days = 7 if granularity == "weekly" else 1
        end = F.coalesce(F.date_sub("following", days), F.col("date"))
        run = F.sequence(F.col("date"), end, F.expr(f"interval {days} day"))
        buckets = F.floor(F.datediff("last", "first") / F.lit(days)).cast("int") + 1
    filled = (
        sums.where(F.col("date").isNotNull())
        .withColumns({"following": following, "first": first, "last": last})
        .select(*keys, "total", "last", buckets.alias("buckets"), F.posexplode(run).alias("gap", "bucket"))
    )
    if as_of is not None and granularity == "daily":
        unfinished = (F.col("last") >= F.lit(str(as_of)[:10]).cast("date")) & (F.col("buckets") > 1)
        filled = filled.where(~(unfinished & (F.col("bucket") == F.col("last")))).withColumn(
            "buckets", F.col("buckets") - F.when(unfinished, 1).otherwise(0)
        )
    cost = F.when(F.col("gap") == 0, F.col("total").cast("double")).otherwise(F.lit(0.0))
    return filled.where(F.col("buckets") >= 2).select(*keys, F.col("bucket").alias("date"), cost.alias("cost"))


def clip_outliers(points: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """``clipped``: cost within 1.5 interquartile ranges of the quartiles, for series of 10 points or more."""
    quartiles = points.groupBy(*keys).agg(
        F.percentile("cost", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.count(F.lit(1)).alias("points")
    )
    low, high = F.col("q")[0], F.col("q")[1]
    spread = (high - low) * F.lit(1.5)
    bounded = F.greatest(F.least(F.col("cost"), high + spread), low - spread)
    return points.join(quartiles, keys).select(
        *keys, "date", "cost",
        F.when(F.col("points") >= CLIP_MIN_POINTS, bounded).otherwise(F.col("cost")).alias("clipped"),
    )


TERMS = ["t", "t2", "sin1", "cos1", "sin2", "cos2"]


def time_features(points: DataFrame, granularity: str, keys: list[str] = SERIES) -> DataFrame:
    """Days since the series start, their square and two seasonal waves.

    The start is the row's ``series_start`` if there is such a column, else the series' first date.
    """
    period = F.lit(SEASON_DAYS[FREQUENCY[granularity]])
    start = F.col("series_start") if "series_start" in points.columns else F.min("date").over(Window.partitionBy(*keys))
    return points.withColumn("t", F.datediff("date", start).cast("double")).select(
        "*", (F.col("t") * F.col("t")).alias("t2"),
        F.sin(F.lit(2 * np.pi) * F.col("t") / period).alias("sin1"),
        F.cos(F.lit(2 * np.pi) * F.col("t") / period).alias("cos1"),
        F.sin(F.lit(4 * np.pi) * F.col("t") / period).alias("sin2"),
        F.cos(F.lit(4 * np.pi) * F.col("t") / period).alias("cos2"),
    )


def future_dates(points: DataFrame, granularity: str, periods: int, keys: list[str] = SERIES, start_after: str | None = None) -> DataFrame:
    """The ``periods`` buckets after the last one, or after ``start_after`` if that is later, with their ``step`` from 1 and the ``series_start``."""
    last = points.groupBy(*keys).agg(F.max("date").alias("last"), F.min("date").alias("series_start"))
    if start_after is not None:
        last = last.withColumn("last", F.greatest("last", F.lit(str(start_after)).cast("date")))
    step = F.col("step")
    day = {
        "daily": F.date_add("last", step),
        "weekly": F.date_add("last", step * 7),
        "monthly": F.last_day(F.add_months(F.date_add("last", 1), step - 1)),
    }[granularity]
    return last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods)))).select(*keys, "step", day.alias("date"), "series_start")


def history_output(points: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    return points.select(*keys, F.date_format("date", "yyyy-MM-dd").alias("date"), fixed("cost").alias("actual_cost"))


def _waves(t: np.ndarray, period: float, order: int) -> np.ndarray:
    angles = 2 * np.pi * np.outer(t, np.arange(1, order + 1)) / period
    return np.hstack([np.sin(angles), np.cos(angles)])


def linear_forecast(
    points: DataFrame, periods: int, granularity: str, keys: list[str] = SERIES, start_after: str | None = None,
) -> DataFrame:
    """Least squares on clipped costs: trend, its square and seasonal waves; minimum-norm when the series is short.

    Expressions and grouped sums only. The points are read for the sums, the residuals and
    the dates ahead, so cut their lineage first if they are costly.
    """
    rows = time_features(clip_outliers(points, keys), granularity, keys)
    fits = linear_model.fit(rows, keys, TERMS, "clipped", "date")
    fitted = rows.join(fits, keys).withColumn("residual", F.col("clipped") - linear_model.predicted(TERMS))
    share = F.when(F.abs("clipped") > 1e-6, F.abs(F.col("residual") / F.col("clipped")))
    quality = fitted.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) > 2, F.stddev_pop("residual")).otherwise(0.0).alias("spread"),
        (F.coalesce(F.avg(share), F.lit(1.0)) * 100.0).alias("error"))
    ahead = time_features(future_dates(points, granularity, periods, keys, start_after), granularity, keys)
    found = ahead.join(fits, keys).join(quality, keys).withColumn("value", F.greatest(F.lit(0.0), linear_model.predicted(TERMS)))
    margin = F.lit(INTERVAL_FACTOR) * F.col("spread") * F.sqrt(1 + F.col("step") / F.col("points"))
    return found.select(
        *keys, F.col("step").cast("int").alias("step"), "date", F.col("value").alias("prediction"),
        F.greatest(F.lit(0.0), F.col("value") - margin).alias("lower"), (F.col("value") + margin).alias("upper"),
        fixed("value").alias("trend_value"), F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 - F.col("error"))).alias("confidence"))


def additive_fit(
    dates: pd.Series, cost: np.ndarray, freq: str, future: pd.Series, seed: int,
    width: float = INTERVAL_WIDTH, simulations: int = 300,
) -> dict:
    """Piecewise-linear trend plus seasonality (Taylor, Letham 2018), fitted by reweighted least squares.

    The Laplace prior on slope changes becomes a quadratic one whose weights
    follow the current changes. Bounds come from simulated future slope
    changes and residual noise.
    """
    y = np.asarray(cost, dtype=float)
    scale = max(float(np.abs(y).max()), 1e-9)
    z = y / scale
    origin = dates.iloc[0]
    days = np.asarray((pd.DatetimeIndex(dates) - origin).days, dtype=float)
    ahead = np.asarray((pd.DatetimeIndex(future) - origin).days, dtype=float)
    span = max(days[-1], 1.0)
    count = max(0, min(CHANGEPOINTS, int(np.floor(len(z) * CHANGEPOINT_RANGE)) - 1))
    places = np.linspace(0, int(np.floor(len(z) * CHANGEPOINT_RANGE)) - 1, count + 1).round().astype(int)[1:]
    knots = days[places] / span if count else np.zeros(0)

    def trend_basis(t: np.ndarray) -> np.ndarray:
        unit = t / span
        return np.column_stack([np.ones_like(unit), unit, np.maximum(0.0, unit[:, None] - knots[None, :])])

    def season_basis(t: np.ndarray) -> np.ndarray:
        blocks = [_waves(t, WEEK_PERIOD, WEEK_ORDER)]
        if freq == "D":
            blocks.append(_waves(t, MONTH_PERIOD, MONTH_ORDER))
        return np.hstack(blocks)

    x = np.hstack([trend_basis(days), season_basis(days)])
    slopes = slice(2, 2 + count)
    penalty = np.full(x.shape[1], 1.0 / 100.0)
    penalty[:2] = 1.0 / 25.0
    noise, beta = 0.1, np.zeros(x.shape[1])
    for _ in range(30):
        penalty[slopes] = 1.0 / (CHANGEPOINT_SCALE * np.maximum(np.abs(beta[slopes]), 1e-4))
        updated = np.linalg.solve(x.T @ x / noise**2 + np.diag(penalty), x.T @ z / noise**2)
        noise = max(float(np.sqrt(np.mean((z - x @ updated) ** 2))), 1e-4)
        settled = np.max(np.abs(updated - beta)) < 1e-7
        beta = updated
        if settled:
            break
    trend = trend_basis(ahead) @ beta[: 2 + count]
    centre = trend + season_basis(ahead) @ beta[2 + count:]

    rng = np.random.default_rng(seed)
    change = float(np.mean(np.abs(beta[slopes]))) if count else 0.0
    unit = ahead / span
    steps = np.diff(np.concatenate([[1.0], unit]))
    occurs = rng.random((simulations, len(unit))) < np.clip(count * steps, 0.0, 1.0)
    slope = np.cumsum(occurs * rng.laplace(0.0, max(change, 1e-12), occurs.shape), axis=1)
    paths = centre + np.cumsum(slope * steps, axis=1) + rng.normal(0.0, noise, occurs.shape)
    lower, upper = np.quantile(paths, [(1 - width) / 2, (1 + width) / 2], axis=0)
    yhat = centre * scale
    confidence = 100.0 - float(np.mean(upper - lower)) * scale / max(float(yhat.mean()), 1.0) * 50.0
    return {
        "predicted": np.maximum(0.0, yhat), "lower": np.maximum(0.0, lower * scale),
        "upper": np.maximum(0.0, upper * scale), "trend_value": trend * scale,
        "confidence": float(np.clip(confidence, 0.0, 100.0)),
    }


def forecast(
    points: DataFrame, periods: int, granularity: str = "daily", model: str = "linear",
    keys: list[str] = SERIES, start_after: str | None = None, interval_width: float = INTERVAL_WIDTH, seed: int = 42,
) -> DataFrame:
    """Forecast of every series: (keys, step, date, prediction, lower, upper, trend_value, confidence).

    Predictions start after the last point, or after ``start_after`` if that is
    later. Values are unrounded; see :func:`forecast_output`.
    """
    if model not in ("linear", "additive"):
        raise ValueError("model is 'linear' or 'additive'")
    if model == "linear":
        return linear_forecast(points, periods, granularity, keys, start_after)
    freq = FREQUENCY[granularity]
    key_types = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys)
    schema = (
        f"{key_types}, step int, date date, prediction double, lower double, upper double, "
        "trend_value double, confidence double"
    )

    def fit(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("date")
        past, ahead = series[series["step"].isna()], series[series["step"].notna()]
        name = "|".join(str(series[k].iloc[0]) for k in keys)
        fitted = additive_fit(
            pd.to_datetime(past["date"]).reset_index(drop=True), past["cost"].to_numpy(dtype=float), freq,
            pd.to_datetime(ahead["date"]), zlib.crc32(name.encode()) ^ seed, interval_width)
        return pd.DataFrame({
            **{k: ahead[k].to_numpy() for k in keys},
            "step": ahead["step"].to_numpy(dtype=np.int32), "date": ahead["date"].to_numpy(),
            "prediction": fitted["predicted"], "lower": fitted["lower"], "upper": fitted["upper"],
            "trend_value": fitted["trend_value"], "confidence": fitted["confidence"],
        })

    past = points.select(*keys, "date", "cost", F.lit(None).cast("int").alias("step"))
    ahead = future_dates(points, granularity, periods, keys, start_after).select(*keys, "date", F.lit(None).cast("double").alias("cost"), "step")
    return past.unionByName(ahead).groupBy(*keys).applyInPandas(fit, schema)


def forecast_output(predictions: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Rounded forecast points."""
    return predictions.select(
        *keys, F.date_format("date", "yyyy-MM-dd").alias("date"),
        fixed("prediction").alias("predicted_cost"), fixed("lower").alias("lower_bound"), fixed("upper").alias("upper_bound"),
    )


def forecast_totals(predictions: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Total, trend label and confidence of every series."""
    first, last = F.min_by("trend_value", "step"), F.max_by("trend_value", "step")
    return (
        predictions.groupBy(*keys)
        .agg(
            fixed(exact_sum("prediction")).alias("total_predicted_cost"),
            first.alias("first"), last.alias("last"), F.count(F.lit(1)).alias("periods"),
            fixed(F.first("confidence"), 1).alias("confidence_score"),
        )
        .withColumn("trend", trend_label(F.col("first"), F.col("last")))
        .drop("first", "last")
    )


def trend_label(first: Column, last: Column) -> Column:
    """Direction between the first and the last value, stable within 5 %."""
    return (
        F.when((first > 0) & (last > first * (1 + TREND_BAND)), "increasing")
        .when((first > 0) & (last < first * (1 - TREND_BAND)), "decreasing")
        .otherwise("stable")
    )


def series_growth(predictions: DataFrame, points: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """Totals with history average, predicted average and growth percentage per series."""
    history = points.groupBy(*keys).agg(exact_sum(fixed("cost")).cast("double").alias("history"), F.count(F.lit(1)).alias("n"))
    growth = F.coalesce(
        ratio(F.col("predicted_avg") - F.col("current_avg"), F.when(F.col("current_avg") > 0, F.col("current_avg"))) * 100.0,
        F.lit(0.0),
    )
    return (
        forecast_totals(predictions, keys).join(history, keys)
        .withColumn("current_avg", F.col("history") / F.col("n"))
        .withColumn("predicted_avg", F.col("total_predicted_cost") / F.col("periods"))
        .withColumn("growth", growth).drop("history", "n")
    )


def _percent_text(value: Column) -> Column:
    return F.format_string("%.1f", F.abs(value))


def executive_summary(growth: DataFrame, granularity: str = "daily") -> DataFrame:
    """Per tenant: growth, badge, risk text and labels of the overall series."""
    unit = UNIT_LABEL.get(granularity, "Period")
    g = F.col("growth")
    return growth.where(F.col("series") == ALL_SERVICES).select(
        "user_id", "total_predicted_cost", fixed(g, 1).alias("growth_percentage"),
        F.when(g > 20, "Critical").when(g > 5, "Warning").when(g < -5, "Good").otherwise("Stable").alias("status_badge"),
        F.when(g > 20, F.concat(F.lit("Significant cost increase of "), _percent_text(g), F.lit("% expected")))
        .when(g > 5, F.concat(F.lit("Moderate cost increase of "), _percent_text(g), F.lit("% expected")))
        .when(g < -5, F.concat(F.lit("Cost saving of "), _percent_text(g), F.lit("% expected"))).alias("risk"),
        F.concat(F.lit("Next "), F.col("periods").cast("string"), F.lit(f" {unit}"),
                 F.when(F.col("periods") == 1, "").otherwise("s")).alias("period_label"),
        F.lit(unit).alias("period_unit"),
        "trend", "confidence_score",
        fixed("current_avg").alias("current_period_avg"), fixed("predicted_avg").alias("predicted_period_avg"),
    )


def service_outlook(growth: DataFrame) -> DataFrame:
    """Per forecast service: growth, status and action item."""
    g = F.col("growth")
    return growth.where(F.col("series") != ALL_SERVICES).select(
        "user_id", F.col("series").alias("service_name"), "total_predicted_cost", "trend",
        fixed(g, 1).alias("growth_pct"),
        F.when(g > 15, "Increasing").when(g < -5, "Decreasing").otherwise("Stable").alias("status"),
        F.when(g > 15, "Review resource allocation and scaling policies.")
        .when(g < -5, "Validate if meaningful services were turned off.")
        .otherwise("Monitor for unexpected spikes.").alias("action_item"),
    )


def card_values(summary: DataFrame) -> DataFrame:
    """Monthly projection and days to exhaustion from a summary's averages and growth."""
    unit = F.lower("period_unit")
    factor = F.when(unit == "week", F.lit(4.345)).when(unit == "month", F.lit(1.0)).otherwise(F.lit(30.0))
    growth, mean = F.col("growth_percentage"), F.col("predicted_period_avg")
    return summary.select(
        "user_id",
        fixed(mean * factor).alias("projected_monthly"),
        F.when((growth > 0) & (mean > 0), F.floor(F.lit(30.0) / (F.lit(1.0) + growth / F.lit(100.0)) + F.lit(0.5)))
        .cast("bigint").alias("days_to_exhaustion"),
        F.when(growth > 20, "Immediate attention needed").when(growth > 5, "Monitor closely")
        .otherwise("Within normal range").alias("risk_note"),
    )


def pivot_forecast(output: DataFrame, services: list[str]) -> DataFrame:
    """One row per tenant and date, one predicted-cost column per listed service."""
    return (
        output.where(F.col("series").isin(services)).groupBy("user_id", "date")
        .pivot("series", services).agg(F.first("predicted_cost"))
    )


def forecast_metrics(joined: DataFrame, keys: list[str]) -> DataFrame:
    """MAE, RMSE, MAPE, bias and interval coverage of (actual, predicted, lower, upper) rows."""
    error = F.col("predicted") - F.col("actual")
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"),
        fixed(F.avg(F.abs(error)), 2).alias("mae"),
        fixed(F.sqrt(F.avg(error * error)), 2).alias("rmse"),
        fixed(F.avg(F.when(F.col("actual") != 0, F.abs(error / F.col("actual")))) * 100.0, 2).alias("mape"),
        fixed(ratio(F.sum(error), F.sum("actual")) * 100.0, 2).alias("bias_pct"),
        fixed(F.avg(F.when(F.col("actual").between(F.col("lower"), F.col("upper")), 1.0).otherwise(0.0)) * 100.0, 2)
        .alias("coverage_pct"),
    )


def seasonal_naive(points: DataFrame, band: float = 0.2, keys: list[str] = SERIES) -> DataFrame:
    """Comparison forecast: the cost 7 points earlier, with a relative band."""
    before = F.lag("cost", 7).over(Window.partitionBy(*keys).orderBy("date"))
    return points.select(*keys, "date", F.col("cost").alias("actual"), before.alias("predicted")).where(
        F.col("predicted").isNotNull()
    ).withColumn("lower", F.col("predicted") * F.lit(1 - band)).withColumn("upper", F.col("predicted") * F.lit(1 + band))


def backtest(
    points: DataFrame, as_of: str, window_days: int = 90, horizon: int = 30, model: str = "linear",
    keys: list[str] = SERIES,
) -> DataFrame:
    """Metrics of rolling daily forecasts over the last ``window_days`` days, one fit per origin."""
    end = F.lit(str(as_of)[:10]).cast("date")
    folds = F.array(*[F.date_sub(end, back) for back in range(window_days, 0, -horizon)])
    copies = points.where(F.col("date") < end).withColumn("origin", F.explode(folds))
    fold_keys = [*keys, "origin"]
    train = copies.where(F.col("date") < F.col("origin"))
    size = F.count(F.lit(1)).over(Window.partitionBy(*fold_keys))
    train = train.withColumn("n", size).where(F.col("n") >= 2).drop("n")
    predicted = forecast(train, horizon, "daily", model, keys=fold_keys)
    joined = predicted.join(points.where(F.col("date") < end).withColumnRenamed("cost", "actual"), [*keys, "date"]).select(
        *keys, "actual", F.col("prediction").alias("predicted"), "lower", "upper"
    )
    return forecast_metrics(joined, keys)
