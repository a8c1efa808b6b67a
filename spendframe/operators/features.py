"""Daily series and their detection features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.category import with_category
from ..functions.numeric import carried_max, exact_sum
from ..schema import START_MONTH

# --- fixed values -----------------------------------------------------------
FEATURES = [
    "cost", "lag_1", "lag_7", "rolling_mean_7", "rolling_std_7", "cost_ratio_1", "cost_ratio_7", "is_weekend",
]
RATIO_EPSILON = 1e-5
HISTORY_DAYS = 90
RECENT_DAYS = 7
MIN_SERIES_ROWS = 8
MIN_TRAINING_DAYS = 14
MIN_TRAINING_ROWS = 10
# ----------------------------------------------------------------------------


def normalize_costs(raw: DataFrame, keys: tuple[str, ...] = (), ordered: bool = False) -> DataFrame:
    """(date, service, cost, provider) rows to day, category and provider totals, sorted only if asked for.

    Rows are summed per service first, so the category rules run once per
    day and service instead of once per row.
    """
    by_service = raw.groupBy(*keys, F.to_date("date").alias("date"), "service", "provider").agg(
        exact_sum("cost").alias("total")
    )
    normalized = with_category(by_service, "service").groupBy(*keys, "date", "category", "provider").agg(F.sum("total").cast("double").alias("cost"))
    return normalized.orderBy(*keys, "date", "category", "provider") if ordered else normalized


def daily_series(costs: DataFrame, keys: tuple[str, ...] = ("user_id", "service_name")) -> DataFrame:
    """Exact total per series and day."""
    return costs.groupBy(*keys, F.to_date("usage_start_date").alias("date")).agg(exact_sum("cost").alias("total"))


def months_with_history(costs: DataFrame, history_days: int) -> list[str]:
    """Months that hold the last ``history_days`` days of any tenant; reads two narrow columns."""
    newest = costs.groupBy("user_id").agg(F.max("billing_period").alias("newest")).where(F.col("newest").isNotNull())
    first = F.to_date(F.concat("newest", F.lit("-01")))
    months = F.sequence(F.trunc(F.date_sub(first, history_days), "month"), first, F.expr("interval 1 month"))
    found = newest.select("newest").distinct().select(F.explode(months).alias("month")).distinct()  # as many as the calendar has
    return sorted(row.month.isoformat()[:7] for row in found.collect())


def detection_series(costs: DataFrame, history_days: int = HISTORY_DAYS) -> DataFrame:
    """Daily series of the tenant's last ``history_days`` days, with the tenant's ``latest`` day.

    Series with fewer than 8 days are left out. Of the cost table, only the months that some
    tenant's history reaches into are read.
    """
    if "billing_period" in costs.columns and costs.schema["billing_period"].metadata.get(START_MONTH):
        costs = costs.where(F.col("billing_period").isin(months_with_history(costs, history_days)))
    daily = daily_series(costs).where(F.col("date").isNotNull())
    latest = daily.groupBy("user_id").agg(carried_max("date", "total").alias("latest"))
    recent = daily.join(latest, "user_id").where(F.col("date") >= F.date_sub("latest", history_days))
    size = F.count(F.lit(1)).over(Window.partitionBy("user_id", "service_name"))
    return recent.withColumn("series_rows", size).where(F.col("series_rows") >= MIN_SERIES_ROWS).drop("series_rows")


def with_features(series: DataFrame, keys: list[str], order: str = "date", value: str = "total") -> DataFrame:
    """Lags, statistics of the 7 rows before, ratios and the weekend flag.

    Offsets count rows, not calendar days. ``value`` is an exact decimal or a
    double column. Rows with incomplete history are dropped, so the first kept
    row of a series is its eighth.
    """
    by_date = Window.partitionBy(*keys).orderBy(order)
    before = by_date.rowsBetween(-7, -1)
    cost = F.col(value).cast("double")
    mean = F.sum(value).over(before).cast("double") / F.lit(7.0)
    return (
        series.select(
            "*",
            cost.alias("cost"),
            F.lag(cost, 1).over(by_date).alias("lag_1"),
            F.lag(cost, 7).over(by_date).alias("lag_7"),
            mean.alias("rolling_mean_7"),
            F.stddev_samp(cost).over(before).alias("rolling_std_7"),
        )
        .where(F.col("lag_7").isNotNull())
        .withColumn("cost_ratio_1", F.col("cost") / (F.col("lag_1") + F.lit(RATIO_EPSILON)))
        .withColumn("cost_ratio_7", F.col("cost") / (F.col("rolling_mean_7") + F.lit(RATIO_EPSILON)))
        .withColumn("is_weekend", F.when(F.weekday(order) >= 5, 1.0).otherwise(0.0))
    )


def recent_days(daily: DataFrame, days: int = RECENT_DAYS, by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Rows of the last ``days`` days before each group's newest day, that day included."""
    latest = F.max("date").over(Window.partitionBy(*by))
    return daily.withColumn("latest", latest).where(F.col("date") >= F.date_sub("latest", days))


def training_features(training: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(date, service, cost) rows to training feature rows per category, or per category of each ``by`` group.

    Days are summed over providers; a category needs 14 days, rows of its last
    7 days are held out, and 10 rows must remain.
    """
    keys = [*by, "category"]
    by_service = training.groupBy(*by, F.to_date("date").alias("date"), "service").agg(exact_sum("cost").alias("total"))
    daily = with_category(by_service, "service").groupBy(*keys, "date").agg(F.sum("total").alias("total"))
    whole = Window.partitionBy(*keys)
    enough = daily.withColumn("days", F.count(F.lit(1)).over(whole)).where(F.col("days") >= MIN_TRAINING_DAYS)
    rows = with_features(enough.drop("days"), keys)
    return (
        rows.withColumn("last", F.max("date").over(whole))
        .where(F.col("date") < F.date_sub("last", RECENT_DAYS))
        .withColumn("train_rows", F.count(F.lit(1)).over(whole))
        .where(F.col("train_rows") >= MIN_TRAINING_ROWS)
        .select(*keys, "date", "train_rows", *FEATURES)
    )


def own_and_shared_features(training: DataFrame, tenants: DataFrame | None = None) -> DataFrame:
    """Training rows of the shared models '<category>' and of each tenant's own '<user>_<category>', by ``model_key``.

    ``tenants`` (user_id) limits who has models of their own.
    """
    shared = training_features(training).withColumn("model_key", F.col("category"))
    owners = training if tenants is None else training.join(tenants.select("user_id").distinct(), "user_id", "left_semi")
    own = training_features(owners.where(F.col("user_id").isNotNull()), ("user_id",)).withColumn(
        "model_key", F.concat_ws("_", F.col("user_id").cast("string"), "category")).drop("user_id")
    return shared.unionByName(own).drop("category")


def scaler(rows: DataFrame, key: str = "category") -> DataFrame:
    """Mean and population standard deviation per model and feature; zero deviation counts as 1."""
    means = [F.avg(name).alias(f"mean_{name}") for name in FEATURES]
    deviations = [F.stddev_pop(name).alias(f"std_{name}") for name in FEATURES]
    table = rows.groupBy(key).agg(F.count(F.lit(1)).alias("train_rows"), *means, *deviations)
    for name in FEATURES:
        spread = F.col(f"std_{name}")
        table = table.withColumn(f"std_{name}", F.when(spread > F.abs(F.col(f"mean_{name}")) * 1e-12, spread).otherwise(1.0))
    return table


def scale(rows: DataFrame, table: DataFrame, key: str = "category") -> DataFrame:
    """Standardised features; rows whose model has no scaler are dropped."""
    columns = [c for c in rows.columns if c not in FEATURES]
    joined = rows.join(table.drop("train_rows"), key)
    scaled = [((F.col(n) - F.col(f"mean_{n}")) / F.col(f"std_{n}")).alias(f"z_{n}") for n in FEATURES]
    return joined.select(*columns, *FEATURES, *scaled)
