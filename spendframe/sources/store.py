"""Writers and readers of the engine's own tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.filters import between_dates
from ..schema import COST_SCHEMA, START_MONTH


def cost_rows(costs: DataFrame) -> DataFrame:
    """Records in the stored layout: the period, which the table is partitioned by, is the start date's month."""
    month = F.coalesce(F.date_format("usage_start_date", "yyyy-MM"), F.col("billing_period"))
    return costs.withColumn("billing_period", month).select([F.col(f.name).cast(f.dataType) for f in COST_SCHEMA])


def append_costs(costs: DataFrame, path: str, batch_id: str | None = None) -> None:
    """Add cost records, partitioned by month and batch and sorted for min/max statistics.

    A batch that is stored again under its ``batch_id`` replaces itself instead of
    adding its rows twice; without one, every call is a batch of its own. The
    rebalance hint lets adaptive execution split a month that holds most of the rows
    and merge small ones, so neither giant nor tiny files appear.
    """
    (
        cost_rows(costs)
        .hint("rebalance", "billing_period")
        .sortWithinPartitions("billing_period", "user_id", "usage_start_date")
        .withColumn("batch_id", F.lit(batch_id or uuid.uuid4().hex))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("billing_period", "batch_id").parquet(path)
    )


def read_costs(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """Cost table; a date range, here or in a later filter, also prunes the monthly partitions."""
    costs = spark.read.schema(COST_SCHEMA).parquet(path).drop("batch_id").withMetadata("billing_period", {START_MONTH: True})
    return between_dates(costs, start, end)


def write_report_csv(report: DataFrame, path: str) -> None:
    """Report rows as CSV with a header, one file per partition in row order."""
    report.write.mode("overwrite").option("header", True).csv(path)


def write_model(model: dict[str, DataFrame], path: str) -> None:
    """Forest parts (trees, scaler, offsets) as Parquet tables under one folder."""
    for part, frame in model.items():
        frame.write.mode("overwrite").parquet(f"{path}/{part}")


def read_model(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {part: spark.read.parquet(f"{path}/{part}") for part in ("trees", "scaler", "offsets")}


def preferred_model_key(rows: DataFrame, keys: DataFrame, user: str = "user_id", name: str = "category") -> DataFrame:
    """Attach ``model_key``: the user's own model '<user>_<name>' if stored, else the shared '<name>'.

    Rows without either are dropped. ``keys`` holds the stored ``model_key`` values.
    """
    stored = keys.select("model_key").distinct()
    own = stored.select(F.col("model_key").alias("own_key"))
    shared = stored.select(F.col("model_key").alias("shared_key"))
    wanted = rows.select(user, name).distinct().withColumn(
        "__own", F.concat_ws("_", F.col(user).cast("string"), F.col(name))
    )
    resolved = (
        wanted.join(own, F.col("__own") == F.col("own_key"), "left")
        .join(shared, F.col(name) == F.col("shared_key"), "left")
        .select(user, name, F.coalesce("own_key", "shared_key").alias("model_key"))
        .where(F.col("model_key").isNotNull())
    )
    return rows.join(resolved, [user, name])
