"""File stream to the cost table, and daily totals with late-data handling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.category import with_category
from ..functions.numeric import exact_sum
from ..operators import records
from ..sources.store import cost_rows, read_costs

RAW_FIELDS = [
    "user_id", "provider", "cloud_account_id", "service_name", "resource_id", "region", "usage_quantity",
    "usage_unit", "cost", "currency", "usage_start_date", "usage_end_date",
]
RAW_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in RAW_FIELDS])


def stream_csv(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New CSV files of a folder as text records."""
    return spark.readStream.schema(RAW_SCHEMA).option("header", True).option("maxFilesPerTrigger", files_per_trigger).csv(folder)


BAD_TENANT = "User id must be a whole number"


def checked_batch(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cost records, rejects): a tenant id that is no whole number is a reject, never a record without tenant."""
    tenant = F.col("user_id").cast("string").try_cast("bigint")
    readable = batch.where(tenant.isNotNull()).withColumn("user_id", tenant)
    good, rejects = records.ingest(readable)
    strangers = batch.where(tenant.isNull()).withColumn("error", F.lit(BAD_TENANT))
    return good, rejects.withColumn("user_id", F.col("user_id").cast("string")).unionByName(strangers, allowMissingColumns=True)


def start_ingest(stream: DataFrame, cost_path: str, reject_path: str, checkpoint: str) -> StreamingQuery:
    """Append valid records to the cost table and rejected ones to a side table.

    Each micro-batch goes to its own ``batch_id`` folders in overwrite mode, so a
    batch that is run again after a failure replaces itself instead of adding
    its rows twice. A month's rows of a batch meet in files of a bounded size, so
    files do not multiply with the tasks that read.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # the files are read once for records and rejects
        good, rejects = checked_batch(batch)
        # dynamic overwrite touches only the partitions this batch writes
        (
            cost_rows(good).withColumn("batch_id", F.lit(batch_id))
            .hint("rebalance", "billing_period")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("billing_period", "batch_id").parquet(cost_path)
        )
        (
            rejects.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(reject_path)
        )
        batch.unpersist()

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def daily_category_stream(costs: DataFrame, delay: str = "3 days") -> DataFrame:
    """Cost per tenant, category and day; rows later than ``delay`` behind the newest are dropped."""
    timed = costs.withColumn("event_time", F.col("usage_start_date").cast("timestamp")).withWatermark("event_time", delay)
    return (
        with_category(timed).groupBy("user_id", "category", F.window("event_time", "1 day").alias("day"))
        .agg(exact_sum("cost").alias("total"), F.count(F.lit(1)).alias("record_count"))
        .select("user_id", "category", F.to_date("day.start").alias("date"), F.col("total").cast("double").alias("cost"), "record_count")
    )


def read_streamed_costs(spark: SparkSession, path: str) -> DataFrame:
    """Cost table written by :func:`start_ingest`."""
    return read_costs(spark, path)


