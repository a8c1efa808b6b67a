"""Registered queries that run a stream over the given tables to its end and read its output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numeric import exact_sum, fixed as fixed_col, money as money_col
from ..session import shared_dir
from ..sources.tables import lineitem_costs, table
from ..streaming import cooldown, ingest
from .queries_models import A12_SQL, alert_users
from .registry import COSTS, money, query, total

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _drain(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over everything available and read what it appended."""
    spark = stream.sparkSession
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
    writer.outputMode("append").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("T1_stream_ingest", f"""WITH {COSTS}
SELECT user_id, billing_period, count(*) AS record_count, {money(total('cost'))} AS total_cost, CAST(0 AS BIGINT) AS rejected
FROM costs WHERE provider <> 'Other' GROUP BY 1, 2
UNION ALL SELECT -1, 'rejects', count(*), 0, count(*) FROM costs WHERE provider = 'Other'""")
def t1_ingest(spark, sf_dir):
    folder = _folder(spark, "stream-ingest")
    costs = lineitem_costs(spark, sf_dir, ingest.RAW_FIELDS)
    # records of provider Other arrive with a provider the rules reject
    provider = F.when(F.col("provider") == "Other", "unknown").otherwise(F.upper("provider"))
    (
        costs.withColumn("provider", provider)
        .withColumn("usage_start_date", F.date_format("usage_start_date", "yyyy-MM-dd'T'HH:mm:ss"))
        .withColumn("usage_end_date", F.date_format("usage_end_date", "yyyy-MM-dd'T'HH:mm:ss"))
        .write.option("header", True).csv(f"{folder}/landing")
    )
    stream = ingest.stream_csv(spark, f"{folder}/landing")
    ingest.start_ingest(stream, f"{folder}/costs", f"{folder}/rejects", f"{folder}/checkpoint").awaitTermination()
    good = ingest.read_streamed_costs(spark, f"{folder}/costs").groupBy("user_id", "billing_period").agg(
        F.count(F.lit(1)).alias("record_count"), money_col(exact_sum("cost")).alias("total_cost"), F.lit(0).cast("bigint").alias("rejected")
    )
    rejects = spark.read.parquet(f"{folder}/rejects").agg(F.count(F.lit(1)).alias("record_count")).select(
        F.lit(-1).cast("bigint").alias("user_id"), F.lit("rejects").alias("billing_period"), "record_count",
        F.lit(0.0).alias("total_cost"), F.col("record_count").alias("rejected"),
    )
    return good.unionByName(rejects)


@query("T2_stream_daily_category", f"""WITH daily AS (SELECT user_id, CAST(ts AS DATE) AS d, {total('value')} AS t, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, 'Other' AS category, strftime(d, '%Y-%m-%d') AS date, CAST(t AS DOUBLE) AS cost, n AS record_count
FROM daily WHERE CAST(d + 1 AS TIMESTAMP) <= (SELECT max(ts) FROM events) - INTERVAL 3 DAY""")
def t2_daily(spark, sf_dir):
    costs = _event_stream(spark, sf_dir).select(
        "user_id", F.col("event_type").alias("service_name"), F.col("value").alias("cost"), F.col("ts").alias("usage_start_date")
    )
    done = _drain(ingest.daily_category_stream(costs), _folder(spark, "stream-daily"))
    return done.select(
        "user_id", "category", F.date_format("date", "yyyy-MM-dd").alias("date"), fixed_col("cost", 4).alias("cost"), "record_count"
    )


@query("T3_stream_cooldown", f"""SELECT * FROM ({A12_SQL}) WHERE CAST(alert_at AS TIMESTAMP) < (
    SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 DAY FROM events JOIN customer ON events.user_id = c_custkey
    WHERE c_custkey % 11 <> 0 AND (c_custkey % 3 = 0 OR (c_custkey % 3 = 2 AND c_custkey % 2 = 0)))""")
def t3_cooldown(spark, sf_dir):
    """Alerts the watermark has passed by the end of the events, which arrive in the order of their ids."""
    fired = _event_stream(spark, sf_dir).select("user_id", F.col("event_type").alias("service_name"), F.col("ts").alias("alert_at"))
    before = spark.conf.get(STATE_PROVIDER, None)
    spark.conf.set(STATE_PROVIDER, ROCKSDB)
    try:
        sent = _drain(cooldown.cooldown_stream(fired, alert_users(spark, sf_dir)), _folder(spark, "stream-cooldown"))
    finally:
        spark.conf.unset(STATE_PROVIDER) if before is None else spark.conf.set(STATE_PROVIDER, before)
    return sent.withColumn("alert_at", F.date_format("alert_at", "yyyy-MM-dd HH:mm:ss"))
