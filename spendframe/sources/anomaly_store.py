"""Stored anomalies: one folder for each batch, partitioned by day inside.

A batch that is stored again replaces its whole folder, so a run that is repeated after a
failure stores nothing twice. Reads are cut to the days and types they need.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.anomalies import purge_decreases
from ..schema import ANOMALY_SCHEMA

DAY, BATCH = "detected_day", "batch_id"
_STORED = T.StructType([*ANOMALY_SCHEMA.fields, T.StructField(BATCH, T.StringType()), T.StructField(DAY, T.DateType())])


def write_batch(anomalies: DataFrame, path: str, batch_id: str | None = None) -> None:
    """Store anomalies as the only content of their batch; without an id every call is a batch of its own."""
    present = {f.name for f in anomalies.schema.fields}
    columns = [(F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name) for f in ANOMALY_SCHEMA]
    (
        anomalies.select(*columns, F.to_date("detected_at").alias(DAY))
        .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(DAY).parquet(f"{path}/{BATCH}={batch_id or uuid.uuid4().hex}")
    )


def read_anomalies(spark: SparkSession, path: str, since: date | str | None = None, not_of: str | None = None, purged: bool = True) -> DataFrame:
    """All stored increases, from ``since`` on and without one batch; both bounds prune folders.

    Decreases, which an ingest may store, are purged from every read unless ``purged`` is
    off. A table that nobody has written yet is empty.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], _STORED)
    stored = spark.read.schema(_STORED).option("basePath", path).parquet(path)
    if since is not None:
        stored = stored.where(F.col(DAY) >= F.lit(str(since)).cast("date"))
    if not_of is not None:
        stored = stored.where(F.col(BATCH) != not_of)
    return purge_decreases(stored) if purged else stored
