"""Exact quantiles per group without collecting a group.

The approximate quantiles of a group, with their known error of rank, bracket the
wanted value. Only the few distinct values inside the bracket are counted and
ranked; the rows below it are just counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

ACCURACY = 2000  # the approximate quantile's rank is off by at most one row in so many


def grouped_quantile(df: DataFrame, keys: list[str], value: str, quantile: float) -> DataFrame:
    """Smallest value whose cumulative row share reaches ``quantile``, as ``quantile_value``."""
    rows = df.select(*keys, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    margin = 2.0 / ACCURACY
    bounds = [F.lit(max(0.0, quantile - margin)), F.lit(min(1.0, quantile + margin))]
    brackets = rows.groupBy(*keys).agg(
        F.percentile_approx("v", F.array(*bounds), F.lit(ACCURACY)).alias("around"), F.count(F.lit(1)).alias("n"))
    counted = rows.join(brackets, keys).select(
        *keys, "n", F.when(F.col("v") < F.col("around")[0], F.lit(None)).otherwise(F.col("v")).alias("v"), F.col("v").alias("each"),
        F.col("around")[1].alias("upper")).where(F.col("each") <= F.col("upper"))
    # everything below the bracket is one row of the aggregate, with a null value
    counts = counted.groupBy(*keys, "n", "v").agg(F.count(F.lit(1)).alias("rows"))
    reached = F.sum("rows").over(Window.partitionBy(*keys).orderBy(F.col("v").asc_nulls_first()))
    rank = F.greatest(F.lit(1), F.ceil(F.lit(quantile) * F.col("n")))
    return (
        counts.withColumn("reached", reached).where((F.col("reached") >= rank) & F.col("v").isNotNull())
        .groupBy(*keys).agg(F.min("v").alias("quantile_value"))
    )
