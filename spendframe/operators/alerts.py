"""Which anomaly alerts to send: user settings and a cooldown per tenant and service."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.numeric import carried_max

# --- fixed values -----------------------------------------------------------
DEFAULT_COOLDOWN_MINUTES = 10
DEFAULT_NAME = "Cloud Service"
# ----------------------------------------------------------------------------


def wanted_alerts(alerts: DataFrame, users: DataFrame) -> DataFrame:
    """Alerts of users with an address who want them, with their cooldown in microseconds."""
    enabled = F.coalesce("email_alerts_enabled", "email_notifications", F.lit(False))
    minutes = F.coalesce(F.nullif("email_alert_cooldown_minutes", F.lit(0)), F.lit(DEFAULT_COOLDOWN_MINUTES))
    settings = users.where(F.col("email").isNotNull() & (F.col("email") != "") & enabled).select(
        "user_id", (minutes.cast("bigint") * F.lit(60_000_000)).alias("cooldown_us")
    )
    named = alerts.where(F.col("alert_at").isNotNull()).withColumn("service_name", F.coalesce("service_name", F.lit(DEFAULT_NAME)))
    return named.join(settings, "user_id")


def _sessions(alerts: DataFrame) -> DataFrame:
    """Distinct alert times with the start of their burst.

    A pause of at least the cooldown always lets the next alert through, so
    bursts are independent of each other. Pauses are found per day, and only
    the edges of the days are compared over the whole history of a key.
    """
    key = ["user_id", "service_name"]
    times = (
        alerts.withColumn("us", F.unix_micros(F.col("alert_at").cast("timestamp")))
        .groupBy(*key, "us").agg(F.max("cooldown_us").alias("cooldown_us"))
        .withColumn("day", F.floor(F.col("us") / F.lit(86_400_000_000)))
    )
    days = times.groupBy(*key, "day").agg(carried_max("us", "cooldown_us").alias("day_last"))
    by_day = Window.partitionBy(*key).orderBy("day")
    edges = days.withColumn("last_before", F.lag("day_last").over(by_day)).drop("day_last")
    inside = Window.partitionBy(*key, "day").orderBy("us")
    gaps = times.join(edges, [*key, "day"]).withColumn(
        "before", F.coalesce(F.lag("us").over(inside), F.col("last_before"))
    )
    starts = gaps.withColumn(
        "start", F.when(F.col("before").isNull() | (F.col("us") - F.col("before") >= F.col("cooldown_us")), F.col("us"))
    ).drop("last_before", "before")
    running = F.max("start").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    carried = starts.groupBy(*key, "day").agg(F.max("start").alias("day_start")).select(
        *key, "day",
        F.max("day_start").over(by_day.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"),
    )
    return starts.join(carried, [*key, "day"]).select(
        *key, "us", "cooldown_us", F.coalesce(running, F.col("carried")).alias("burst")
    )


def select_alerts(alerts: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, service_name, alert_at) of the alerts to send.

    Per tenant and service an alert goes out when the last sent one is at least
    the cooldown ago. A burst is read in time order batch by batch; only the
    last sent time is kept between batches.
    """
    bursts = _sessions(wanted_alerts(alerts, users))
    key = ["user_id", "service_name", "burst"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, allowed = None, 0
        for batch in batches:
            if batch.empty:
                continue
            names = [batch[column].to_numpy() for column in key]
            times, pauses = batch["us"].to_numpy(), batch["cooldown_us"].to_numpy()
            changed = np.zeros(len(batch), dtype=bool)
            for values in names:
                changed[1:] |= values[1:] != values[:-1]
            keep = changed.copy()  # the first alert of a burst always goes out
            begins = np.flatnonzero(changed)
            edges = np.concatenate([[0], begins, [len(batch)]])
            keep[0] = tuple(values[0] for values in names) != current
            longer = np.flatnonzero(np.diff(edges) > 1)
            for piece in sorted({0, *longer.tolist()}):
                begin, end = edges[piece], edges[piece + 1]
                at = begin
                if keep[begin]:
                    allowed = times[begin] + pauses[begin]
                    at = begin + 1
                at += np.searchsorted(times[at:end], allowed)
                while at < end:
                    keep[at] = True
                    allowed = times[at] + pauses[at]
                    at += np.searchsorted(times[at:end], allowed)
            if len(edges) > 2 and edges[-1] - edges[-2] == 1:
                allowed = times[-1] + pauses[-1]
            current = tuple(values[-1] for values in names)
            yield batch.loc[keep, ["user_id", "service_name", "us"]]

    schema = f"user_id {bursts.schema['user_id'].dataType.simpleString()}, service_name string, us bigint"
    return (
        bursts.repartition(*key).sortWithinPartitions(*key, "us").mapInPandas(fold, schema)
        .select("user_id", "service_name", F.timestamp_micros("us").cast("timestamp_ntz").alias("alert_at"))
    )
