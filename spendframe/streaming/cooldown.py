"""Alert cooldown as keyed state: the streaming twin of the batch selection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.alerts import wanted_alerts

OUTPUT = "user_id bigint, service_name string, us bigint"
DELAY = "1 day"  # how much later than the newest alert one may arrive and still take its place


class Cooldown(StatefulProcessor):
    """Alerts wait until the watermark has passed them, so those of later micro-batches fall into their place in time.

    The state of a tenant and service is the last sent time and the alerts still waiting.
    A timer at the earliest waiting alert settles all that the watermark has passed.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        # one value, so a key costs one read and one write of state for each micro-batch and timer
        self._state = handle.getValueState("state", "last bigint, due bigint, us array<bigint>, cooldown_us array<bigint>")

    def _settle(self, last: int | None, due: int | None, us: list[int], pauses: list[int]) -> None:
        """Store the key's state, with a timer at the millisecond at which the earliest waiting alert is over."""
        ms = min(us) // 1000 + 1 if us else None
        if due is not None and ms != due:
            self._handle.deleteTimer(due)
        if ms is not None and ms != due:
            self._handle.registerTimer(ms)
        self._state.update((last, ms, us, pauses))

    def _known(self) -> tuple:
        """Last sent time, timer, and the waiting alerts' times and cooldowns."""
        last, due, us, pauses = self._state.get() or (None, None, [], [])
        return last, due, list(us), list(pauses)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, due, us, pauses = self._known()
        for chunk in rows:
            us += chunk["us"].tolist()
            pauses += chunk["cooldown_us"].tolist()
        if us:
            self._settle(last, due, us, pauses)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        last, _, us, pauses = self._known()
        sent, left = [], []
        for at, pause in sorted(zip(us, pauses)):
            if at >= passed:
                left.append((at, pause))
            elif last is None or at - last >= pause:
                last = at
                sent.append(at)
        self._settle(last, None, [at for at, _ in left], [pause for _, pause in left])
        if sent:
            yield pd.DataFrame({"user_id": [key[0]] * len(sent), "service_name": pd.Series([key[1]] * len(sent), dtype=object), "us": sent})

    def close(self) -> None:
        pass


def cooldown_stream(alerts: DataFrame, users: DataFrame, delay: str = DELAY) -> DataFrame:
    """Streaming alerts (user_id, service_name, alert_at) to the ones to send, each once the watermark has passed it.

    Alerts may arrive in any order within ``delay`` of the newest one and give what the batch
    selection gives for all of them; later ones are dropped.
    """
    timed = wanted_alerts(alerts, users).select(
        "user_id", "service_name", "cooldown_us", F.col("alert_at").cast("timestamp").alias("at"), F.unix_micros(F.col("alert_at").cast("timestamp")).alias("us")
    ).withWatermark("at", delay)
    return (
        timed.groupBy("user_id", "service_name")
        .transformWithStateInPandas(Cooldown(), OUTPUT, "Append", "EventTime")
        .select("user_id", "service_name", F.timestamp_micros("us").cast("timestamp_ntz").alias("alert_at"))
    )
