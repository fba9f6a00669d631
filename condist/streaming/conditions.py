"""Alert conditions as keyed state of a stream.

Events of a key (service, indicator) are occurrences, ends or neither. A key's
state is its firing alert: the id of its first occurrence, the number of
occurrences, and when it was last handed on. An end (a good verdict, a pause,
a removal, a change of generation) resolves the alert and drops the state, so
state is held for firing alerts only. A timer in event time hands a firing
alert on again when two minutes passed without news of it.

Within a batch a key's events are taken by (us, id); batches come in order of
time. What a task sorts is bounded by what a batch admits of one key.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from condist.streaming.jobs import KEYS, LATE, finished

REFRESH_US = 120_000_000
EVENTS = ["service", "indicator", "us", "id", "occurs", "ends", "reason"]
#: status is firing, resolved or refresh
UPDATES = "service string, indicator int, alert long, occurrences long, severity string, status string, reason string, us long"
STATE = "alert long, count long, handed_us long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Conditions(StatefulProcessor):
    """Folds the events of each key into updates of its alert."""

    def __init__(self, threshold: int, refresh_us: int):
        self.threshold, self.refresh_us = threshold, refresh_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.firing = handle.getValueState("firing", STATE)

    def _update(self, key: tuple, alert: int, count: int, status: str, reason: str | None, us: int) -> Row:
        severity = "critical" if count >= self.threshold else "warning"
        return Row(service=key[0], indicator=key[1], alert=alert, occurrences=count, severity=severity, status=status, reason=reason, us=us)

    def _keep(self, alert: int, count: int, us: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if count:
            self.firing.update((alert, count, us))
            if self.refresh_us:
                self.handle.registerTimer((us + self.refresh_us) // 1000)
        elif self.firing.exists():
            self.firing.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        alert, count, us = self.firing.get() if self.firing.exists() else (0, 0, 0)
        news = False
        for at, number, occurs, ends, reason in sorted((r.us, r.id, r.occurs, r.ends, r.reason) for r in rows if r.occurs or r.ends):
            news = True
            if occurs:
                alert, count, us = (alert, count + 1, at) if count else (number, 1, at)
                yield self._update(key, alert, count, "firing", None, at)
            if ends and count:
                yield self._update(key, alert, count, "resolved", reason, at)
                count = 0
        if news:
            self._keep(alert, count, us)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        if self.firing.exists():
            alert, count, _ = self.firing.get()
            us = expiredTimerInfo.getExpiryTimeInMs() * 1000
            yield self._update(key, alert, count, "refresh", None, us)
            # the next one falls due after what the watermark has reached, so idle time is one row, not one for every two minutes
            self._keep(alert, count, max(us, timerValues.getCurrentWatermarkInMs() * 1000))

    def close(self) -> None:
        pass


def updates(events: DataFrame, threshold: int = 3, refresh_us: int = REFRESH_US, late: str = LATE) -> DataFrame:
    """Updates of alert conditions by a stream of EVENTS; the state store must be of the PROVIDER's kind."""
    rows = events.select(*EVENTS, F.timestamp_micros("us").alias("at")).withWatermark("at", late)
    return rows.groupBy(*KEYS).transformWithState(Conditions(threshold, refresh_us), UPDATES, "Update", "EventTime")


def alert_stream(events: DataFrame, spark: SparkSession, threshold: int = 3, refresh_us: int = REFRESH_US, late: str = LATE, folder: str | None = None) -> DataFrame:
    """All updates that the job of a folder has made."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)

    def sink(batch: DataFrame, path: str, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    try:
        return finished(updates(events, threshold, refresh_us, late), spark, "alerts", "update", sink, folder)
    finally:
        spark.conf.set(name, before)


def firing(spark: SparkSession, folder: str) -> DataFrame:
    """The firing alerts in a job's state store: service, indicator, alert, count, handed_us."""
    rows = spark.read.format("statestore").option("stateVarName", "firing").load(f"{folder}/state")
    return rows.select("key.*", "value.*")
