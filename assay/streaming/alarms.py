"""Alarm states over time: transitions between OK and ALARM, in batch and on a stream.

A period that breaches puts an alarm into ALARM; one that does not, or one without data, puts it back to OK.
Only changes are given, each once, at the end of the period that made it. Alarms start OK.

The stream aggregates points to windows first, combined before their shuffle, so an alarm that watches a
third of all points reaches its state as one row per period. The state per alarm is where it stands and since
when; an event-time timer at the end of the following period brings a silent alarm back to OK.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from assay.operators.metrics import ALARM_COLUMNS, PERIOD_SECONDS, alarm_points, alarm_values, alarm_windows
from assay.streaming.events import WATERMARK

TRANSITION = "alarm string, state string, period_start timestamp, updated timestamp, value double"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "last_end bigint"


def alarm_transitions(metrics: DataFrame, alarms: DataFrame, until: Column) -> DataFrame:
    """All changes of state up to `until`: alarm, the new state, the period that made it, its end and value.

    A silent period has no value. Windows that end after `until` do not count yet. Works on windows, one row
    per alarm and period.
    """
    length = F.col("period")
    windows = alarm_windows(metrics, alarms).join(F.broadcast(alarms.select("alarm", "period")), "alarm")
    start, limit = F.unix_seconds("period_start"), F.unix_micros(until.cast("timestamp"))
    closed = windows.withColumn("start", start).where((start + length) * 1_000_000 <= limit)
    order = Window.partitionBy("alarm").orderBy("start")
    follows = F.lag("start").over(order) + length == F.col("start")
    before = F.coalesce(F.lag("breach").over(order), F.lit(False))
    after = F.lead("start").over(order)
    steps = closed.select(
        "alarm", "start", "period", "value", "breach", (before & F.coalesce(follows, F.lit(False))).alias("was"),
        F.coalesce(after == F.col("start") + length, F.lit(False)).alias("goes_on"),
    )
    silent_end = F.col("start") + 2 * length

    def change(state: str, begin: Column, value: Column) -> Column:
        return F.struct(
            F.lit(state).alias("state"), F.timestamp_seconds(begin).alias("period_start"),
            F.timestamp_seconds(begin + length).alias("updated"), value.alias("value"),
        )

    changes = F.array(
        F.when(F.col("breach") & ~F.col("was"), change("ALARM", F.col("start"), F.col("value"))),
        F.when(~F.col("breach") & F.col("was"), change("OK", F.col("start"), F.col("value"))),
        F.when(
            F.col("breach") & ~F.col("goes_on") & (silent_end * 1_000_000 <= limit),
            change("OK", F.col("start") + length, F.lit(None).cast("double")),
        ),
    )
    return steps.select("alarm", F.inline(F.array_compact(changes)))


class _Machine(StatefulProcessor):
    """Where an alarm stands: `last_end`, the end of the period that keeps it in ALARM; no state is OK."""

    def __init__(self, period: int):
        self.period = period

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.raised = handle.getValueState("raised", _STATE)

    def _change(self, key, state: str, start: int, value) -> Row:
        return Row(alarm=key[0], state=state, start=start, value=value)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.raised.get()[0] if self.raised.exists() else None
        first = held
        # A watermark that jumps closes several windows at once.
        for row in sorted(rows, key=lambda r: r.start):
            if held is not None and held < row.start:
                yield self._change(key, "OK", held, None)
                held = None
            if row.breach:
                if held is None:
                    yield self._change(key, "ALARM", row.start, row.value)
                held = row.start + self.period
            elif held is not None:
                yield self._change(key, "OK", row.start, row.value)
                held = None
        if held == first:
            return
        if first is not None:
            self.handle.deleteTimer(self._timer(first))
        if held is None:
            self.raised.clear()
        else:
            self.raised.update((held,))
            self.handle.registerTimer(self._timer(held))

    def _timer(self, last_end: int) -> int:
        return (last_end + self.period) * 1000

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.raised.get()[0] if self.raised.exists() else None
        if held is not None and self._timer(held) <= expiredTimerInfo.getExpiryTimeInMs():
            self.raised.clear()
            yield self._change(key, "OK", held, None)

    def close(self) -> None:
        pass


def transition_stream(
    metrics: DataFrame, alarms: DataFrame, period: int = PERIOD_SECONDS, delay: str = WATERMARK
) -> DataFrame:
    """`alarm_transitions` of a metric stream, each as soon as the watermark has passed its end.

    All alarms of a stream share one period. The session must keep its state in RocksDB (`ROCKSDB`).
    """
    points = alarm_points(metrics.withWatermark("ts", delay), alarms)
    window = F.window("ts", f"{period} seconds").alias("period_start")
    values = alarm_values(points.groupBy(*ALARM_COLUMNS, window)).select(
        "alarm", F.unix_seconds("period_start.start").alias("start"), "value", "breach"
    )
    changes = values.groupBy("alarm").transformWithState(
        _Machine(period), "alarm string, state string, start bigint, value double", "Append", "EventTime"
    )
    return changes.select(
        "alarm", "state", F.timestamp_seconds("start").alias("period_start"),
        F.timestamp_seconds(F.col("start") + period).alias("updated"), "value",
    )
