"""Alarm states over time: batch against a direct machine, stream against batch, restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from assay.operators import metrics as M
from assay.streaming import alarms as L
from assay.streaming import events as E

T0 = dt.datetime(2025, 9, 1)
SCHEMA = "ts timestamp, name string, value double, dimensions map<string,string>"
ALARMS = [M.Alarm("high", "m", "Sum", 10.0, ">"), M.Alarm("low", "m", "Minimum", 1.0, "<"), M.Alarm("other", "n", "Sum", 0.0, ">")]


def points(seed, hours=30):
    draw = random.Random(seed)
    out = []
    for minute in range(hours * 60):
        if draw.random() < 0.12:
            out.append((T0 + dt.timedelta(minutes=minute, seconds=draw.randrange(60)), draw.choice("mmmn"), draw.choice([0.5, 2.0, 6.0, 9.0]), {}))
    return out


def direct(rows, until):
    """Walk through every period in turn."""
    out = []
    for alarm in ALARMS:
        state, at = "OK", T0
        while at + dt.timedelta(minutes=5) <= until:
            values = [r[2] for r in rows if r[1] == alarm.metric and at <= r[0] < at + dt.timedelta(minutes=5)]
            value = None if not values else sum(values) if alarm.statistic == "Sum" else min(values)
            breach = value is not None and (value > alarm.threshold if alarm.comparison == ">" else value < alarm.threshold)
            new = "ALARM" if breach else "OK"
            if new != state:
                out.append((alarm.name, new, at, value))
                state = new
            at += dt.timedelta(minutes=5)
    return sorted(out, key=str)


def shown(df):
    return sorted([(r.alarm, r.state, r.period_start, r.value) for r in df.collect()], key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_history_of_states(spark, seed):
    rows = points(seed)
    df, alarms = spark.createDataFrame(rows, SCHEMA), M.alarm_table(spark, ALARMS)
    for until in (T0 + dt.timedelta(hours=30), T0 + dt.timedelta(hours=3, minutes=7)):
        got = L.alarm_transitions(df.where(F.col("ts") < F.lit(until)), alarms, F.lit(until))
        assert shown(got) == direct(rows, until)
    assert L.alarm_transitions(df.limit(0), alarms, F.lit(T0)).count() == 0


def test_stream_equals_history_over_restarts(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", L.ROCKSDB)
    src, out, check = (str(tmp_path / n) for n in ("src", "out", "check"))
    rows = points(7, hours=12)
    alarms = M.alarm_table(spark, ALARMS)
    cuts = [0, len(rows) // 3, len(rows) // 2, len(rows)]
    for low, high in zip(cuts, cuts[1:]):
        spark.createDataFrame(rows[low:high], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = L.transition_stream(E.read_stream(spark, src, SCHEMA), alarms)
        for _ in range(2):  # the second run finds nothing new
            E.run_available(stream.writeStream.format("parquet").option("path", out).outputMode("append"), check)
        until = rows[high - 1][0] - dt.timedelta(minutes=10)
        assert shown(spark.read.schema(stream.schema).parquet(out)) == direct(rows[:high], until)
