"""Streams: equal to their batch twins, and stable under repeats and restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from assay.operators import violations as V
from assay.plans.catalog import ORACLE, QUERIES
from assay.streaming import events as E
from tests.oracle import compare, connect
from tests.test_goldens import CORRUPTED_MONTH, SIMULATED, evaluation

T0 = dt.datetime(2025, 9, 1)


def batch(spark, name, results, minute=0):
    return evaluation(spark, *results).withColumn("evaluation_id", F.lit(name)).withColumn(
        "ts", F.lit(T0 + dt.timedelta(minutes=minute))
    )


def test_violation_stream_and_restart(spark, tmp_path):
    src, root, check = (str(tmp_path / n) for n in ("src", "audit", "check"))
    batch(spark, "e1", SIMULATED).write.parquet(src)
    schema = spark.read.parquet(src).schema

    def run(checkpoint):
        E.run_available(E.violation_stream(E.read_stream(spark, src, schema), root), checkpoint)

    run(check)
    assert spark.read.parquet(f"{root}/violations").count() == 3
    batch(spark, "e2", CORRUPTED_MONTH, 5).write.mode("append").parquet(src)
    run(check)
    run(check)
    run(check + "_lost")  # a lost checkpoint replays everything
    stored = spark.read.parquet(f"{root}/violations")
    both = V.violations(spark.read.parquet(src)).select("evaluation_id", "position", "type", "severity", "rule")
    assert sorted(map(str, stored.select(*both.columns).collect())) == sorted(map(str, both.collect()))
    scans = {r.evaluation_id: r.overall_score for r in spark.read.parquet(f"{root}/scans").collect()}
    assert scans == {"e1": 40, "e2": 30}


def test_repeats_are_dropped_whatever_the_day(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for minute in (0, 3, 60, 3 * 1440, -5 * 1440):
        batch(spark, "e1", SIMULATED, minute).select("evaluation_id", "ts").write.mode("append").parquet(src)
    stream = E.read_stream(spark, src, spark.read.parquet(src).schema, files_per_trigger=1)
    E.run_available(E.write_once(stream, out, ["evaluation_id"]), str(tmp_path / "check"))
    assert spark.read.parquet(out).count() == 1


def test_late_evaluations_are_kept(spark, tmp_path):
    src, root = str(tmp_path / "src"), str(tmp_path / "audit")
    for n, minute in enumerate((600, 0, 300, 1)):  # far out of order, one file per micro-batch
        batch(spark, f"e{n}", SIMULATED, minute).write.mode("append").parquet(src)
    stream = E.read_stream(spark, src, spark.read.parquet(src).schema, files_per_trigger=1)
    E.run_available(E.violation_stream(stream, root), str(tmp_path / "check"))
    scans = {r.evaluation_id: r.ts for r in spark.read.parquet(f"{root}/scans").collect()}
    assert sorted(scans) == ["e0", "e1", "e2", "e3"]
    assert scans["e1"] == T0 and spark.read.parquet(f"{root}/violations").count() == 12


@pytest.mark.parametrize("name", ["stream_dedup", "stream_alarms", "stream_metric_windows"])
@pytest.mark.parametrize("order", ["time", "hash"])
def test_streams_over_many_files(spark, tmp_path, name, order):
    """The same rows from 300 files, in time order and in hash order."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    files = events.repartitionByRange(300, "ts") if order == "time" else events.repartition(300, F.xxhash64("event_id"))
    files.write.parquet(str(tmp_path / "events.parquet"))
    compare(spark, connect(str(tmp_path)), str(tmp_path), QUERIES[name], ORACLE[name])


def test_windows_close_with_the_watermark(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    rows = [(T0 + dt.timedelta(minutes=m), "a", float(m)) for m in (0, 1, 4, 5, 7, 30)]
    spark.createDataFrame(rows, "ts timestamp, name string, value double").coalesce(1).write.parquet(src)
    windows = E.metric_windows(E.read_stream(spark, src, spark.read.parquet(src).schema))
    E.run_available(
        windows.writeStream.format("parquet").option("path", out).outputMode("append"), str(tmp_path / "check")
    )
    got = {(r.period_start.minute, r.sample_count, r.total) for r in spark.read.schema(windows.schema).parquet(out).collect()}
    assert got == {(0, 3, 5.0), (5, 2, 12.0)}  # the window at 30 stays open
