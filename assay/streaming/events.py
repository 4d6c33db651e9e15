"""Streams of evaluation events and of metrics.

The batch operators work row by row on an evaluation, so they serve the stream unchanged; what
is added here is state (windows) and sinks that store every id once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.types import StructType

from assay.operators.metrics import ALARM_COLUMNS, PERIOD_SECONDS, alarm_points, alarm_values
from assay.operators.violations import scan_results, violations
from assay.sources.audit import append_audit
from assay.sources.results import sound_events

WATERMARK = "10 minutes"


def read_stream(
    spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int | None = None, source: str = "parquet"
) -> DataFrame:
    """A folder as a stream. Without `files_per_trigger` a backlog is one micro-batch.

    A number of files splits a backlog into micro-batches in the order in which files are listed.
    The watermark then moves from one to the next, so name it only where files come in time order.
    """
    reader = spark.readStream.format(source).schema(schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def run_available(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process what is there, then stop."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def write_once(
    events: DataFrame, path: str, key: Sequence[str], ts: str = "ts", append: Callable = append_audit
) -> DataStreamWriter:
    """Append one row per key to an audit table, however late or often it comes, or its batch is replayed.
    With `idindex.append_indexed` a micro-batch opens the files alone that may hold its ids.

    The stored ids alone hold repeats back: there is no watermark, so no event is too late, and no
    state per key, and repeats within a batch are combined before its shuffle.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        append(batch.sparkSession, batch, path, key, ts)

    return events.writeStream.foreachBatch(sink)


def violation_stream(events: DataFrame, root: str) -> DataStreamWriter:
    """Evaluation events → scan results and violations under `root`.

    The tables are keyed by evaluation id (and position), so a batch that is replayed, or that failed
    between the appends, leaves each row once. Events read from JSON carry `error`; those that could
    not be read go to `errors`. An empty batch is harmless.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            sound = batch
            if "error" in batch.columns:
                sound = sound_events(batch)
                broken = batch.where(F.col("error").isNotNull()).select("evaluation_id", "error", "ts")
                append_audit(spark, broken, f"{root}/errors", ["evaluation_id"])
            append_audit(spark, scan_results(sound, "stream", ["ts"]), f"{root}/scans", ["evaluation_id"])
            append_audit(
                spark, violations(sound, carry=["ts"]), f"{root}/violations", ["evaluation_id", "position"]
            )
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(sink)


def metric_windows(
    metrics: DataFrame, by: Sequence[str] = ("name",), period: int = PERIOD_SECONDS, delay: str = WATERMARK
) -> DataFrame:
    """Tumbling statistics per series; points later than the watermark are dropped."""
    return (
        metrics.withWatermark("ts", delay)
        .groupBy(F.window("ts", f"{period} seconds").alias("w"), *by)
        .agg(
            F.avg("value").alias("average"),
            F.min("value").alias("minimum"),
            F.max("value").alias("maximum"),
            F.sum("value").alias("total"),
            F.count("value").alias("sample_count"),
        )
        .select(
            F.col("w.start").alias("period_start"),
            F.col("w.end").alias("period_end"),
            *by,
            "average",
            "minimum",
            "maximum",
            "total",
            "sample_count",
        )
    )


def alarm_stream(
    metrics: DataFrame, alarms: DataFrame, period: int = PERIOD_SECONDS, delay: str = WATERMARK
) -> DataFrame:
    """The alarm windows of a metric stream, each emitted once the watermark has passed its end.

    All alarms of a stream share one period. The alarm table is small and joined by broadcast.
    """
    points = alarm_points(metrics.withWatermark("ts", delay), alarms)
    window = F.window("ts", f"{period} seconds").alias("period_start")
    values = alarm_values(points.groupBy(*ALARM_COLUMNS, window))
    return values.withColumn("period_start", F.col("period_start.start"))
