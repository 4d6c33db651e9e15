"""Evaluation set off by arriving data: once for every version of a partition that has come to rest.

Files are arrivals of their partition. Arrivals without a quiet time between them are one session; a session
that the watermark has passed is a settled version of the partition, and later files begin another. Spark's
session windows merge sessions within a task before their shuffle, so a partition that a third of all files
belong to reaches its state as a few rows per task.

Each settled version is evaluated from stored file states, so only files that are new are read, and stored
under the partition and the time it settled: a batch that is repeated leaves one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from assay.functions.text import partition_text
from assay.operators.incremental import evaluate_stored, refresh
from assay.operators.rules import Rule, named
from assay.operators.violations import scan_results
from assay.sources.audit import append_audit
from assay.streaming.events import WATERMARK

QUIET = "30 minutes"


def file_arrivals(spark: SparkSession, path: str, by: Sequence[str], files_per_trigger: int | None = None) -> DataFrame:
    """The Parquet files below a path as a stream of arrivals: the partition's values, `file` and `ts`.

    Contents are not read. Values are taken from the folder names.
    """
    reader = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    found = reader.schema(schema).load(path)
    return found.select(
        *[F.regexp_extract("path", rf"/{c}=([^/]*)/", 1).alias(c) for c in by], F.col("path").alias("file"),
        F.col("modificationTime").alias("ts"),
    )


def settled(arrivals: DataFrame, by: Sequence[str], quiet: str = QUIET, delay: str = WATERMARK) -> DataFrame:
    """`by`, `first_arrival`, `settled_at`, `files`: the sessions of each partition, for batches and streams.

    A stream gives a session once the watermark has passed `settled_at`, its last arrival plus the quiet
    time. A batch gives all sessions; limit it by `settled_at` to what has come to rest.
    """
    marked = arrivals.withWatermark("ts", delay)
    return (
        marked.groupBy(*[named(c) for c in by], F.session_window("ts", quiet).alias("w"))
        .agg(F.count("*").alias("files"))
        .select(*[named(c) for c in by], F.col("w.start").alias("first_arrival"), F.col("w.end").alias("settled_at"), "files")
    )


def evaluation_stream(
    versions: DataFrame, path: str, store: str, root: str, schema: str, by: Sequence[str], rules: Sequence[Rule],
    table: str, as_of: Column | None = None,
) -> DataStreamWriter:
    """Evaluate the partitions of `settled` versions; a scan result per version under `root`/scans."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            if batch.isEmpty():
                return
            refresh(spark, path, store, schema, by, rules)
            due = batch.select(partition_text(list(by)).alias("partition"), F.col("settled_at").alias("ts"))
            found = evaluate_stored(spark, path, store, schema, by, rules, table, as_of=as_of)
            # A partition that settled twice within a batch has a row for either time.
            scans = scan_results(found).join(due, "partition")
            append_audit(spark, scans, f"{root}/scans", ["evaluation_id", "ts"])
        finally:
            batch.unpersist()

    return versions.writeStream.foreachBatch(sink)
