"""Audit tables: append-only, with a content-derived id, so that a replay changes nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from assay.operators.retention import expiry
from assay.sources.partitions import path_exists

DAY = "ds"
BUCKET = "id_bucket"


def audit_id(natural_key: Sequence[str]) -> Column:
    """The id of an audit row: a hash of the columns that make it the same row."""
    return F.sha2(F.to_json(F.struct(*natural_key), {"ignoreNullFields": "false", "timeZone": "UTC"}), 256)


def _utc_day(ts: Column) -> Column:
    """The day as text, the same in sessions of any time zone."""
    days = F.floor(F.unix_seconds(ts.cast("timestamp")) / 86400).cast("int")
    return F.date_from_unix_date(days).cast("string")


def audit_rows(rows: DataFrame, natural_key: Sequence[str], ts: str = "ts") -> DataFrame:
    """Rows with their id, expiry, day and bucket. Of rows with one id the earliest stays, so that
    a batch in any order gives the same rows; repeats are combined map-side."""
    named = (
        rows.withColumn("audit_id", audit_id(natural_key))
        .withColumn("ttl", expiry(F.col(ts)))
        .withColumn(DAY, _utc_day(F.col(ts)))
    )
    first = named.groupBy("audit_id").agg(F.min_by(F.struct(*named.columns), F.col(ts)).alias("r"))
    return first.select("r.*", _bucket(F.col("audit_id")).alias(BUCKET))


def _bucket(id_: Column) -> Column:
    """The folder of an id: its first hex digit. It depends on the id alone, whatever the row's day."""
    return F.substring(id_, 1, 1)


def append_audit(
    spark: SparkSession, rows: DataFrame, path: str, natural_key: Sequence[str], ts: str = "ts"
) -> None:
    """Append the rows an audit table does not hold yet, whenever their ids were stored.

    The table is laid out by a bucket of the id, so a row that comes back on another day meets its
    earlier copy. Only the buckets of the batch are read back, and of those the id column only. The
    batch is computed once and kept on disk meanwhile; lost blocks are computed again.
    """
    new = audit_rows(rows, natural_key, ts).persist(StorageLevel.DISK_ONLY)
    try:
        fresh = new
        if path_exists(spark, path):
            # Sixteen at most; they prune the table's folders.
            buckets = [row[BUCKET] for row in new.select(BUCKET).distinct().collect()]
            known = spark.read.schema(f"audit_id string, {BUCKET} string").parquet(path)
            fresh = new.join(known.where(F.col(BUCKET).isin(buckets)).select("audit_id"), "audit_id", "left_anti")
        fresh.hint("rebalance", F.col(BUCKET)).write.mode("append").partitionBy(BUCKET).parquet(path)
    finally:
        new.unpersist()
