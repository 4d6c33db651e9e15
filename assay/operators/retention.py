"""Expiry of audit rows and of quarantined data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.session import scratch_dir

# Fixed value.
RETENTION_DAYS = 90


def expiry(ts: Column, days: int = RETENTION_DAYS) -> Column:
    """Seconds since 1970 at which a row written at `ts` expires."""
    return F.unix_seconds(ts.cast("timestamp")) + days * 86400


def live_rows(df: DataFrame, as_of: Column, ttl: str = "ttl") -> DataFrame:
    """Rows not yet expired at a reference time. Tables without expiry (baselines) stay whole."""
    return df.where(F.col(ttl) > F.unix_seconds(as_of.cast("timestamp")))


# The zone's folder level of the day a copy was written on.
DAY = "written_on"


def with_folder(zone: DataFrame) -> DataFrame:
    """Rows with the folder of their file, as the file listing spells it."""
    return zone.withColumn("folder", F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", ""))


def remove_folders(spark: SparkSession, folders: DataFrame) -> None:
    """Delete the folders in column `folder`, one partition of names at a time on the driver, as the
    file system calls need them there. A folder that cannot be deleted raises."""
    jvm = spark._jvm
    hadoop = spark._jsc.hadoopConfiguration()
    for row in folders.toLocalIterator():
        target = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(row["folder"]))
        files = target.getFileSystem(hadoop)
        if files.exists(target) and not files.delete(target, True):
            raise OSError(f"could not delete {row['folder']}")


def expire_quarantine(
    spark: SparkSession, path: str, keys: Sequence[str], as_of: Column, days: int = RETENTION_DAYS
) -> None:
    """Remove quarantined rows older than the retention time, folder by folder.

    Where the zone has a level for the day of writing, later days are not even listed, and earlier ones
    are dropped by their names; only the day of the cutoff is read. A folder with both kinds of rows is
    rewritten: its live rows go to scratch space first and come back from there, so that they exist
    outside the folder while it is replaced. Every step can be repeated.
    """
    zone = with_folder(spark.read.option("basePath", path).schema(_as_text(spark, path, keys)).parquet(path))
    cutoff = as_of.cast("timestamp") - F.expr(f"interval {days} days")
    live = F.col("written_at").cast("timestamp") >= cutoff
    if DAY in zone.columns:
        day = spark.range(1).select(F.date_format(cutoff, "yyyy-MM-dd").alias("d")).first()["d"]
        remove_folders(spark, zone.where(F.col(DAY) < day).select("folder").distinct())
        spark.catalog.refreshByPath(path)
        zone = with_folder(spark.read.option("basePath", path).schema(_as_text(spark, path, keys)).parquet(path))
        zone = zone.where(F.col(DAY) == day)
    ages = zone.groupBy("folder").agg(F.count_if(live).alias("live"), F.count_if(~live).alias("dead")).where("dead > 0")
    scratch = scratch_dir(spark, "expiry")
    ages.write.parquet(f"{scratch}/ages")
    touched = spark.read.parquet(f"{scratch}/ages")
    if not touched.where("live > 0").isEmpty():
        mixed = touched.where("live > 0").select(F.col("folder").alias("mixed"))
        kept = zone.join(mixed, F.col("folder") == F.col("mixed"), "left_semi").where(live).drop("folder")
        kept.write.parquet(f"{scratch}/kept")
        levels = [*keys, *([DAY] if DAY in zone.columns and DAY not in keys else [])]
        (
            spark.read.schema(kept.schema).parquet(f"{scratch}/kept")
            .hint("rebalance", *[F.col(k) for k in levels])
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*levels)
            .parquet(path)
        )
    remove_folders(spark, touched.where("live = 0").select("folder"))


def _as_text(spark: SparkSession, path: str, keys: Sequence[str]):
    """The zone's schema with its partition keys as text."""
    from pyspark.sql import types as T

    found = spark.read.option("basePath", path).parquet(path).schema
    texts = {*keys, DAY}
    return T.StructType(
        [T.StructField(f.name, T.StringType() if f.name in texts else f.dataType) for f in found]
    )
