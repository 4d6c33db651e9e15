"""Partitioned ingest: which partitions are there, which are missing, write, register, restore."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import islice
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.text import NULL_PARTITION

# Present partitions that become a filter of the plan; more are joined.
MAX_LISTED = 1000
# Partition specs per ALTER TABLE statement.
_REGISTER_BATCH = 500


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def partition_folders(spark: SparkSession, path: str, keys: Sequence[str]) -> list[tuple[str, ...]]:
    """Partition values under a path, from its folders, level by level; data files are not listed.

    A folder counts if its last level holds anything. Partition names are what a catalog keeps on the
    driver too.
    """
    if not path_exists(spark, path):
        return []
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    level = [(root, ())]
    for key in keys:
        below = []
        for folder, values in level:
            for status in files.listStatus(folder):
                name = status.getPath().getName()
                if status.isDirectory() and name.startswith(f"{key}="):
                    below.append((status.getPath(), (*values, unquote(name[len(key) + 1 :]))))
        level = below
    return sorted(values for folder, values in level if files.listStatusIterator(folder).hasNext())


def existing_partitions(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Partition values present under a path as a table of texts."""
    schema = T.StructType([T.StructField(k, T.StringType()) for k in keys])
    return spark.createDataFrame(partition_folders(spark, path, keys), schema)


def partition_name(keys: Sequence[str]) -> Column:
    """The values of a row's partition as one text; null is spelled as its folder."""
    return F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit(NULL_PARTITION)) for k in keys])


def month_calendar(spark: SparkSession, start_year: int, start_month: int, months: int) -> DataFrame:
    """Consecutive (year, month) texts, the year rolling over after December."""
    first = F.make_date(F.lit(start_year), F.lit(start_month), F.lit(1))
    steps = spark.range(months).select(F.add_months(first, F.col("id").cast("int")).alias("d"))
    return steps.select(
        F.lpad(F.year("d").cast("string"), 4, "0").alias("year"),
        F.lpad(F.month("d").cast("string"), 2, "0").alias("month"),
    )


def missing_partitions(wanted: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    return wanted.join(present.select(*keys).distinct(), list(keys), "left_anti")


def write_partitions(
    df: DataFrame, path: str, keys: Sequence[str], mode: str = "append", rebalance: bool = True
) -> None:
    """Partitioned Parquet. Overwriting touches only the partitions in the frame.

    `rebalance` lets AQE shape the files: small partitions are merged into one task, a hot one is
    split over several. Pass False for input that already lies partition by partition, which then
    is written without a shuffle.
    """
    out = df.hint("rebalance", *[F.col(k) for k in keys]) if rebalance else df
    (
        out.write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def ingest_partitions(
    df: DataFrame, path: str, keys: Sequence[str], overwrite: bool = False, rebalance: bool = True
) -> None:
    """Write a frame's partitions: skip those already there, or overwrite them.

    What is there becomes a filter on the partition columns. If the frame is a scan that is partitioned by
    them, the skipped partitions are not read. Beyond MAX_LISTED partitions they are a table to join with, so
    that the plan does not grow with them.
    """
    if overwrite:
        write_partitions(df, path, keys, "overwrite", rebalance)
        return
    there = partition_folders(df.sparkSession, path, keys)
    new = df
    if len(there) > MAX_LISTED:
        present = df.sparkSession.createDataFrame([("/".join(values),) for values in there], "_present string")
        new = df.join(present, partition_name(keys) == F.col("_present"), "left_anti")
    elif there:
        new = df.where(~partition_name(keys).isin(["/".join(values) for values in there]))
    write_partitions(new, path, keys, "append", rebalance)


def known_partitions(spark: SparkSession, table: str, keys: Sequence[str]) -> DataFrame:
    """Partitions the catalog knows of a table."""
    shown = spark.sql(f"SHOW PARTITIONS {table}")
    return shown.select(*[F.regexp_extract("partition", rf"(?:^|/){k}=([^/]*)", 1).alias(k) for k in keys])


def register_partitions(spark: SparkSession, table: str, wanted: DataFrame, keys: Sequence[str]) -> None:
    """Make the catalog know the wanted partitions. Repeating it changes nothing.

    Only the partition values it lacks come to the driver, a batch at a time, as the catalog
    call needs them there.
    """
    new = missing_partitions(wanted.select(*keys).distinct(), known_partitions(spark, table, keys), keys)
    rows = new.toLocalIterator()
    while batch := list(islice(rows, _REGISTER_BATCH)):
        specs = " ".join(
            "PARTITION (" + ", ".join("{}='{}'".format(k, str(row[k]).replace("'", "\\'")) for k in keys) + ")"
            for row in batch
        )
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {specs}")


def create_fact_table(spark: SparkSession, table: str, schema: str, path: str, keys: Sequence[str]) -> None:
    """An external Parquet table over a partitioned path, with no partition registered."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({schema}) USING parquet "
        f"PARTITIONED BY ({', '.join(keys)}) LOCATION '{path}'"
    )


def restore_partitions(
    spark: SparkSession,
    clean: DataFrame,
    path: str,
    keys: Sequence[str],
    clear: Sequence[str] = (),
    rebalance: bool = False,
) -> None:
    """Overwrite partitions from the clean copy, and empty the audit tables named in `clear`.

    The clean copy lies partition by partition, so the default writes it without a shuffle.
    """
    write_partitions(clean, path, keys, "overwrite", rebalance)
    for audit in clear:
        if path_exists(spark, audit):
            empty = spark.createDataFrame([], spark.read.parquet(audit).schema)
            empty.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(audit)
