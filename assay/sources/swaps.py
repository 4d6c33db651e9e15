"""Restore partitions by a staged swap: written beside, counted, then moved in the catalog.

The old data stay where they are. A swap is logged with old and new places before the first partition moves,
so it can be rolled back, or carried on after a failure; readers see a partition's old folder or its new one,
never half of one. What no partition points to any more is removed later, by the age of its swap.
"""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.operators.rules import named
from assay.sources.partitions import partition_folders, path_exists, write_partitions

LOG = "swap string, swapped_at timestamp, spec array<struct<name:string,value:string>>, old string, new string"


class CountMismatch(RuntimeError):
    """What was staged is not what was to be restored."""


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def _folder(spark: SparkSession, value: str) -> str:
    """A partition value as the writer spells it in a folder's name."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def _spec(pairs) -> str:
    return "PARTITION (" + ", ".join(f"`{p['name']}`='{_quoted(p['value'])}'" for p in pairs) + ")"


def location(spark: SparkSession, table: str, pairs) -> str | None:
    """Where a partition's data lie, by the catalog; None for a partition it does not know."""
    values = ", ".join(f"`{p['name']}`='{_quoted(p['value'])}'" for p in pairs)
    known = spark.sql(f"SHOW PARTITIONS {table} PARTITION ({values})")
    if known.isEmpty():
        return None
    rows = spark.sql(f"DESCRIBE EXTENDED {table} PARTITION ({values})").where("col_name = 'Location'")
    return rows.first()["data_type"]


def stage(spark: SparkSession, clean: DataFrame, staging: str, keys: Sequence[str]) -> tuple[str, list[tuple[str, ...]]]:
    """Write the partitions of `clean` to a new folder and count them; returns it and the partitions."""
    path = f"{staging.rstrip('/')}/swap={uuid4().hex}"
    write_partitions(clean, path, keys, "errorifexists", rebalance=False)
    want = clean.groupBy(*[named(k).cast("string").alias(k) for k in keys]).count()
    schema = clean.select(*[c for c in clean.columns if c not in keys], *[named(k).cast("string").alias(k) for k in keys]).schema
    found = spark.read.schema(schema).parquet(path).groupBy(*keys).count()
    if not want.exceptAll(found).isEmpty() or not found.exceptAll(want).isEmpty():
        raise CountMismatch(f"{path} does not hold the rows that were to be restored")
    return path, partition_folders(spark, path, keys)


def restore_swapped(
    spark: SparkSession, table: str, clean: DataFrame, staging: str, log: str, keys: Sequence[str]
) -> str:
    """Point the table's partitions to a staged copy of `clean`; returns the swap's id.

    Partitions that `clean` has no row of stay as they are. The catalog moves one partition at a time, each
    at once; after a failure `finish` moves the rest and `roll_back` all of them back. Partition names come
    to the driver, as the catalog needs them there.
    """
    path, partitions = stage(spark, clean, staging, keys)
    swap = path.rsplit("=", 1)[1]
    moves = []
    for values in partitions:
        pairs = [{"name": k, "value": v} for k, v in zip(keys, values)]
        new = f"{path}/" + "/".join(f"{k}={_folder(spark, v)}" for k, v in zip(keys, values))
        moves.append((swap, pairs, location(spark, table, pairs), new))
    rows = spark.createDataFrame(moves, "swap string, spec array<struct<name:string,value:string>>, old string, new string")
    rows.withColumn("swapped_at", F.current_timestamp()).select("swap", "swapped_at", "spec", "old", "new").write.mode("append").parquet(log)
    finish(spark, table, log, swap)
    return swap


def _moves(spark: SparkSession, log: str, swap: str) -> list:
    return spark.read.schema(LOG).parquet(log).where(F.col("swap") == swap).collect()


def _point(spark: SparkSession, table: str, pairs, place: str) -> None:
    spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {_spec(pairs)} LOCATION '{_quoted(place)}'")
    spark.sql(f"ALTER TABLE {table} {_spec(pairs)} SET LOCATION '{_quoted(place)}'")


def finish(spark: SparkSession, table: str, log: str, swap: str) -> None:
    """Move every partition of a swap; repeating it changes nothing."""
    for move in _moves(spark, log, swap):
        _point(spark, table, move["spec"], move["new"])
    spark.catalog.refreshTable(table)


def roll_back(spark: SparkSession, table: str, log: str, swap: str) -> None:
    """Point every partition of a swap to where it was; partitions that were new are forgotten."""
    for move in _moves(spark, log, swap):
        if move["old"] is None:
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {_spec(move['spec'])}")
        else:
            _point(spark, table, move["spec"], move["old"])
    spark.catalog.refreshTable(table)


def remove_replaced(spark: SparkSession, table: str, log: str, before) -> list[str]:
    """Delete folders, old or new, of swaps before a time that no partition points to; returns them."""
    if not path_exists(spark, log):
        return []
    rows = spark.read.schema(LOG).parquet(log)
    aged = rows.where(F.col("swapped_at") < F.lit(before)).select("spec", F.explode(F.array("old", "new")).alias("folder"))
    # A folder that a younger swap would go back to stays.
    kept = rows.where(F.col("swapped_at") >= F.lit(before)).select(F.explode(F.array("old", "new")).alias("folder"))
    gone = []
    for row in aged.where("folder IS NOT NULL").join(kept, "folder", "left_anti").distinct().toLocalIterator():
        target = spark._jvm.org.apache.hadoop.fs.Path(row["folder"])
        files = target.getFileSystem(spark._jsc.hadoopConfiguration())
        now = location(spark, table, row["spec"])
        if now is not None and files.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(now)).equals(files.makeQualified(target)):
            continue
        if files.exists(target):
            files.delete(target, True)
            gone.append(row["folder"])
    return gone
