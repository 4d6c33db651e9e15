"""Scan history, schema baselines and the newest-first reads over audit tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCAN_KEY = ("table_name", "partition")
CONTEXT_SCANS = 5
CONTEXT_SHOWN = 3


def newest_per_key(
    df: DataFrame, n: int, by: Sequence[str] = SCAN_KEY, ts: str = "ts", tie: str = "evaluation_id"
) -> DataFrame:
    """The newest `n` rows per key, numbered from 1 in `recency`.

    Spark limits each key to `n` rows before the shuffle, so a key with a third of all rows
    sends no more than `n` rows per task.
    """
    order = Window.partitionBy(*by).orderBy(F.desc(ts), F.col(tie))
    return df.withColumn("recency", F.row_number().over(order)).where(F.col("recency") <= n)


def history_per_key(scans: DataFrame, n: int = CONTEXT_SCANS, shown: int = CONTEXT_SHOWN) -> DataFrame:
    """One row per table and partition: number of scans found (at most `n`) and the newest few."""
    entry = F.struct("recency", "ts", "evaluation_id", "overall_score", "overall_status", "violation_count")
    return (
        newest_per_key(scans, n)
        .groupBy(*SCAN_KEY)
        .agg(
            F.count("*").alias("previous_scans"),
            F.count_if(F.col("violation_count") > 0).alias("failing_scans"),
            # At most n entries per key.
            F.slice(F.sort_array(F.collect_list(entry)), 1, shown).alias("scans"),
        )
    )


def history_context(violations: DataFrame, scans: DataFrame) -> DataFrame:
    """Violations with their partition's history; no table or partition → no history.

    The current scan is part of it once it has been stored. Only the scans of violated keys are ranked:
    the few keys filter the history before its window.
    """
    asked = violations.select(*SCAN_KEY).where((F.col("table_name") != "") & (F.col("partition") != "")).distinct()
    history = history_per_key(scans.join(asked, list(SCAN_KEY), "left_semi"))
    return violations.join(history, list(SCAN_KEY), "left").withColumns(
        {
            "previous_scans": F.coalesce("previous_scans", F.lit(0)),
            "failing_scans": F.coalesce("failing_scans", F.lit(0)),
        }
    )


def newest(df: DataFrame, n: int, ts: str = "ts", tie: str = "evaluation_id") -> DataFrame:
    """The newest `n` rows of all, as a report: each task keeps `n` rows, the rest is dropped."""
    return df.orderBy(F.desc(ts), F.col(tie)).limit(n)


def split_key(df: DataFrame, pk: str = "pk") -> DataFrame:
    """`table#partition` at the first `#`, without replacing values already there."""
    at = F.instr(F.col(pk), "#")
    table = F.when(at > 0, F.substring_index(pk, "#", 1)).otherwise(F.col(pk))
    partition = F.when(at > 0, F.substr(F.col(pk), at + 1)).otherwise("")

    def kept(name: str, value):
        return F.coalesce(F.col(name), value) if name in df.columns else value

    return df.withColumns({"table_name": kept("table_name", table), "partition": kept("partition", partition)})


def remediation_history(
    remediations: DataFrame, table: str | None = None, limit: int = 50, tie: str = "issue_id"
) -> DataFrame:
    """Newest remediations, of one table if named: the filter comes before the limit."""
    rows = remediations.where(F.col("table_name") == table) if table else remediations
    return newest(rows, limit, tie=tie)


def latest_baseline(baselines: DataFrame) -> DataFrame:
    """The newest baseline per database and table; versions are numbers, so 10 follows 9."""
    rest = [c for c in baselines.columns if c not in ("database", "table_name", "version")]
    return (
        baselines.groupBy("database", "table_name")
        .agg(F.max_by(F.struct("version", *rest), "version").alias("b"))
        .select("database", "table_name", "b.*")
    )


def next_baseline(new: DataFrame, baselines: DataFrame) -> DataFrame:
    """New baselines with the version after the newest stored one, 1 for a new table."""
    last = baselines.groupBy("database", "table_name").agg(F.max("version").alias("last"))
    return (
        new.join(last, ["database", "table_name"], "left")
        .withColumn("version", F.coalesce("last", F.lit(0)) + 1)
        .drop("last")
    )


def before_score(keys: DataFrame, scans: DataFrame) -> DataFrame:
    """The newest stored score per table and partition, 0.0 where there is none.

    Only the scans of the keys asked for are aggregated: the few keys filter the history first.
    """
    asked = keys.select(*SCAN_KEY).distinct()
    last = scans.join(asked, list(SCAN_KEY), "left_semi").groupBy(*SCAN_KEY).agg(
        F.max_by("overall_score", F.struct("ts", "evaluation_id")).cast("double").alias("before_score")
    )
    return keys.join(last, list(SCAN_KEY), "left").withColumn(
        "before_score", F.coalesce("before_score", F.lit(0.0))
    )
