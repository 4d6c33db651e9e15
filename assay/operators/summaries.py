"""Counts and details for a dashboard, as aggregates over the audit tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.operators.rules import Rule, completeness, freshness_hours, outside


def decision_summary(decisions: DataFrame) -> DataFrame:
    """Number of decisions, of distinct types and of distinct tables (empty names not counted).

    Counted per type and table first, so the distinct counts see a small frame.
    """
    return (
        decisions.groupBy("decision_type", "table_name")
        .agg(F.count("*").alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_decisions"),
            F.count_distinct("decision_type").alias("decision_types"),
            F.count_distinct(F.nullif("table_name", F.lit(""))).alias("tables_scanned"),
        )
    )


def decision_types(decisions: DataFrame) -> DataFrame:
    return decisions.select("decision_type").distinct().orderBy("decision_type")


def decision_feed(decisions: DataFrame, decision_type: str | None = None, limit: int = 30) -> DataFrame:
    """Newest decisions, of one type if named: time to the second, type, first 120 characters."""
    rows = decisions.where(F.col("decision_type") == decision_type) if decision_type else decisions
    shown = F.left(F.coalesce(F.nullif("reasoning", F.lit("")), F.lit("-")), F.lit(120))
    return (
        rows.orderBy(F.desc("ts"), "decision_id")
        .limit(limit)
        .select(
            "decision_id",
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("time"),
            "decision_type",
            shown.alias("reasoning"),
        )
    )


def quarantine_totals(remediations: DataFrame) -> DataFrame:
    quarantined = remediations.where(F.col("action_type") == "quarantine")
    return quarantined.agg(
        F.count("*").alias("actions"),
        F.coalesce(F.sum(F.coalesce("records_affected", F.lit(0))), F.lit(0)).alias("records_isolated"),
    )


def latest_scan(scans: DataFrame) -> DataFrame:
    """The newest scan of all, by one aggregate."""
    newest = F.max_by(F.struct(*scans.columns), F.struct("ts", "evaluation_id"))
    return scans.agg(newest.alias("s")).where(F.col("s").isNotNull()).select("s.*")


def violation_details(
    df: DataFrame, rules: Sequence[Rule], by: Sequence[str], as_of: Column | None = None
) -> DataFrame:
    """What each failing rule found, per partition: null share, staleness, or outliers and range.

    Completeness, freshness and value-range rules, in one aggregate.
    """
    null = F.lit(None).cast("double")
    aggregates, rows = [], []
    for i, r in enumerate(rules):
        found = {"null_pct": null, "staleness_hours": null, "outlier_pct": null, "min_found": null,
                 "max_found": null, "expected_min": null, "expected_max": null}
        count = F.lit(None).cast("bigint")
        threshold = F.lit(r.lo)
        value = F.col(f"d_{i}")
        if r.rule_type == "Completeness":
            aggregates.append(completeness(r.column).alias(f"d_{i}"))
            dimension, fails = "completeness", value < r.lo
            found["null_pct"] = F.round((F.lit(1.0) - value) * 100, 2)
        elif r.rule_type == "DataFreshness":
            aggregates.append(freshness_hours(r.column, as_of).alias(f"d_{i}"))
            dimension, fails = "freshness", value > r.lo
            found["staleness_hours"] = F.round(value, 1)
        elif r.rule_type == "ColumnValues":
            aggregates += [
                F.count_if(outside(r.column, r.lo, r.hi)).alias(f"d_{i}"),
                F.count(r.column).alias(f"n_{i}"),
                F.min(r.column).alias(f"lo_{i}"),
                F.max(r.column).alias(f"hi_{i}"),
            ]
            dimension, fails, threshold, count = "distribution", value > 0, null, value
            found["outlier_pct"] = F.round(F.try_divide(value, F.col(f"n_{i}")) * 100, 2)
            found["min_found"], found["max_found"] = F.col(f"lo_{i}"), F.col(f"hi_{i}")
            found["expected_min"], found["expected_max"] = F.lit(r.lo), F.lit(r.hi)
        else:
            continue
        row = F.struct(
            F.lit(dimension).alias("dimension"),
            F.lit(r.column).alias("column"),
            threshold.cast("double").alias("threshold"),
            count.alias("outlier_count"),
            *[v.cast("double").alias(k) for k, v in found.items()],
        )
        rows.append(F.when(fails, row))
    return df.groupBy(*by).agg(*aggregates).select(*by, F.inline(F.array_compact(F.array(*rows))))
