"""Bounds of a column learned from its own clean partitions, out of mergeable quantile sketches.

A KLL sketch per partition and column is taken in one scan, stored with the baselines, and merged over the
partitions that were clean: their rows are not read again. Ranks of a merged sketch are off by a known share
of the rows at most. The bounds are the median plus and minus a number of robust deviations (median absolute
deviation, scaled to a normal distribution's), so a few wild values in a clean partition do not widen them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.operators.rules import named

# Sketches of this size are off by some 0.33 % of the rows in rank, with 99 % confidence, merged or not.
SKETCH_SIZE = 800
RANK_ERROR = 0.0033
# Quantiles that the deviation is taken from, at equal ranks.
LEVELS = 1000
# The median absolute deviation of a normal distribution, as a share of its standard deviation.
NORMAL_MAD = 0.6745


def sketched(df: DataFrame, columns: Sequence[str], by: Sequence[str], size: int = SKETCH_SIZE) -> DataFrame:
    """`by`, `column`, `value_count`, `sketch`: one row per partition and column, from one scan.

    Nulls and NaN are left out. A column without a value in a partition has no row there.
    """
    def value(c: str) -> Column:
        return F.nanvl(named(c).cast("double"), F.lit(None).cast("double"))

    aggregates = [F.kll_sketch_agg_double(value(c), F.lit(size)).alias(f"k{i}") for i, c in enumerate(columns)]
    aggregates += [F.count(value(c)).alias(f"n{i}") for i, c in enumerate(columns)]
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("value_count"), F.col(f"k{i}").alias("sketch"))
        for i, c in enumerate(columns)
    ])
    grouped = df.groupBy(*[named(c) for c in by]).agg(*aggregates)
    return grouped.select(*[named(c) for c in by], F.inline(rows)).where("value_count > 0")


def clean_partitions(scans: DataFrame) -> DataFrame:
    """`table_name` and `partition` of the scans whose newest result has no violation."""
    newest = scans.groupBy("table_name", "partition").agg(F.max_by("violation_count", F.struct("ts", "evaluation_id")).alias("n"))
    return newest.where("n = 0").drop("n")


def merged_quantiles(sketches: DataFrame, levels: Sequence[float], by: Sequence[str] = ("column",), size: int = SKETCH_SIZE) -> DataFrame:
    """`by`, `partitions`, `value_count`, `quantiles` of sketches put together, one row per column."""
    merged = sketches.groupBy(*by).agg(
        F.count("*").alias("partitions"), F.sum("value_count").alias("value_count"),
        F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"),
    )
    ranks = F.array(*[F.lit(float(x)) for x in levels])
    return merged.withColumn("quantiles", F.kll_sketch_get_quantile_double("sketch", ranks)).drop("sketch")


def learned_bounds(
    sketches: DataFrame, deviations: float = 6.0, by: Sequence[str] = ("column",), size: int = SKETCH_SIZE
) -> DataFrame:
    """`by`, `partitions`, `value_count`, `median`, `deviation`, `lo`, `hi` from the sketches of clean partitions.

    Where half of the values are equal the deviation is 0; the bounds are then the outermost quantiles, so
    that a column of few values is not refused its others.
    """
    found = merged_quantiles(sketches, [(2 * i + 1) / (2 * LEVELS) for i in range(LEVELS)], by, size)
    middle = F.col("quantiles")[LEVELS // 2]
    gaps = F.array_sort(F.transform("quantiles", lambda q: F.abs(q - F.col("median"))))
    spread = found.withColumn("median", middle).withColumn("deviation", gaps[LEVELS // 2] / NORMAL_MAD)
    reach = deviations * F.col("deviation")
    flat = F.col("deviation") == 0
    return spread.select(
        *by, "partitions", "value_count", "median", "deviation",
        F.when(flat, F.col("quantiles")[0]).otherwise(F.col("median") - reach).alias("lo"),
        F.when(flat, F.col("quantiles")[LEVELS - 1]).otherwise(F.col("median") + reach).alias("hi"),
    )


def bound_lines(bounds: DataFrame) -> DataFrame:
    """A rule line per learned column, as `rules.rules_from_text` and `load_rules` read them."""
    def number(c: str) -> Column:
        return F.col(c).cast("decimal(38,6)").cast("string")

    return bounds.select("*", F.concat(F.lit('ColumnValues "'), "column", F.lit('" between '), number("lo"), F.lit(" and "), number("hi")).alias("rule_text"))
