"""Mixing sources to target weights by systematic sampling.

Within a source, ordered by size, the expected copies of the documents are summed up, one random offset
is added, and a document is emitted once for every integer that its part of the sum crosses. All
documents of a source expect the same number of copies, so the prefix sum is that rate times the rank.

The rank is found on two levels, so that no task holds a source: counts by (source, size) and by a bin of
the order within it, whose prefix sums are added to the row number within a bin. A group of m rows of one
size has about sqrt(m) bins of sqrt(m) rows. Only the table of sources, one row each, is ordered as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.frames import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
SEED = 29
DRAW_BITS = 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def draw(label: str, value: Column, digits: int) -> Column:
    """A number from the first hex digits of an md5, which any SQL engine can repeat."""
    digest = F.md5(F.concat(F.lit(label), value).cast("binary"))
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def _whole(column: Column) -> Column:
    return column.cast("decimal(38,0)")


def source_targets(
    sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = SEED
) -> DataFrame:
    """One row per source: its size, its target, and its rate of copies as a fraction with an offset.

    Sources take the weights in turn, in code point order, null last. Targets share all words by
    weight; one that would exceed `max_copies` times its source stops there and the rest is shared
    anew. In order of size over weight the stopped sources come first, so that ends in one pass.
    """
    common = math.lcm(*weights)
    everyone = Window.partitionBy()
    by_name = everyone.orderBy(F.col("source").asc_nulls_last())
    by_fill = everyone.orderBy("fill", F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    turn = F.row_number().over(by_name) - 1
    weight = F.array(*[F.lit(w).cast("bigint") for w in weights])[(turn % len(weights)).cast("int")]
    size = _whole(F.col("source_size"))
    named = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    filled = named.withColumn("fill", size * F.lit(common) / F.col("weight")).select(
        "*",
        F.sum("source_size").over(everyone).alias("total"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("smaller"),
        F.sum("weight").over(onward).alias("weight_onward"),
    )
    stopped = _whole(F.col("weight")) * (_whole(F.col("total")) - max_copies * _whole(F.col("smaller"))) > (
        max_copies * size * _whole(F.col("weight_onward"))
    )
    shared = filled.withColumn("stopped", stopped).select(
        "source", "source_size", "weight", "stopped",
        (F.col("total") - F.coalesce(
            F.sum(F.when(F.col("stopped"), max_copies * F.col("source_size"))).over(everyone), F.lit(0)
        )).alias("rest"),
        F.sum(F.when(~F.col("stopped"), F.col("weight"))).over(everyone).alias("rest_weight"),
    )
    named_key = F.concat(F.when(F.col("source").isNull(), "0|").otherwise("1|"), F.coalesce("source", F.lit("")))
    offset = draw(f"{seed}|offset|", named_key, 8)
    share = F.col("weight") * F.col("rest")
    return shared.select(
        "source", "source_size",
        F.when(F.col("stopped"), F.lit(float(max_copies)) * F.col("source_size").cast("double"))
        .otherwise(share.cast("double") / F.col("rest_weight").cast("double"))
        .alias("target"),
        F.when(F.col("stopped"), _whole(F.lit(max_copies))).otherwise(_whole(share)).alias("numerator"),
        F.when(F.col("source_size") == 0, _whole(F.lit(0)))
        .when(F.col("stopped"), _whole(F.lit(1)))
        .otherwise(_whole(F.col("rest_weight")) * size)
        .alias("denominator"),
        offset.alias("offset"),
    )


def _ranked(sized: DataFrame) -> DataFrame:
    """Rank of every row within its source, from 0, in order of (size, draw, key)."""
    sizes = sized.groupBy("source", "size").agg(F.count("*").alias("rows"))
    smaller = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        F.col("source").alias("of_source"), F.col("size").alias("of_size"),
        F.coalesce(F.sum("rows").over(smaller), F.lit(0)).alias("before_size"),
        F.ceil(F.log2("rows") / 2).cast("int").alias("bits"),
    )
    own_size = F.col("source").eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("of_size"))
    binned = sized.join(sizes, own_size).select(
        "key", "source", "size", "draw", "before_size",
        F.expr(f"shiftright(draw, {DRAW_BITS} - bits)").alias("bin"),
    )
    bins = binned.groupBy("source", "size", "bin").agg(F.count("*").alias("rows"))
    lower = Window.partitionBy("source", "size").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(
        F.col("source").alias("of_source"), F.col("size").alias("of_size"), F.col("bin").alias("of_bin"),
        F.coalesce(F.sum("rows").over(lower), F.lit(0)).alias("before_bin"),
    )
    own_bin = own_size & (F.col("bin") == F.col("of_bin"))
    within = Window.partitionBy("source", "size", "bin").orderBy("draw", F.col("key").asc_nulls_last())
    joined = binned.join(bins, own_bin).select("key", "source", "size", "draw", "bin", "before_size", "before_bin")
    rank = F.col("before_size") + F.col("before_bin") + F.row_number().over(within) - 1
    return joined.select("key", "source", "size", rank.alias("rank"))


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[int] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = SEED,
) -> DataFrame:
    """How often the mix takes each document: `key`, `source`, `size`, `source_size`, `target`, `copies`, `taken`.

    Sizes are words; a null text has none. A source without words has the target 0 and is not taken.
    One row per row of `docs`; rows that repeat a key are taken each for itself, null keys and null
    sources take part (all null sources are one source). An empty table gives an empty one. Equal
    inputs give equal results, however they are partitioned. Columns of other names are not read.
    """
    sized = written(
        docs.select(
            F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
            draw(f"{seed}|order|", F.coalesce(F.col(key).cast("string"), F.lit("")), DRAW_BITS // 4).alias("draw"),
        ),
        "mix-sizes",
    )
    targets = source_targets(sized, weights, max_copies, seed).withColumnRenamed("source", "of_source")
    rows = _ranked(sized).join(targets, F.col("source").eqNullSafe(F.col("of_source")))
    offset = F.expr("cast(offset as decimal(38,0)) * denominator div 4294967296")
    empty = F.col("denominator") == 0
    started = rows.withColumn("start", _whole(F.when(empty, F.lit(0)).otherwise(offset)))
    copies = F.expr(
        "case when denominator = 0 then 0L else "
        "((cast(rank + 1 as decimal(38,0)) * numerator + start) div denominator) - "
        "((cast(rank as decimal(38,0)) * numerator + start) div denominator) end"
    )
    return started.withColumn("copies", copies).select(
        F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )
