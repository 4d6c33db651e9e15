"""Shards that each hold the mixture: proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source. The row of rank r among the n of its source has the
fractional rank (r + p) / n, where the phase p, 0 <= p < 1, is drawn for the source, so that many sources of
a few rows do not meet in the middle. In order of that, every stretch of rows holds the sources in
proportion, and the order is cut into shards whose row counts are at most one apart.

Neither rank needs a source, let alone the table, in one task:

- Rows alike in key, source, size and checksum are one group with a count, combined before the shuffle. Its
  rows have consecutive ranks, whichever is which.
- The rank within a source adds the groups before it within its bin of the shuffle order to the rows of the
  bins before. A source of m groups has about sqrt(m) bins.
- The order of fractional ranks is cut into bins of equal width, which all hold as many rows, give or take
  one a source; phases are multiples of that width. How many rows of a source fall into a bin follows from its row count alone, so the rows
  before a bin are known without looking at a row, and so is how a group is cut at the bins. Groups travel
  to their bins in pieces and become rows there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.frames import written
from assay.llm.mixing import DRAW_BITS, draw

SHARDS = 24
SEED = 11
OVERHEAD = 8
LAW = "rows"


def _rows_before(bin_: str, bins: int) -> str:
    """SQL: how many of a source's n rows have a fractional rank below bin_ / bins."""
    return f"(({bin_} * n - phase + {bins - 1}L) div {bins}L)"


def _bin(rank: str, bins: int) -> str:
    return f"(({rank} * {bins}L + phase) div n)"


def _pieces(first: str, count: str, bins: int) -> Column:
    """The ranks `first` to `first + count - 1` of a source, cut at the bins: structs of bin, low, high.

    By bin, or one piece a rank where that makes fewer.
    """
    last = f"({first} + {count} - 1)"
    return F.expr(f"""
        if({count} - 1 <= {_bin(last, bins)} - {_bin(first, bins)},
           transform(sequence({first}, {last}), r -> named_struct('bin', {_bin('r', bins)}, 'low', r, 'high', r + 1)),
           transform(sequence({_bin(first, bins)}, {_bin(last, bins)}), b -> named_struct('bin', b,
             'low', greatest({first}, {_rows_before('b', bins)}),
             'high', least({first} + {count}, {_rows_before('(b + 1)', bins)}))))""")


def _ranked(groups: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Groups with `n` and `phase` of their source and `start`, the rank of their first row within it."""
    text = F.concat_ws("|", F.coalesce(F.col("key").cast("string"), F.lit("")), "size", "crc")
    bits = F.ceil(F.log2("groups") / 2).cast("int")
    of_source = sources.select(F.col("source").alias("of_source"), "n", "phase", bits.alias("bits"))
    binned = groups.withColumn("draw", draw(f"{seed}|", text, DRAW_BITS // 4)).join(
        of_source, F.col("source").eqNullSafe(F.col("of_source"))
    ).withColumn("part", F.expr(f"shiftright(draw, {DRAW_BITS} - bits)")).drop("of_source", "bits")
    lower = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = binned.groupBy("source", "part").agg(F.sum("copies").alias("rows")).select(
        F.col("source").alias("of_source"), F.col("part").alias("of_part"),
        F.coalesce(F.sum("rows").over(lower), F.lit(0)).alias("before"),
    )
    own = F.col("source").eqNullSafe(F.col("of_source")) & (F.col("part") == F.col("of_part"))
    within = Window.partitionBy("source", "part").orderBy("draw", F.col("key").asc_nulls_last(), "size", "crc")
    earlier = F.coalesce(F.sum("copies").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return binned.join(parts, own).withColumn("start", F.col("before") + earlier).select(
        "source", "key", "size", "crc", "copies", "n", "phase", "start"
    )


def _bins_before(sources: DataFrame, bins: int, bits: int) -> DataFrame:
    """`bin` and `before`, the rows in lower bins; prefix sums on two levels."""
    half = bits // 2
    counts = sources.select("n", "phase", F.inline(_pieces("0L", "n", bins))).groupBy("bin").agg(
        F.sum(F.col("high") - F.col("low")).alias("rows")
    ).withColumn("upper", F.shiftright("bin", half))
    # Some 2**(bits / 2) rows at most.
    uppers = counts.groupBy("upper").agg(F.sum("rows").alias("rows")).select(
        F.col("upper").alias("of_upper"),
        F.coalesce(F.sum("rows").over(Window.orderBy("upper").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
    )
    inner = F.sum("rows").over(Window.partitionBy("upper").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("inner", F.coalesce(inner, F.lit(0))).join(
        uppers, F.col("upper") == F.col("of_upper")
    ).select(F.col("bin").alias("of_bin"), (F.col("base") + F.col("inner")).alias("before"))


def interleave(
    docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", source: str = "source",
    seed: int = SEED,
) -> DataFrame:
    """The place of every row: `key`, `source`, `size`, `text_crc32`, `shard` and `slot` within it, from 0.

    Sizes are the bytes of the text in UTF-8 plus 8; a null text has none and the checksum 0. One row per
    row of `docs`, repeated ones included; null keys and null sources take part (all null sources are one
    source, the last). Shards differ by one row at most; where there are fewer rows than shards, some are
    empty. An empty table gives an empty one. Equal tables give equal results, however they are partitioned.
    Columns of other names are not read.
    """
    groups = written(
        docs.select(
            F.col(source).alias("source"), F.col(key).alias("key"),
            (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + OVERHEAD).cast("bigint").alias("size"),
            F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("crc"),
        ).groupBy("source", "key", "size", "crc").agg(F.count("*").alias("copies")),
        "shard-groups",
    )
    total = groups.agg(F.sum("copies")).first()[0] or 0
    bits = math.ceil(math.log2(max(total, 1)) / 2) + 2
    bins = 1 << bits
    named = F.concat(F.when(F.col("source").isNull(), "0|").otherwise("1|"), F.coalesce("source", F.lit("")))
    sources = groups.groupBy("source").agg(F.sum("copies").alias("n"), F.count("*").alias("groups")).withColumn(
        "phase", draw(f"{seed}|phase|", named, 8) % bins
    )
    pieces = _ranked(groups, sources, seed).select(
        "source", "key", "size", "crc", "n", "phase", F.inline(_pieces("start", "copies", bins))
    ).where("low < high")
    placed = pieces.repartition("bin").join(_bins_before(sources, bins, bits), F.col("bin") == F.col("of_bin"))
    rows = placed.withColumn("rank", F.explode(F.sequence("low", F.col("high") - 1)))
    share = (F.col("rank") * bins + F.col("phase")).cast("double") / (F.col("n") * bins).cast("double")
    in_bin = Window.partitionBy("bin").orderBy("share", F.col("source").asc_nulls_last())
    place = F.col("before") + F.row_number().over(in_bin) - 1
    shard = F.expr(f"(place * {shards}) div {max(total, 1)}L")
    slot = F.expr(f"place - (shard * {total}L + {shards - 1}) div {shards}")
    return (
        rows.withColumn("share", share).withColumn("place", place)
        .withColumn("shard", shard).withColumn("slot", slot)
        .select(
            F.col("key").alias(key), F.col("source").alias(source), "size", F.col("crc").alias("text_crc32"),
            F.col("shard").cast("int").alias("shard"), "slot",
        )
    )
