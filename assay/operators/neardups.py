"""Rows that nearly repeat an earlier one: equal in some columns, within a tolerance in others.

Rows whose equal columns nobody shares drop out first, by a count that moves their hashes only. Of the rest, rows
alike in all of these columns are one with a count, combined before the shuffle; they lie on a grid whose cells are as wide as the tolerances. Any two rows
of a cell are near duplicates, so all but its first are counted without a comparison. The first of a cell,
its representative, is compared with the rows of the neighbouring cells that its tolerance reaches: a row
meets 3^k - 1 representatives at most for k columns, however many rows are alike.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.severity import uniqueness_severity
from assay.operators.rules import named
from assay.session import scratch_dir

# The cell of a missing value, which is near to missing values only.
_NOWHERE = -(1 << 62)
_EDGE = 1e-9


def _cell(x: Column, width: float) -> Column:
    return F.coalesce(F.floor(x / width).cast("bigint"), F.lit(_NOWHERE))


def _reached(x: Column, width: float, up: bool) -> Column:
    """The cells that a value within the tolerance of x may lie in; without `up`, one that is not above x."""
    low, high = F.floor(x / width - 1 - _EDGE), F.floor(x / width + 1 + _EDGE) if up else F.floor(x / width)
    return F.when(x.isNull(), F.array(F.lit(_NOWHERE))).otherwise(F.sequence(low.cast("bigint"), high.cast("bigint")))


def _keyed(df: DataFrame, exact: Sequence[str], near: Mapping[str, float], by: Sequence[str]) -> tuple[DataFrame, DataFrame, list[str], dict[str, str]]:
    """The rows with `_block`, a hash of what has to be equal, and the hashes that several rows have."""
    if not near or min(near.values()) <= 0:
        raise ValueError("at least one column with a positive tolerance")
    block = [*by, *[c for c in exact if c not in by]]
    names = {c: f"_near_{i}" for i, c in enumerate(near)}
    values = [F.nanvl(named(c).cast("double"), F.lit(None).cast("double")).alias(n) for c, n in names.items()]
    rows = df.select(*[named(c) for c in block], *values).withColumn("_block", F.xxhash64(F.struct(*[named(c) for c in block])))
    return rows, rows.groupBy("_block").agg(F.count("*").alias("n")).where("n > 1").select("_block"), block, names


def _crowded(rows: DataFrame, shared: DataFrame, block: list[str], names: dict[str, str], near: Mapping[str, float]) -> DataFrame:
    """The distinct rows whose block others share, with `copies` and `repeats`. They are stored once, as several
    steps start from them."""
    # Two hashes stand for the block in the joins; the columns themselves decide.
    distinct = rows.join(shared, "_block", "left_semi").groupBy("_block", *[named(c) for c in block], *names.values()).agg(F.count("*").alias("copies"))
    path = scratch_dir(rows.sparkSession, "crowded")
    distinct.toDF("_block", *[f"_key_{i}" for i in range(len(block))], *names.values(), "copies").write.parquet(path)
    crowded = rows.sparkSession.read.parquet(path).toDF(*distinct.columns)
    crowded = crowded.withColumn("_row", F.struct(*names.values()))
    crowded = crowded.withColumn("_cell", F.array(*[_cell(F.col(n), near[c]) for c, n in names.items()]))
    crowded = crowded.withColumn("_at", F.xxhash64("_block", "_cell"))
    firsts = crowded.groupBy("_block", "_cell", "_at", *[named(c) for c in block]).agg(F.min("_row").alias("_first"))
    same_block = reduce(lambda a, b: a & b, [F.col(f"f.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in block], F.lit(True))
    # Representatives ask for the cells they reach, by hashes; those that exist are compared. What is earlier is
    # not above in the first column.
    reach = reduce(
        lambda done, step: F.flatten(F.transform(done, lambda d: F.transform(step, lambda s: F.concat(d, F.array(s))))),
        [_reached(F.col("_first")[n], near[c], i > 0) for i, (c, n) in enumerate(names.items())],
        F.array(F.array().cast("array<bigint>")),
    )
    sent = firsts.select("_block", "_cell", F.col("_at").alias("_from"), F.explode(reach).alias("_to")).where(F.col("_to") != F.col("_cell"))
    asked = sent.select("_from", F.xxhash64("_block", "_to").alias("_at"))
    there = asked.join(firsts.select("_at"), "_at", "left_semi").withColumnRenamed("_at", "_asked")
    close = reduce(
        lambda a, b: a & b,
        [
            (F.col("f._first")[n].isNull() & F.col("r._row")[n].isNull())
            | (F.abs(F.col("f._first")[n] - F.col("r._row")[n]) <= near[c])
            for c, n in names.items()
        ],
    )
    asking = firsts.join(there, F.col("_at") == F.col("_from")).select("_block", *[named(c) for c in block], "_first", "_asked")
    met = asking.alias("f").join(
        crowded.alias("r"),
        (F.col("f._block") == F.col("r._block")) & (F.col("f._asked") == F.col("r._at")) & same_block
        & (F.col("r._row") < F.col("f._first")) & F.coalesce(close, F.lit(False)),
        "left_semi",
    )
    repeated = met.select("_block", *[named(c) for c in block], F.col("_first"), F.lit(True).alias("_met")).distinct()
    joined = crowded.alias("r").join(
        firsts.select("_block", "_cell", *[named(c) for c in block], "_first").alias("f"),
        (F.col("f._block") == F.col("r._block")) & (F.col("f._cell") == F.col("r._cell")) & same_block,
    ).select("r.*", "f._first")
    again = joined.alias("r").join(
        repeated.alias("f"),
        (F.col("f._block") == F.col("r._block")) & (F.col("r._row") == F.col("f._first")) & same_block, "left",
    )
    return again.select("r.*", ((F.col("r._row") != F.col("r._first")) | F.col("f._met").isNotNull()).alias("repeats"))


def first_rows(df: DataFrame, exact: Sequence[str], near: Mapping[str, float], by: Sequence[str]) -> DataFrame:
    """The distinct rows (`by`, `exact`, `near`) with `copies`, their number, and `repeats`: is an earlier row of
    the partition equal in `exact` and within the tolerance in every column of `near`?

    Earlier means smaller in the columns of `near`, in their order, missing values first. Missing values are
    near to each other and to nothing else; NaN counts as missing. Cells are counted in 64 bits: values must
    stay below 2^61 tolerances.
    """
    rows, shared, block, names = _keyed(df, exact, near, by)
    single = rows.join(shared, "_block", "left_anti").withColumns({"copies": F.lit(1).cast("bigint"), "repeats": F.lit(False)})
    columns = [*[named(c) for c in block], *[F.col(n).alias(c) for c, n in names.items()], "copies", "repeats"]
    return _crowded(rows, shared, block, names, near).select(*columns).unionByName(single.select(*columns))


def near_uniqueness(df: DataFrame, exact: Sequence[str], near: Mapping[str, float], by: Sequence[str]) -> DataFrame:
    """`by`, `row_count`, `near_repeats`, `duplicate_share` and its `severity` per partition.

    A row counts as a repeat if it equals or nearly equals an earlier row of its partition.
    """
    rows, shared, block, names = _keyed(df, exact, near, by)
    crowded = _crowded(rows, shared, block, names, near)
    keys, none = [named(c) for c in by], F.lit(0).cast("bigint")
    repeats = F.col("copies") - F.when(F.col("repeats"), 0).otherwise(1)
    totals = df.groupBy(*keys).agg(F.count("*").alias("row_count"), F.max(none).alias("near_repeats"))
    counts = totals.unionByName(crowded.select(*keys, none.alias("row_count"), repeats.alias("near_repeats")))
    out = counts.groupBy(*keys).agg(F.sum("row_count").alias("row_count"), F.sum("near_repeats").alias("near_repeats"))
    share = F.col("near_repeats") / F.col("row_count")
    return out.withColumn("duplicate_share", share).withColumn("severity", F.coalesce(uniqueness_severity(share), F.lit("OK")))
