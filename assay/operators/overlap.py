"""Which issues hit the same rows: shared causes read off the rows themselves.

Every bad row gets a mask, one bit per predicate. One aggregate by partition and mask, combined map-side,
leaves a few rows per partition, whatever the number of bad rows; everything else works on those. A set of
issues is closed if no further issue hits all of its rows. The closed sets are the intersections of masks.
Issues whose rows coincide are one group, which needs one action and one copy in quarantine.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.text import partition_text
from assay.operators.rules import named
from assay.session import scratch_dir

# Bits of a mask; more predicates than that are asked in several calls.
MOST_ISSUES = 62


def row_masks(df: DataFrame, issues: Mapping[str, str], by: Sequence[str]) -> DataFrame:
    """`by`, `mask`, `n`: how many rows of a partition violate exactly the predicates of a mask.

    `issues` maps names to SQL predicates; bit i belongs to the i-th name. A predicate that is null on a
    row does not hold. Mask 0 holds the rows without an issue.
    """
    if not 0 < len(issues) <= MOST_ISSUES:
        raise ValueError(f"1 to {MOST_ISSUES} issues a call")
    bits = [F.when(F.coalesce(F.expr(p), F.lit(False)), F.lit(1 << i)).otherwise(0).cast("bigint") for i, p in enumerate(issues.values())]
    mask = reduce(lambda a, b: a + b, bits)
    return df.groupBy(*[named(c) for c in by], mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"))


def _kept(df: DataFrame) -> DataFrame:
    """A small table between the steps of a loop, written so that its plan ends there."""
    path = scratch_dir(df.sparkSession, "issue-sets")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _met(left: DataFrame, right: DataFrame, by: Sequence[str], on: Column | None = None) -> DataFrame:
    """Rows of one partition side by side; null is a partition like any other."""
    other = right.withColumnsRenamed({c: f"_of_{i}" for i, c in enumerate(by)})
    same = [named(c).eqNullSafe(F.col(f"_of_{i}")) for i, c in enumerate(by)]
    condition = reduce(lambda a, b: a & b, [*same, *([on] if on is not None else [])], F.lit(True))
    return left.join(other, condition).drop(*[f"_of_{i}" for i in range(len(by))])


def _names(mask: str, issues: Sequence[str]) -> Column:
    held = [F.when(F.col(mask).bitwiseAND(F.lit(1 << i)) != 0, F.lit(name)) for i, name in enumerate(issues)]
    return F.array_compact(F.array(*held))


def closed_sets(
    masks: DataFrame, issues: Sequence[str], by: Sequence[str], min_support: int = 1, min_size: int = 1
) -> DataFrame:
    """`by`, `issues`, `support`, `lift` of the closed sets with that support and size at least.

    Support counts the rows that have all the issues of a set; lift divides its share of the partition's
    rows by what independent issues would give. `masks` are those of `row_masks`, a few per partition.
    """
    masks = _kept(masks)
    keys = [named(c) for c in by]
    found = _kept(masks.where("mask > 0").select(*keys, F.col("mask").alias("held")))
    seen = found.count()
    while True:
        # Each step meets the sets of the last one with each other: a set of any size is there after six.
        pairs = _met(found, found.withColumnRenamed("held", "other"), by, F.col("held") < F.col("other"))
        more = pairs.select(*keys, F.col("held").bitwiseAND(F.col("other")).alias("held")).where("held > 0")
        found = _kept(found.unionByName(more).distinct())
        if (now := found.count()) == seen:
            break
        seen = now
    inside = F.col("mask").bitwiseAND(F.col("held")) == F.col("held")
    counted = _met(found, masks, by, inside).groupBy(*keys, "held").agg(F.sum("n").alias("support"))
    single = masks.groupBy(*keys).agg(
        F.sum("n").alias("total"),
        F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.col("n")).otherwise(0)) for i in range(len(issues))]).alias("each"),
    )
    chance = F.lit(1.0)
    for i in range(len(issues)):
        share = F.col("each")[i] / F.col("total")
        chance = chance * F.when(F.col("held").bitwiseAND(F.lit(1 << i)) != 0, share).otherwise(1.0)
    whole = _met(counted, single, by).where((F.col("support") >= min_support) & (F.bit_count("held") >= min_size))
    return whole.select(*keys, _names("held", issues).alias("issues"), "support", (F.col("support") / F.col("total") / chance).alias("lift"))


def coinciding(masks: DataFrame, issues: Sequence[str], by: Sequence[str], similarity: float = 0.9) -> DataFrame:
    """`by`, `issues`, `bad_rows`: per partition the groups of issues whose rows coincide.

    Two issues coincide if the rows of both are at least `similarity` of the rows of either; groups are what
    that connects. An issue without rows is in no group. `bad_rows` counts each row of a group once.
    """
    masks, keys = _kept(masks), [named(c) for c in by]
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(issues) - 1)), lambda i: F.call_function("shiftright", F.col("mask"), i).bitwiseAND(F.lit(1)) != 0))
    each = masks.select(*keys, "mask", "n", bit.alias("i"))
    sizes = each.groupBy(*keys, "i").agg(F.sum("n").alias("size"))
    # A mask gives its own pairs of issues; rows are never paired.
    pairs = each.withColumn("j", F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(issues) - 1)), lambda j: F.call_function("shiftright", F.col("mask"), j).bitwiseAND(F.lit(1)) != 0)))
    both = pairs.groupBy(*keys, "i", "j").agg(F.sum("n").alias("both"))
    left = _met(both, sizes.withColumnsRenamed({"i": "i2", "size": "ni"}), by, F.col("i") == F.col("i2"))
    met = _met(left, sizes.withColumnsRenamed({"i": "j2", "size": "nj"}), by, F.col("j") == F.col("j2"))
    links = _kept(met.where(F.col("both") >= similarity * (F.col("ni") + F.col("nj") - F.col("both"))).select(*keys, "i", "j"))
    labels = _kept(sizes.select(*keys, "i", F.col("i").alias("label")))
    while True:
        near = _met(links, labels.withColumnsRenamed({"i": "k", "label": "other"}), by, F.col("j") == F.col("k"))
        least = near.groupBy(*keys, "i").agg(F.min("other").alias("label"))
        moved = _met(least.withColumnRenamed("label", "new"), labels.withColumnsRenamed({"i": "k"}), by, (F.col("i") == F.col("k")) & (F.col("new") < F.col("label")))
        if moved.isEmpty():
            break
        labels = _kept(least)
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("i")))
    groups = labels.groupBy(*keys, "label").agg(bits.alias("held"))
    hit = _met(groups, masks, by, F.col("mask").bitwiseAND(F.col("held")) != 0)
    return hit.groupBy(*keys, "held").agg(F.sum("n").alias("bad_rows")).select(*keys, _names("held", issues).alias("issues"), "bad_rows")


def joint_requests(groups: DataFrame, issues: Mapping[str, str], table: str, by: Sequence[str]) -> DataFrame:
    """Quarantine requests for the groups of `coinciding`: one per group, for the rows of any of its issues."""
    predicate = F.create_map(*[x for name, p in issues.items() for x in (F.lit(name), F.lit(f"({p})"))])
    return groups.select(
        F.lit(table).alias("table_name"), partition_text(list(by)).alias("partition"),
        F.array_join(F.transform("issues", lambda i: predicate[i]), " OR ").alias("filter_condition"),
        F.array_join("issues", "+").alias("issue_id"),
    )
