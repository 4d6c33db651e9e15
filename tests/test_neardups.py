"""Near duplicates of rows against all pairs, and planted copies found."""

import random

import pytest
from pyspark.sql import functions as F

from assay.operators import neardups as D
from tests.passes import counted, worked_out

NEAR = {"x": 0.5, "y": 0.1}


def direct(rows):
    """Distinct rows with their copies, and whether an earlier one of the block is near in both columns."""
    low = lambda v: float("-inf") if v is None else v
    held = {}
    for r in rows:
        held[r] = held.get(r, 0) + 1

    def near(a, b, t):
        return a is b is None or (a is not None and b is not None and abs(a - b) <= t)

    return {
        r: (n, any(o[:2] == r[:2] and (low(o[2]), low(o[3])) < (low(r[2]), low(r[3])) and near(o[2], r[2], 0.5) and near(o[3], r[3], 0.1) for o in held))
        for r, n in held.items()
    }


def run(spark, rows):
    df = spark.createDataFrame(rows, "p string, k int, x double, y double")
    return {(r.p, r.k, r.x, r.y): (r.copies, r.repeats) for r in D.first_rows(df, ["k"], NEAR, ["p"]).collect()}


def test_against_all_pairs(spark):
    draw = random.Random(2)
    rows = [
        (draw.choice(["a", "b", None]), draw.choice([1, 2, 3, None]), draw.choice([None, round(draw.gauss(0, 1.2), 3)]), round(draw.gauss(0, 0.4), 3))
        for _ in range(500)
    ] + [("c", n, 1.0, 1.0) for n in range(30)]
    rows += rows[:40]
    assert run(spark, rows) == direct(rows)
    assert run(spark, []) == {} and run(spark, [("a", 1, None, None)] * 3) == {("a", 1, None, None): (3, False)}
    with pytest.raises(ValueError):
        D.first_rows(spark.createDataFrame(rows, "p string, k int, x double, y double"), ["k"], {}, ["p"])


def test_a_crowd_makes_no_pairs(spark):
    """A thousand rows within one tolerance: as many comparisons as rows, whatever their number."""
    df = spark.range(4000).selectExpr("'a' AS p", "1 AS k", "(id % 1000) * 0.0004 AS x", "id * 1e-6 AS y")
    rows = D.first_rows(df, ["k"], NEAR, ["p"])
    assert rows.where("NOT repeats").count() == 1
    out = D.near_uniqueness(df, ["k"], NEAR, ["p"]).first()
    assert (out.row_count, out.near_repeats, out.severity) == (4000, 3999, "CRITICAL")


def test_planted_copies_are_found(spark):
    clean = spark.range(2000).selectExpr("'a' AS p", "int(id) AS k", "id * 1.5 AS x", "id * 0.25 AS y")
    copies = clean.where("k % 50 = 0").withColumn("x", F.col("x") + 0.3).withColumn("y", F.col("y") - 0.09)
    far = clean.where("k % 50 = 1").withColumn("x", F.col("x") + 0.51)
    out = D.near_uniqueness(clean.unionByName(copies).unionByName(far), ["k"], NEAR, ["p"]).first()
    assert (out.row_count, out.near_repeats) == (2080, 40)


def test_rows_are_worked_out_a_few_times(spark, tmp_path):
    """Once for the blocks' sizes, the rows of shared ones, and the partitions' sizes; never for later steps."""
    rows = [("a", n % 40, n * 0.01, n % 3 * 0.05) for n in range(100)] + [("b", n, 1.0, 1.0) for n in range(50)] + [(None, None, None, 1.0)] * 2
    df = spark.createDataFrame(rows, "p string, k int, x double, y double").repartition(1)
    out = {r.p: (r.row_count, r.near_repeats) for r in D.near_uniqueness(counted(df, tmp_path), ["k"], NEAR, ["p"]).collect()}
    assert worked_out(tmp_path) <= 3 * len(rows)
    want = {}
    for (p, *_), (n, repeats) in direct(rows).items():
        a, b = want.get(p, (0, 0))
        want[p] = (a + n, b + n - (not repeats))
    assert out == want
