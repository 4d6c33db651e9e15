"""Learned bounds: rank error of merged sketches, robustness, rules made of them."""

import random

import pytest
from pyspark.sql import functions as F

from assay.operators import learned as Q
from assay.operators import rules as R


@pytest.fixture(scope="module")
def values(spark):
    draw = random.Random(4)
    rows = [(f"p{n % 7}", draw.lognormvariate(0, 1), draw.gauss(50, 4) if n % 97 else 10.0**6) for n in range(40_000)]
    rows += [("p1", None, float("nan"))] * 50 + [("p9", None, None)]
    return spark.createDataFrame(rows, "p string, a double, b double").repartition(8).cache()


def test_ranks_of_merged_sketches(spark, values):
    sketches = Q.sketched(values, ["a", "b"], ["p"])
    assert sketches.count() == 14
    levels = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]
    found = {r["column"]: r for r in Q.merged_quantiles(sketches, levels).collect()}
    assert found["a"].value_count == found["b"].value_count == 40_000 and found["a"].partitions == 7
    a = sorted(r.a for r in values.where("a IS NOT NULL").collect())
    for level, q in zip(levels, found["a"].quantiles):
        low, high = sum(x < q for x in a) / len(a), sum(x <= q for x in a) / len(a)
        assert low - Q.RANK_ERROR * 2 <= level <= high + Q.RANK_ERROR * 2


def test_wild_values_leave_the_bounds_alone(spark, values):
    row = next(r for r in Q.learned_bounds(Q.sketched(values, ["b"], ["p"])).collect())
    assert row.median == pytest.approx(50, abs=0.2) and row.deviation == pytest.approx(4, rel=0.05)
    assert row.lo == pytest.approx(26, abs=2) and row.hi == pytest.approx(74, abs=2)
    flat = spark.createDataFrame([("x", 1.0)] * 90 + [("x", 2.0)] * 10, "p string, a double")
    row = Q.learned_bounds(Q.sketched(flat, ["a"], ["p"])).first()
    assert (row.deviation, row.lo, row.hi) == (0.0, 1.0, 2.0)


def test_rules_from_clean_partitions(spark, values):
    scans = spark.createDataFrame(
        [("t", f"p=p{n}", f"e{n}{k}", k, int(n == 3 and k == 2)) for n in range(7) for k in (1, 2)],
        "table_name string, partition string, evaluation_id string, ts int, violation_count int",
    )
    clean = Q.clean_partitions(scans)
    assert clean.count() == 6
    sketches = Q.sketched(values, ["a", "b"], ["p"]).withColumn("partition", F.concat(F.lit("p="), "p"))
    lines = Q.bound_lines(Q.learned_bounds(sketches.join(clean, "partition", "left_semi"))).orderBy("column")
    assert all(r.partitions == 6 for r in lines.collect())
    rules = R.load_rules(spark, [r.rule_text for r in lines.collect()])
    assert [(r.rule_type, r.column) for r in rules] == [("ColumnValues", "a"), ("ColumnValues", "b")]
    got = R.rule_results(R.evaluate(values.where("p = 'p3'"), rules, ["p"], "t")).collect()
    ratio = {r.column: next(iter(r.evaluated_metrics.values())) for r in got}
    assert ratio["b"] == pytest.approx(1 / 97, abs=0.006)


def test_one_scan(spark, values, tmp_path):
    values.write.parquet(str(tmp_path / "t"))
    plan = Q.sketched(spark.read.parquet(str(tmp_path / "t")), ["a", "b"], ["p"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "partial_kll_sketch_agg" in plan
