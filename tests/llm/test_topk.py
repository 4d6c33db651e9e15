"""Exact top-k against all products, with buckets and blocks of a few rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from assay.llm.topk import top_k


TOP = 2**63 - 1


def direct(rows, k, step=5):
    good = {}
    for key, v in rows:
        if key is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.setdefault(key, []).append([math.floor(256 * x) for x in v])
    out = []
    for q in sorted(good):
        if q % step:
            continue
        scores = [
            (-min(TOP, max(sum(a * b for a, b in zip(u, v)) for u in good[q] for v in vs)), key)
            for key, vs in good.items() if key != q
        ]
        out += [(q, n, key, -s) for n, (s, key) in enumerate(sorted(scores)[:k], 1)]
    return out


def run(spark, rows, k=5, step=5):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "'x' AS key", "'x' AS length")
    got = top_k(df, F.col("vec_id") % step == 0, k, bucket_rows=16, block_rows=4)
    return sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect()))


@pytest.mark.parametrize("spread", [0.0, 1.0, 4.0])
def test_against_all_products(spark, spread):
    draw = random.Random(int(spread))
    centres = [[draw.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = []
    for n in range(300):
        scale = math.exp(draw.gauss(0, spread))
        rows.append((n, [scale * (c + draw.gauss(0, 0.2)) for c in centres[n % 5]]))
    assert run(spark, rows) == direct(rows, 5)


def test_ties_repeats_and_odd_vectors(spark):
    rows = [(n, [0.5, 0.25, -0.5]) for n in range(60)] + [(n, [0.5, 0.25, -0.5]) for n in range(20)]
    rows += [(100, None), (101, [None, 1.0, 1.0]), (102, [math.nan, 1.0, 1.0]), (103, [math.inf, 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(105, []), (106, [0.0, 0.0, 0.0]), (107, [3.0]), (110, [2.0, 0.0, 0.0, 9.0])]
    assert run(spark, rows) == direct(rows, 5)
    assert run(spark, []) == [] and run(spark, [(5, [1.0])]) == []
    assert run(spark, [(5, [1.0]), (6, [2.0])]) == [(5, 1, 6, 256 * 512)]


def test_numbers_beyond_doubles(spark):
    rows = [(0, [1e7, 1.0]), (1, [1e7, 2.0]), (2, [1e7, 2.0 + 1 / 256]), (3, [-1e6, 5.0]), (4, [1e5, 1e5])]
    assert run(spark, rows) == direct(rows, 5)
    # Scores are cut to 64 bits, and then tie.
    rows = [(0, [1e9, 1.0]), (1, [1e9, 2.0]), (2, [1e9, 3.0]), (3, [1e3, 5.0])]
    assert run(spark, rows) == direct(rows, 5)
