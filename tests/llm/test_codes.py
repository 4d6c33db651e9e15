"""Vector codes against a direct version, and the access tree against all distances."""

import hashlib
import math
import random

import numpy as np
import pytest

from assay.llm.codes import Tree, compress, floor_root, rounded, squared


def direct(rows, parts=16, entries=64, rounds=2):
    kept = [
        (key, label, [math.floor(256 * x) for x in v]) for key, label, v in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    width = max((len(v) for _, _, v in kept), default=0)
    wide = max(1, -(-width // parts))
    cut = [[(v + [0] * (parts * wide - len(v)))[p * wide : (p + 1) * wide] for p in range(parts)] for _, _, v in kept]
    order = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, kept[n][0] or 0, kept[n][2]))[:entries]
    books = [[cut[n][p] for n in order] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(book))

    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            held = [[] for _ in book]
            for c in cut:
                held[nearest(c[p], book)[1]].append(c[p])
            new.append([[sum(x) // len(h) for x in zip(*h)] if h else y for h, y in zip(held, book)])
        books = new
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], {}
    for (key, label, _), c in zip(kept, cut):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        out.append((key, label, "".join(f"{e:02x}" for _, e in found), error))
        by_label[label] = by_label.get(label, 0) + error
    return sorted([(*r, by_label[r[1]], sha) for r in out], key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    df = df.selectExpr("*", "'x' AS key", "'x' AS v", "'x' AS code", "1 AS error", "'x' AS of_label").repartition(5)
    got = compress(df, **kw).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("entries,splits", [(1, 8), (7, 8), (64, 8), (200, 3), (300, 16)])
def test_tree_finds_the_nearest_entry(entries, splits):
    draw = np.random.default_rng(entries)
    for reach in (2, 40, 3_000_000):
        points = draw.integers(-reach, reach + 1, (entries, 3))
        asked = np.vstack([draw.integers(-reach, reach + 1, (500, 3)), points])
        index, far = Tree(points, splits).nearest(asked)
        table = squared(asked[:, None], points[None])
        assert (far == table.min(1)).all() and (index == table.argmin(1)).all()


def test_tree_skips_subtrees():
    draw = np.random.default_rng(5)
    points = draw.normal(0, 1, (8, 4))[draw.integers(0, 8, 64)] * 1000 + draw.normal(0, 10, (64, 4))
    tree, looked = Tree(points.astype(np.int64)), []
    tree.entries = type("Counted", (np.ndarray,), {"__getitem__": lambda s, i: looked.append(i) or np.ndarray.__getitem__(s, i)})(
        tree.entries.shape, tree.entries.dtype, tree.entries.tobytes())
    tree.nearest(tree.entries[3:4] + 1)
    assert len(looked) < 40


def test_roots_are_exact():
    numbers = np.array([0, 1, 2, 3, 4, 2**52, 2**60 - 1, 2**60, (2**31 - 5) ** 2 - 1, (2**31 - 5) ** 2])
    assert floor_root(numbers).tolist() == [math.isqrt(int(n)) for n in numbers]
    low, high = rounded(numbers[:6])
    assert all(lo * lo <= 256 * n <= hi * hi for lo, hi, n in zip(low.tolist(), high.tolist(), numbers.tolist()))


def test_against_direct(spark):
    draw = random.Random(12)
    rows = [(n, [None, 1, 2][n % 3] if n % 4 else 7, [draw.gauss(0, 0.2) for _ in range(32)]) for n in range(300)]
    assert run(spark, rows) == direct(rows)
    few = rows[:20]
    assert run(spark, few) == direct(few)
    assert run(spark, rows, parts=4, entries=5, rounds=3) == direct(rows, 4, 5, 3)


def test_odd_vectors_ties_and_repeats(spark):
    rows = [(n, None, [0.25, -0.001] * 16) for n in range(80)] * 2 + [(None, 1, [0.5] * 32), (None, 1, [0.5] * 32)]
    rows += [(200, 1, None), (201, 1, [None] * 32), (202, 1, [math.nan] * 32), (203, 1, [math.inf] * 32)]
    rows += [(204, 1, []), (205, 2, [0.5] * 5), (-3, 2, [1.5] * 33)]
    assert run(spark, rows) == direct(rows)
    assert run(spark, []) == [] and run(spark, rows[-7:-3]) == []
    assert run(spark, [(1, None, [])]) == direct([(1, None, [])])
