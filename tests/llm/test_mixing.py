"""Mixing: targets by sharing again and again, whole copies, prefix sums that cross integers."""

from collections import defaultdict
from fractions import Fraction

import pytest

from assay.llm.mixing import mix
from tests.llm.frames import ODD, documents


def shared(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[n % 3] for n, s in enumerate(names)}
    stopped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in stopped)
        free = [s for s in names if s not in stopped]
        share = {s: Fraction(rest * weight[s], sum(weight[f] for f in free)) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: float(share[s]) if s in share else float(most * sizes[s]) for s in names}
        stopped |= over


def check(got, most=3):
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.copies <= most and r.taken == r.copies * r["size"]
    targets = shared({s: sum(r["size"] for r in rs) for s, rs in by.items()})
    for source, rs in by.items():
        assert rs[0].source_size == sum(r["size"] for r in rs)
        assert rs[0].target == pytest.approx(targets[source])
        expected = targets[source] / rs[0].source_size if rs[0].source_size else 0
        assert abs(sum(r.copies for r in rs) - expected * len(rs)) <= 1
        assert abs(sum(r.taken for r in rs) - targets[source]) <= 2 * max(r["size"] for r in rs) + 1


def test_hot_source_and_equal_sizes(spark):
    rows = [(n, "w " * (1 + n % 3 if n % 5 else 7), "en", ["a", "b", "c", "d", None][n % 5] if n % 3 else "a") for n in range(3000)]
    docs = documents(spark, rows)
    got = mix(docs).collect()
    assert len(got) == 3000
    check(got)
    again = mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_small_sources_stop_at_three_copies(spark):
    rows = [(0, "w " * 5, "en", "a")] + [(n, "w " * 50, "en", "b") for n in range(1, 40)] + [(99, "", "en", "c")]
    got = {r.doc_id: r for r in mix(documents(spark, rows)).collect()}
    assert (got[0].copies, got[0].target) == (3, 15.0) and (got[99].target, got[99].taken) == (0.0, 0)
    check(got.values())


def test_odd_rows(spark):
    got = mix(documents(spark, ODD)).collect()
    assert len(got) == len(ODD)
    check(got)
    assert {r.source for r in got} == {"s", None}
    assert mix(documents(spark, [])).count() == 0
    nothing = mix(documents(spark, [(1, None), (2, " ")])).collect()
    assert [(r["size"], r.target, r.taken) for r in nothing] == [(0, 0.0, 0)] * 2
