"""Overlap of issues against all subsets of rows, and one request for issues that coincide."""

import itertools
import random

from assay.operators import overlap as O

ISSUES = {f"i{n}": f"x{n}" for n in range(5)}


def frame(spark, rows):
    return spark.createDataFrame(rows, "p string, " + ", ".join(f"x{n} boolean" for n in range(5)))


def test_closed_sets_against_all_subsets(spark):
    draw = random.Random(6)
    rows = [(draw.choice(["a", "b", None]), *[draw.choice([True, False, False, None]) for _ in range(5)]) for _ in range(300)]
    rows += [("c", True, True, True, False, None)] * 20 + [("d", False, None, False, False, False)]
    got = {(r.p, tuple(r.issues)): (r.support, round(r.lift, 9)) for r in O.closed_sets(O.row_masks(frame(spark, rows), ISSUES, ["p"]), list(ISSUES), ["p"]).collect()}
    want = {}
    for p in ("a", "b", "c", "d", None):
        own = [r[1:] for r in rows if r[0] == p]
        support = {s: sum(all(r[i] for i in s) for r in own) for n in range(1, 6) for s in itertools.combinations(range(5), n)}
        for s, n in support.items():
            if n and not any(set(s) < set(w) and n == m for w, m in support.items()):
                chance = 1.0
                for i in s:
                    chance *= support[(i,)] / len(own)
                want[p, tuple(f"i{i}" for i in s)] = (n, round(n / len(own) / chance, 9))
    assert got == want


def test_issues_that_coincide_are_one_request(spark):
    rows = [("a", True, True, False, False, False)] * 19 + [("a", True, False, False, False, False)]
    rows += [("a", False, False, True, n < 10, False) for n in range(20)] + [("b", False, True, True, None, False)] * 3
    masks = O.row_masks(frame(spark, rows), ISSUES, ["p"])
    groups = O.coinciding(masks, list(ISSUES), ["p"])
    got = {(r.p, tuple(r.issues)): r.bad_rows for r in groups.collect()}
    assert got == {("a", ("i0", "i1")): 20, ("a", ("i2",)): 20, ("a", ("i3",)): 10, ("b", ("i1", "i2")): 3}
    requests = {r.issue_id: (r.partition, r.filter_condition) for r in O.joint_requests(groups, ISSUES, "t", ["p"]).collect()}
    assert requests["i0+i1"] == ("p=a", "(x0) OR (x1)") and requests["i3"] == ("p=a", "(x3)")
    chain = [("a", *[n in (k, k + 1, k + 2, k + 3) for k in range(5)]) for n in range(8)]
    assert O.coinciding(O.row_masks(frame(spark, chain), ISSUES, ["p"]), list(ISSUES), ["p"], 0.6).first().issues == list(ISSUES)


def test_rows_are_aggregated_once(spark, tmp_path):
    frame(spark, [("a", True, True, False, False, False)] * 9).write.parquet(str(tmp_path / "t"))
    plan = O.row_masks(spark.read.parquet(str(tmp_path / "t")), ISSUES, ["p"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "partial_count" in plan
