"""Partitions that come to rest are evaluated once per version, whatever the order of their files."""

import datetime as dt
import glob
import os


from assay.operators import rules as R
from assay.operators.violations import scan_results
from assay.streaming import arrivals as A
from assay.streaming import events as E

SCHEMA = "a bigint, v double, p string"
LINES = ['Completeness "v" >= 0.98', "RowCount > 15"]
T0 = 1_750_000_000


def land(spark, path, p, low, high, minute):
    """Rows of a partition as one file with a given time."""
    before = set(glob.glob(f"{path}/p={p}/*.parquet"))
    df = spark.range(low, high).selectExpr("id AS a", "if(id % 10 = 0, null, double(id)) AS v", f"'{p}' AS p")
    df.coalesce(1).write.mode("append").partitionBy("p").parquet(path)
    for file in set(glob.glob(f"{path}/p={p}/*.parquet")) - before:
        os.utime(file, (T0 + 60 * minute, T0 + 60 * minute))


def at(minute):
    return dt.datetime.fromtimestamp(T0 + 60 * minute, dt.timezone.utc).replace(tzinfo=None)


def test_each_version_is_evaluated_once(spark, tmp_path):
    path, store, root, check = (str(tmp_path / n) for n in ("data", "store", "audit", "check"))
    rules = R.load_rules(spark, LINES)

    def run(checkpoint=check):
        versions = A.settled(A.file_arrivals(spark, path, ["p"]), ["p"])
        E.run_available(A.evaluation_stream(versions, path, store, root, SCHEMA, ["p"], rules, "t"), checkpoint)

    def stored():
        rows = spark.read.parquet(f"{root}/scans").collect() if os.path.exists(f"{root}/scans") else []
        return sorted((r.partition, r.ts, r.overall_score) for r in rows)

    # Two files of x within the quiet time, out of order; y goes on.
    land(spark, path, "x", 1, 10, 20)
    land(spark, path, "x", 10, 20, 0)
    land(spark, path, "y", 0, 5, 90)
    run()
    # Completeness 18 / 19 is CRITICAL; 19 rows are enough.
    assert stored() == [("p=x", at(50), 80)]
    run()
    land(spark, path, "x", 21, 30, 300)
    land(spark, path, "z", 1, 5, 600)
    run()
    full = {r.partition: r.overall_score for r in scan_results(R.evaluate(spark.read.schema(SCHEMA).parquet(path), rules, ["p"], "t")).collect()}
    assert stored() == [("p=x", at(50), 80), ("p=x", at(330), full["p=x"]), ("p=y", at(120), full["p=y"])]
    run(check + "-lost")  # everything again: the same versions
    assert [r[:2] for r in stored()] == [("p=x", at(50)), ("p=x", at(330)), ("p=y", at(120))]


def test_sessions_of_a_batch(spark):
    rows = [("a", 0), ("a", 25), ("a", 54), ("b", 10), ("a", 100), (None, 3)]
    df = spark.createDataFrame([(p, at(m)) for p, m in rows], "p string, ts timestamp")
    got = sorted((r.p or "", r.first_arrival, r.settled_at, r.files) for r in A.settled(df, ["p"]).collect())
    assert got == [("", at(3), at(33), 1), ("a", at(0), at(84), 3), ("a", at(100), at(130), 1), ("b", at(10), at(40), 1)]
    assert A.settled(df.limit(0), ["p"]).count() == 0
