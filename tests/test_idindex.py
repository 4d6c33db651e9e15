"""Appends to an indexed audit table: exact, and few files opened."""

import os

from pyspark.sql import functions as F

from assay.sources import idindex as X
from assay.sources.audit import audit_id
from tests.passes import counted, worked_out


def rows(spark, low, high, shift=0):
    return spark.range(low, high).select("id", F.timestamp_seconds(F.col("id") + shift).alias("ts"))


def ids(spark, path):
    return sorted(r.id for r in X.read_indexed(spark, path).select("id").collect())


def asked(spark, low, high):
    return spark.range(low, high).select(audit_id(["id"]).alias("audit_id"))


def test_replays_and_overlaps_store_each_id_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert X.read_indexed(spark, path) is None
    assert X.append_indexed(spark, rows(spark, 0, 300), path, ["id"]) == 300
    assert X.append_indexed(spark, rows(spark, 0, 300), path, ["id"]) == 0
    assert X.append_indexed(spark, rows(spark, 200, 350, shift=-10**6).unionByName(rows(spark, 320, 330)), path, ["id"]) == 50
    assert X.append_indexed(spark, rows(spark, 0, 0), path, ["id"]) == 0
    assert ids(spark, path) == list(range(350)) and len(X.live_runs(spark, path)) == 2
    # Of rows with one id in a batch the earliest stays.
    kept = {r.id: r.ts for r in X.read_indexed(spark, path).collect()}
    first = {r.id: r.ts for r in rows(spark, 320, 350, shift=-10**6).collect()}
    assert all(kept[n] == first[n] for n in first)


def test_runs_are_merged(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(6):
        X.append_indexed(spark, rows(spark, 40 * n, 40 * n + 60), path, ["id"], max_runs=2)
        assert len(X.live_runs(spark, path)) <= 3
    assert ids(spark, path) == list(range(260))
    assert set(os.listdir(f"{path}/runs")) == {f"run={r.run}" for r in X.live_runs(spark, path)}


def test_what_is_not_logged_is_not_there(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    X.append_indexed(spark, rows(spark, 0, 50), path, ["id"])
    with monkeypatch.context() as failing:
        failing.setattr(X, "_index_run", lambda *a: 1 / 0)
        try:
            X.append_indexed(spark, rows(spark, 30, 80), path, ["id"])
        except ZeroDivisionError:
            pass
    assert ids(spark, path) == list(range(50))
    assert X.append_indexed(spark, rows(spark, 30, 80), path, ["id"]) == 30
    # A merge that was logged, with the old runs still there, shows every row once.
    old = [r.run for r in X.live_runs(spark, path)]
    X._write_run(X.read_indexed(spark, path), path, "merged")
    X._index_run(spark, path, "merged", old)
    assert ids(spark, path) == list(range(80)) and [r.run for r in X.live_runs(spark, path)] == ["merged"]


def test_few_files_may_hold_an_id(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        X.append_indexed(spark, rows(spark, 0, 40_000), path, ["id"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    run = X.live_runs(spark, path)[0]
    files = [f for f in os.listdir(f"{path}/runs/run={run.run}") if f.endswith(".parquet")]
    assert len(files) > 150 and run.depth > 3
    # Every stored id finds its file; new ids find hardly any.
    stored = spark.read.parquet(f"{path}/runs/run={run.run}").select("audit_id", F.col("_metadata.file_path").alias("file"))
    some = stored.where(F.col("id") < 3) if "id" in stored.columns else stored.limit(3)
    wanted = {r.file for r in some.collect()}
    found = X.possible_files(spark, some.select("audit_id"), path)
    assert wanted <= set(found) and len(found) <= 5
    assert len(X.possible_files(spark, asked(spark, 10**6, 10**6 + 1000), path)) <= 10
    assert len(set(X.possible_files(spark, asked(spark, 0, 40_000), path))) >= len(files) - 1


def test_rows_of_a_run_are_worked_out_once(spark, tmp_path):
    (tmp_path / "seen").mkdir()
    new = rows(spark, 0, 5000).withColumn("audit_id", audit_id(["id"]))
    X._write_run(counted(new, tmp_path / "seen"), str(tmp_path / "t"), "one")
    assert worked_out(tmp_path / "seen") == 5000
    assert X._index_run(spark, str(tmp_path / "t"), "one") == 5000
    index = spark.read.parquet(str(tmp_path / "t" / "index"))
    assert index.select("file").distinct().count() == len(spark.read.parquet(str(tmp_path / "t" / "runs")).inputFiles())
