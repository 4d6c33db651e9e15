"""Staged restore: a failure in the middle leaves readable data, and swaps can be undone."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from assay.sources import partitions as P
from assay.sources import swaps as W

LATER = dt.datetime(2100, 1, 1)


@pytest.fixture
def lake(spark, tmp_path):
    name, path = f"swap_{tmp_path.name}".replace("-", "_").lower(), str(tmp_path / "t")
    dirty = spark.range(40).selectExpr("-id AS id", "if(id % 2 = 0, 'a', \"b'c\") AS p")
    P.write_partitions(dirty, path, ["p"])
    P.create_fact_table(spark, name, "id bigint, p string", path, ["p"])
    P.register_partitions(spark, name, P.existing_partitions(spark, path, ["p"]), ["p"])
    clean = spark.range(60).selectExpr("id", "CASE id % 3 WHEN 0 THEN 'a' WHEN 1 THEN \"b'c\" ELSE 'new' END AS p")
    yield name, path, clean, str(tmp_path / "staging"), str(tmp_path / "log")
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def held(spark, name):
    return {r.p: (r.n, r.low) for r in spark.table(name).groupBy("p").agg(F.count("*").alias("n"), F.min("id").alias("low")).collect()}


DIRTY = {"a": (20, -38), "b'c": (20, -39)}
CLEAN = {"a": (20, 0), "b'c": (20, 1), "new": (20, 2)}


def test_swap_and_roll_back(spark, lake):
    name, path, clean, staging, log = lake
    assert held(spark, name) == DIRTY
    swap = W.restore_swapped(spark, name, clean, staging, log, ["p"])
    assert held(spark, name) == CLEAN
    assert spark.read.parquet(path).count() == 40  # the old data stay
    W.roll_back(spark, name, log, swap)
    assert held(spark, name) == DIRTY
    W.finish(spark, name, log, swap)
    W.finish(spark, name, log, swap)
    assert held(spark, name) == CLEAN


def test_a_failure_in_the_middle(spark, lake, monkeypatch):
    name, _, clean, staging, log = lake
    with monkeypatch.context() as failing:
        failing.setattr(W, "write_partitions", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            W.restore_swapped(spark, name, clean, staging, log, ["p"])
    assert held(spark, name) == DIRTY
    with monkeypatch.context() as failing:
        failing.setattr(W, "write_partitions", lambda df, *a, **k: P.write_partitions(df.where("id > 7"), *a, **k))
        with pytest.raises(W.CountMismatch):
            W.restore_swapped(spark, name, clean, staging, log, ["p"])
    assert held(spark, name) == DIRTY
    done, point = [], W._point
    with monkeypatch.context() as failing:
        failing.setattr(W, "_point", lambda *a: done.append(a) or (1 / 0 if len(done) > 1 else point(*a)))
        with pytest.raises(ZeroDivisionError):
            W.restore_swapped(spark, name, clean, staging, log, ["p"])
    spark.catalog.refreshTable(name)
    between = held(spark, name)
    assert all(between[p] in (DIRTY.get(p), CLEAN[p]) for p in between) and between != CLEAN
    swap = spark.read.parquet(log).first().swap
    W.finish(spark, name, log, swap)
    assert held(spark, name) == CLEAN


def test_what_is_replaced_goes_when_it_is_old(spark, lake):
    name, path, clean, staging, log = lake
    W.restore_swapped(spark, name, clean, staging, log, ["p"])
    second = W.restore_swapped(spark, name, clean.where("p = 'a'"), staging, log, ["p"])
    assert W.remove_replaced(spark, name, log, dt.datetime(2000, 1, 1)) == []
    gone = W.remove_replaced(spark, name, log, LATER)
    assert len(gone) == 3 and not any(os.path.exists(g.removeprefix("file:")) for g in gone)
    assert held(spark, name) == CLEAN and W.remove_replaced(spark, name, log, LATER) == [] and second
