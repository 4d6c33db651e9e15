"""Evaluation from stored file states: new, replaced, deleted and empty files."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from assay.operators import incremental as N
from assay.operators import rules as R

SCHEMA = "a bigint, v double, t timestamp, p string"
LINES = ['Completeness "v" >= 0.98', 'Mean "v" between 0 and 5', 'ColumnValues "v" between 3 and 90', 'DataFreshness "t" <= 1',
         'ColumnExists "w"', 'Mean "w" > 1', "RowCount > 40"]
AS_OF = "timestamp '1970-01-01 03:00:00'"


def load(spark, path, low, high, name="part one+two"):
    df = spark.range(low, high, 1, 1).selectExpr(
        "id AS a", "if(id % 5 = 0, null, double(id)) AS v", "timestamp_seconds(id) AS t", f"concat('{name} ', id % 2) AS p"
    )
    df.write.mode("append").partitionBy("p").parquet(path)


@pytest.fixture
def at(spark, tmp_path):
    path, store = str(tmp_path / "data"), str(tmp_path / "store")
    rules = R.load_rules(spark, LINES)

    def results(df):
        return {(r.partition, r.rule): (r.state, r.evaluated_metrics) for r in R.rule_results(df).collect()}

    def check():
        full = R.evaluate(spark.read.schema(SCHEMA).parquet(path), rules, ["p"], "t", as_of=F.expr(AS_OF))
        stored = N.evaluate_stored(spark, path, store, SCHEMA, ["p"], rules, "t", as_of=F.expr(AS_OF))
        assert results(stored) == results(full)
        return results(stored)

    def refresh(**kw):
        return N.refresh(spark, path, store, SCHEMA, ["p"], kw.pop("rules", rules), **kw)

    return path, store, rules, refresh, check


def test_only_new_files_are_read(spark, at):
    path, store, rules, refresh, check = at
    load(spark, path, 0, 60)
    assert refresh() == 2 and refresh() == 0
    check()
    load(spark, path, 60, 61)
    new = N.new_files(spark, path, store, SCHEMA, ["p"], rules).collect()
    assert len(new) == 1
    with pytest.raises(ValueError):
        check()
    scan = spark.read.schema(SCHEMA).option("basePath", path).parquet(new[0].name)
    assert len(scan.inputFiles()) == 1
    assert refresh() == 1
    check()


def test_replaced_and_deleted_files(spark, at):
    path, _, _, refresh, check = at
    load(spark, path, 0, 100)
    load(spark, path, 100, 130)
    refresh()
    before = check()
    gone = sorted(glob.glob(f"{path}/*1/*.parquet"))[0]
    os.remove(gone)
    assert refresh() == 0 and check() != before
    other = sorted(glob.glob(f"{path}/*0/*.parquet"))[0]
    extra = spark.range(7).selectExpr("id AS a", "double(id) AS v", "timestamp_seconds(id) AS t").coalesce(1)
    extra.write.parquet(f"{path}-new")
    os.remove(f"{os.path.dirname(other)}/.{os.path.basename(other)}.crc")
    os.replace(glob.glob(f"{path}-new/*.parquet")[0], other)
    assert refresh() == 1
    check()


def test_repeats_empty_files_and_new_rules(spark, at):
    path, store, rules, refresh, check = at
    load(spark, path, 0, 50)
    spark.createDataFrame([], "a bigint, v double, t timestamp").coalesce(1).write.mode("append").parquet(f"{path}/p=empty")
    assert refresh(rules=rules[:1]) == 3
    # The rest of the rules needs states that are not stored: all files with rows are read again.
    assert refresh() == 2 and refresh() == 0
    check()
    spark.read.parquet(store).write.mode("append").parquet(f"{store}-copy")
    spark.read.parquet(f"{store}-copy").write.mode("append").parquet(store)
    check()


def test_no_data_is_read_to_evaluate(spark, at):
    path, store, rules, refresh, _ = at
    load(spark, path, 0, 50)
    refresh()
    out = N.evaluate_stored(spark, path, store, SCHEMA, ["p"], rules, "t", as_of=F.expr(AS_OF))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "v:double" not in plan and "content" not in plan
    assert [f"{store}]" in scan for scan in plan.split("FileScan parquet")[1:]] == [True]
