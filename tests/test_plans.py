"""The plans at scale: what is pruned, pushed down, combined early and never done."""

import pytest
from pyspark.sql import functions as F

from assay.operators import corrupt as C
from assay.operators import history as H
from assay.operators import metrics as M
from assay.operators import quarantine as Q
from assay.operators import rules as R
from assay.operators import violations as V
from assay.plans import inputs as I
from assay.sources import partitions as P
from assay.sources import tables as S

FACT = I.LINEITEM_SCHEMA + ", year string, month string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("fact") / "t")
    P.write_partitions(I.fact(spark, sf_dir), path, I.BY)
    return S.read_fact(spark, path, FACT)


def test_a_ruleset_is_one_scan_and_one_aggregate(stored):
    text = plan(R.evaluate(stored, I.RULES, I.BY, "t", as_of=I.month_end()))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1
    assert text.count("HashAggregate") == 2 and "SortAggregate" not in text and "ObjectHash" not in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_extendedprice:double,l_tax:double,l_shipdate" in text


def test_scores_need_no_shuffle_of_their_own(stored):
    found = R.evaluate(stored, I.RULES, I.BY, "t", as_of=I.month_end())
    assert plan(V.scan_results(found)).count("Exchange") == 1
    assert plan(V.violations(found)).count("Exchange") == 1


def test_corruption_is_narrow(stored):
    text = plan(C.corrupt(stored, I.CONFIG, I.KEY))
    assert text.count("FileScan") == 1 and "Exchange" not in text and "Union" not in text
    assert "Python" not in text and "Window" not in text


def test_exact_count_never_sorts_all_rows(stored):
    out = C.inject_duplicates(stored, {"enabled": True, "exact_duplicates": 0.03}, I.KEY, exact_count=True)
    text = plan(out)
    assert "TakeOrdered" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
    main = text.split("Subqueries")[0]
    assert "Sort" not in main.split("Subquery")[0]


def test_quarantine_prunes_partitions_and_pushes_the_filter(stored):
    request = Q.Request("t", "year=1998/month=03", "l_quantity > 40 OR l_tax < 0", "a")
    text = plan(Q.bad_rows(stored, request))
    assert "PartitionFilters: [isnotnull(year" in text
    assert "PushedFilters: [Or(GreaterThan(l_quantity,40.0),LessThan(l_tax,0.0))]" in text
    two = [request, Q.Request("t", "year=1999/month=01", "l_quantity > 45", "b")]
    text = plan(Q.tag_issues(stored, two))
    pruned = text.split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "1998" in pruned and "1999" in pruned
    text = plan(Q.quarantine_counts(stored, two))
    assert "ReadSchema: struct<l_quantity:double,l_tax:double>" in text
    assert "1998" in text.split("PartitionFilters: ")[1].split("PushedFilters")[0]


def test_history_limits_each_key_before_the_shuffle(spark, sf_dir):
    text = plan(H.history_per_key(I.scans(spark, sf_dir)))
    assert text.count("WindowGroupLimit") == 2 and text.count("Exchange") == 1


def test_newest_is_a_top_k(spark, sf_dir):
    text = plan(H.newest(I.scans(spark, sf_dir), 20))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_uniqueness_has_no_expand(stored):
    text = plan(R.uniqueness(stored, ["l_orderkey", "l_linenumber"], I.BY))
    assert "Expand" not in text and text.count("FileScan") == 1
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in text


def test_alarms_are_one_pass_and_no_nested_loop(spark, sf_dir):
    alarms = M.alarm_table(spark, M.default_alarms("lineitem"))
    text = plan(M.alarm_windows(I.metrics(spark, sf_dir), alarms))
    assert "BroadcastHashJoin" in text and "NestedLoop" not in text and "Cartesian" not in text
    assert text.count("FileScan") == 1


def test_baseline_diff_is_an_equi_join(spark, sf_dir):
    rows = I.scans(spark, sf_dir).select(
        F.lit("d").alias("database"), "table_name", F.col("partition").alias("name"), F.lit("int").alias("type")
    ).distinct()
    text = plan(R.schema_drift(rows, rows))
    assert "FullOuter" in text and "NestedLoop" not in text


def test_ingest_rebalances_by_partition(stored):
    text = plan(stored.hint("rebalance", F.col("year"), F.col("month")))
    assert "REBALANCE_PARTITIONS_BY_COL" in text


def test_a_hot_partition_is_written_by_several_tasks(spark, sf_dir, tmp_path):
    """A third of the rows in one month: its folder gets several files, small months one each."""
    hot = F.when(F.col("l_orderkey") % 3 == 0, F.lit("1998-03-05").cast("timestamp_ntz"))
    raw = I.table(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.coalesce(hot, F.col("l_shipdate")))
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "256KB")
    try:
        P.write_partitions(raw.repartition(8).withColumns(I.year_month("l_shipdate")), str(tmp_path / "t"), I.BY)
    finally:
        spark.conf.set(key, before)
    files = {p.parent: len(list(p.parent.glob("*.parquet"))) for p in (tmp_path / "t").rglob("*.parquet")}
    assert files[tmp_path / "t" / "year=1998" / "month=03"] > 2
    assert sorted(files.values())[len(files) // 2] == 1


def test_the_fast_generator_stays_in_generated_code(stored):
    text = plan(C.corrupt(stored, {**I.CONFIG, "generator": "xxhash64"}, I.KEY))
    assert "xxhash64" in text and "md5" not in text
