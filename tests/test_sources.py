"""Scans, partitions, evaluation records and audit tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from assay.functions import text as X
from assay.operators import violations as V
from assay.session import scratch_dir
from assay.sources import audit as A
from assay.sources import partitions as P
from assay.sources import results as E
from assay.sources import tables as S

SCHEMA = "id bigint, year string, month string"


def months(spark):
    rows = [(i, "2025", f"{i % 3 + 1:02d}") for i in range(30)]
    return spark.createDataFrame(rows, SCHEMA)


def value(spark, column, *args):
    return spark.range(1).select(column(*[F.lit(a) for a in args])).first()[0]


@pytest.mark.parametrize(
    "predicate, spec",
    [
        ("year='2025' AND month='09'", "year=2025/month=09"),
        ("month = '09' and (year= '2025')", "month=09/year=2025"),
        ("", ""),
        (None, ""),
        ("fare > 3", ""),
        ("x=''", "x="),
    ],
)
def test_partition_of_predicate(spark, predicate, spec):
    assert value(spark, X.partition_of_predicate, predicate) == spec


def test_predicate_of_partition(spark):
    assert value(spark, X.predicate_of_partition, "year=2025/junk/month=09") == "year='2025' AND month='09'"


@pytest.mark.parametrize("spec", ["", "2025", "/"])
def test_broken_partition_specs(spec):
    with pytest.raises(ValueError):
        S.parse_partition(spec)


def test_partition_scan_prunes(spark, tmp_path):
    P.write_partitions(months(spark), str(tmp_path / "t"), ["year", "month"])
    df = S.read_partition(spark, str(tmp_path / "t"), "year=2025/month=02", SCHEMA)
    assert sorted(r.id for r in df.collect()) == list(range(1, 30, 3))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "month" in plan


def test_month_from_file_name(spark, tmp_path):
    months(spark).coalesce(1).write.parquet(str(tmp_path / "src"))
    (part,) = (tmp_path / "src").glob("*.parquet")
    for name in ("trips_2024-01.parquet", "trips_2025-12.parquet", "trips.parquet"):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(part.read_bytes())
    df = spark.read.parquet(str(tmp_path / "in")).select(
        X.year_month_of_filename(F.col("_metadata.file_name")).alias("p")
    ).where("p is not null").select("p.*").distinct()
    assert {tuple(r) for r in df.collect()} == {("2024", "01"), ("2025", "12")}


def test_calendar_rolls_over(spark):
    got = [tuple(r) for r in P.month_calendar(spark, 2024, 11, 4).orderBy("year", "month").collect()]
    assert got == [("2024", "11"), ("2024", "12"), ("2025", "01"), ("2025", "02")]


def test_ingest_skips_or_overwrites(spark, tmp_path):
    path = str(tmp_path / "t")
    first = months(spark).where("month = '01'").withColumn("v", F.lit(1))
    P.ingest_partitions(first, path, ["year", "month"])
    P.ingest_partitions(months(spark).withColumn("v", F.lit(2)), path, ["year", "month"])
    read = lambda: {
        (r.month, r.v): r["count"]
        for r in S.read_fact(spark, path, SCHEMA + ", v int").groupBy("month", "v").count().collect()
    }
    assert read() == {("01", 1): 10, ("02", 2): 10, ("03", 2): 10}
    P.ingest_partitions(first.withColumn("v", F.lit(3)), path, ["year", "month"], overwrite=True, rebalance=False)
    assert read() == {("01", 3): 10, ("02", 2): 10, ("03", 2): 10}
    got = {tuple(r) for r in P.existing_partitions(spark, path, ["year", "month"]).collect()}
    assert got == {("2025", "01"), ("2025", "02"), ("2025", "03")}
    assert P.existing_partitions(spark, path + "_none", ["year"]).count() == 0


def test_register_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    P.write_partitions(months(spark), path, ["year", "month"])
    P.create_fact_table(spark, "reg_test", SCHEMA, path, ["year", "month"])
    assert spark.table("reg_test").count() == 0
    wanted = P.existing_partitions(spark, path, ["year", "month"])
    for _ in range(2):
        P.register_partitions(spark, "reg_test", wanted, ["year", "month"])
    assert spark.table("reg_test").count() == 30
    assert P.known_partitions(spark, "reg_test", ["year", "month"]).count() == 3


def test_restore_brings_back_the_clean_copy(spark, tmp_path):
    dirty, audit = str(tmp_path / "dirty"), str(tmp_path / "audit")
    P.write_partitions(months(spark).withColumn("id", -F.col("id")), dirty, ["year", "month"])
    A.append_audit(spark, months(spark).withColumn("ts", F.lit(dt.datetime(2025, 1, 1))), audit, ["id"])
    P.restore_partitions(spark, months(spark), dirty, ["year", "month"], clear=[audit, audit + "_none"], rebalance=True)
    assert S.read_fact(spark, dirty, SCHEMA).agg(F.min("id")).first()[0] == 0
    assert spark.read.schema("audit_id string").parquet(audit).count() == 0


def record(**detail):
    return {
        "detail": {"state": "SUCCEEDED", **detail},
        "DataSource": {"CatalogTable": {"DatabaseName": "db", "TableName": "t",
                                        "AdditionalOptions": {"pushDownPredicate": "year='2025' AND month='09'"}}},
        "RuleResults": [
            {"Name": "r1", "Description": 'Completeness "a" > 0.9', "Result": "FAIL",
             "EvaluatedMetrics": {"Column.a.Completeness": 0.5}, "EvaluationMessage": "low"},
            {"Name": "r2", "Result": "fail", "EvaluatedMetrics": {"x": None}},
            {"Name": "r3", "Result": "ERROR"},
            {"Name": "r4", "Result": "PASS"},
        ],
    }


def read(spark, *texts):
    return E.read_results(spark.createDataFrame([(t,) for t in texts], "value string")).collect()


def test_records(spark):
    a, b, c, d, e = read(
        spark,
        json.dumps(record(resultID="one")),
        json.dumps(record(resultId="two")),
        json.dumps(record()),
        "no json",
        json.dumps({"detail": {"resultID": "", "resultId": "three", "context": {"databaseName": "x", "tableName": "y"}}}),
    )
    assert (a.evaluation_id, b.evaluation_id, c.evaluation_id) == ("one", "two", None)
    assert (a.error, b.error, c.error, d.error) == (None, None, "no result id", "not a JSON record")
    assert (a.database, a.table_name, a.partition) == ("db", "t", "year=2025/month=09")
    assert [(r.rule, r.state, r.evaluated_metrics, r.description) for r in a.rule_results] == [
        ('Completeness "a" > 0.9', "FAILED", {"Column.a.Completeness": 0.5}, "low"),
        ("r2", "FAILED", {"x": 0.0}, ""),
        ("r3", "ERROR", None, ""),
        ("r4", "PASS", None, ""),
    ]
    assert (e.evaluation_id, e.database, e.table_name, e.partition) == ("three", "x", "y", "")
    assert e.overall_state == "PASSED" and e.rule_results == []


def test_raw_records_know_fail_only(spark):
    df = spark.createDataFrame([("FAIL",), ("fail",), ("FAILED",), ("ERROR",), ("PASS",), (None,)], "state string")
    assert V.failed_results(df, states=["FAIL"]).count() == 2
    assert V.failed_results(df).count() == 3


def test_events_with_lacking_fields(spark):
    text = '{"evaluation_id": "e", "rule_results": [{"rule": "Completeness \\"a\\"", "state": "FAILED", "evaluated_metrics": {"m": "0.93"}}]}'
    events = E.read_events(spark.createDataFrame([(text,), ("{}",)], "value string"))
    rows = {r.evaluation_id: r for r in V.with_violations(events).collect()}
    assert rows["e"].overall_score == 80 and rows["e"].table_name == rows["e"].partition == "unknown"
    assert rows["unknown"].overall_score == 100 and rows["unknown"].overall_state == "UNKNOWN"


def test_audit_twice_is_once(spark, tmp_path):
    path = str(tmp_path / "audit")
    rows = months(spark).withColumn("ts", F.lit(dt.datetime(2025, 1, 1)) + F.make_dt_interval(F.col("id")))
    A.append_audit(spark, rows.unionByName(rows), path, ["id"])
    A.append_audit(spark, rows, path, ["id"])
    A.append_audit(spark, rows.withColumn("id", F.col("id") + 100), path, ["id"])
    A.append_audit(spark, rows.limit(0), path, ["id"])
    stored = spark.read.parquet(path)
    assert stored.count() == stored.select("id").distinct().count() == 60
    row = stored.where("id = 0").first()
    assert row.ttl - row.ts.replace(tzinfo=dt.timezone.utc).timestamp() == 90 * 86400


@pytest.mark.parametrize(
    "cell, kind, got",
    [
        (None, "null", None), ("", "null", None), ("12", "long", 12), ("-7", "long", -7), ("1.5", "double", 1.5),
        ("1.", "double", 1.0), (".5e1", "double", 5.0), ("1e5", "text", "1e5"), ("1.5d", "text", "1.5d"),
        ("a.b", "text", "a.b"), ("2025-09-01", "text", "2025-09-01"), ("1_000", "long", 1000),
        ("99999999999999999999", "text", "99999999999999999999"), (" 3 ", "long", 3),
    ],
)
def test_cells(spark, cell, kind, got):
    row = spark.createDataFrame([(cell,)], "c string").select(X.coerce_cell(F.col("c")).alias("x")).first().x
    assert row.kind == kind
    assert {"null": None, "long": row.as_long, "double": row.as_double, "text": row.as_text}[kind] == got


def test_scratch_dir_is_under_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(spark, "x").startswith(base) and scratch_dir(spark, "x") != scratch_dir(spark, "x")


def test_zones():
    assert S.zone_path("/lake/", "raw", "trips") == "/lake/raw/trips"
    with pytest.raises(ValueError):
        S.zone_path("/lake", "bronze", "trips")


def test_skipped_partitions_are_not_read(spark, tmp_path):
    src, path = str(tmp_path / "src"), str(tmp_path / "table")
    rows = [(n, "2025", f"{1 + n % 4:02d}", f"a{n % 2}:50%") for n in range(40)]
    df = spark.createDataFrame(rows, "id bigint, year string, month string, kind string")
    keys = ["year", "month", "kind"]
    P.write_partitions(df, src, keys)
    P.write_partitions(df.where("month < '03'"), path, keys)
    assert {tuple(r) for r in P.existing_partitions(spark, path, keys).collect()} == {
        ("2025", m, k) for m, k in (("01", "a0:50%"), ("02", "a1:50%"))
    }
    stored = spark.read.schema("id bigint, year string, month string, kind string").parquet(src)
    there = ["/".join(v) for v in P.partition_folders(spark, path, keys)]
    left = stored.where(~P.partition_name(keys).isin(there))
    text = left._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [NOT" in text and len(left.inputFiles()) == len(stored.inputFiles())
    P.ingest_partitions(stored, path, keys)
    P.ingest_partitions(stored, path, keys)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(40))


def test_a_null_key_is_never_left_out(spark):
    from assay.functions.text import partition_text

    df = spark.createDataFrame([(None, "01"), ("2025", "02")], "year string, month string")
    got = sorted(r[0] for r in df.select(partition_text(["year", "month"])).collect())
    assert got == ["year=2025/month=02", "year=__HIVE_DEFAULT_PARTITION__/month=01"]


@pytest.mark.parametrize("listed", [0, 1000])
def test_present_partitions_are_skipped_by_list_or_join(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(P, "MAX_LISTED", listed)
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a", "x/y"), (2, "b", None), (3, "c", "")], "id int, p string, q string")
    P.ingest_partitions(rows.where("id < 3"), path, ["p", "q"])
    P.ingest_partitions(rows.withColumn("id", F.col("id") + 10), path, ["p", "q"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 13]
