"""Quarantine: nothing vanishes, nothing is written without a scope, replays leave one copy."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assay.operators import quarantine as Q
from assay.operators.retention import expire_quarantine
from assay.sources.partitions import write_partitions
from tests.passes import counted, worked_out

SCHEMA = "id bigint, fare_amount double, year string, month string"


def now():
    return F.lit(dt.datetime(2025, 10, 1))


def trips(spark):
    rows = [(i, None if i % 10 == 0 else float(i * 10 - 50), "2025", "09" if i < 80 else "10") for i in range(100)]
    return spark.createDataFrame(rows, SCHEMA)


REQUEST = Q.Request("trips", "year=2025/month=09", "fare_amount < 0 OR fare_amount > 500", "i1")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_bad_and_clean_are_the_partition(spark):
    df = trips(spark)
    bad, clean = ids(Q.bad_rows(df, REQUEST)), ids(Q.clean_rows(df, REQUEST))
    assert sorted(bad + clean) == list(range(80))
    assert 0 in clean and 10 in clean  # null fare


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=1, max_size=8))
def test_bad_plus_clean_is_total(spark, values):
    df = spark.createDataFrame([(v, "a") for v in values], "v int, p string")
    request = Q.Request("t", "p=a", "v < 0 or v > 3")
    n = Q.quarantine_counts(df, [request]).first()
    assert n.total_count == len(values) and n.bad_count + n.remaining_count == n.total_count
    assert Q.bad_rows(df, request).count() == n.bad_count == sum(v is not None and (v < 0 or v > 3) for v in values)
    assert Q.clean_rows(df, request).count() == n.remaining_count


@pytest.mark.parametrize("spec", ["", "2025-09", "/", "year"])
def test_no_scope_is_refused(spark, spec):
    with pytest.raises(ValueError):
        Q.bad_rows(trips(spark), Q.Request("trips", spec, "true"))
    row = Q.check_requests(
        spark.createDataFrame([(spec, "true")], "partition string, filter_condition string")
    ).first()
    assert row.error


def scans(spark, *rows):
    return spark.createDataFrame(
        [("trips", "year=2025/month=09", dt.datetime(2025, 9, d), f"e{d}", s) for d, s in rows],
        "table_name string, partition string, ts timestamp, evaluation_id string, overall_score bigint",
    )


def counts(spark, bad, total):
    return spark.createDataFrame(
        [("i1", "trips", "year=2025/month=09", "f > 1", bad, total)],
        "issue_id string, table_name string, partition string, filter_condition string, bad_count bigint, total_count bigint",
    )


@pytest.mark.parametrize(
    "history, bad, total, before, after",
    [
        ([(1, 70), (2, 40)], 30, 100, 40.0, 55.0),
        ([(1, 90)], 100, 100, 90.0, 100.0),
        ([], 30, 100, 0.0, 15.0),
    ],
)
def test_scores(spark, history, bad, total, before, after):
    row = Q.remediation_rows(counts(spark, bad, total), scans(spark, *history), now(), "zone").first()
    assert (row.before_score, row.after_score) == (before, after)
    assert row.quarantine_path == "zone/table_name=trips/year=2025/month=09/issue_id=i1"


def test_texts(spark):
    rows = Q.remediation_rows(counts(spark, 133451, 3000000), scans(spark, (2, 40)), now(), "zone")
    row = Q.remediation_decisions(rows).first()
    assert row.reasoning == "Quarantined 133,451 records matching: f > 1. Score: 40.0 → 42.2."
    assert row.action_taken == "quarantine_records (133,451 of 3,000,000 records isolated)"
    assert row.context["issue_id"] == "i1"


def test_no_match_no_remediation(spark):
    assert Q.remediation_rows(counts(spark, 0, 100), scans(spark, (2, 40)), now(), "zone").count() == 0


def test_write_twice_is_write_once_and_other_issues_stay(spark, tmp_path):
    path = str(tmp_path / "zone")
    other = Q.Request("trips", "year=2025/month=10", "fare_amount > 900", "i2")
    Q.write_quarantine(trips(spark), [other], path, ["year", "month"], now())
    for _ in range(2):
        Q.write_quarantine(trips(spark), [REQUEST], path, ["year", "month"], now())
    zone = Q.read_quarantine(spark, path, ["year", "month"])
    assert dict(zone.schema.jsonValue()["fields"][-3]) and dict(zone.dtypes)["month"] == "string"
    assert ids(zone.where("issue_id = 'i1'")) == ids(Q.bad_rows(trips(spark), REQUEST))
    assert ids(zone.where("issue_id = 'i2'")) == ids(Q.bad_rows(trips(spark), other))
    lineage = Q.remediation_rows(
        Q.quarantine_counts(trips(spark), [REQUEST]), scans(spark, (2, 40)), now(), path
    )
    found = Q.recover_issue(zone, lineage.unionByName(lineage), "i1")
    assert ids(found) == ids(Q.bad_rows(trips(spark), REQUEST))
    assert found.first().filter_condition == REQUEST.filter_condition


def test_issues_of_a_row_are_tagged_together(spark):
    wide = Q.Request("trips", "year=2025", "fare_amount > 700", "i3")
    tagged = {r.id: r.issue_ids for r in Q.tag_issues(trips(spark), [REQUEST, wide]).collect()}
    assert tagged[79] == ["i1", "i3"] and tagged[81] == ["i3"] and tagged[1] == ["i1"] and 0 not in tagged


def test_issue_id_is_made_from_the_request():
    a = Q.Request("t", "p=1", "x > 1")
    assert a.issue == Q.Request("t", "p=1", "x > 1").issue != Q.Request("t", "p=1", "x > 2").issue


def test_expiry_drops_old_folders_and_rewrites_mixed_ones(spark, tmp_path):
    path = str(tmp_path / "zone")
    rows = [(1, "old", dt.datetime(2025, 1, 1)), (2, "mixed", dt.datetime(2025, 1, 1)),
            (3, "mixed", dt.datetime(2025, 9, 1)), (4, "new", dt.datetime(2025, 9, 1))]
    df = spark.createDataFrame(rows, "id bigint, issue_id string, written_at timestamp")
    write_partitions(df, path, ["issue_id"])
    for _ in range(2):
        expire_quarantine(spark, path, ["issue_id"], now())
        assert ids(spark.read.parquet(path)) == [3, 4]
    assert not (tmp_path / "zone" / "issue_id=old").exists()


@pytest.mark.parametrize("as_table", [False, True])
def test_any_number_of_predicates(spark, tmp_path, as_table):
    df = spark.range(1000).selectExpr("id AS a", "'x' AS p").coalesce(1)
    asked = [Q.Request("t", "p=x", f"a = {n} OR a = {n + 1}", f"i{n}") for n in range(450)]
    requests = asked
    if as_table:
        rows = [(r.issue_id, r.table_name, r.partition, r.filter_condition) for r in asked]
        requests = spark.createDataFrame(rows, "issue_id string, table_name string, partition string, filter_condition string")
    counts = Q.quarantine_counts(df, requests).collect()
    assert sorted(r.issue_id for r in counts) == sorted(r.issue_id for r in asked)
    assert all((r.bad_count, r.total_count) == (2, 1000) for r in counts)


def test_requests_of_a_table_are_worked_out_once(spark, tmp_path):
    (tmp_path / "seen").mkdir()
    rows = [(f"i{n}{m}", "trips", f"year=2025/month={n:02d}", f"fare_amount > {m}") for n in range(1, 13) for m in (100, 700)]
    requests = spark.createDataFrame(rows, "issue_id string, table_name string, partition string, filter_condition string")
    zone = str(tmp_path / "zone")
    Q.write_quarantine(trips(spark), counted(requests, tmp_path / "seen"), zone, ["year", "month"], now())
    assert worked_out(tmp_path / "seen") == len(rows)
    assert Q.read_quarantine(spark, zone, ["year", "month"]).count() == 58 + 4 + 18 + 18


def test_many_scopes_are_a_short_filter(spark):
    """The keys may be expressions, so a row's are not worked out once per scope."""
    df = trips(spark)
    requests = [Q.Request("trips", f"year=2025/month={n:02d}", "true", f"i{n}") for n in range(1, 13)] + [Q.Request("trips", "year=2024", "true", "j")]
    wanted = Q._requested(spark, requests).wanted
    assert str(wanted).count("month") <= 3 and df.where(wanted).count() == 100
    assert df.where(Q._requested(spark, requests[:9]).wanted).count() == 80
    assert {r.issue_id: r.bad_count for r in Q.quarantine_counts(df, requests).collect() if r.total_count} == {"i9": 80, "i10": 20}
