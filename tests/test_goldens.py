"""Severity, score and status on the worked examples and at their boundaries."""

import pytest
from pyspark.sql import functions as F

from assay.functions import severity as sev
from assay.operators import violations as V

EVENT = (
    "evaluation_id string, database string, table_name string, partition string, overall_state string, "
    "rule_results array<struct<rule_id:int,rule:string,rule_type:string,column:string,state:string,"
    "evaluated_metrics:map<string,double>,description:string>>"
)


def result(rule, metrics, state="FAILED", description=""):
    return (1, rule, None, None, state, metrics, description)


def completeness(column, value):
    return result(f'Completeness "{column}" >= 0.98', {f"Column.{column}.Completeness": value})


def evaluation(spark, *results):
    row = ("e1", "lake", "trips", "year=2025/month=09", "FAILED", list(results))
    return spark.createDataFrame([row], EVENT)


SIMULATED = [
    completeness("tpep_pickup_datetime", 0.93),
    result('DataFreshness "tpep_pickup_datetime" <= 72', {"Column.tpep_pickup_datetime.Freshness.Hours": 96.0}),
    result('ColumnValues "fare_amount" between 0 and 500', {"Column.fare_amount.OutlierRatio": 0.05}),
]
CORRUPTED_MONTH = [
    completeness("passenger_count", 0.64),
    completeness("fare_amount", 0.92),
    completeness("trip_distance", 0.97),
    result('Mean "fare_amount" between 5 and 100', {"Column.fare_amount.Mean": 815.0}),
    result('Mean "trip_distance" between 0.5 and 50', {"Column.trip_distance.Mean": 104.0}),
]


@pytest.mark.parametrize(
    "results, score, status, count",
    [
        (SIMULATED, 40, "CRITICAL", 3),
        ([completeness("passenger_count", 0.64)], 80, "OK", 1),
        ([completeness("tpep_pickup_datetime", 0.93)], 80, "OK", 1),
        (CORRUPTED_MONTH, 30, "CRITICAL", 5),
        ([], 100, "OK", 0),
        ([result("RowCount > 1", {}, "PASSED")], 100, "OK", 0),
        ([result("RowCount > 1", {}, "ERROR")], 100, "OK", 0),
        ([result("RowCount > 1", {}, "fail")], 90, "OK", 1),
        ([completeness("c", 0.5)] * 6, 0, "CRITICAL", 6),
        ([result("RowCount > 1", {})] * 5, 50, "WARNING", 5),
        ([result("RowCount > 1", {})] * 2, 80, "OK", 2),
    ],
)
def test_scores(spark, results, score, status, count):
    row = V.scan_results(evaluation(spark, *results)).first()
    assert (row.overall_score, row.overall_status, row.violation_count) == (score, status, count)
    assert row.needs_action == (count > 0)
    flat = V.score_violations(
        evaluation(spark, *results).select("evaluation_id"), V.violations(evaluation(spark, *results))
    ).first()
    assert (flat.overall_score, flat.overall_status, flat.violation_count) == (score, status, count)


def test_violation_row(spark):
    row = V.violations(evaluation(spark, *SIMULATED)).orderBy("position").first()
    assert row.type == "completeness" and row.severity == "CRITICAL"
    assert row.affected_columns == ["tpep_pickup_datetime"]
    assert row.observed_values == {"Column.tpep_pickup_datetime.Completeness": 0.93}


def test_rule_text_falls_back_to_description_only_if_absent(spark):
    rows = V.violations(
        evaluation(spark, result(None, {}, description='ColumnExists "a"'), result("", {}, description="Mean"))
    ).orderBy("position").collect()
    assert [(r.rule, r.type) for r in rows] == [('ColumnExists "a"', "schema"), ("", "unknown")]


@pytest.mark.parametrize(
    "kind, metrics, expected",
    [
        ("completeness", [("a", 0.95)], "CRITICAL"),
        ("completeness", [("a", 0.98)], "WARNING"),
        ("completeness", [("a", 0.97), ("b", 0.50)], "WARNING"),
        ("completeness", [("a", 0.99), ("b", 0.50)], "CRITICAL"),
        ("completeness", [], "WARNING"),
        ("completeness", None, "WARNING"),
        ("freshness", [("a", 72.0)], "WARNING"),
        ("freshness", [("a", 72.1)], "CRITICAL"),
        ("freshness", [("a", 24.0)], "WARNING"),
        ("freshness", [], "WARNING"),
        ("distribution", [("x.OutlierRatio", 0.01)], "WARNING"),
        ("distribution", [("x.OutlierRatio", 0.011)], "CRITICAL"),
        ("distribution", [("x.Mean", 900.0)], "WARNING"),
        ("distribution", [], "WARNING"),
        ("schema", [], "CRITICAL"),
        ("unknown", [("a", 0.0)], "WARNING"),
    ],
)
def test_severity(spark, kind, metrics, expected):
    row = (kind, dict(metrics) if metrics is not None else None)
    df = spark.createDataFrame([row], "kind string, metrics map<string,double>")
    assert df.select(sev.severity(F.col("kind"), F.col("metrics"))).first()[0] == expected


@pytest.mark.parametrize(
    "text, kind, column",
    [
        ('Completeness "a" >= 0.9', "completeness", "a"),
        ("RowCount > 100000", "unknown", "unknown"),
        ('Mean "completeness_x" > 1', "completeness", "completeness_x"),
        ('Mean "freshness" between 1 and 2', "freshness", "freshness"),
        ('Mean "a" between 1 and 2', "distribution", "a"),
        ('COLUMNEXISTS "a"', "schema", "a"),
    ],
)
def test_classify(spark, text, kind, column):
    df = spark.createDataFrame([(text,)], "t string")
    assert tuple(df.select(sev.classify_rule(F.col("t")), sev.extract_column(F.col("t"))).first()) == (kind, column)


def test_type_of_the_rule_table_is_an_option(spark):
    wrong = evaluation(spark, (1, 'Mean "freshness_x" > 1', "Mean", "freshness_x", "FAILED", {}, ""))
    assert V.violations(wrong).first().type == "freshness"
    assert V.violations(wrong, by_rule_table=True).first().type == "distribution"


@pytest.mark.parametrize("share, expected", [(0.11, "CRITICAL"), (0.06, "WARNING"), (0.05, None)])
def test_uniqueness_lines(spark, share, expected):
    assert spark.range(1).select(sev.uniqueness_severity(F.lit(share))).first()[0] == expected
