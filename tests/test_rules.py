"""Rule evaluation on small frames, and the shipped ruleset."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from assay.operators import rules as R
from assay.operators.violations import scan_results


def test_shipped_ruleset_is_read_from_its_text(spark):
    rules = R.load_rules(spark, R.TRIP_RULES)
    assert len(rules) == 13
    assert rules[0] == R.Rule(1, "Completeness", "tpep_pickup_datetime", ">=", 0.98, None, R.TRIP_RULES[0])
    assert rules[5] == R.Rule(6, "RowCount", None, ">", 100000.0, None, "RowCount > 100000")
    assert rules[7] == R.Rule(8, "Mean", "trip_distance", "between", 0.5, 50.0, R.TRIP_RULES[7])
    assert rules[12] == R.Rule(13, "ColumnExists", "trip_distance", None, None, None, R.TRIP_RULES[12])
    assert R.rule_table(spark, rules).count() == 13


def test_ruleset_file(spark, tmp_path):
    (tmp_path / "rules.txt").write_text("Rules = [\n    " + ",\n    ".join(R.TRIP_RULES) + "\n]\n")
    assert R.read_ruleset(spark, str(tmp_path / "rules.txt")) == R.load_rules(spark, R.TRIP_RULES)


def trips(spark, n=100, null_every=0, fare=19.0):
    ts = F.lit("2025-09-01 10:00:00").cast("timestamp")
    fare_column = F.when(F.col("id") % null_every != 0, fare) if null_every else F.lit(fare)
    return spark.range(n).select(
        F.lit("2025").alias("year"), F.lit("09").alias("month"), ts.alias("tpep_pickup_datetime"),
        ts.alias("tpep_dropoff_datetime"), F.lit(1).cast("bigint").alias("passenger_count"),
        F.lit(3.0).alias("trip_distance"), fare_column.alias("fare_amount"),
    )


def test_clean_month_passes_all_rules(spark):
    rules = [r for r in R.load_rules(spark, R.TRIP_RULES) if r.rule_type != "RowCount"]
    out = R.evaluate(trips(spark), rules, ["year", "month"], "trips")
    assert {r.state for r in R.rule_results(out).collect()} == {"PASSED"}
    row = scan_results(out).first()
    assert (row.overall_score, row.overall_status, row.needs_action) == (100, "OK", False)
    assert row.partition == "year=2025/month=09"


def test_failing_rules_and_metrics(spark):
    rules = R.load_rules(spark, R.TRIP_RULES)
    out = R.rule_results(R.evaluate(trips(spark, null_every=10, fare=815.0), rules, ["year", "month"], "trips"))
    failed = {r.rule_id: r.evaluated_metrics for r in out.where("state = 'FAILED'").collect()}
    assert failed == {
        5: {"Column.fare_amount.Completeness": 0.9},
        6: {"Dataset.RowCount": 100.0},
        7: {"Column.fare_amount.Mean": 815.0},
    }


def test_lacking_column_fails_without_raising(spark):
    rules = R.load_rules(spark, R.TRIP_RULES)
    out = R.rule_results(R.evaluate(trips(spark).drop("fare_amount"), rules, ["year"], "trips"))
    failed = {r.rule_id for r in out.where("state = 'FAILED'").collect()}
    assert failed == {5, 6, 7, 12}


def test_bounds_of_between(spark):
    rule = R.load_rules(spark, ['Mean "v" between 5 and 100'])
    df = spark.createDataFrame([("a", 5.0), ("b", 100.0), ("c", 6.0), ("d", 101.0), ("e", None)], "k string, v double")
    states = lambda inclusive: {
        r.partition: r.state for r in R.rule_results(R.evaluate(df, rule, ["k"], "t", inclusive=inclusive)).collect()
    }
    assert states(True) == {"k=a": "PASSED", "k=b": "PASSED", "k=c": "PASSED", "k=d": "FAILED", "k=e": "FAILED"}
    assert states(False)["k=a"] == states(False)["k=b"] == "FAILED"


def test_freshness_needs_a_reference_time(spark):
    rule = R.load_rules(spark, ['DataFreshness "ts" <= 72'])
    df = spark.createDataFrame([("a", dt.datetime(2025, 9, 1)), ("a", dt.datetime(2025, 8, 1))], "k string, ts timestamp")
    with pytest.raises(ValueError):
        R.evaluate(df, rule, ["k"], "t")
    for hours, state in ((72, "PASSED"), (96, "FAILED")):
        as_of = F.lit(dt.datetime(2025, 9, 1) + dt.timedelta(hours=hours))
        row = R.rule_results(R.evaluate(df, rule, ["k"], "t", as_of=as_of)).first()
        assert row.evaluated_metrics == {"Column.ts.Freshness.Hours": float(hours)} and row.state == state


def test_column_values_fail_on_any_outlier(spark):
    rule = R.load_rules(spark, ['ColumnValues "v" between 0 and 500'])
    df = spark.createDataFrame([("a", 0.0), ("a", 500.0), ("b", -1.0), ("b", None), ("b", 3.0), ("c", None)],
                               "k string, v double")
    rows = {r.partition: r for r in R.rule_results(R.evaluate(df, rule, ["k"], "t")).collect()}
    assert rows["k=a"].state == "PASSED"
    assert rows["k=b"].state == "FAILED" and rows["k=b"].evaluated_metrics == {"Column.v.OutlierRatio": 0.5}
    assert rows["k=c"].state == "FAILED"  # no value, no metric


def test_quotes_in_rule_text(spark):
    rule = R.Rule(1, "Completeness", "v", ">=", 0.5, None, "Completeness \"v\" >= 0.5 -- it's \\ here")
    df = spark.createDataFrame([("a", 1.0)], "k string, v double")
    assert R.rule_results(R.evaluate(df, [rule], ["k"], "t")).first().rule == rule.rule_text


def test_unknown_rules_are_refused(spark):
    df = spark.createDataFrame([("a", 1.0)], "k string, v double")
    for rule in (R.Rule(1, "Entropy", "v", ">", 1.0), R.Rule(1, "Mean", "v", "~", 1.0)):
        with pytest.raises(ValueError):
            R.evaluate(df, [rule], ["k"], "t")


def test_schema_drift_of_real_frames(spark):
    before = spark.createDataFrame([(1, 2.0, "x")], "a int, b double, c string")
    after = spark.createDataFrame([(1, "2", 3)], "a int, b string, d int")
    drift = R.schema_drift(R.schema_columns(before, "lake", "t"), R.schema_columns(after, "lake", "t"))
    assert {(r.name, r.change, r.severity) for r in drift.collect()} == {
        ("b", "retyped", "CRITICAL"), ("c", "removed", "CRITICAL"), ("d", "added", "WARNING"),
    }
    assert [r.name for r in R.missing_columns(["a", "z"], before).collect()] == ["z"]


def test_uniqueness_with_one_key_in_most_rows(spark):
    df = spark.range(10_000).select(
        F.lit("p").alias("p"), F.when(F.col("id") < 4_000, F.lit(-1)).otherwise(F.col("id")).alias("k")
    )
    row = R.uniqueness(df, ["k"], ["p"]).first()
    assert (row.row_count, row.distinct_rows, row.severity) == (10_000, 6_001, "CRITICAL")
    assert row.duplicate_share == pytest.approx(0.3999)
