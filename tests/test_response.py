"""History, diagnosis, alerts, metrics and alarms on small frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from assay.functions import text as X
from assay.operators import diagnosis as D
from assay.operators import history as H
from assay.operators import metrics as M
from assay.operators import notify as N
from assay.operators import summaries as S
from assay.plans import response as P
from tests.test_goldens import CORRUPTED_MONTH, SIMULATED, evaluation

T0 = dt.datetime(2025, 9, 1)
SCAN = ("evaluation_id string, table_name string, partition string, ts timestamp, overall_score bigint, "
        "overall_status string, violation_count bigint")


def scans(spark, n=8, partition="year=2025/month=09"):
    return spark.createDataFrame(
        [(f"s{i}", "trips", partition, T0 + dt.timedelta(hours=i), i * 10, "OK", i % 2) for i in range(n)], SCAN
    )


def test_newest_per_key_and_ties(spark):
    out = H.newest_per_key(scans(spark), 5).orderBy("recency").collect()
    assert [r.evaluation_id for r in out] == ["s7", "s6", "s5", "s4", "s3"]
    tied = scans(spark, 3).withColumn("ts", F.lit(T0))
    assert [r.evaluation_id for r in H.newest(tied, 2).collect()] == ["s0", "s1"]


def test_history_of_unknown_and_empty_keys(spark):
    found = spark.createDataFrame([("trips", "year=2025/month=09"), ("trips", ""), ("trips", "x")],
                                  "table_name string, partition string")
    rows = {r.partition: r for r in H.history_context(found, scans(spark).unionByName(scans(spark, 2, ""))).collect()}
    assert rows["year=2025/month=09"].previous_scans == 5 and rows["year=2025/month=09"].failing_scans == 3
    assert [s.evaluation_id for s in rows["year=2025/month=09"].scans] == ["s7", "s6", "s5"]
    assert rows[""].previous_scans == rows["x"].previous_scans == 0 and rows[""].scans is None


def test_split_key(spark):
    df = spark.createDataFrame([("t#p", None), ("t#p#q", "own"), ("t", None)], "pk string, table_name string")
    got = [(r.table_name, r.partition) for r in H.split_key(df).collect()]
    assert got == [("t", "p"), ("own", "p#q"), ("t", "")]


def test_baseline_versions_are_numbers(spark):
    stored = spark.createDataFrame([("d", "t", v) for v in range(1, 13)], "database string, table_name string, version bigint")
    new = spark.createDataFrame([("d", "t"), ("d", "u")], "database string, table_name string")
    assert H.latest_baseline(stored).first().version == 12
    assert {(r.table_name, r.version) for r in H.next_baseline(new, stored).collect()} == {("t", 13), ("u", 1)}


def test_remediation_filter_comes_before_the_limit(spark):
    rows = spark.createDataFrame([(f"i{i}", "a" if i < 3 else "b", T0 + dt.timedelta(hours=i)) for i in range(50)],
                                 "issue_id string, table_name string, ts timestamp")
    assert [r.issue_id for r in H.remediation_history(rows, "a", 2).collect()] == ["i2", "i1"]
    assert H.remediation_history(rows, limit=10).count() == 10


FULL = ('{"probable_cause": "c", "confidence": "HIGH", "recommended_action": "auto_resolve", '
        '"action_details": {"description": "d"}, "explanation": "e"}')
OK = ("c", "HIGH", "auto_resolve", "d", "e", True)


def fallback(text):
    return (text, "LOW", "notify_only", "Could not parse structured diagnosis", text, False)


@pytest.mark.parametrize(
    "answer, expected",
    [
        (FULL, OK),
        (f"\n {FULL} \n", OK),
        (f"```json\n{FULL}\n```", OK),
        (f"```\n{FULL}", OK),
        (f"```json\n{FULL}\n```\nmore", OK),
        ('```json\n{"probable_cause": "a ``` b"}\n```', ("a ``` b", None, None, None, None, True)),
        ('{"confidence": "LOW"}', (None, "LOW", None, None, None, True)),
        ("no json", fallback("no json")),
        ("```\nno json\n```", fallback("no json")),
        ("``` no break", fallback("``` no break")),
        ("{'probable_cause': 'c'}", fallback("{'probable_cause': 'c'}")),
        ('{"a": 1', fallback('{"a": 1')),
        ('{"a": 1} trailing', fallback('{"a": 1} trailing')),
        ("", fallback("")),
    ],
)
def test_parse_answer(spark, answer, expected):
    row = spark.createDataFrame([(answer,)], "a string").select(D.parse_answer(F.col("a")).alias("x")).first().x
    assert tuple(row)[:6] == expected


def test_batches_reach_the_callable(spark):
    df = spark.range(10).select("id", F.lit("CRITICAL").alias("severity"))
    prompts = df.withColumn("prompt", F.concat_ws("-", "severity", "id"))
    out = D.diagnose_batch(prompts, lambda batch: [p.lower() for p in batch], ["id"], partitions=3)
    assert {r.id: r.answer for r in out.collect()}[3] == "critical-3"
    assert out.columns == ["id", "answer"] and out.rdd.getNumPartitions() == 3


@pytest.mark.parametrize("details", ['"text"', "[1,2]", '{"a":{"b":1}}', "null"])
def test_action_details_are_kept_whole(spark, details):
    answer = '{"recommended_action": "notify_only", "action_details": ' + details + "}"
    row = spark.createDataFrame([(answer,)], "a string").select(D.parse_answer(F.col("a")).alias("x")).first().x
    wanted = {'"text"': "text", "null": None}.get(details, details)
    assert row.parsed and row.action_details == wanted and row.recommended_action == "notify_only"


@pytest.mark.parametrize(
    "severity, prefix",
    [("critical", "🚨 CRITICAL"), ("Warning", "⚠️ WARNING"), ("INFO", "ℹ️ INFO"), ("odd", "ODD")],
)
def test_subjects(spark, severity, prefix):
    df = spark.createDataFrame([("12345678-90", severity, "m" * 300)], "issue_id string, severity string, message string")
    row = N.alerts(df, "lake").first()
    assert row.subject == f"[lake] {prefix}: Data Quality Issue 12345678"
    decision = N.alert_decisions(N.alerts(df)).first()
    assert len(decision.context["message_preview"]) == 200 and decision.reasoning.endswith(": " + "m" * 100)


def test_long_subjects_are_cut(spark):
    df = spark.createDataFrame([("i", "x" * 200, "m")], "issue_id string, severity string, message string")
    assert len(N.alerts(df).first().subject) == 100


def test_labels(spark):
    assert spark.range(1).select(X.label(F.lit("null_share of_x"))).first()[0] == "Null Share Of X"


def test_response_plan(spark):
    events = evaluation(spark, *SIMULATED).unionByName(
        evaluation(spark, *CORRUPTED_MONTH).withColumn("evaluation_id", F.lit("e2"))
    )
    out = P.respond(events, scans(spark), F.lit(T0 + dt.timedelta(days=1)))
    assert out.scans.count() == 2 and out.violations.count() == out.alerts.count() == 8
    acted = out.actions.groupBy("recommended_action", "alert_severity").count().collect()
    assert {tuple(r) for r in acted} == {("quarantine_and_notify", "critical", 5), ("notify_only", "warning", 3)}
    assert out.actions.select("previous_scans", "confidence").distinct().collect() == [(5, "HIGH")]
    assert out.decisions.count() == 24
    assert {tuple(r) for r in out.decisions.select("table_name", "partition").distinct().collect()} == {
        ("trips", "year=2025/month=09")
    }
    assert {r.name: r["count"] for r in out.metrics.groupBy("name").count().collect()} == {
        "OverallQualityScore": 2, "AnomaliesDetected": 2, "QualityScore": 5, "DecisionCount": 24,
    }
    shared = {r.evaluation_id: r for r in D.shared_cause(events).collect()}
    assert shared["e1"].types == ["completeness", "distribution", "freshness"]


def points(spark, *rows):
    return spark.createDataFrame(
        [(T0 + dt.timedelta(minutes=m), name, v, dims) for m, name, v, dims in rows],
        "ts timestamp, name string, value double, dimensions map<string,string>",
    )


def test_alarm_states(spark):
    t, crit = {"TableName": "trips"}, {"TableName": "trips", "Severity": "CRITICAL"}
    df = points(
        spark, (1, M.SCORE, 40.0, t), (2, M.SCORE, 90.0, t), (1, M.SCORE, 10.0, {"TableName": "other"}),
        (1, M.ANOMALIES, 6.0, crit), (2, M.ANOMALIES, 5.0, crit), (3, M.ANOMALIES, 99.0, {**t, "Severity": "WARNING"}),
        (1, M.TOKEN_COST, 0.5, {"ModelId": "a"}), (4, M.TOKEN_COST, 0.5, {"ModelId": "b"}),
    )
    alarms = M.alarm_table(spark, M.default_alarms("trips", "q-"))
    at = lambda minutes: {
        r.alarm: (r.state, r.value)
        for r in M.alarm_states(df, alarms, F.lit(T0 + dt.timedelta(minutes=minutes)), "q-").collect()
    }
    assert at(5) == {"LowQualityScore": ("ALARM", 40.0), "HighAnomalyCount": ("ALARM", 11.0), "HighTokenCost": ("OK", 1.0)}
    assert at(9) == at(5)
    assert set(at(10).values()) == {("OK", None)}
    assert M.alarm_states(df, alarms, F.lit(T0), "other-").count() == 0


def test_feed_and_summary(spark):
    rows = [(f"d{i}", T0 + dt.timedelta(minutes=i), "a" if i % 2 else "b", ["t", "", None][i % 3], "r" * 200) for i in range(80)]
    df = spark.createDataFrame(rows, "decision_id string, ts timestamp, decision_type string, table_name string, reasoning string")
    feed = S.decision_feed(df, "a").collect()
    assert len(feed) == 30 and feed[0].decision_id == "d79" and len(feed[0].reasoning) == 120
    assert feed[0].time == "2025-09-01T01:19:00"
    assert tuple(S.decision_summary(df).first()) == (80, 2, 1)
    assert tuple(S.decision_summary(df.limit(0)).first()) == (0, 0, 0)
    assert [r[0] for r in S.decision_types(df).collect()] == ["a", "b"]
    assert S.latest_scan(scans(spark)).first().evaluation_id == "s7"
    assert S.latest_scan(scans(spark).limit(0)).count() == 0
