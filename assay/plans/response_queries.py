"""Queries over diagnosis, actions, metrics and alarms."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.operators import answers as S
from assay.operators import diagnosis as D
from assay.operators import history as H
from assay.operators import metrics as M
from assay.operators import notify as N
from assay.operators import violations as V
from assay.plans import inputs as I
from assay.plans import response as P
from assay.plans.registry import query
from assay.session import scratch_dir

_NOW = "2024-01-30 12:00:00"

# --- diagnosis -----------------------------------------------------------------------------


def _violation_context(spark, d):
    """Violations of every month, with the month's own scan as history."""
    found = I.stored_evaluations(spark, d)
    scans = V.scan_results(found).withColumn("ts", F.lit(_NOW).cast("timestamp_ntz"))
    rows = V.violations(found)
    return H.history_context(
        rows.withColumn(
            "observed_values", F.transform_values("observed_values", lambda k, v: F.round(v, 4))
        ),
        scans,
    )


def _sql_text(s):
    return "'" + s.replace("'", "''") + "'"


_JSON_RULE = "replace(rule, '\"', '\\\"')"
_VIOLATION_JSON = (
    "'{\"type\":\"' || type || '\",\"severity\":\"' || severity || '\",\"table\":\"lineitem\",\"partition\":\"' "
    "|| v.\"partition\" || '\",\"affected_columns\":[\"' || col || '\"]' "
    "|| CASE WHEN metric_key <> '' THEN ',\"observed_values\":{\"' || metric_key || '\":' "
    "|| round(value, 4) || '}' ELSE '' END "
    f"|| ',\"rule\":\"' || {_JSON_RULE} || '\",\"evaluation_id\":\"' || v.evaluation_id || '\"}}'"
)
_HISTORY_JSON = (
    "'{\"previous_scans\":1,\"scans\":[{\"evaluation_id\":\"' || v.evaluation_id || '\",\"overall_score\":' "
    "|| overall_score || ',\"overall_status\":\"' || overall_status || '\",\"violation_count\":' "
    "|| violation_count || '}]}'"
)
_SCORED = f"""{I.SUMMARY_SQL},
v AS (SELECT *, row_number() OVER (PARTITION BY evaluation_id ORDER BY rule_id) - 1 AS position FROM violations),
full_rows AS (SELECT v.*, s.overall_score, s.overall_status, s.violation_count FROM v
  JOIN summary s ON s.evaluation_id = v.evaluation_id)"""


@query(
    "diagnosis_prompts",
    f"""WITH {_SCORED} SELECT evaluation_id, CAST(position AS INT) AS position, {_sql_text(D.PROMPT_HEAD)}
  || {_VIOLATION_JSON} || {_sql_text(D.PROMPT_HISTORY)} || {_HISTORY_JSON} || {_sql_text(D.PROMPT_TAIL)} AS prompt
FROM full_rows v""",
)
def diagnosis_prompts(spark, d):
    return D.prompts(_violation_context(spark, d)).select("evaluation_id", "position", "prompt")


@query(
    "recommend_action",
    f"""WITH {_SCORED} SELECT evaluation_id, rule, severity, CASE severity WHEN 'CRITICAL' THEN 'quarantine_and_notify'
    WHEN 'WARNING' THEN 'notify_only' ELSE 'auto_resolve' END AS recommended_action,
  'MEDIUM' AS confidence, CASE severity WHEN 'CRITICAL' THEN 'critical' ELSE 'warning' END AS alert_severity,
  md5(evaluation_id || '#' || position) AS issue_id FROM full_rows""",
)
def recommend_action(spark, d):
    found = I.stored_evaluations(spark, d)
    scans = V.scan_results(found).withColumn("ts", F.lit(_NOW).cast("timestamp_ntz"))
    out = P.actions(V.violations(found), scans)
    return out.select(
        "evaluation_id", "rule", "severity", "recommended_action", "confidence", "alert_severity", "issue_id"
    )


def _severity_rows(spark, d):
    kind = F.col("user_id") % 3
    return I.table(spark, d, "events").select(
        "event_id",
        F.when(kind == 0, "CRITICAL").when(kind == 1, "WARNING").otherwise("INFO").alias("severity"),
        F.concat(F.lit('Mean "'), F.col("event_type"), F.lit('" > 1')).alias("rule"),
        (F.col("user_id") % 5).alias("failing_scans"),
    )


_POLICY_SQL = """WITH t AS (SELECT *, user_id % 5 AS n, CASE user_id % 3 WHEN 0 THEN 'quarantine_and_notify'
    WHEN 1 THEN 'notify_only' ELSE 'auto_resolve' END AS a,
  CASE user_id % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'WARNING' ELSE 'INFO' END AS s FROM events)
SELECT event_id, 'rule not met: Mean "' || event_type || '" > 1' AS probable_cause,
  CASE WHEN n >= 3 THEN 'HIGH' WHEN n >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, a AS recommended_action,
  a || ' for ' || s || ' violation' AS action_description, n || ' failing scans on record' AS explanation,
  true AS parsed, '{"description":"' || a || ' for ' || s || ' violation"}' AS action_details FROM t"""


def _policy(spark, d):
    answer = D.policy_answer(F.col("rule"), F.col("severity"), F.col("failing_scans"))
    return _severity_rows(spark, d).withColumn("prompt", answer)


@query("policy_answer", _POLICY_SQL)
def policy_answer(spark, d):
    """The answers of the default policy, where no model is asked, parsed."""
    return _policy(spark, d).select("event_id", D.parse_answer(F.col("prompt")).alias("x")).select("event_id", "x.*")


@query("diagnose_batch", _POLICY_SQL)
def diagnose_batch(spark, d):
    """Answers from the batch callable, which here sends every prompt back in a code fence, parsed."""
    answered = D.diagnose_batch(
        _policy(spark, d), lambda prompts: "```json\n" + prompts + "\n```", ["event_id"], partitions=4
    )
    return answered.select("event_id", D.parse_answer(F.col("answer")).alias("x")).select("event_id", "x.*")


@query("diagnose_stored", _POLICY_SQL)
def diagnose_stored(spark, d):
    """The same from stored answers: a first run in which a fifth of the prompts fails, a second for those alone."""
    store = scratch_dir(spark, "answers")
    prompts = P.stored(_policy(spark, d), scratch_dir(spark, "prompts"))

    def flaky(texts):
        if texts.map(lambda t: len(t) % 5 == 0).any():
            raise RuntimeError("down")
        return "```json\n" + texts + "\n```"

    S.ask_open(prompts, flaky, store, callers=4)
    S.ask_open(prompts, lambda texts: "```json\n" + texts + "\n```", store, callers=4)
    answered = S.answered(prompts, store)
    return answered.select("event_id", D.parse_answer(F.col("answer")).alias("x")).select("event_id", "x.*")


def _answers(spark, d):
    """An answer per event: plain JSON, fenced, fence not closed, a fence inside a value, lacking
    keys, and no JSON."""
    kind = F.col("user_id") % 7
    cause = F.concat(F.lit("cause "), F.col("event_id").cast("string"))
    body = F.concat(
        F.lit('{"probable_cause": "'), cause,
        F.lit('", "confidence": "HIGH", "recommended_action": "auto_resolve", '
              '"action_details": {"description":"do","column":"c"}, "explanation": "why"}'),
    )
    fence = "```"
    text = (
        F.when(kind == 0, body)
        .when(kind == 1, F.concat(F.lit(f"  {fence}json\n"), body, F.lit(f"\n{fence}\n")))
        .when(kind == 2, F.concat(F.lit(f"{fence}\n"), body))
        .when(kind == 3, F.concat(F.lit(f"{fence}json\n"), F.lit('{"probable_cause": "see ' + fence + 'x'
                                                                 + fence + ' '), cause, F.lit(f'"}}\n{fence}')))
        .when(kind == 4, F.concat(F.lit('{"probable_cause": "'), cause, F.lit('", "action_details": ["a",1]}')))
        .when(kind == 5, F.concat(F.lit(f"{fence} no break "), cause))
        .otherwise(F.concat(F.lit("  not json "), cause, F.lit("\n")))
    )
    return I.table(spark, d, "events").select("event_id", text.alias("answer"))


_CAUSE = "'cause ' || event_id"


@query(
    "parse_diagnosis",
    f"""SELECT event_id, CASE user_id % 7 WHEN 3 THEN 'see ```x``` ' || {_CAUSE} WHEN 5 THEN '``` no break ' || {_CAUSE}
    WHEN 6 THEN 'not json ' || {_CAUSE} ELSE {_CAUSE} END AS probable_cause,
  CASE WHEN user_id % 7 IN (0, 1, 2) THEN 'HIGH' WHEN user_id % 7 IN (5, 6) THEN 'LOW' END AS confidence,
  CASE WHEN user_id % 7 IN (0, 1, 2) THEN 'auto_resolve' WHEN user_id % 7 IN (5, 6) THEN 'notify_only' END
    AS recommended_action,
  CASE WHEN user_id % 7 IN (0, 1, 2) THEN 'do' WHEN user_id % 7 IN (5, 6)
    THEN 'Could not parse structured diagnosis' END AS action_description,
  CASE WHEN user_id % 7 IN (0, 1, 2) THEN 'why' WHEN user_id % 7 = 5 THEN '``` no break ' || {_CAUSE}
    WHEN user_id % 7 = 6 THEN 'not json ' || {_CAUSE} END AS explanation,
  user_id % 7 NOT IN (5, 6) AS parsed, CASE WHEN user_id % 7 IN (0, 1, 2) THEN '{{"description":"do","column":"c"}}'
    WHEN user_id % 7 = 4 THEN '["a",1]' END AS action_details FROM events""",
)
def parse_diagnosis(spark, d):
    return _answers(spark, d).select("event_id", D.parse_answer(F.col("answer")).alias("x")).select("event_id", "x.*")


@query(
    "shared_cause",
    f"""WITH {I.VIOLATIONS_SQL} SELECT evaluation_id, 'lineitem' AS table_name, "partition", count(*) AS violation_count,
  string_agg(DISTINCT type, ',' ORDER BY type) AS types, string_agg(DISTINCT col, ',' ORDER BY col) AS columns
FROM violations GROUP BY evaluation_id, "partition" """,
)
def shared_cause(spark, d):
    out = D.shared_cause(I.evaluations(spark, d))
    return out.withColumns({"types": F.array_join("types", ","), "columns": F.array_join("columns", ",")})


@query(
    "alert_routing",
    """WITH t AS (SELECT *, CASE user_id % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'WARNING' ELSE 'INFO' END AS severity,
  CASE event_type WHEN 'error' THEN 'quarantine_and_notify' WHEN 'view' THEN 'notify_only'
    ELSE 'auto_resolve' END AS action FROM events)
SELECT severity, action, CASE WHEN action = 'quarantine_and_notify' OR severity = 'CRITICAL' THEN 'critical'
    WHEN action = 'notify_only' AND severity = 'WARNING' THEN 'warning' WHEN action = 'notify_only' THEN 'info' END
    AS alert_severity, count(*) AS n FROM t GROUP BY ALL""",
)
def alert_routing(spark, d):
    kind, event = F.col("user_id") % 3, F.col("event_type")
    rows = I.table(spark, d, "events").select(
        F.when(kind == 0, "CRITICAL").when(kind == 1, "WARNING").otherwise("INFO").alias("severity"),
        F.when(event == "error", "quarantine_and_notify").when(event == "view", "notify_only")
        .otherwise("auto_resolve").alias("action"),
    )
    return rows.groupBy(
        "severity", "action", N.alert_severity(F.col("action"), F.col("severity")).alias("alert_severity")
    ).agg(F.count("*").alias("n"))


@query(
    "response_alerts",
    f"""WITH {_SCORED}, a AS (SELECT *, md5(evaluation_id || '#' || position) AS issue_id FROM full_rows)
SELECT issue_id, CASE severity WHEN 'CRITICAL' THEN 'critical' ELSE 'warning' END AS severity,
  rule || ' on lineitem ' || "partition" || ': '
  || CASE severity WHEN 'CRITICAL' THEN 'quarantine_and_notify' ELSE 'notify_only' END AS message,
  '[assay] ' || CASE severity WHEN 'CRITICAL' THEN '🚨 CRITICAL' ELSE '⚠️ WARNING' END
  || ': Data Quality Issue ' || left(issue_id, 8) AS subject FROM a""",
)
def response_alerts(spark, d):
    """The whole response plan, from stored evaluations to the alerts it would send."""
    found = I.stored_evaluations(spark, d)
    out = P.respond(found, I.scans(spark, d), F.lit(_NOW).cast("timestamp_ntz")).alerts
    return out.drop("table_name", "partition")


@query(
    "response_decisions",
    f"""WITH {_SCORED}, a AS (SELECT *, md5(evaluation_id || '#' || position) AS issue_id,
    CASE severity WHEN 'CRITICAL' THEN 'critical' ELSE 'warning' END AS sent FROM full_rows)
SELECT 'violation_detected' AS decision_type, 'lineitem' AS table_name, "partition",
  severity || ' ' || type || ' violation: ' || rule AS reasoning,
  'parsed' AS action_taken, 'recorded for ' || col AS outcome, TIMESTAMP '{_NOW}' AS ts FROM a
UNION ALL SELECT 'diagnosis_complete', 'lineitem', "partition", severity || ' ' || type
  || ' violation, 1 failing scans on record', CASE severity WHEN 'CRITICAL' THEN 'quarantine_and_notify'
  ELSE 'notify_only' END, 'confidence MEDIUM', TIMESTAMP '{_NOW}' FROM a
UNION ALL SELECT 'notification_sent', 'lineitem', "partition", upper(sent) || ' alert sent for issue ' || left(issue_id, 8) || ': '
  || left(rule || ' on lineitem ' || "partition" || ': '
  || CASE severity WHEN 'CRITICAL' THEN 'quarantine_and_notify' ELSE 'notify_only' END, 100),
  'alert publish (' || sent || ')', 'Delivered: ' || issue_id, TIMESTAMP '{_NOW}' FROM a""",
)
def response_decisions(spark, d):
    found = I.stored_evaluations(spark, d)
    out = P.respond(found, I.scans(spark, d), F.lit(_NOW).cast("timestamp_ntz")).decisions
    return out.drop("context")


# Earlier scans on record by month, and what a model said by the violation's place: an answer, no JSON, nothing.
_DIAGNOSED = f"""{_SCORED}, h AS (SELECT *, 1 + least(split_part("partition", 'month=', 2)::INT % 4, 4) AS failing FROM full_rows),
a AS (SELECT *, md5(evaluation_id || '#' || position) AS issue_id,
  CASE position % 3 WHEN 0 THEN 'auto_resolve' WHEN 1 THEN 'notify_only'
    ELSE CASE severity WHEN 'CRITICAL' THEN 'quarantine_and_notify' ELSE 'notify_only' END END AS action,
  CASE position % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' ELSE CASE WHEN failing >= 3 THEN 'HIGH' ELSE 'MEDIUM' END END AS confidence,
  CASE position % 3 WHEN 0 THEN 'late file ' || position WHEN 1 THEN 'cannot tell' END AS cause FROM h)"""


def _diagnosed(spark, d):
    found = I.stored_evaluations(spark, d)
    scans = V.scan_results(found).withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    month = F.substring_index("partition", "month=", -1).cast("int")
    earlier = scans.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3)))).where(F.col("n") <= month % 4)
    earlier = earlier.withColumn("evaluation_id", F.concat_ws("#", "evaluation_id", "n")).withColumn("violation_count", F.lit(1).cast("bigint"))
    said = F.when(
        F.col("position") % 3 == 0,
        F.concat(
            F.lit('{"probable_cause": "late file '), F.col("position").cast("string"),
            F.lit('", "confidence": "HIGH", "recommended_action": "auto_resolve", "action_details": {"days":2}}'),
        ),
    ).when(F.col("position") % 3 == 1, "cannot tell")
    ids = list(P.ANSWER_IDS)
    answers = D.chosen(V.violations(found).select(*ids, said.alias("answer")), ids)
    return P.respond(found, earlier, F.lit(_NOW).cast("timestamp_ntz"), answers)


@query(
    "response_diagnosed",
    f"""WITH {_DIAGNOSED} SELECT evaluation_id, rule, severity, issue_id, action AS recommended_action, confidence,
  cause AS probable_cause, CASE WHEN position % 3 = 0 THEN '{{"days":2}}' END AS action_details,
  failing::BIGINT AS failing_scans,
  CASE WHEN action = 'quarantine_and_notify' OR severity = 'CRITICAL' THEN 'critical'
    WHEN action = 'notify_only' THEN 'warning' END AS alert_severity FROM a""",
)
def response_diagnosed(spark, d):
    """Parsed answers decide the action; violations without one follow the policy, by their history."""
    return _diagnosed(spark, d).actions.select(
        "evaluation_id", "rule", "severity", "issue_id", "recommended_action", "confidence", "probable_cause",
        "action_details", F.col("failing_scans").cast("bigint").alias("failing_scans"), "alert_severity",
    )


@query(
    "diagnosis_decisions",
    f"""WITH {_DIAGNOSED} SELECT "partition", coalesce(cause, severity || ' ' || type || ' violation, ' || failing
  || ' failing scans on record') AS reasoning, action AS action_taken, 'confidence ' || confidence AS outcome FROM a""",
)
def diagnosis_decisions(spark, d):
    rows = _diagnosed(spark, d).decisions.where(F.col("decision_type") == "diagnosis_complete")
    return rows.select("partition", "reasoning", "action_taken", "outcome")


# --- metrics and alarms ------------------------------------------------------------------------

_POINT = "SELECT ts, '{}' AS name, ({})::DOUBLE AS value, '{}' AS unit, {} AS dimensions FROM {}"
_METRIC_ROWS = " UNION ALL ".join(
    [
        _POINT.format("OverallQualityScore", "overall_score", "Percent", "'TableName=' || table_name", "scans"),
        _POINT.format("AnomaliesDetected", "violation_count", "Count",
                      "'Severity=' || overall_status || ',TableName=' || table_name", "scans WHERE violation_count > 0"),
        _POINT.format("RemediationActions", "1", "Count",
                      "'ActionType=' || action_type || ',TableName=' || table_name", "remediations"),
        _POINT.format("RecordsQuarantined", "records_affected", "Count", "'TableName=' || table_name", "remediations"),
        _POINT.format("DecisionCount", "1", "Count", "'DecisionType=' || decision_type", "decisions"),
    ]
)


@query("metric_rows", f"WITH {I.SCANS}, {I.REMEDIATIONS}, {I.DECISIONS} {_METRIC_ROWS}")
def metric_rows(spark, d):
    out = M.metric_rows(I.scans(spark, d), I.remediations(spark, d), I.decisions(spark, d))
    pairs = F.transform(F.map_entries("dimensions"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.withColumn("dimensions", F.array_join(F.array_sort(pairs), ","))


def _ntz(df, column="period_start"):
    return df.withColumn(column, F.col(column).cast("timestamp_ntz"))


@query(
    "metric_stats",
    f"""WITH {I.METRICS} SELECT name, time_bucket(INTERVAL 5 MINUTE, ts) AS period_start,
  round(avg(value), 8) AS average, min(value) AS minimum, max(value) AS maximum, round(sum(value), 4) AS total,
  count(*) AS sample_count FROM metrics
WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 696 HOUR AND ts < TIMESTAMP '2024-01-30 12:00:00' GROUP BY ALL""",
)
def metric_stats(spark, d):
    """All statistics in 5-minute periods, over the 29 days before a reference time."""
    out = M.metric_stats(I.metrics(spark, d), F.lit(_NOW).cast("timestamp"), hours=696)
    return _ntz(out.withColumns({"average": F.round("average", 8), "total": F.round("total", 4)}))


@query(
    "metric_stats_day",
    f"""WITH {I.METRICS} SELECT name, dim_table, time_bucket(INTERVAL 5 MINUTE, ts) AS period_start,
  round(avg(value), 8) AS average, count(*) AS sample_count FROM metrics
WHERE ts >= TIMESTAMP '2024-01-29 12:00:00' AND ts < TIMESTAMP '2024-01-30 12:00:00' GROUP BY ALL""",
)
def metric_stats_day(spark, d):
    """The default range, a day, per metric and table, sorted by time."""
    points = I.metrics(spark, d).withColumn("dim_table", F.try_element_at("dimensions", F.lit("TableName")))
    out = M.metric_stats(points, F.lit(_NOW).cast("timestamp"), by=["name", "dim_table"]).orderBy("period_start")
    return _ntz(out).select(
        "name", "dim_table", "period_start", F.round("average", 8).alias("average"), "sample_count"
    )


_ALARMS_SQL = {
    "LowQualityScore": ("OverallQualityScore", "Minimum", 50.0, "min(value) < 50", "dim_table = 'lineitem'", "min(value)"),
    "HighAnomalyCount": ("AnomaliesDetected", "Sum", 10.0, "sum(value) > 10",
                         "dim_table = 'lineitem' AND dim_severity = 'CRITICAL'", "sum(value)"),
    "HighTokenCost": ("AgentTokenCost", "Sum", 1.0, "sum(value) > 1", "true", "sum(value)"),
}


def _alarm_sql(name, where="true"):
    metric, statistic, threshold, breach, dims, value = _ALARMS_SQL[name]
    return (
        f"SELECT 'quality-{name}' AS alarm, '{metric}' AS metric, '{statistic}' AS statistic, "
        f"{threshold}::DOUBLE AS threshold, time_bucket(INTERVAL 5 MINUTE, ts) AS period_start, "
        f"round({value}, 4) AS value, {breach} AS breach FROM metrics "
        f"WHERE name = '{metric}' AND {dims} AND {where} GROUP BY ALL"
    )


def _alarm(spark, d, i):
    alarms = M.alarm_table(spark, M.default_alarms("lineitem")[i : i + 1])
    return _ntz(M.alarm_windows(I.metrics(spark, d), alarms).withColumn("value", F.round("value", 4)))


@query("alarm_low_score", f"WITH {I.METRICS} {_alarm_sql('LowQualityScore')}")
def alarm_low_score(spark, d):
    return _alarm(spark, d, 0)


@query("alarm_anomalies", f"WITH {I.METRICS} {_alarm_sql('HighAnomalyCount')}")
def alarm_anomalies(spark, d):
    return _alarm(spark, d, 1)


@query("alarm_cost", f"WITH {I.METRICS} {_alarm_sql('HighTokenCost')}")
def alarm_cost(spark, d):
    """An alarm without dimensions matches the metric whatever its dimensions are."""
    return _alarm(spark, d, 2)


ALARMS_SQL = " UNION ALL ".join(_alarm_sql(n) for n in _ALARMS_SQL)
_STATES = " UNION ALL ".join(_alarm_sql(n, f"ts >= TIMESTAMP '{_NOW}' - INTERVAL 5 MINUTE AND ts < TIMESTAMP '{_NOW}'")
                             for n in _ALARMS_SQL)
_ALARM_ROWS = ", ".join(f"('{n}', '{m}', {t}::DOUBLE)" for n, (m, _, t, *_x) in _ALARMS_SQL.items())


@query(
    "alarm_states",
    f"""WITH {I.METRICS}, w AS ({_STATES}), a(alarm, metric, threshold) AS (VALUES {_ALARM_ROWS})
SELECT a.alarm, a.metric, a.threshold, value, CASE WHEN breach THEN 'ALARM' ELSE 'OK' END AS state,
  TIMESTAMP '{_NOW}' AS updated
FROM a LEFT JOIN w ON w.alarm = 'quality-' || a.alarm""",
)
def alarm_states(spark, d):
    """State at a reference time; an alarm without data in its period is OK."""
    other = M.Alarm("other-LowQualityScore", M.SCORE, "Minimum", 50.0, "<")
    alarms = M.alarm_table(spark, [*M.default_alarms("lineitem"), other])
    out = M.alarm_states(I.metrics(spark, d), alarms, F.lit(_NOW).cast("timestamp"), "quality-")
    return _ntz(out.withColumn("value", F.round("value", 4)), "updated")


@query(
    "alarm_days",
    f"""WITH {I.METRICS}, w AS ({ALARMS_SQL})
SELECT alarm, CAST(period_start AS DATE) AS day, count(*) AS periods, count(*) FILTER (breach) AS breaches
FROM w GROUP BY ALL""",
)
def alarm_days(spark, d):
    """Breached periods per alarm and day, all alarms in one pass."""
    alarms = M.alarm_table(spark, M.default_alarms("lineitem"))
    return (
        M.alarm_windows(I.metrics(spark, d), alarms)
        .groupBy("alarm", F.col("period_start").cast("date").alias("day"))
        .agg(F.count("*").alias("periods"), F.count_if("breach").alias("breaches"))
    )


@query(
    "metric_series",
    f"""WITH {I.METRICS}, s AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS period_start, name,
    CASE name WHEN 'AnomaliesDetected' THEN dim_severity WHEN 'RemediationActions' THEN dim_action ELSE '' END AS series,
    avg(value) AS a, sum(value) AS s FROM metrics WHERE name <> 'AgentTokenCost' GROUP BY 1, 2, 3)
SELECT period_start, name, series,
  round(CASE WHEN name IN ('OverallQualityScore', 'ToolCallDuration') THEN a ELSE s END, 8) AS value FROM s""",
)
def metric_series(spark, d):
    return _ntz(M.metric_series(I.metrics(spark, d))).withColumn("value", F.round("value", 8))
