"""Queries over audit tables: history, baselines, decisions, summaries, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions import text as X
from assay.operators import history as H
from assay.operators import notify as N
from assay.operators import retention as T
from assay.operators import summaries as S
from assay.operators import violations as V
from assay.plans import inputs as I
from assay.plans.registry import query

_KEYED = 'table_name, "partition"'


@query(
    "recent_scans",
    f"""WITH {I.SCANS}, r AS (SELECT *, row_number() OVER (PARTITION BY {_KEYED} ORDER BY ts DESC, evaluation_id)
    AS recency FROM scans)
SELECT evaluation_id, {_KEYED}, ts, overall_score, recency FROM r WHERE recency <= 5""",
)
def recent_scans(spark, d):
    out = H.newest_per_key(I.scans(spark, d), 5)
    return out.select("evaluation_id", "table_name", "partition", "ts", "overall_score",
                      F.col("recency").cast("bigint").alias("recency"))


@query(
    "history_context",
    f"""WITH {I.SCANS}, r AS (SELECT *, row_number() OVER (PARTITION BY {_KEYED} ORDER BY ts DESC, evaluation_id)
    AS recency FROM scans WHERE table_name <> '' AND "partition" <> ''),
h AS (SELECT {_KEYED}, count(*) AS previous_scans, count(*) FILTER (violation_count > 0) AS failing_scans,
    string_agg(evaluation_id, ',' ORDER BY recency) FILTER (recency <= 3) AS newest
  FROM r WHERE recency <= 5 GROUP BY ALL),
v AS (SELECT evaluation_id, table_name, CASE WHEN violation_count > 8 THEN '' ELSE "partition" END AS "partition"
  FROM scans)
SELECT v.evaluation_id, v.table_name, v."partition", coalesce(previous_scans, 0) AS previous_scans,
  coalesce(failing_scans, 0) AS failing_scans, newest
FROM v LEFT JOIN h ON h.table_name = v.table_name AND h."partition" = v."partition" """,
)
def history_context(spark, d):
    scans = I.scans(spark, d)
    found = scans.select(
        "evaluation_id", "table_name",
        F.when(F.col("violation_count") > 8, "").otherwise(F.col("partition")).alias("partition"),
    )
    ids = F.transform("scans", lambda s: s["evaluation_id"])
    return H.history_context(found, scans).withColumn(
        "newest", F.when(F.col("scans").isNotNull(), F.array_join(ids, ","))
    ).drop("scans")


@query(
    "recent_all",
    f"""WITH {I.SCANS} SELECT evaluation_id, {_KEYED}, ts, overall_score FROM scans
ORDER BY ts DESC, evaluation_id LIMIT 100""",
)
def recent_all(spark, d):
    """The page of newest scans: sorted first, then limited."""
    return H.newest(I.scans(spark, d), 100).select(
        "evaluation_id", "table_name", "partition", "ts", "overall_score"
    )


@query(
    "split_key",
    f"""WITH {I.SCANS} SELECT evaluation_id,
  CASE WHEN overall_score = 0 THEN 'kept' WHEN overall_score = 10 THEN evaluation_id ELSE table_name END AS table_name,
  CASE WHEN overall_score = 10 THEN '' WHEN overall_score = 20 THEN "partition" || '#x' ELSE "partition" END
    AS "partition" FROM scans""",
)
def split_key(spark, d):
    """Keys with one #, with two, with none; some rows have a table name of their own."""
    score = F.col("overall_score")
    keyed = I.scans(spark, d).select(
        "evaluation_id",
        F.when(score == 10, F.col("evaluation_id"))
        .when(score == 20, F.concat_ws("#", "table_name", "partition", F.lit("x")))
        .otherwise(F.concat_ws("#", "table_name", "partition"))
        .alias("pk"),
        F.when(score == 0, "kept").alias("table_name"),
    )
    return H.split_key(keyed).drop("pk")


@query(
    "remediation_history",
    f"""WITH {I.REMEDIATIONS} SELECT * FROM remediations WHERE table_name = 't_error'
ORDER BY ts DESC, issue_id LIMIT 50""",
)
def remediation_history(spark, d):
    return H.remediation_history(I.remediations(spark, d), "t_error", 50)


_BASELINES = """baselines AS (SELECT 'lake' AS database, 'u' || user_id AS table_name,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version, 'c' || event_id AS columns_text
  FROM events)"""


def _baselines(spark, d):
    """A stored baseline per event; its number within the user is the version."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("event_id")
    name = F.concat(F.lit("c"), F.col("event_id").cast("string"))
    return I.table(spark, d, "events").select(
        F.lit("lake").alias("database"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("table_name"),
        F.row_number().over(order).cast("bigint").alias("version"),
        F.array(F.struct(name.alias("name"), F.lit("bigint").alias("type"))).alias("columns"),
    )


@query(
    "latest_baseline",
    f"""WITH {_BASELINES} SELECT database, table_name, max(version) AS version,
  arg_max(columns_text, version) AS columns_text FROM baselines GROUP BY ALL""",
)
def latest_baseline(spark, d):
    names = F.array_join(F.transform("columns", lambda c: c["name"]), ",")
    return H.latest_baseline(_baselines(spark, d)).withColumn("columns_text", names).drop("columns")


@query(
    "next_baseline",
    f"""WITH {_BASELINES}, l AS (SELECT table_name, max(version) AS last FROM baselines GROUP BY ALL)
SELECT 'lake' AS database, 'u' || c_custkey AS table_name, coalesce(last, 0) + 1 AS version
FROM customer LEFT JOIN l ON table_name = 'u' || c_custkey""",
)
def next_baseline(spark, d):
    new = I.table(spark, d, "customer").select(
        F.lit("lake").alias("database"), F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("table_name")
    )
    return H.next_baseline(new, _baselines(spark, d))


@query(
    "before_score",
    f"""WITH {I.SCANS}, k AS (SELECT DISTINCT 't_error' AS table_name, 'user=' || o_custkey AS "partition" FROM orders),
l AS (SELECT {_KEYED}, arg_max(overall_score, (ts, evaluation_id))::DOUBLE AS s FROM scans GROUP BY ALL)
SELECT k.table_name, k."partition", coalesce(s, 0) AS before_score
FROM k LEFT JOIN l ON l.table_name = k.table_name AND l."partition" = k."partition" """,
)
def before_score(spark, d):
    keys = I.table(spark, d, "orders").select(
        F.lit("t_error").alias("table_name"),
        F.concat(F.lit("user="), F.col("o_custkey").cast("string")).alias("partition"),
    ).distinct()
    return H.before_score(keys, I.scans(spark, d))


# --- decisions and alerts ----------------------------------------------------------------

@query(
    "decision_feed",
    f"""WITH {I.DECISIONS} SELECT decision_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS time, decision_type,
  left(coalesce(nullif(reasoning, ''), '-'), 120) AS reasoning
FROM decisions WHERE decision_type = 'error_logged' ORDER BY ts DESC, decision_id LIMIT 30""",
)
def decision_feed(spark, d):
    return S.decision_feed(I.decisions(spark, d), "error_logged")


@query(
    "decision_summary",
    f"""WITH {I.DECISIONS} SELECT count(*) AS total_decisions, count(DISTINCT decision_type) AS decision_types,
  count(DISTINCT nullif(table_name, '')) AS tables_scanned FROM decisions""",
)
def decision_summary(spark, d):
    return S.decision_summary(I.decisions(spark, d))


@query("decision_types", f"WITH {I.DECISIONS} SELECT DISTINCT decision_type FROM decisions")
def decision_types(spark, d):
    return S.decision_types(I.decisions(spark, d))


@query(
    "decision_rows",
    """SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 't' || user_id WHEN user_id % 3 = 1 THEN 'n' || user_id
    ELSE 'unknown' END AS table_name,
  CASE WHEN user_id % 2 = 0 THEN 'user=' || user_id ELSE 'unknown' END AS "partition", event_type AS decision_type
FROM events""",
)
def decision_rows(spark, d):
    user, id_ = F.col("user_id").cast("string"), F.col("user_id")
    where = F.when(id_ % 2 == 0, F.create_map(F.lit("partition"), F.concat(F.lit("user="), user))).otherwise(
        F.create_map().cast("map<string,string>")
    )
    what = (
        F.when(id_ % 3 == 0, F.create_map(F.lit("table"), F.concat(F.lit("t"), user),
                                          F.lit("table_name"), F.concat(F.lit("n"), user)))
        .when(id_ % 3 == 1, F.create_map(F.lit("table_name"), F.concat(F.lit("n"), user)))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    rows = I.table(spark, d, "events").select(
        "event_id", F.col("event_type").alias("decision_type"), F.map_concat(where, what).alias("context")
    )
    return N.decision_rows(rows).drop("context")


_SEVERITY_SQL = """CASE user_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'Warning' WHEN 2 THEN 'INFO'
    WHEN 3 THEN 'other' ELSE repeat('long', 30) END"""
_ISSUES_SQL = f"""issues AS (SELECT 'is-' || lpad(event_id::VARCHAR, 8, '0') AS issue_id, {_SEVERITY_SQL} AS severity,
    repeat(event_type || ' ', 1 + (user_id % 40)::INT) AS message, user_id FROM events)"""


def _issues(spark, d):
    kind = F.col("user_id") % 5
    severity = (
        F.when(kind == 0, "critical").when(kind == 1, "Warning").when(kind == 2, "INFO")
        .when(kind == 3, "other").otherwise("long" * 30)
    )
    return I.table(spark, d, "events").select(
        F.format_string("is-%08d", "event_id").alias("issue_id"),
        severity.alias("severity"),
        F.repeat(F.concat("event_type", F.lit(" ")), (F.col("user_id") % 40 + 1).cast("int")).alias("message"),
    )


@query(
    "alerts",
    f"""WITH {_ISSUES_SQL} SELECT issue_id, severity, left('[assay] ' || CASE user_id % 5
    WHEN 0 THEN '🚨 CRITICAL' WHEN 1 THEN '⚠️ WARNING' WHEN 2 THEN 'ℹ️ INFO' WHEN 3 THEN 'OTHER'
    ELSE repeat('LONG', 30) END || ': Data Quality Issue ' || left(issue_id, 8), 100) AS subject FROM issues""",
)
def alerts(spark, d):
    return N.alerts(_issues(spark, d)).drop("message")


@query(
    "alert_decisions",
    f"""WITH {_ISSUES_SQL} SELECT issue_id, 'notification_sent' AS decision_type, left(message, 200) AS message_preview,
  upper(severity) || ' alert sent for issue ' || left(issue_id, 8) || ': ' || left(message, 100) AS reasoning,
  'alert publish (' || severity || ')' AS action_taken, 'Delivered: ' || issue_id AS outcome FROM issues""",
)
def alert_decisions(spark, d):
    out = N.alert_decisions(_issues(spark, d))
    return out.select(
        "context.issue_id", "decision_type", "context.message_preview", "reasoning", "action_taken", "outcome"
    )


# --- summaries -----------------------------------------------------------------------------

@query(
    "quarantine_totals",
    f"""WITH {I.REMEDIATIONS} SELECT count(*) AS actions,
  CAST(sum(coalesce(records_affected, 0)) AS BIGINT) AS records_isolated
FROM remediations WHERE action_type = 'quarantine'""",
)
def quarantine_totals(spark, d):
    return S.quarantine_totals(I.remediations(spark, d))


@query("latest_scan", f"WITH {I.SCANS} SELECT * FROM scans ORDER BY ts DESC, evaluation_id DESC LIMIT 1")
def latest_scan(spark, d):
    return S.latest_scan(I.scans(spark, d))


def _detail(dimension, column, threshold, fails, **found):
    names = ["outlier_count", "null_pct", "staleness_hours", "outlier_pct", "min_found", "max_found",
             "expected_min", "expected_max"]
    cells = ", ".join(
        f"({found.get(n, 'NULL')})::{'BIGINT' if n == 'outlier_count' else 'DOUBLE'} AS {n}" for n in names
    )
    return (
        f"SELECT year, month, '{dimension}' AS dimension, '{column}' AS \"column\", "
        f"({threshold})::DOUBLE AS threshold, {cells} FROM a WHERE {fails}"
    )


_NULL_PCT = {c: f"round((1 - c_{c} / n) * 100, 2)" for c in ("l_shipdate", "l_orderkey", "l_tax", "l_quantity",
                                                                  "l_extendedprice")}
_DETAILS = [
    _detail("completeness", r.column, r.lo, f"c_{r.column} / n < {r.lo}::DOUBLE", null_pct=_NULL_PCT[r.column])
    for r in I.RULES
    if r.rule_type == "Completeness"
] + [
    _detail("freshness", "l_shipdate", 23, "stale > 23", staleness_hours="round(stale, 1)"),
    _detail("distribution", "l_extendedprice", "NULL", "outside > 0", outlier_count="outside",
            outlier_pct="round(outside / c_l_extendedprice * 100, 2)", min_found="round(low, 3)",
            max_found="round(high, 3)", expected_min="0", expected_max="500000"),
]


@query(
    "violation_details",
    f"""WITH {I.RESULTS_SQL}, r AS (SELECT year, month, min(l_extendedprice) AS low, max(l_extendedprice) AS high
  FROM dirty GROUP BY year, month),
a AS (SELECT m.*, low, high FROM m JOIN r USING (year, month))
{' UNION ALL '.join(_DETAILS)}""",
)
def violation_details(spark, d):
    out = S.violation_details(I.corrupted(spark, d), I.RULES, I.BY, I.month_end())
    return out.withColumns({"min_found": F.round("min_found", 3), "max_found": F.round("max_found", 3)})


@query(
    "dimension_labels",
    """SELECT user_id, event_type || '_Null share' AS name, upper(left(event_type, 1)) || substr(event_type, 2)
  || ' Null Share' AS label, count(*) AS n FROM events GROUP BY ALL""",
)
def dimension_labels(spark, d):
    name = F.concat("event_type", F.lit("_Null share"))
    return I.table(spark, d, "events").groupBy("user_id", name.alias("name")).agg(F.count("*").alias("n")).withColumn(
        "label", X.label(F.col("name"))
    )


@query(
    "live_rows",
    f"""WITH {I.SCANS}, t AS (SELECT evaluation_id, ts, CAST(floor(epoch(ts)) AS BIGINT) + 90 * 86400 AS ttl FROM scans)
SELECT * FROM t WHERE ttl > epoch(TIMESTAMP '2024-04-14 12:30:00')""",
)
def live_rows(spark, d):
    scans = I.scans(spark, d).select("evaluation_id", "ts").withColumn("ttl", T.expiry(F.col("ts")))
    return T.live_rows(scans, F.lit("2024-04-14 12:30:00").cast("timestamp"))


@query(
    "violation_decisions",
    f"""WITH {I.VIOLATIONS_SQL} SELECT 'violation_detected' AS decision_type, evaluation_id, 'lineitem' AS table_name,
  "partition", severity || ' ' || type || ' violation: ' || rule AS reasoning, 'parsed' AS action_taken,
  'recorded for ' || col AS outcome FROM violations""",
)
def violation_decisions(spark, d):
    out = N.violation_decisions(V.violations(I.evaluations(spark, d)))
    return out.withColumn("evaluation_id", F.col("context.evaluation_id")).drop("context")
