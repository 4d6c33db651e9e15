"""Queries over rules, violations and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions import severity as sev
from assay.operators.corrupt import inject_nulls
from assay.operators import rules as R
from assay.operators import violations as V
from assay.plans import inputs as I
from assay.plans.registry import query


def _metric(results):
    return results.withColumn("metric", F.round(R.single_metric(F.col("evaluated_metrics")), 4))


def _rule_rows(spark, d, kind):
    rules = [r for r in I.RULES if r.rule_type == kind]
    out = R.evaluate(I.corrupted(spark, d), rules, I.BY, I.TABLE, as_of=I.month_end())
    return _metric(R.rule_results(out, I.BY)).select("year", "month", "rule", "metric", "state")


def _rule_sql(kind):
    return f"""WITH {I.RESULTS_SQL}
SELECT year, month, rule, round(value, 4) AS metric, CASE WHEN passed THEN 'PASSED' ELSE 'FAILED' END AS state
FROM results WHERE rule LIKE '{kind}%'"""


@query("rule_completeness", _rule_sql("Completeness"))
def rule_completeness(spark, d):
    return _rule_rows(spark, d, "Completeness")


@query("rule_mean", _rule_sql("Mean"))
def rule_mean(spark, d):
    return _rule_rows(spark, d, "Mean")


@query(
    "rule_column_exists",
    f"WITH {I.RESULTS_SQL} SELECT year, month, rule, "
    "CASE WHEN passed THEN 'PASSED' ELSE 'FAILED' END AS state FROM results WHERE rule LIKE 'ColumnExists%'",
)
def rule_column_exists(spark, d):
    """Per partition present in the table, so that the result covers what was scanned."""
    return _rule_rows(spark, d, "ColumnExists").drop("metric")


@query(
    "rule_row_count",
    f"""WITH {I.CORRUPT}, c AS (SELECT year, month, count(*) AS row_count FROM dirty GROUP BY ALL),
t AS (SELECT quantile_cont(row_count, 0.5) * 0.97::DOUBLE AS threshold FROM c)
SELECT year, month, row_count, round(threshold, 4) AS threshold, row_count > threshold AS passed FROM c, t""",
)
def rule_row_count(spark, d):
    """Per month, against a share of the median month, so that the line scales with the table."""
    counts = I.corrupted(spark, d).groupBy(*I.BY).agg(F.count("*").alias("row_count"))
    return R.row_count_check(counts, 0.97).withColumn("threshold", F.round("threshold", 4))


@query(
    "rule_freshness",
    """SELECT o_custkey, round(date_diff('second', max(o_orderdate), TIMESTAMP '2001-08-02 12:00:00')
    / 3600.0::DOUBLE, 4) AS hours,
  CASE WHEN date_diff('second', max(o_orderdate), TIMESTAMP '2001-08-02 12:00:00') / 3600.0 <= 2160
    THEN 'PASSED' ELSE 'FAILED' END AS state FROM orders GROUP BY o_custkey""",
)
def rule_freshness(spark, d):
    rule = R.Rule(1, "DataFreshness", "o_orderdate", "<=", 2160.0, None, 'DataFreshness "o_orderdate" <= 2160')
    as_of = F.to_timestamp(F.lit("2001-08-02 12:00:00"))
    out = R.evaluate(I.table(spark, d, "orders"), [rule], ["o_custkey"], "orders", as_of=as_of)
    return R.rule_results(out, ["o_custkey"]).select(
        "o_custkey", F.round(R.single_metric(F.col("evaluated_metrics")), 4).alias("hours"), "state"
    )


@query(
    "rule_column_values",
    f"""WITH {I.CORRUPT} SELECT year, month, count(l_extendedprice) AS value_count,
  count(*) FILTER (l_extendedprice < 0 OR l_extendedprice > 500000) AS outlier_count,
  round(count(*) FILTER (l_extendedprice < 0 OR l_extendedprice > 500000)::DOUBLE / count(l_extendedprice), 6)
    AS outlier_ratio,
  round(min(l_extendedprice), 3) AS min_found, round(max(l_extendedprice), 3) AS max_found
FROM dirty GROUP BY year, month""",
)
def rule_column_values(spark, d):
    out = R.column_profile(I.corrupted(spark, d), "l_extendedprice", 0.0, 500000.0, I.BY)
    return out.withColumns(
        {
            "outlier_ratio": F.round("outlier_ratio", 6),
            "min_found": F.round("min_found", 3),
            "max_found": F.round("max_found", 3),
        }
    )


@query(
    "rule_uniqueness",
    f"""WITH {I.FACT}, g AS (SELECT year, month, l_orderkey, l_linenumber, count(*) AS copies
  FROM fact GROUP BY ALL),
s AS (SELECT year, month, CAST(sum(copies) AS BIGINT) AS row_count, count(*) AS distinct_rows FROM g GROUP BY ALL)
SELECT *, round(1 - distinct_rows::DOUBLE / row_count, 6) AS duplicate_share,
  CASE WHEN (1.0::DOUBLE - distinct_rows::DOUBLE / row_count) * 100 > 10 THEN 'CRITICAL'
    WHEN (1.0::DOUBLE - distinct_rows::DOUBLE / row_count) * 100 > 5 THEN 'WARNING' ELSE 'OK' END AS severity
FROM s""",
)
def rule_uniqueness(spark, d):
    out = R.uniqueness(I.fact(spark, d), ["l_orderkey", "l_linenumber"], I.BY)
    return out.withColumn("duplicate_share", F.round("duplicate_share", 6))


@query(
    "rule_uniqueness_by_order",
    """WITH g AS (SELECT l_returnflag, l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL),
s AS (SELECT l_returnflag, CAST(sum(copies) AS BIGINT) AS row_count, count(*) AS distinct_rows FROM g GROUP BY ALL)
SELECT *, round(1 - distinct_rows::DOUBLE / row_count, 6) AS duplicate_share,
  CASE WHEN (1.0::DOUBLE - distinct_rows::DOUBLE / row_count) * 100 > 10 THEN 'CRITICAL'
    WHEN (1.0::DOUBLE - distinct_rows::DOUBLE / row_count) * 100 > 5 THEN 'WARNING' ELSE 'OK' END AS severity
FROM s""",
)
def rule_uniqueness_by_order(spark, d):
    """Three groups, one of them with about a third of the rows."""
    out = R.uniqueness(I.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_returnflag"])
    return out.withColumn("duplicate_share", F.round("duplicate_share", 6))


_HALF = "CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 2 END"
_KIND = "CASE WHEN {} % 25 > 20 THEN 'bigint' ELSE 'double' END"


@query(
    "schema_drift",
    f"""WITH seen AS (SELECT {_HALF} AS half, 'u' || user_id AS table_name, 
    event_type || CAST(floor(value / 25) AS BIGINT) AS name, max(value) AS top FROM events GROUP BY ALL),
b AS (SELECT table_name, name, {_KIND.format('top')} AS old_type FROM seen WHERE half = 1),
c AS (SELECT table_name, name, {_KIND.format('top')} AS new_type FROM seen WHERE half = 2)
SELECT 'lake' AS database, table_name, name, old_type, new_type,
  CASE WHEN new_type IS NULL THEN 'removed' WHEN old_type IS NULL THEN 'added' ELSE 'retyped' END AS change,
  CASE WHEN old_type IS NULL THEN 'WARNING' ELSE 'CRITICAL' END AS severity
FROM b FULL JOIN c USING (table_name, name) WHERE old_type IS DISTINCT FROM new_type""",
)
def schema_drift(spark, d):
    """Columns seen per table in the first and the second half of the events: two catalogs."""
    half = F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), 1).otherwise(2)
    seen = (
        I.table(spark, d, "events")
        .groupBy(
            half.alias("half"),
            F.lit("lake").alias("database"),
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("table_name"),
            F.concat("event_type", F.floor(F.col("value") / 25).cast("string")).alias("name"),
        )
        .agg(F.when(F.max("value") % 25 > 20, "bigint").otherwise("double").alias("type"))
    )
    return R.schema_drift(seen.where("half = 1"), seen.where("half = 2"))


@query(
    "evaluate_ruleset",
    f"""WITH {I.RESULTS_SQL}
SELECT {I.EVALUATION_ID} AS evaluation_id, {I.PARTITION} AS "partition", year, month, rule_id, rule,
  metric_key, round(value, 4) AS metric, CASE WHEN passed THEN 'PASSED' ELSE 'FAILED' END AS state,
  CASE WHEN passed THEN '' ELSE 'not met: ' || rule END AS description FROM
  (SELECT * REPLACE (nullif(metric_key, '') AS metric_key) FROM results)""",
)
def evaluate_ruleset(spark, d):
    """Fifteen rules on every month of the corrupted table, in one pass."""
    out = _metric(R.rule_results(I.evaluations(spark, d), I.BY))
    return out.select(
        "evaluation_id", "partition", "year", "month", "rule_id", "rule",
        F.get(F.map_keys("evaluated_metrics"), F.lit(0)).alias("metric_key"), "metric", "state", "description",
    )


@query(
    "rule_compare",
    """WITH t AS (SELECT *, CASE l_linenumber WHEN 1 THEN '>=' WHEN 2 THEN '>' WHEN 3 THEN '<=' WHEN 4 THEN '<'
    WHEN 5 THEN 'between' WHEN 6 THEN '=' ELSE '?' END AS op, l_tax * 500 AS lo, l_tax * 500 + 10 AS hi FROM lineitem)
SELECT op, l_tax, l_quantity, count(*) AS n,
  count(*) FILTER (CASE op WHEN '>=' THEN l_quantity >= lo WHEN '>' THEN l_quantity > lo
    WHEN '<=' THEN l_quantity <= lo WHEN '<' THEN l_quantity < lo WHEN '=' THEN l_quantity = lo
    WHEN 'between' THEN l_quantity >= lo AND l_quantity <= hi ELSE false END) AS passed,
  count(*) FILTER (op = 'between' AND l_quantity > lo AND l_quantity < hi) AS passed_inside
FROM t GROUP BY op, l_tax, l_quantity""",
)
def rule_compare(spark, d):
    op = F.col("l_linenumber")
    signs = [">=", ">", "<=", "<", "between", "="]
    sign = F.lit("?")
    for i, s in enumerate(signs, 1):
        sign = F.when(op == i, s).otherwise(sign)
    t = I.table(spark, d, "lineitem").select("l_quantity", "l_tax", sign.alias("op"))
    lo = F.col("l_tax") * 500
    args = (F.col("l_quantity"), F.col("op"), lo, lo + 10)
    return t.groupBy("op", "l_tax", "l_quantity").agg(
        F.count("*").alias("n"),
        F.count_if(sev.compare(*args)).alias("passed"),
        F.count_if((F.col("op") == "between") & sev.compare(*args, inclusive=False)).alias("passed_inside"),
    )


_LINES = """SELECT o_orderkey,
  CASE o_orderkey % 12 WHEN 0 THEN 'Completeness "c' || o_custkey || '" >= 0.' || (10 + o_custkey % 90)
    WHEN 1 THEN 'RowCount > ' || o_custkey WHEN 2 THEN
      'Mean "c' || o_custkey || '" between -' || (o_custkey % 50) || '.5 and ' || o_custkey || ','
    WHEN 3 THEN '    ColumnExists "c' || o_custkey || '",' WHEN 4 THEN 'DataFreshness "c' || o_custkey || '" <= 72'
    WHEN 5 THEN 'ColumnValues "c' || o_custkey || '" between 0 and ' || o_custkey
    WHEN 6 THEN 'Mean "between 1 and ' || o_custkey || '" between -5 and 1e3'
    WHEN 7 THEN 'RowCount > ' || o_custkey || '.5e6' WHEN 8 THEN 'Completeness "c' || o_custkey || '" >= .5'
    WHEN 9 THEN 'RowCount > ' || o_custkey || ' rows' WHEN 10 THEN 'Completeness "c' || o_custkey || '"'
    ELSE 'Uniqueness "c' || o_custkey || '" > 1' END AS rule_text FROM orders"""


_FORMS = 12  # one line of each form for every order, in turn
_RULE_TYPES = ["Completeness", "RowCount", "Mean", "ColumnExists", "DataFreshness", "ColumnValues", "Mean", "RowCount",
               "Completeness"]


@query(
    "rules_from_text",
    f"""WITH t AS (SELECT o_orderkey, o_custkey, o_orderkey % {_FORMS} AS f, l.rule_text
    FROM ({_LINES}) l JOIN orders USING (o_orderkey))
SELECT o_orderkey, rule_text, {_RULE_TYPES}[f + 1] AS rule_type,
  CASE WHEN f IN (0, 2, 3, 4, 5, 8) THEN 'c' || o_custkey WHEN f = 6 THEN 'between 1 and ' || o_custkey END AS "column",
  CASE f WHEN 0 THEN '>=' WHEN 1 THEN '>' WHEN 4 THEN '<=' WHEN 2 THEN 'between' WHEN 5 THEN 'between'
    WHEN 6 THEN 'between' WHEN 7 THEN '>' WHEN 8 THEN '>=' END AS op,
  CASE f WHEN 0 THEN ('0.' || (10 + o_custkey % 90))::DOUBLE WHEN 1 THEN o_custkey::DOUBLE
    WHEN 2 THEN ('-' || (o_custkey % 50) || '.5')::DOUBLE WHEN 4 THEN 72 WHEN 5 THEN 0 WHEN 6 THEN -5
    WHEN 7 THEN (o_custkey || '.5e6')::DOUBLE WHEN 8 THEN 0.5 END::DOUBLE AS lo,
  CASE WHEN f IN (2, 5) THEN o_custkey::DOUBLE WHEN f = 6 THEN 1000.0 END::DOUBLE AS hi,
  CASE WHEN f >= 9 THEN 'not a rule: ' || rule_text END AS error FROM t""",
)
def rules_from_text(spark, d):
    """A line of each form for every order: exponents, bare points, names that hold keywords, and no rules."""
    c = F.col("o_custkey")
    name = F.concat(F.lit(' "c'), c.cast("string"), F.lit('"'))
    num = c.cast("string")
    kind = F.col("o_orderkey") % _FORMS
    line = (
        F.when(kind == 0, F.concat(F.lit("Completeness"), name, F.lit(" >= 0."), (c % 90 + 10).cast("string")))
        .when(kind == 1, F.concat(F.lit("RowCount > "), num))
        .when(kind == 2, F.concat(F.lit("Mean"), name, F.lit(" between -"), (c % 50).cast("string"),
                                  F.lit(".5 and "), num, F.lit(",")))
        .when(kind == 3, F.concat(F.lit("    ColumnExists"), name, F.lit(",")))
        .when(kind == 4, F.concat(F.lit("DataFreshness"), name, F.lit(" <= 72")))
        .when(kind == 5, F.concat(F.lit("ColumnValues"), name, F.lit(" between 0 and "), num))
        .when(kind == 6, F.concat(F.lit('Mean "between 1 and '), num, F.lit('" between -5 and 1e3')))
        .when(kind == 7, F.concat(F.lit("RowCount > "), num, F.lit(".5e6")))
        .when(kind == 8, F.concat(F.lit("Completeness"), name, F.lit(" >= .5")))
        .when(kind == 9, F.concat(F.lit("RowCount > "), num, F.lit(" rows")))
        .when(kind == 10, F.concat(F.lit("Completeness"), name))
        .otherwise(F.concat(F.lit("Uniqueness"), name, F.lit(" > 1")))
    )
    return R.rules_from_text(I.table(spark, d, "orders").select("o_orderkey", line.alias("rule_text")))


@query(
    "calibrate_thresholds",
    f"""WITH {I.FACT}, {I.NULLED}, c AS (SELECT year, month, count(*)::DOUBLE AS n, count(l_tax) / n AS l_tax,
    count(l_quantity) / n AS l_quantity, count(l_extendedprice) / n AS l_extendedprice FROM nulled GROUP BY ALL),
l AS (UNPIVOT (SELECT l_tax, l_quantity, l_extendedprice FROM c) ON l_tax, l_quantity, l_extendedprice
  INTO NAME column_name VALUE value)
SELECT column_name, count(*) AS partitions, round(quantile_cont(value, 0.05) - 0.02::DOUBLE, 4) AS threshold
FROM l GROUP BY column_name""",
)
def calibrate_thresholds(spark, d):
    """Completeness lines from each column's own months: the 5 % quantile less two points."""
    past = inject_nulls(I.fact(spark, d), I.CONFIG["null_injection"], I.KEY, generator=I.GENERATOR)
    columns = ["l_tax", "l_quantity", "l_extendedprice"]
    per_month = past.groupBy(*I.BY).agg(*[R.completeness(c).alias(c) for c in columns])
    long = per_month.unpivot(I.BY, columns, "column_name", "value")
    out = R.calibrate(long, ["column_name"], quantile=0.05)
    return out.withColumn("threshold", F.round("threshold", 4))


# --- classification and severity ---------------------------------------------------------

_TEXTS = [
    'Completeness "c{}" >= 0.98', 'DataFreshness "c{}" <= 72', 'ColumnValues "c{}" between 0 and 5',
    'Mean "c{}" between 1 and 2', 'ColumnExists "c{}"', "RowCount > {}", 'Mean "completeness_c{}" > 1',
]
_TEXT_SQL = "CASE o_orderkey % 7 " + " ".join(
    "WHEN {} THEN '{}' || o_custkey || '{}'".format(i, *t.split("{}")) for i, t in enumerate(_TEXTS)
) + " END"


def _texts(spark, d):
    kind, c = F.col("o_orderkey") % 7, F.col("o_custkey").cast("string")
    text = F.lit(None).cast("string")
    for i, t in enumerate(_TEXTS):
        head, tail = t.split("{}")
        text = F.when(kind == i, F.concat(F.lit(head), c, F.lit(tail))).otherwise(text)
    return I.table(spark, d, "orders").select("o_orderkey", text.alias("rule"))


@query(
    "classify_rules",
    f"""SELECT o_orderkey, {_TEXT_SQL} AS rule, CASE o_orderkey % 7 WHEN 0 THEN 'completeness'
  WHEN 1 THEN 'freshness' WHEN 2 THEN 'distribution' WHEN 3 THEN 'distribution' WHEN 4 THEN 'schema'
  WHEN 5 THEN 'unknown' ELSE 'completeness' END AS type FROM orders""",
)
def classify_rules(spark, d):
    return _texts(spark, d).withColumn("type", sev.classify_rule(F.col("rule")))


@query(
    "extract_column",
    """SELECT o_orderkey, CASE o_orderkey % 7 WHEN 5 THEN 'unknown' WHEN 6 THEN 'completeness_c' || o_custkey
  ELSE 'c' || o_custkey END AS "column" FROM orders""",
)
def extract_column(spark, d):
    return _texts(spark, d).select("o_orderkey", sev.extract_column(F.col("rule")).alias("column"))


def _graded(spark, d, grade, keys, first, second):
    t = I.table(spark, d, "lineitem")
    metrics = F.create_map(F.lit(first[0]), first[1], F.lit(second[0]), second[1])
    return t.withColumn("severity", grade(metrics)).groupBy(*keys, "severity").agg(F.count("*").alias("n"))


@query(
    "severity_completeness",
    """SELECT l_tax, l_discount, CASE WHEN (1 - (1 - l_tax)) * 100 > 5 THEN 'CRITICAL'
    WHEN (1 - (1 - l_tax)) * 100 > 2 THEN 'WARNING' WHEN (1 - (1 - l_discount)) * 100 > 5 THEN 'CRITICAL'
    ELSE 'WARNING' END AS severity, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def severity_completeness(spark, d):
    """Two metrics per row: the first that reaches a line decides."""
    return _graded(
        spark, d, sev.completeness_severity, ["l_tax", "l_discount"],
        ("Column.a.Completeness", F.lit(1.0) - F.col("l_tax")),
        ("Column.b.Completeness", F.lit(1.0) - F.col("l_discount")),
    )


@query(
    "severity_freshness",
    """SELECT l_quantity, l_linenumber, CASE WHEN l_quantity * 3 > 72 THEN 'CRITICAL'
    WHEN l_quantity * 3 > 24 THEN 'WARNING' WHEN l_linenumber * 24 > 72 THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
  count(*) AS n FROM (SELECT l_quantity, l_linenumber::BIGINT AS l_linenumber FROM lineitem) GROUP BY ALL""",
)
def severity_freshness(spark, d):
    line = F.col("l_linenumber").cast("bigint")
    out = _graded(
        spark, d, sev.freshness_severity, ["l_quantity", "l_linenumber"],
        ("Column.a.Freshness.Hours", F.col("l_quantity") * 3), ("Column.b.Freshness.Hours", line * F.lit(24.0)),
    )
    return out.withColumn("l_linenumber", line)


@query(
    "severity_distribution",
    """SELECT l_tax, l_quantity, CASE WHEN l_tax / 4 > 0.01::DOUBLE THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
  count(*) AS n FROM lineitem GROUP BY ALL""",
)
def severity_distribution(spark, d):
    """Only the metric named like an outlier ratio counts, whatever the mean."""
    return _graded(
        spark, d, sev.distribution_severity, ["l_tax", "l_quantity"],
        ("Column.a.Mean", F.col("l_quantity")), ("Column.a.OUTLIERRatio", F.col("l_tax") / 4),
    )


@query(
    "severity_schema",
    """SELECT CASE o_orderkey % 7 WHEN 4 THEN 'CRITICAL' WHEN 0 THEN 'CRITICAL' WHEN 6 THEN 'CRITICAL'
    ELSE 'WARNING' END AS severity, o_orderkey % 7 AS kind, count(*) AS n FROM orders GROUP BY ALL""",
)
def severity_schema(spark, d):
    """Every type at one metric of 0.5: schema is CRITICAL whatever the metric, unknown never."""
    rows = _texts(spark, d)
    kind = sev.classify_rule(F.col("rule"))
    metrics = F.create_map(F.lit("Column.a.Value"), F.lit(0.5))
    return rows.groupBy(
        sev.severity(kind, metrics).alias("severity"), (F.col("o_orderkey") % 7).alias("kind")
    ).agg(F.count("*").alias("n"))


# --- violations and scores ---------------------------------------------------------------


@query(
    "violations",
    f"""WITH {I.VIOLATIONS_SQL}
SELECT evaluation_id, 'lineitem' AS table_name, "partition", type, severity, col AS "column", rule,
  nullif(metric_key, '') AS metric, round(value, 4) AS value FROM violations""",
)
def violations(spark, d):
    """Violation rows with their metric beside them (schema violations have none)."""
    rows = V.violations(I.evaluations(spark, d))
    return rows.select(
        "evaluation_id", "table_name", "partition", "type", "severity",
        F.array_join("affected_columns", ",").alias("column"), "rule",
        F.explode_outer("observed_values").alias("metric", "value"),
    ).withColumn("value", F.round("value", 4))


@query(
    "observed_values",
    f"""WITH {I.VIOLATIONS_SQL} SELECT evaluation_id, metric_key AS metric, round(value, 4) AS value
FROM violations WHERE metric_key <> ''""",
)
def observed_values(spark, d):
    rows = V.observed_values(V.violations(I.evaluations(spark, d)))
    return rows.select("evaluation_id", "metric", F.round("value", 4).alias("value"))


@query(
    "quality_score",
    f"""WITH {I.SUMMARY_SQL} SELECT evaluation_id, CAST(overall_score AS BIGINT) AS overall_score,
  violation_count FROM summary""",
)
def quality_score(spark, d):
    """The score from flat violation rows, joined back to the evaluations."""
    found = I.stored_evaluations(spark, d)
    return V.score_violations(found.select("evaluation_id"), V.violations(found)).select(
        "evaluation_id", "overall_score", "violation_count"
    )


@query(
    "quality_status",
    f"""WITH {I.SUMMARY_SQL} SELECT overall_status, CAST(overall_score AS BIGINT) AS overall_score,
  count(*) AS evaluations FROM summary GROUP BY ALL""",
)
def quality_status(spark, d):
    return (
        V.scan_results(I.evaluations(spark, d))
        .groupBy("overall_status", "overall_score")
        .agg(F.count("*").alias("evaluations"))
    )


@query(
    "scan_results",
    f"""WITH {I.SUMMARY_SQL} SELECT evaluation_id, 'lake' AS database, 'lineitem' AS table_name, "partition",
  CASE WHEN violation_count > 0 THEN 'FAILED' ELSE 'PASSED' END AS overall_state,
  CAST(overall_score AS BIGINT) AS overall_score, overall_status, violation_count,
  violation_count > 0 AS needs_action, 'rules' AS source FROM summary""",
)
def scan_results(spark, d):
    return V.scan_results(I.evaluations(spark, d))


@query(
    "dimension_scores",
    f"""WITH {I.VIOLATIONS_SQL}, c AS (SELECT evaluation_id, type, count(*) AS violation_count,
    count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'WARNING') AS warning
  FROM violations GROUP BY ALL)
SELECT evaluation_id, type, violation_count, CAST({I.SCORE} AS BIGINT) AS score,
  {I.STATUS.format(I.SCORE)} AS status FROM c""",
)
def dimension_scores(spark, d):
    return V.dimension_scores(V.violations(I.evaluations(spark, d))).drop("table_name")


@query(
    "flagged_partitions",
    f"""WITH {I.FACT}, {I.NULLED}, m AS (SELECT {I.PARTITION} AS "partition",
    count(l_quantity)::DOUBLE / count(*) AS value FROM nulled GROUP BY year, month)
SELECT "partition", 90::BIGINT AS overall_score, 'OK' AS overall_status, 1::BIGINT AS violation_count
FROM m WHERE value < 0.98::DOUBLE AND (1 - value) * 100 <= 5""",
)
def flagged_partitions(spark, d):
    """Partitions that need action although their status is OK: one WARNING scores 90."""
    rules = [r for r in I.RULES if r.column == "l_quantity" and r.rule_type == "Completeness"]
    past = inject_nulls(I.fact(spark, d), I.CONFIG["null_injection"], I.KEY, generator=I.GENERATOR)
    out = V.scan_results(R.evaluate(past, rules, I.BY, I.TABLE))
    return out.where("needs_action AND overall_score = 90").select(
        "partition", "overall_score", "overall_status", "violation_count"
    )
