"""Stand-in inputs for the registered queries, as frames and as SQL.

`lineitem` plays the fact table, partitioned by the year and month of its ship date. `events`
plays the audit and metric tables. All are derived from whole tables by expressions that both
engines have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.operators.corrupt import corrupt
from assay.operators.rules import Rule, evaluate
from assay.plans.response import stored
from assay.session import scratch_dir

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
BY = ["year", "month"]
TABLE = "lineitem"
COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
LINEITEM_SCHEMA = (
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
    "l_linestatus string, l_shipdate timestamp_ntz"
)

# The shipped rates on the stand-in columns: l_tax for passenger_count, l_extendedprice for
# fare_amount, l_discount for payment_type and total_amount, l_quantity for trip_distance,
# l_returnflag for store_and_fwd_flag, l_linenumber for RatecodeID.
# The md5 generator can be repeated in SQL.
GENERATOR = "md5"
CONFIG = {
    "seed": 42,
    "generator": GENERATOR,
    "null_injection": {
        "enabled": True,
        "columns": [
            {"column": "l_tax", "null_rate": 0.15},
            {"column": "l_extendedprice", "null_rate": 0.08},
            {"column": "l_discount", "null_rate": 0.05},
            {"column": "l_quantity", "null_rate": 0.03},
        ],
    },
    "outlier_injection": {
        "enabled": True,
        "rules": [
            {"column": "l_tax", "values": [-5, 0, 99, 255, 999], "inject_rate": 0.02},
            {"column": "l_extendedprice", "min": -100000.0, "max": 2000000.0, "inject_rate": 0.03},
            {"column": "l_quantity", "min": -10.0, "max": 10000.0, "inject_rate": 0.02},
            {"column": "l_discount", "min": -5000.0, "max": 100000.0, "inject_rate": 0.01},
        ],
    },
    "duplicate_injection": {"enabled": True, "exact_duplicates": 0.03, "near_duplicates": 0.02},
    "freshness_issues": {
        "enabled": False,
        "backdate_days": 7,
        "affected_rate": 0.1,
        "columns": ["l_shipdate"],
    },
    "format_violations": {
        "enabled": True,
        "rules": [
            {
                "column": "l_returnflag",
                "inject_values": ["YES", "NO", "maybe", "1", "0", ""],
                "inject_rate": 0.05,
            },
            {"column": "l_linenumber", "inject_values": [0, 7, 8, 99, -1], "inject_rate": 0.03},
        ],
    },
    "schema_drift": {
        "enabled": False,
        "actions": [
            {"type": "rename_column", "from_name": "l_extendedprice", "to_name": "l_price"},
            {"type": "add_column", "name": "surcharge_v2", "fill_value": 0.0},
            {"type": "drop_column", "name": "l_linestatus"},
            {"type": "change_type", "column": "l_suppkey", "new_dtype": "string"},
        ],
    },
}

# The shipped ruleset on the stand-in columns, and the two rules known from events only.
RULES = [
    Rule(1, "Completeness", "l_shipdate", ">=", 0.98, None, 'Completeness "l_shipdate" >= 0.98'),
    Rule(2, "Completeness", "l_orderkey", ">=", 0.98, None, 'Completeness "l_orderkey" >= 0.98'),
    Rule(3, "Completeness", "l_tax", ">=", 0.70, None, 'Completeness "l_tax" >= 0.70'),
    Rule(4, "Completeness", "l_quantity", ">=", 0.98, None, 'Completeness "l_quantity" >= 0.98'),
    Rule(5, "Completeness", "l_extendedprice", ">=", 0.98, None, 'Completeness "l_extendedprice" >= 0.98'),
    Rule(6, "RowCount", None, ">", 500.0, None, "RowCount > 500"),
    Rule(7, "Mean", "l_extendedprice", "between", 40000.0, 65000.0,
         'Mean "l_extendedprice" between 40000 and 65000'),
    Rule(8, "Mean", "l_quantity", "between", 20.0, 60.0, 'Mean "l_quantity" between 20 and 60'),
    Rule(9, "ColumnExists", "l_shipdate", None, None, None, 'ColumnExists "l_shipdate"'),
    Rule(10, "ColumnExists", "l_orderkey", None, None, None, 'ColumnExists "l_orderkey"'),
    Rule(11, "ColumnExists", "l_tax", None, None, None, 'ColumnExists "l_tax"'),
    Rule(12, "ColumnExists", "l_extendedprice", None, None, None, 'ColumnExists "l_extendedprice"'),
    Rule(13, "ColumnExists", "l_surcharge", None, None, None, 'ColumnExists "l_surcharge"'),
    Rule(14, "DataFreshness", "l_shipdate", "<=", 23.0, None, 'DataFreshness "l_shipdate" <= 23'),
    Rule(15, "ColumnValues", "l_extendedprice", "between", 0.0, 500000.0,
         'ColumnValues "l_extendedprice" between 0 and 500000'),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def year_month(column: str) -> dict[str, Column]:
    return {
        "year": F.lpad(F.year(column).cast("string"), 4, "0"),
        "month": F.lpad(F.month(column).cast("string"), 2, "0"),
    }


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.schema(LINEITEM_SCHEMA).parquet(f"{sf_dir}/lineitem.parquet")
    return raw.withColumns(year_month("l_shipdate"))


def month_end() -> Column:
    """The first moment after a partition's month."""
    start = F.make_date(F.col("year").cast("int"), F.col("month").cast("int"), F.lit(1))
    return F.add_months(start, 1)


def corrupted(spark: SparkSession, sf_dir: str, keep_key: bool = False) -> DataFrame:
    return corrupt(fact(spark, sf_dir), CONFIG, KEY, keep_key=keep_key)


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(corrupted(spark, sf_dir), RULES, BY, TABLE, as_of=month_end())


def stored_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluations from a written table, for plans that start from them more than once."""
    return stored(evaluations(spark, sf_dir), scratch_dir(spark, "evaluations"))


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored scan results: one per event; user and event type make the partition."""
    score = (F.floor("value").cast("bigint") % 11) * 10
    return table(spark, sf_dir, "events").select(
        F.format_string("ev-%08d", "event_id").alias("evaluation_id"),
        F.concat(F.lit("t_"), "event_type").alias("table_name"),
        F.concat(F.lit("user="), F.col("user_id").cast("string")).alias("partition"),
        "ts",
        score.alias("overall_score"),
        F.when(score < 50, "CRITICAL").when(score < 80, "WARNING").otherwise("OK").alias("overall_status"),
        (F.lit(10) - score / 10).cast("bigint").alias("violation_count"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    return table(spark, sf_dir, "events").select(
        F.format_string("de-%08d", "event_id").alias("decision_id"),
        "ts",
        F.concat("event_type", F.lit("_logged")).alias("decision_type"),
        F.when(F.col("user_id") % 7 == 0, "").otherwise(F.concat(F.lit("t_"), user)).alias("table_name"),
        F.when(F.col("user_id") % 5 == 0, F.lit(None))
        .when(F.col("user_id") % 5 == 1, "")
        .otherwise(F.concat(F.lit("user "), user, F.lit(" did "), F.repeat(F.col("event_type"), F.lit(25))))
        .alias("reasoning"),
    )


def remediations(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.floor("value").cast("bigint")
    return table(spark, sf_dir, "events").select(
        F.format_string("is-%08d", "event_id").alias("issue_id"),
        F.concat(F.lit("t_"), "event_type").alias("table_name"),
        F.concat(F.lit("user="), F.col("user_id").cast("string")).alias("partition"),
        "ts",
        F.when(F.col("event_type").isin("error", "view"), "quarantine").otherwise("notify").alias("action_type"),
        F.when(F.col("user_id") % 9 != 0, whole).alias("records_affected"),
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metric point per event; the event type decides the metric."""
    return metric_points(table(spark, sf_dir, "events"))


def metric_points(events: DataFrame) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id")
    table_name = F.when(user % 2 == 0, "lineitem").otherwise("orders")
    level = F.when(user % 3 == 0, "CRITICAL").otherwise("WARNING")
    action = F.when(user % 3 == 0, "quarantine").otherwise("notify")
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "signup", "OverallQualityScore")
        .when(kind == "error", "AnomaliesDetected")
        .when(kind == "purchase", "RemediationActions")
        .when(kind == "view", "AgentTokenCost")
        .otherwise("ToolCallDuration")
        .alias("name"),
        "value",
        F.when(kind == "signup", F.create_map(F.lit("TableName"), table_name))
        .when(kind == "error", F.create_map(F.lit("TableName"), table_name, F.lit("Severity"), level))
        .when(kind == "purchase", F.create_map(F.lit("TableName"), table_name, F.lit("ActionType"), action))
        .when(kind == "view", F.create_map(F.lit("ModelId"), F.concat(F.lit("m"), (user % 4).cast("string"))))
        .otherwise(F.create_map(F.lit("ToolName"), F.concat(F.lit("tool"), (user % 5).cast("string"))))
        .alias("dimensions"),
    )


# --- the same in SQL ---------------------------------------------------------------------

FACT = """fact AS (
  SELECT *, strftime(l_shipdate, '%Y') AS year, strftime(l_shipdate, '%m') AS month,
    concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_key
  FROM lineitem)"""


def u(op: str, column: str, n: int = 0, key: str = "row_key", open_end: bool = False) -> str:
    """SQL of a hash uniform."""
    word = f"('0x' || substr(md5('42|{op}|{column}|' || {key}), {8 * n + 1}, 8))::BIGINT"
    return f"(({word}{' + 1' if open_end else ''})::DOUBLE / 4294967296.0::DOUBLE)"


def _null(i: int, column: str, rate: float) -> str:
    return f"CASE WHEN {u('null', '0', i)} < {rate}::DOUBLE THEN NULL ELSE {column} END AS {column}"


def _range(i: int, column: str, rate: float, lo: float, hi: float) -> str:
    drawn = f"({lo}::DOUBLE + {u('outlier_value', column)} * {hi - lo}::DOUBLE)"
    return f"CASE WHEN {u('outlier', '0', i)} < {rate}::DOUBLE THEN {drawn} ELSE {column} END AS {column}"


def _pick(op: str, i: int, column: str, rate: float, values: str, n: int, to: str) -> str:
    drawn = f"({values})[1 + floor({u(op + '_value', column)} * {n})::INT]::{to}"
    return f"CASE WHEN {u(op, '0', i)} < {rate}::DOUBLE THEN {drawn} ELSE {column} END AS {column}"


NULLED = f"""nulled AS (
  SELECT * REPLACE ({_null(0, 'l_tax', 0.15)}, {_null(1, 'l_extendedprice', 0.08)},
    {_null(2, 'l_discount', 0.05)}, {_null(3, 'l_quantity', 0.03)}) FROM fact)"""
OUTLIERS = f"""
  SELECT * REPLACE ({_pick('outlier', 0, 'l_tax', 0.02, '[-5, 0, 99, 255, 999]', 5, 'DOUBLE')},
    {_range(1, 'l_extendedprice', 0.03, -100000.0, 2000000.0)},
    {_range(2, 'l_quantity', 0.02, -10.0, 10000.0)},
    {_range(3, 'l_discount', 0.01, -5000.0, 100000.0)})"""
OUTLIED = f"outlied AS ({OUTLIERS} FROM nulled)"


def copies(name: str, source: str, exact: float, near: float) -> str:
    """CTE `name`: the rows of `source`, chosen ones several times, a copy's key with a suffix."""
    x = f"{u('copies', '0')} < {exact}::DOUBLE"
    n = [f"{u('copies', '0', i)} < ({near / (1 + exact)!r})::DOUBLE" for i in (1, 2)]
    return f"""{name}_marked AS (
  SELECT *, unnest(list_filter(['', CASE WHEN {x} THEN '|x' END, CASE WHEN {n[0]} THEN '|n' END,
    CASE WHEN {x} AND {n[1]} THEN '|x|n' END], lambda m: m IS NOT NULL)) AS copy FROM {source}),
{name} AS (SELECT * EXCLUDE (row_key, copy), row_key || copy AS row_key, copy LIKE '%|n' AS is_copy
  FROM {name}_marked)"""


def _noise(column: str) -> str:
    u1, u2 = u("noise", column, 0, open_end=True), u("noise", column, 1)
    drawn = f"sqrt(ln({u1}) * -2.0::DOUBLE) * cos(2 * pi() * {u2}) * 0.01::DOUBLE"
    return f"CASE WHEN is_copy THEN {column} + {drawn} ELSE {column} END AS {column}"


NOISE = f"""SELECT * EXCLUDE (is_copy) REPLACE ({_noise('l_quantity')}, {_noise('l_extendedprice')},
  {_noise('l_discount')})"""
COPIED = copies("copied", "outlied", 0.03, 0.02) + f",\nnoisy AS ({NOISE} FROM copied)"
FORMATS = f"""
  SELECT * REPLACE (
    {_pick('format', 0, 'l_returnflag', 0.05, "['YES', 'NO', 'maybe', '1', '0', '']", 6, 'VARCHAR')},
    {_pick('format', 1, 'l_linenumber', 0.03, '[0, 7, 8, 99, -1]', 5, 'INT')})"""
DIRTY = f"dirty AS ({FORMATS} FROM noisy)"
CORRUPT = ",\n".join([FACT, NULLED, OUTLIED, COPIED, DIRTY])

PARTITION = "'year=' || year || '/month=' || month"
EVALUATION_ID = f"md5('lake#lineitem#' || {PARTITION})"


def _rule(i: int, text: str, metric: str, value: str, passed: str) -> str:
    name = f"'{metric}'" if metric else "NULL"
    return (
        f"SELECT year, month, {i} AS rule_id, '{text}' AS rule, {name} AS metric_key, "
        f"({value})::DOUBLE AS value, coalesce({passed}, false) AS passed FROM m"
    )


def rule_sql() -> str:
    """CTEs `m` (one row per month) and `results` (one row per month and rule), from `dirty`."""
    aggregates = """m AS (SELECT year, month, count(*)::DOUBLE AS n,
    count(l_shipdate)::DOUBLE AS c_l_shipdate, count(l_orderkey)::DOUBLE AS c_l_orderkey,
    count(l_tax)::DOUBLE AS c_l_tax, count(l_quantity)::DOUBLE AS c_l_quantity,
    count(l_extendedprice)::DOUBLE AS c_l_extendedprice,
    avg(l_extendedprice) AS a_l_extendedprice, avg(l_quantity) AS a_l_quantity,
    date_diff('second', max(l_shipdate),
      make_date(year::INT, month::INT, 1)::TIMESTAMP + INTERVAL 1 MONTH) / 3600.0::DOUBLE AS stale,
    count(*) FILTER (l_extendedprice < 0 OR l_extendedprice > 500000)::DOUBLE AS outside
  FROM dirty GROUP BY year, month)"""
    rows = []
    for r in RULES:
        c = r.column
        if r.rule_type == "Completeness":
            part = (f"Column.{c}.Completeness", f"c_{c} / n", f"c_{c} / n >= {r.lo}::DOUBLE")
        elif r.rule_type == "RowCount":
            part = ("Dataset.RowCount", "n", f"n > {r.lo}")
        elif r.rule_type == "Mean":
            part = (f"Column.{c}.Mean", f"a_{c}", f"a_{c} BETWEEN {r.lo} AND {r.hi}")
        elif r.rule_type == "DataFreshness":
            part = (f"Column.{c}.Freshness.Hours", "stale", f"stale <= {r.lo}")
        elif r.rule_type == "ColumnValues":
            part = (f"Column.{c}.OutlierRatio", f"outside / c_{c}", "outside = 0")
        else:
            part = ("", "NULL", "true" if c in COLUMNS else "false")
        rows.append(_rule(r.rule_id, r.rule_text, *part))
    return aggregates + ",\nresults AS (" + "\n  UNION ALL ".join(rows) + ")"


# Severity of a failed result; its metric map holds at most one entry.
VIOLATION_TYPE = """CASE WHEN lower(rule) LIKE '%completeness%' THEN 'completeness'
    WHEN lower(rule) LIKE '%freshness%' THEN 'freshness'
    WHEN lower(rule) LIKE '%columnvalues%' OR lower(rule) LIKE '%between%' THEN 'distribution'
    WHEN lower(rule) LIKE '%columnexists%' THEN 'schema' ELSE 'unknown' END"""
SEVERITY = """CASE
    WHEN type = 'completeness' AND (1 - value) * 100 > 5 THEN 'CRITICAL'
    WHEN type = 'freshness' AND value > 72 THEN 'CRITICAL'
    WHEN type = 'distribution' AND metric_key LIKE '%Outlier%' AND value > 0.01::DOUBLE THEN 'CRITICAL'
    WHEN type = 'schema' THEN 'CRITICAL' ELSE 'WARNING' END"""
VIOLATIONS = f"""typed AS (SELECT *, {VIOLATION_TYPE} AS type FROM results WHERE NOT passed),
violations AS (SELECT *, {SEVERITY} AS severity,
    coalesce(nullif(regexp_extract(rule, '"([^"]+)"', 1), ''), 'unknown') AS col,
    {EVALUATION_ID} AS evaluation_id, {PARTITION} AS "partition" FROM typed)"""
SCORE = "greatest(0, 100 - 20 * critical - 10 * warning)"
STATUS = "CASE WHEN {0} < 50 THEN 'CRITICAL' WHEN {0} < 80 THEN 'WARNING' ELSE 'OK' END"
SUMMARY = f"""counted AS (SELECT m.year, m.month, count(v.rule_id) AS violation_count,
    count(*) FILTER (v.severity = 'CRITICAL') AS critical,
    count(*) FILTER (v.severity = 'WARNING') AS warning
  FROM m LEFT JOIN violations v ON v.year = m.year AND v.month = m.month GROUP BY m.year, m.month),
summary AS (SELECT *, {SCORE} AS overall_score, {STATUS.format(SCORE)} AS overall_status,
    {EVALUATION_ID} AS evaluation_id, {PARTITION} AS "partition" FROM counted)"""
RESULTS_SQL = CORRUPT + ",\n" + rule_sql()
VIOLATIONS_SQL = RESULTS_SQL + ",\n" + VIOLATIONS
SUMMARY_SQL = VIOLATIONS_SQL + ",\n" + SUMMARY

_USER = "CAST(user_id AS VARCHAR)"
_EVENT = "lpad(CAST(event_id AS VARCHAR), 8, '0')"
_SCORE = "(CAST(floor(value) AS BIGINT) % 11) * 10"
SCANS = f"""scans AS (SELECT 'ev-' || {_EVENT} AS evaluation_id, 't_' || event_type AS table_name,
    'user=' || {_USER} AS "partition", ts, {_SCORE} AS overall_score,
    {STATUS.format('(' + _SCORE + ')')} AS overall_status,
    CAST(10 - {_SCORE} / 10 AS BIGINT) AS violation_count FROM events)"""
DECISIONS = f"""decisions AS (SELECT 'de-' || {_EVENT} AS decision_id, ts,
    event_type || '_logged' AS decision_type,
    CASE WHEN user_id % 7 = 0 THEN '' ELSE 't_' || {_USER} END AS table_name,
    CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 5 = 1 THEN ''
      ELSE 'user ' || {_USER} || ' did ' || repeat(event_type, 25) END AS reasoning FROM events)"""
REMEDIATIONS = f"""remediations AS (SELECT 'is-' || {_EVENT} AS issue_id,
    't_' || event_type AS table_name, 'user=' || {_USER} AS "partition", ts,
    CASE WHEN event_type IN ('error', 'view') THEN 'quarantine' ELSE 'notify' END AS action_type,
    CASE WHEN user_id % 9 <> 0 THEN CAST(floor(value) AS BIGINT) END AS records_affected FROM events)"""
METRICS = """metrics AS (SELECT ts, value,
    CASE event_type WHEN 'signup' THEN 'OverallQualityScore' WHEN 'error' THEN 'AnomaliesDetected'
      WHEN 'purchase' THEN 'RemediationActions' WHEN 'view' THEN 'AgentTokenCost'
      ELSE 'ToolCallDuration' END AS name,
    CASE WHEN event_type IN ('signup', 'error', 'purchase') THEN
      CASE WHEN user_id % 2 = 0 THEN 'lineitem' ELSE 'orders' END END AS dim_table,
    CASE WHEN event_type = 'error' THEN
      CASE WHEN user_id % 3 = 0 THEN 'CRITICAL' ELSE 'WARNING' END END AS dim_severity,
    CASE WHEN event_type = 'purchase' THEN
      CASE WHEN user_id % 3 = 0 THEN 'quarantine' ELSE 'notify' END END AS dim_action FROM events)"""
