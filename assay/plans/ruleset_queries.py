"""Queries over rulesets with keys and schemas, and over stored states, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions.text import partition_text
from assay.operators import incremental as N
from assay.operators import learned as Q
from assay.operators import neardups as D
from assay.operators import overlap as O
from assay.operators import rules as R
from assay.operators import rulesets as S
from assay.operators import violations as V
from assay.plans import inputs as I
from assay.plans import response
from assay.plans.registry import query
from assay.session import scratch_dir

KEYED_LINES = (
    'Uniqueness "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey" >= 0.98',
    'Uniqueness "l_suppkey","l_partkey" >= 0.97',
    'Uniqueness "l_orderkey" > 0.99',
    'Uniqueness "l_orderkey", "l_surcharge" >= 0.5',
    'Completeness "l_tax" >= 0.90',
    'Mean "l_quantity" between 20 and 60',
    "RowCount > 700",
    'ColumnValues "l_extendedprice" between 0 and 500000',
    'SchemaMatch "lineitem"',
    'SchemaMatch "lineitem_narrow"',
    'SchemaMatch "lineitem_same"',
)


def keyed_rules(spark):
    return R.load_rules(spark, KEYED_LINES, ruleset=True)


def baselines(df):
    """Stored baselines: versions of three tables, all from the schema of the frame that is checked."""
    now = [(f.name, f.dataType.simpleString()) for f in df.schema]
    older = [(n, "decimal(15,2)" if n == "l_tax" else t) for n, t in now if n != "l_suppkey"] + [("l_comment", "string")]
    narrow = [c for c in now if c[0] not in ("l_discount", "month")]
    rows = [
        ("lake", "lineitem", 2, now), ("lake", "lineitem", 10, older), ("lake", "lineitem_narrow", 1, narrow),
        ("lake", "lineitem_same", 1, older), ("lake", "lineitem_same", 2, now), ("other", "lineitem", 11, now),
    ]
    return df.sparkSession.createDataFrame(
        rows, "database string, table_name string, version int, columns array<struct<name:string,type:string>>"
    )


def keyed_evaluations(spark, d):
    dirty = I.corrupted(spark, d)
    found = S.evaluate(dirty, keyed_rules(spark), I.BY, I.TABLE, baselines=baselines(dirty))
    return response.stored(found, scratch_dir(spark, "keyed-evaluations"))


def _text(i: int) -> str:
    return "'" + KEYED_LINES[i - 1].replace("'", "''") + "'"


def _rule(i: int, key: str, value: str, passed: str, kind: str, severity: str, columns: str) -> str:
    return (
        f"SELECT year, month, {i} AS rule_id, {_text(i)} AS rule, {key} AS metric, ({value})::DOUBLE AS value, "
        f"coalesce({passed}, false) AS passed, '{kind}' AS type, {severity} AS severity, '{columns}' AS columns FROM m"
    )


def _unique(i: int, columns: str, value: str, test: str) -> str:
    grade = f"CASE WHEN (1 - ({value})) * 100 > 10 THEN 'CRITICAL' ELSE 'WARNING' END"
    named = ",".join(c.strip() for c in columns.split(","))
    return _rule(i, f"'Column.{named}.Uniqueness'", value, f"({value}) {test}", "uniqueness", grade, named)


# The metrics of a schema rule are listed as one text, sorted.
KEYED_SQL = f"""{I.CORRUPT}, m AS (SELECT year, month, count(*)::DOUBLE AS n,
    count(DISTINCT (l_orderkey, l_linenumber, l_partkey, l_suppkey)) / n AS whole,
    count(DISTINCT (l_suppkey, l_partkey)) / n AS parts, count(DISTINCT l_orderkey) / n AS orders,
    count(l_tax) / n AS tax, avg(l_quantity) AS quantity,
    count(*) FILTER (l_extendedprice < 0 OR l_extendedprice > 500000) / count(l_extendedprice)::DOUBLE AS outside
  FROM dirty GROUP BY year, month),
results AS ({_unique(1, "l_orderkey,l_linenumber,l_partkey,l_suppkey", "whole", ">= 0.98::DOUBLE")}
  UNION ALL {_unique(2, "l_suppkey,l_partkey", "parts", ">= 0.97::DOUBLE")}
  UNION ALL {_unique(3, "l_orderkey", "orders", "> 0.99::DOUBLE")}
  UNION ALL {_rule(4, "'Column.l_orderkey,l_surcharge.Uniqueness'", "NULL", "false", "uniqueness", "'WARNING'", "l_orderkey,l_surcharge")}
  UNION ALL {_rule(5, "'Column.l_tax.Completeness'", "tax", "tax >= 0.9::DOUBLE", "completeness",
                   "CASE WHEN (1 - tax) * 100 > 5 THEN 'CRITICAL' ELSE 'WARNING' END", "l_tax")}
  UNION ALL {_rule(6, "'Column.l_quantity.Mean'", "quantity", "quantity BETWEEN 20 AND 60", "distribution", "'WARNING'", "l_quantity")}
  UNION ALL {_rule(7, "'Dataset.RowCount'", "n", "n > 700", "unknown", "'WARNING'", "unknown")}
  UNION ALL {_rule(8, "'Column.l_extendedprice.OutlierRatio'", "outside", "outside = 0", "distribution",
                   "CASE WHEN outside > 0.01::DOUBLE THEN 'CRITICAL' ELSE 'WARNING' END", "l_extendedprice")}
  UNION ALL {_rule(9, "'Column.l_comment.Removed,Column.l_suppkey.Added,Column.l_tax.Retyped'", "3", "false", "schema",
                   "'CRITICAL'", "l_comment,l_suppkey,l_tax")}
  UNION ALL {_rule(10, "'Column.l_discount.Added,Column.month.Added'", "2", "false", "schema", "'WARNING'", "l_discount,month")}
  UNION ALL {_rule(11, "''", "0", "true", "schema", "'WARNING'", "")})"""


@query(
    "ruleset_with_keys",
    f"""WITH {KEYED_SQL} SELECT year, month, rule_id::INT AS rule_id, rule,
  CASE WHEN passed THEN 'PASSED' ELSE 'FAILED' END AS state, metric, round(value, 4) AS value FROM results""",
)
def ruleset_with_keys(spark, d):
    """Uniqueness and schema rules in one ruleset with the row-wise ones; metrics of a rule as one text, and their sum."""
    dirty = I.corrupted(spark, d)
    found = S.evaluate(dirty, keyed_rules(spark), I.BY, I.TABLE, baselines=baselines(dirty))
    total = F.aggregate(F.map_values("evaluated_metrics"), F.lit(0.0), lambda a, x: a + x)
    return R.rule_results(found, I.BY).select(
        "year", "month", "rule_id", "rule", "state",
        F.array_join(F.array_sort(F.map_keys("evaluated_metrics")), ",").alias("metric"), F.round(total, 4).alias("value"),
    )


@query(
    "violations_of_keys",
    f"""WITH {KEYED_SQL} SELECT {I.EVALUATION_ID} AS evaluation_id, {I.PARTITION} AS "partition", rule, type, severity,
  columns FROM results WHERE NOT passed""",
)
def violations_of_keys(spark, d):
    """Duplicates over 10 % are CRITICAL, over 5 % WARNING; columns removed or retyped CRITICAL, added WARNING."""
    rows = V.violations(keyed_evaluations(spark, d))
    columns = F.when(F.col("type") == "schema", F.array_sort("affected_columns")).otherwise(F.col("affected_columns"))
    return rows.select("evaluation_id", "partition", "rule", "type", "severity", F.array_join(columns, ",").alias("columns"))


@query(
    "response_to_keys",
    f"""WITH {KEYED_SQL}, c AS (SELECT year, month, count(*) FILTER (NOT passed) AS violation_count,
    count(*) FILTER (NOT passed AND severity = 'CRITICAL') AS critical,
    count(*) FILTER (NOT passed AND severity = 'WARNING') AS warning FROM results GROUP BY ALL),
s AS (SELECT *, {I.SCORE} AS overall_score FROM c)
SELECT {I.EVALUATION_ID} AS evaluation_id, overall_score::BIGINT AS overall_score, {I.STATUS.format('overall_score')} AS overall_status,
  violation_count, r.type, r.severity, CASE r.severity WHEN 'CRITICAL' THEN 'quarantine_and_notify' ELSE 'notify_only' END
    AS recommended_action, count(*) AS actions
FROM s JOIN results r USING (year, month) WHERE NOT passed GROUP BY ALL""",
)
def response_to_keys(spark, d):
    """Score and status of every partition beside the actions that its violations lead to."""
    found = keyed_evaluations(spark, d)
    scans = V.scan_results(found).withColumn("ts", F.lit("2025-01-01").cast("timestamp"))
    acted = response.actions(V.violations(found), scans)
    return (
        scans.select("evaluation_id", "overall_score", "overall_status", "violation_count")
        .join(acted.select("evaluation_id", "type", "severity", "recommended_action"), "evaluation_id")
        .groupBy("evaluation_id", "overall_score", "overall_status", "violation_count", "type", "severity", "recommended_action")
        .agg(F.count("*").alias("actions"))
    )


# --- states per file -----------------------------------------------------------------------

PARTED_SCHEMA = I.LINEITEM_SCHEMA + ", year string, month string"


def _in_two_loads(spark, d, refresh):
    """The corrupted table in month folders, written in two loads with a refresh after each; path and store."""
    path, store = scratch_dir(spark, "loads"), scratch_dir(spark, "file-states")
    dirty = response.stored(I.corrupted(spark, d), scratch_dir(spark, "dirty"))
    late = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(3)) == 0
    for part in (dirty.where(~late), dirty.where(late)):
        part.hint("rebalance", *I.BY).write.mode("append").partitionBy(*I.BY).parquet(path)
        refresh(path, store)
    return path, store


@query(
    "incremental_evaluation",
    f"""WITH {I.RESULTS_SQL} SELECT year, month, rule, round(value, 4) AS metric,
  CASE WHEN passed THEN 'PASSED' ELSE 'FAILED' END AS state FROM results""",
)
def incremental_evaluation(spark, d):
    """The ruleset from states of files that were read once each, when they came."""
    args = (PARTED_SCHEMA, I.BY, I.RULES)
    path, store = _in_two_loads(spark, d, lambda path, store: N.refresh(spark, path, store, *args))
    found = N.evaluate_stored(spark, path, store, *args, I.TABLE, as_of=I.month_end())
    return R.rule_results(found, I.BY).select(
        "year", "month", "rule", F.round(R.single_metric(F.col("evaluated_metrics")), 4).alias("metric"), "state"
    )


# --- issues that hit the same rows ----------------------------------------------------------

ISSUES = {
    "tax": "l_tax < 0 OR l_tax > 1", "price": "l_extendedprice < 0 OR l_extendedprice > 500000",
    "quantity": "l_quantity < 1 OR l_quantity > 50", "cheap": "l_extendedprice < 1",
    "flag": "l_returnflag NOT IN ('A', 'N', 'R')", "blank": "l_returnflag IN ('YES', 'NO', 'maybe', '1', '0', '')",
}
_BITS = " + ".join(f"CASE WHEN coalesce({p}, false) THEN {1 << i} ELSE 0 END" for i, p in enumerate(ISSUES.values()))
_HELD = "list_filter([" + ", ".join(f"CASE WHEN {{0}} & {1 << i} <> 0 THEN '{n}' END" for i, n in enumerate(ISSUES)) + "], lambda x: x IS NOT NULL)"
MASKS_SQL = f"""{I.CORRUPT}, masks AS (SELECT year, month, ({_BITS})::BIGINT AS mask, count(*) AS n FROM dirty GROUP BY ALL)"""


def _masks(spark, d):
    return O.row_masks(I.corrupted(spark, d), ISSUES, I.BY)


@query(
    "issue_overlap",
    f"""WITH {MASKS_SQL}, t AS (SELECT year, month, sum(n) AS total FROM masks GROUP BY ALL),
every AS (SELECT year, month, s.held, sum(n) AS support FROM masks, range(1, {1 << len(ISSUES)}) s(held)
  WHERE mask & held = held GROUP BY ALL),
closed AS (SELECT * FROM every e WHERE NOT EXISTS (SELECT 1 FROM every w WHERE w.year = e.year AND w.month = e.month
  AND w.held <> e.held AND w.held & e.held = e.held AND w.support = e.support))
SELECT c.year, c.month, array_to_string({_HELD.format('c.held')}, '+') AS issues, c.support::BIGINT AS support,
  round(c.support / t.total / product(e.support::DOUBLE / t.total), 3) AS lift
FROM closed c JOIN t ON c.year = t.year AND c.month = t.month
JOIN every e ON e.year = c.year AND e.month = c.month AND bit_count(e.held) = 1 AND c.held & e.held <> 0
WHERE c.support >= 2 GROUP BY c.year, c.month, c.held, c.support, t.total""",
)
def issue_overlap(spark, d):
    """All closed sets of issues that two rows of a month have at least, by brute force over all subsets in SQL."""
    found = O.closed_sets(_masks(spark, d), list(ISSUES), I.BY, min_support=2)
    return found.select("year", "month", F.array_join("issues", "+").alias("issues"), "support", F.round("lift", 3).alias("lift"))


@query(
    "joint_quarantine_requests",
    f"""WITH RECURSIVE {MASKS_SQL}, pairs AS (SELECT year, month, i, j, sum(n) FILTER (mask & (1 << i) <> 0 AND mask & (1 << j) <> 0) AS n_both,
    sum(n) FILTER (mask & (1 << i) <> 0 OR mask & (1 << j) <> 0) AS n_either
  FROM masks, range({len(ISSUES)}) a(i), range({len(ISSUES)}) b(j) GROUP BY ALL),
links AS (SELECT year, month, i, j FROM pairs WHERE n_both >= 0.9::DOUBLE * n_either),
reach AS (SELECT year, month, i, j FROM links UNION SELECT r.year, r.month, r.i, l.j FROM reach r
  JOIN links l ON l.year = r.year AND l.month = r.month AND l.i = r.j),
held AS (SELECT DISTINCT year, month, held FROM (SELECT year, month, i, sum(1 << j)::BIGINT AS held FROM reach GROUP BY ALL))
SELECT {I.PARTITION} AS "partition", array_to_string({_HELD.format('held')}, '+') AS issue_id, sum(n)::BIGINT AS bad_rows
FROM held JOIN masks USING (year, month) WHERE mask & held <> 0 GROUP BY year, month, held""",
)
def joint_quarantine_requests(spark, d):
    """Issues whose rows coincide are one request; with the number of rows it takes out."""
    groups = O.coinciding(_masks(spark, d), list(ISSUES), I.BY)
    requests = O.joint_requests(groups, ISSUES, I.TABLE, I.BY).select("partition", "issue_id")
    named = groups.select(partition_text(I.BY).alias("partition"), F.array_join("issues", "+").alias("issue_id"), "bad_rows")
    return requests.join(named, ["partition", "issue_id"])


# --- bounds learned from the data -------------------------------------------------------------

_LEARNED = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "learned_bounds",
    f"""WITH {I.CORRUPT}, long AS (UNPIVOT (SELECT year, month, {', '.join(_LEARNED)} FROM dirty)
  ON {', '.join(_LEARNED)} INTO NAME "column" VALUE v)
SELECT "column", count(DISTINCT (year, month)) AS partitions, count(*) AS value_count, true AS within, true AS robust
FROM long GROUP BY ALL""",
)
def learned_bounds(spark, d):
    """Bounds of three columns with planted outliers, merged over months: are ranks within the sketches' error,
    and do the bounds leave out the planted values, 1 to 3 in a hundred, and hardly more?"""
    past = response.stored(I.corrupted(spark, d).select(*I.BY, *_LEARNED), scratch_dir(spark, "past"))
    sketches = response.stored(Q.sketched(past, _LEARNED, I.BY), scratch_dir(spark, "sketches"))
    levels = [n / 10 for n in range(1, 10)]
    asked = Q.merged_quantiles(sketches, levels).join(Q.learned_bounds(sketches).select("column", "lo", "hi"), "column")
    values = past.unpivot(I.BY, _LEARNED, "column", "v").where(F.col("v").isNotNull())
    met = values.join(F.broadcast(asked), "column")
    ranks = [F.count_if(F.col("v") < F.col("quantiles")[i]) for i in range(9)], [F.count_if(F.col("v") <= F.col("quantiles")[i]) for i in range(9)]
    grouped = met.groupBy("column").agg(
        F.first("partitions").alias("partitions"), F.count("*").alias("value_count"),
        F.array(*ranks[0]).alias("below"), F.array(*ranks[1]).alias("upto"),
        (F.count_if((F.col("v") < F.col("lo")) | (F.col("v") > F.col("hi"))) / F.count("*")).alias("outside"),
    )
    slack = 2 * Q.RANK_ERROR
    within = [((F.col("below")[i] / F.col("value_count") <= p + slack) & (F.col("upto")[i] / F.col("value_count") >= p - slack)) for i, p in enumerate(levels)]
    return grouped.select("column", "partitions", "value_count", F.forall(F.array(*within), lambda x: x).alias("within"),
                          (F.col("outside").between(0.005, 0.05)).alias("robust"))


# --- rows that nearly repeat an earlier one -----------------------------------------------------

_EXACT = ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate"]
_NEAR = {"l_quantity": 0.06, "l_extendedprice": 0.06, "l_discount": 0.06}
_LOW = "-1e18::DOUBLE"
_TUPLE = "(" + ", ".join(f"coalesce({{0}}.{c}, {_LOW})" for c in _NEAR) + ")"
_CLOSE = " AND ".join(f"abs(coalesce(a.{c}, {_LOW}) - coalesce(b.{c}, {_LOW})) <= {t}::DOUBLE" for c, t in _NEAR.items())


@query(
    "near_duplicate_rows",
    f"""WITH {I.CORRUPT}, d AS (SELECT year, month, {', '.join([*_EXACT, *_NEAR])}, count(*) AS copies FROM dirty GROUP BY ALL),
f AS (SELECT a.*, EXISTS (SELECT 1 FROM d b WHERE {' AND '.join(f'a.{c} = b.{c}' for c in ['year', 'month', *_EXACT])}
  AND {_TUPLE.format('b')} < {_TUPLE.format('a')} AND {_CLOSE}) AS repeats FROM d a),
g AS (SELECT year, month, sum(copies)::BIGINT AS row_count, sum(copies - CASE WHEN repeats THEN 0 ELSE 1 END)::BIGINT AS near_repeats
  FROM f GROUP BY year, month)
SELECT year, month, row_count, near_repeats, round(near_repeats / row_count, 6) AS duplicate_share,
  CASE WHEN near_repeats / row_count * 100 > 10 THEN 'CRITICAL' WHEN near_repeats / row_count * 100 > 5 THEN 'WARNING' ELSE 'OK' END AS severity
FROM g""",
)
def near_duplicate_rows(spark, d):
    """Planted near copies, three columns off by a little, and exact ones; by brute force over pairs in SQL."""
    out = D.near_uniqueness(I.corrupted(spark, d), _EXACT, _NEAR, I.BY)
    return out.withColumn("duplicate_share", F.round("duplicate_share", 6))
