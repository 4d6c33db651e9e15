"""Queries over scans, ingest, evaluation records, quarantine and audit tables.

What writes does so into a fresh folder of the shared scratch space, and returns what it reads
back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.functions import text as X
from assay.operators import history as H
from assay.operators import quarantine as Q
from assay.operators import retention as T
from assay.operators import violations as V
from assay.operators.corrupt import inject_nulls
from assay.operators.rules import evaluate, rule_results
from assay.plans import inputs as I
from assay.plans.registry import query
from assay.plans.response import isolate, stored
from assay.session import scratch_dir
from assay.sources import audit as A
from assay.sources import idindex as J
from assay.sources import partitions as P
from assay.sources import results as E
from assay.sources import swaps as W
from assay.sources import tables as S

FACT_SCHEMA = I.LINEITEM_SCHEMA + ", year string, month string"
_COLS = ", ".join(I.COLUMNS)


@query("scan_fact", f"WITH {I.FACT} SELECT {_COLS}, year, month FROM fact")
def scan_fact(spark, d):
    return I.fact(spark, d)


def _stored(spark, d, label):
    """lineitem as a partitioned table."""
    path = scratch_dir(spark, label)
    P.write_partitions(I.fact(spark, d), path, I.BY)
    return path


@query(
    "scan_partition",
    f"WITH {I.FACT} SELECT {_COLS}, year, month FROM fact WHERE year = '1998' AND month = '03'",
)
def scan_partition(spark, d):
    """One partition of the stored table, by its partition text; the others are not opened."""
    return S.read_partition(spark, _stored(spark, d, "scan"), "year=1998/month=03", FACT_SCHEMA)


@query(
    "partition_from_predicate",
    f"""WITH {I.FACT} SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN ''
  WHEN 3 THEN 'month=' || month || '/year=' || year WHEN 4 THEN 'year=' || year
  ELSE 'year=' || year || '/month=' || month END AS "partition" FROM fact""",
)
def partition_from_predicate(spark, d):
    y, m, n = F.col("year"), F.col("month"), F.col("l_linenumber")
    predicate = (
        F.when(n == 1, "")
        .when(n == 2, F.lit(None))
        .when(n == 3, F.concat(F.lit("(month = '"), m, F.lit("') and (year  ='"), y, F.lit("')")))
        .when(n == 4, F.concat(F.lit("year='"), y, F.lit("' AND month > "), m))
        .otherwise(F.concat(F.lit("year='"), y, F.lit("' AND month='"), m, F.lit("'")))
    )
    return I.fact(spark, d).select(
        "l_orderkey", "l_linenumber", "l_partkey", X.partition_of_predicate(predicate).alias("partition")
    )


@query(
    "partition_from_filename",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%m') AS month
FROM orders WHERE o_custkey % 10 <> 0""",
)
def partition_from_filename(spark, d):
    """One file name per order; names without a month are skipped."""
    stamp = F.concat_ws("-", I.year_month("o_orderdate")["year"], I.year_month("o_orderdate")["month"])
    name = F.when(F.col("o_custkey") % 10 == 0, "orders_latest.parquet").otherwise(
        F.concat(F.lit("orders_"), stamp, F.lit(".parquet"))
    )
    named = I.table(spark, d, "orders").select("o_orderkey", X.year_month_of_filename(name).alias("p"))
    return named.where(F.col("p").isNotNull()).select("o_orderkey", "p.*")


@query(
    "missing_partitions",
    f"""WITH {I.FACT}, c AS (SELECT unnest(generate_series(DATE '1994-06-01', DATE '2002-09-01', INTERVAL 1 MONTH)) AS t)
SELECT strftime(t, '%Y') AS year, strftime(t, '%m') AS month FROM c
WHERE strftime(t, '%Y-%m') NOT IN (SELECT year || '-' || month FROM fact)""",
)
def missing_partitions(spark, d):
    """A hundred months from June 1994, less those that the table has."""
    return P.missing_partitions(P.month_calendar(spark, 1994, 6, 100), I.fact(spark, d), I.BY)


@query(
    "ingest_partitions",
    f"""WITH {I.FACT} SELECT year, month, count(*) AS rows_stored,
  count(*) FILTER (year < '1998') AS first_batch, CAST(sum(l_quantity) AS BIGINT) AS quantity
FROM fact GROUP BY ALL""",
)
def ingest_partitions(spark, d):
    """Two ingests that overlap: the second skips the partitions that the first has written."""
    path = scratch_dir(spark, "ingest")
    facts = I.fact(spark, d)
    P.ingest_partitions(facts.where("year < '1998'").withColumn("batch", F.lit(1)), path, I.BY)
    P.ingest_partitions(facts.withColumn("batch", F.lit(2)), path, I.BY)
    stored = S.read_fact(spark, path, FACT_SCHEMA + ", batch int")
    return stored.groupBy(*I.BY).agg(
        F.count("*").alias("rows_stored"),
        F.count_if(F.col("batch") == 1).alias("first_batch"),
        F.sum("l_quantity").cast("bigint").alias("quantity"),
    )


@query(
    "overwrite_partitions",
    f"""WITH {I.FACT} SELECT year, month, count(*) AS rows_stored,
  count(*) FILTER (year >= '1999') AS second_batch FROM fact GROUP BY ALL""",
)
def overwrite_partitions(spark, d):
    """An overwriting ingest touches only the partitions it brings."""
    path = scratch_dir(spark, "overwrite")
    facts = I.fact(spark, d)
    P.ingest_partitions(facts.withColumn("batch", F.lit(1)), path, I.BY)
    late = facts.where("year >= '1999'").withColumn("batch", F.lit(2))
    P.ingest_partitions(late, path, I.BY, overwrite=True)
    stored = S.read_fact(spark, path, FACT_SCHEMA + ", batch int")
    return stored.groupBy(*I.BY).agg(
        F.count("*").alias("rows_stored"), F.count_if(F.col("batch") == 2).alias("second_batch")
    )


@query(
    "register_partitions",
    f"WITH {I.FACT} SELECT year, month, count(*) AS n FROM fact GROUP BY ALL",
)
def register_partitions(spark, d):
    """A catalog table over the stored partitions, registered twice, read through the catalog."""
    path = _stored(spark, d, "register")
    name = "assay_" + path.rsplit("-", 1)[1]
    P.create_fact_table(spark, name, FACT_SCHEMA, path, I.BY)
    for _ in range(2):
        P.register_partitions(spark, name, P.existing_partitions(spark, path, I.BY), I.BY)
    return spark.table(name).groupBy(*I.BY).agg(F.count("*").alias("n"))


@query(
    "restore_partitions",
    f"""WITH {I.FACT} SELECT year, month, count(*) AS n, round(sum(l_extendedprice), 2) AS price, 0::BIGINT AS audit_left
FROM fact GROUP BY ALL""",
)
def restore_partitions(spark, d):
    """A corrupted table, overwritten from the clean copy, with its scan history cleared."""
    path, audit = scratch_dir(spark, "dirty"), scratch_dir(spark, "audit")
    P.write_partitions(I.corrupted(spark, d), path, I.BY)
    A.append_audit(spark, I.scans(spark, d), audit, ["evaluation_id"])
    clean = S.read_fact(spark, _stored(spark, d, "clean"), FACT_SCHEMA)
    P.restore_partitions(spark, clean, path, I.BY, clear=[audit])
    left = spark.read.schema("audit_id string, ds string").parquet(audit).agg(F.count("*").alias("n"))
    return (
        S.read_fact(spark, path, FACT_SCHEMA)
        .groupBy(*I.BY)
        .agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))
        .withColumn("audit_left", left.scalar())
    )


# --- evaluation records ----------------------------------------------------------------------

def _record(spark, d):
    """A raw result record per event, as JSON text, in all the shapes a reader has to take.

    user % 5: 0 no id, 1 `resultId`, else `resultID`. user % 4: 0 no source (context names the
    table), 1 no predicate. The results: a FAIL without description, a `fail` with null metric
    and empty message, an ERROR, a PASS.
    """
    user, event = F.col("user_id"), F.format_string("ev-%08d", "event_id")
    id_name = F.when(user % 5 == 1, "resultId").otherwise("resultID")
    id_part = F.when(user % 5 == 0, "").otherwise(F.concat(F.lit('"'), id_name, F.lit('":"'), event, F.lit('",')))
    detail = F.concat(
        F.lit('"detail":{'), id_part,
        F.lit('"state":"SUCCEEDED","context":{"databaseName":"ctx","tableName":"ctx_'), F.col("event_type"),
        F.lit('"}}'),
    )
    predicate = F.when(user % 4 == 1, "").otherwise(
        F.concat(F.lit(',"AdditionalOptions":{"pushDownPredicate":"user=\''), user.cast("string"), F.lit("'\"}"))
    )
    source = F.when(user % 4 == 0, "").otherwise(
        F.concat(
            F.lit(',"DataSource":{"CatalogTable":{"DatabaseName":"lake","TableName":"'), F.col("event_type"),
            F.lit('"'), predicate, F.lit("}}"),
        )
    )
    results = F.concat(
        F.lit(',"RuleResults":[{"Name":"r1","Result":"FAIL","EvaluatedMetrics":{"a":'),
        F.col("value").cast("string"),
        F.lit('}},{"Name":"r2","Description":"Completeness \\"'), F.col("event_type"),
        F.lit('\\" > 0.9","Result":"fail","EvaluatedMetrics":{"b":null},"EvaluationMessage":""},'
              '{"Name":"r3","Description":"d3","Result":"ERROR","EvaluationMessage":"broken"},'
              '{"Name":"r4","Description":"d4","Result":"PASS","EvaluationMessage":"fine"}]'),
    )
    return I.table(spark, d, "events").select(
        "event_id", F.concat(F.lit("{"), detail, source, results, F.lit("}")).alias("value")
    )


_RECORDS_SQL = """records AS (SELECT *, CASE WHEN user_id % 5 <> 0 THEN 'ev-' || lpad(event_id::VARCHAR, 8, '0') END
    AS evaluation_id, CASE WHEN user_id % 4 = 0 THEN 'ctx' ELSE 'lake' END AS database,
    CASE WHEN user_id % 4 = 0 THEN 'ctx_' || event_type ELSE event_type END AS table_name,
    CASE WHEN user_id % 4 IN (0, 1) THEN '' ELSE 'user=' || user_id END AS "partition" FROM events)"""


@query(
    "read_results",
    f"""WITH {_RECORDS_SQL} SELECT evaluation_id, database, table_name, "partition", 'SUCCEEDED' AS run_state,
  'FAILED' AS overall_state, CASE WHEN evaluation_id IS NULL THEN 'no result id' END AS error,
  4::BIGINT AS results, 2::BIGINT AS failed FROM records""",
)
def read_results(spark, d):
    out = E.read_results(_record(spark, d))
    failed = F.filter("rule_results", lambda r: r["state"] == "FAILED")
    return out.withColumns(
        {"results": F.size("rule_results").cast("bigint"), "failed": F.size(failed).cast("bigint")}
    ).drop("rule_results")


def _results(spark, d):
    out = E.read_results(_record(spark, d)).where(F.col("error").isNull())
    return out.select("evaluation_id", F.inline("rule_results"))


@query(
    "normalize_results",
    f"""WITH {_RECORDS_SQL}, r AS (SELECT * FROM records WHERE evaluation_id IS NOT NULL)
SELECT evaluation_id, 'r1' AS rule, 'FAILED' AS state, '' AS description, 'a' AS metric, value FROM r
UNION ALL SELECT evaluation_id, 'Completeness "' || event_type || '" > 0.9', 'FAILED',
  'Completeness "' || event_type || '" > 0.9', 'b', 0 FROM r
UNION ALL SELECT evaluation_id, 'd3', 'ERROR', 'broken', NULL, NULL FROM r
UNION ALL SELECT evaluation_id, 'd4', 'PASS', 'fine', NULL, NULL FROM r""",
)
def normalize_results(spark, d):
    return _results(spark, d).select(
        "evaluation_id", "rule", "state", "description",
        F.explode_outer("evaluated_metrics").alias("metric", "value"),
    )


@query(
    "failed_results",
    f"""WITH {_RECORDS_SQL}, r AS (SELECT * FROM records WHERE evaluation_id IS NOT NULL)
SELECT evaluation_id, 'r1' AS rule FROM r
UNION ALL SELECT evaluation_id, 'Completeness "' || event_type || '" > 0.9' FROM r""",
)
def failed_results(spark, d):
    return V.failed_results(_results(spark, d)).select("evaluation_id", "rule")


@query(
    "failed_evaluations",
    f"""WITH {I.FACT}, {I.NULLED}, m AS (SELECT year, month, count(*) AS row_count,
    count(l_quantity)::DOUBLE / count(*) AS q FROM nulled GROUP BY ALL)
SELECT {I.PARTITION} AS "partition", row_count FROM m WHERE q < 0.98::DOUBLE""",
)
def failed_evaluations(spark, d):
    """Months whose only rule failed; months without a failure stop here."""
    rules = [r for r in I.RULES if r.column == "l_quantity" and r.rule_type == "Completeness"]
    past = inject_nulls(I.fact(spark, d), I.CONFIG["null_injection"], I.KEY, generator=I.GENERATOR)
    found = stored(evaluate(past, rules, I.BY, I.TABLE), scratch_dir(spark, "evaluations"))
    return V.failed_evaluations(found, rule_results(found)).select("partition", "row_count")


@query(
    "route_events",
    """SELECT event_id, user_id FROM events WHERE event_type = 'error' AND user_id % 3 = 1""",
)
def route_events(spark, d):
    events = I.table(spark, d, "events").select(
        "event_id", "user_id", F.col("event_type").alias("source"),
        F.concat(F.lit("detail "), (F.col("user_id") % 3).cast("string")).alias("detail_type"),
    )
    return V.route_events(events, "error", "detail 1").select("event_id", "user_id")


@query(
    "coerce_cells",
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN l_partkey::VARCHAR
    WHEN 3 THEN l_partkey || '.5' WHEN 4 THEN 'k' || l_partkey WHEN 5 THEN l_partkey || 'e2'
    WHEN 6 THEN '-' || l_partkey || '.25e1' ELSE l_partkey || '.5d' END AS cell FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN l_linenumber = 1 THEN 'null' WHEN l_linenumber = 2 THEN 'long' WHEN l_linenumber IN (3, 6) THEN 'double'
    ELSE 'text' END AS kind,
  CASE WHEN l_linenumber IN (3, 6) THEN cell::DOUBLE END AS as_double,
  CASE WHEN l_linenumber = 2 THEN l_partkey END AS as_long,
  CASE WHEN l_linenumber IN (4, 5, 7) THEN cell END AS as_text FROM c""",
)
def coerce_cells(spark, d):
    part, n = F.col("l_partkey").cast("string"), F.col("l_linenumber")
    cell = (
        F.when(n == 1, "")
        .when(n == 2, part)
        .when(n == 3, F.concat(part, F.lit(".5")))
        .when(n == 4, F.concat(F.lit("k"), part))
        .when(n == 5, F.concat(part, F.lit("e2")))
        .when(n == 6, F.concat(F.lit("-"), part, F.lit(".25e1")))
        .otherwise(F.concat(part, F.lit(".5d")))
    )
    t = I.table(spark, d, "lineitem")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", X.coerce_cell(cell).alias("c")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "c.*"
    )


# --- quarantine --------------------------------------------------------------------------------

_PRICE = "l_extendedprice < 0 OR l_extendedprice > 500000"
_QTY = "l_quantity > 100"
_FLAG = "l_returnflag NOT IN ('A', 'N', 'R')"
REQUESTS = [
    Q.Request("lineitem", "year=1998/month=03", _PRICE, "issue-price"),
    Q.Request("lineitem", "year=1998/month=03", _QTY, "issue-qty"),
    Q.Request("lineitem", "year=1999", _FLAG, "issue-flag"),
    Q.Request("lineitem", "year=1997/month=01", "l_quantity > 1000000", "issue-none"),
]
_MARCH = "year = '1998' AND month = '03'"
_ROUND = ["l_tax", "l_quantity", "l_extendedprice", "l_discount"]
_ROW_SQL = (
    "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus, l_shipdate, "
    + ", ".join(f"round({c}, 4) AS {c}" for c in _ROUND)
)


def _round(df):
    return df.withColumns({c: F.round(c, 4) for c in _ROUND})


@query("bad_rows", f"WITH {I.CORRUPT} SELECT {_ROW_SQL}, year, month FROM dirty WHERE {_MARCH} AND ({_PRICE})")
def bad_rows(spark, d):
    return _round(Q.bad_rows(I.corrupted(spark, d), REQUESTS[0]))


@query(
    "clean_rows",
    f"""WITH {I.CORRUPT} SELECT {_ROW_SQL}, year, month FROM dirty
WHERE {_MARCH} AND NOT coalesce({_PRICE}, false)""",
)
def clean_rows(spark, d):
    """The complement; rows whose price is null stay."""
    return _round(Q.clean_rows(I.corrupted(spark, d), REQUESTS[0]))


_ALL = [
    ("issue-price", _MARCH, _PRICE, "year=1998/month=03"),
    ("issue-qty", _MARCH, _QTY, "year=1998/month=03"),
    ("issue-flag", "year = '1999'", _FLAG, "year=1999"),
    ("issue-none", "year = '1997' AND month = '01'", "l_quantity > 1000000", "year=1997/month=01"),
]


@query(
    "tag_issues",
    f"""WITH {I.CORRUPT}, t AS (SELECT *, concat_ws(',', {', '.join(
        f"CASE WHEN {scope} AND ({cond}) THEN '{i}' END" for i, scope, cond, _ in _ALL)}) AS issue_ids FROM dirty)
SELECT {_ROW_SQL}, year, month, issue_ids FROM t WHERE issue_ids <> ''""",
)
def tag_issues(spark, d):
    out = Q.tag_issues(I.corrupted(spark, d), REQUESTS)
    return _round(out).withColumn("issue_ids", F.array_join("issue_ids", ","))


_COUNTS_SQL = "counts AS (" + " UNION ALL ".join(
    "SELECT '{}' AS issue_id, 'lineitem' AS table_name, '{}' AS \"partition\", '{}' AS filter_condition, "
    "count(*) FILTER ({}) AS bad_count, count(*) AS total_count, count(*) - count(*) FILTER ({}) AS remaining_count "
    "FROM dirty WHERE {}".format(i, spec, cond.replace("'", "''"), cond, cond, scope)
    for i, scope, cond, spec in _ALL
) + ")"


@query("quarantine_counts", f"WITH {I.CORRUPT}, {_COUNTS_SQL} SELECT * FROM counts")
def quarantine_counts(spark, d):
    return Q.quarantine_counts(I.corrupted(spark, d), REQUESTS)


def _zone(spark, d):
    path = scratch_dir(spark, "quarantine")
    when = F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")
    for _ in range(2):  # a repeated request leaves one copy
        Q.write_quarantine(I.corrupted(spark, d), REQUESTS, path, I.BY, when)
    return path


_ZONE_SQL = " UNION ALL ".join(
    f"SELECT {_ROW_SQL}, year, month, '{i}' AS issue_id, 'lineitem' AS table_name, "
    f"TIMESTAMP '2024-01-31 12:00:00' AS written_at FROM dirty WHERE {scope} AND ({cond})"
    for i, scope, cond, _ in _ALL
)


@query("quarantine_write", f"WITH {I.CORRUPT} {_ZONE_SQL}")
def quarantine_write(spark, d):
    return _round(Q.read_quarantine(spark, _zone(spark, d), I.BY)).drop("run_id", "written_on")


@query("quarantine_rows", f"WITH {I.CORRUPT} SELECT {_ROW_SQL}, year, month FROM dirty WHERE year = '1999' AND ({_FLAG})")
def quarantine_rows(spark, d):
    """One request from scan to zone: what was isolated, read from the issue's own folder."""
    path = scratch_dir(spark, "quarantine")
    when = F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")
    Q.write_quarantine(I.corrupted(spark, d), REQUESTS[2:3], path, I.BY, when)
    zone = Q.read_quarantine(spark, path, I.BY).where(F.col("issue_id") == "issue-flag")
    return _round(zone).drop("table_name", "issue_id", "run_id", "written_on", "written_at")


_KEYS_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(
    "quarantine_runs",
    f"""WITH {I.FACT} SELECT {_KEYS_SQL}, 'two: 50%' AS issue_id, 'a' AS run FROM fact WHERE {_MARCH} AND l_quantity > 40
UNION ALL SELECT {_KEYS_SQL}, 'two: 50%', 'b' FROM fact WHERE {_MARCH} AND l_tax < 0.02""",
)
def quarantine_runs(spark, d):
    """Two requests under one issue id, in two calls, beside one that at first matches and then does not."""
    path = scratch_dir(spark, "quarantine")
    when = F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")
    fact, scope = I.fact(spark, d), "year=1998/month=03"
    a = Q.Request("lineitem", scope, "l_quantity > 40", "two: 50%")
    b = Q.Request("lineitem", scope, "l_tax < 0.02", "two: 50%")
    gone = Q.Request("lineitem", scope, "l_discount > 0.05", "two: 50%")
    Q.write_quarantine(fact, [a, gone], path, I.BY, when)
    Q.write_quarantine(fact, [b], path, I.BY, when)
    Q.write_quarantine(fact.where("l_discount <= 0.05"), [gone], path, I.BY, when)
    zone = Q.read_quarantine(spark, path, I.BY)
    names = F.when(F.col("run_id") == Q.run_id(F.lit(a.filter_condition)), "a").otherwise("b")
    return zone.select(*_KEYS_SQL.split(", "), "issue_id", names.alias("run"))


_FOUR = ["l_quantity > 45", "l_tax < 0.01", "l_discount > 0.09", "l_extendedprice > 90000"]


def _monthly_requests(spark, d):
    """A request per month and predicate: several hundred."""
    months = I.fact(spark, d).select("year", "month").distinct()
    conditions = F.array(*map(F.lit, _FOUR))
    spec = F.concat(F.lit("year="), "year", F.lit("/month="), "month")
    rows = months.select(spec.alias("partition"), F.posexplode(conditions).alias("n", "filter_condition"))
    return rows.select(
        F.concat_ws("#", "partition", "n").alias("issue_id"), F.lit("lineitem").alias("table_name"), "partition", "filter_condition"
    )


_MONTHLY = f"""m AS (SELECT 'year=' || year || '/month=' || month AS "partition", * FROM fact),
asked AS (SELECT * FROM (VALUES {", ".join(f"({n}, '{c}')" for n, c in enumerate(_FOUR))}) AS v(n, filter_condition)),
hit AS ({" UNION ALL ".join(f"SELECT {n} AS n, * FROM m WHERE {c}" for n, c in enumerate(_FOUR))})"""


@query(
    "quarantine_counts_many",
    f"""WITH {I.FACT}, {_MONTHLY}, totals AS (SELECT "partition", count(*) AS total_count FROM m GROUP BY ALL),
bad AS (SELECT "partition", n, count(*) AS bad_count FROM hit GROUP BY ALL)
SELECT t."partition" || '#' || a.n AS issue_id, 'lineitem' AS table_name, t."partition", filter_condition,
  coalesce(bad_count, 0) AS bad_count, total_count, total_count - coalesce(bad_count, 0) AS remaining_count
FROM totals t CROSS JOIN asked a LEFT JOIN bad b ON b."partition" = t."partition" AND b.n = a.n""",
)
def quarantine_counts_many(spark, d):
    return Q.quarantine_counts(I.fact(spark, d), _monthly_requests(spark, d))


@query(
    "quarantine_write_many",
    f"""WITH {I.FACT}, {_MONTHLY} SELECT {_KEYS_SQL}, "partition" || '#' || n AS issue_id FROM hit""",
)
def quarantine_write_many(spark, d):
    """Several hundred requests, given as a table, in one call."""
    path = scratch_dir(spark, "quarantine")
    requests = _monthly_requests(spark, d)
    when = F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")
    Q.write_quarantine(I.fact(spark, d), requests, path, I.BY, when)
    return Q.read_quarantine(spark, path, I.BY).select(*_KEYS_SQL.split(", "), "issue_id")


@query(
    "expire_escaped",
    f"""WITH {I.FACT} SELECT {_KEYS_SQL}, 'new:1%' AS issue_id FROM fact WHERE {_MARCH} AND l_quantity > 40
UNION ALL SELECT {_KEYS_SQL}, 'mixed=a b/c' FROM fact WHERE {_MARCH} AND l_tax < 0.02 AND l_linenumber % 2 = 0""",
)
def expire_escaped(spark, d):
    """Issue ids that folder names have to escape; old, new and partly expired copies."""
    path = scratch_dir(spark, "expire")
    fact, scope = I.fact(spark, d), "year=1998/month=03"
    requests = {
        "old:1%": ("l_discount > 0.05", F.lit("2023-06-01 08:00:00")),
        "new:1%": ("l_quantity > 40", F.lit("2024-01-31 12:00:00")),
        # Written on the day of the cutoff, before and after its time.
        "mixed=a b/c": ("l_tax < 0.02", F.when(F.col("l_linenumber") % 2 == 0, "2024-01-15 13:00:00").otherwise("2024-01-15 11:00:00")),
    }
    for issue, (condition, when) in requests.items():
        Q.write_quarantine(fact, [Q.Request("lineitem", scope, condition, issue)], path, I.BY, when.cast("timestamp_ntz"))
    T.expire_quarantine(spark, path, Q.zone_keys(I.BY), F.lit("2024-04-14 12:00:00").cast("timestamp"))
    return Q.read_quarantine(spark, path, I.BY).select(*_KEYS_SQL.split(", "), "issue_id")


# The audit scans of the quarantined partitions: events of one user stand for each partition.
_SCANS_SQL = """stored AS (SELECT 'ev-' || lpad(event_id::VARCHAR, 8, '0') AS evaluation_id, 'lineitem' AS table_name,
    CASE user_id % 3 WHEN 0 THEN 'year=1998/month=03' WHEN 1 THEN 'year=1999' ELSE 'other' END AS "partition", ts,
    (CAST(floor(value) AS BIGINT) % 11) * 10 AS overall_score FROM events),
last AS (SELECT "partition", arg_max(overall_score, (ts, evaluation_id))::DOUBLE AS before_score FROM stored GROUP BY ALL)"""


def _stored_scans(spark, d):
    kind = F.regexp_extract("partition", r"(\d+)", 1).cast("int") % 3
    return I.scans(spark, d).select(
        "evaluation_id", F.lit("lineitem").alias("table_name"),
        F.when(kind == 0, "year=1998/month=03").when(kind == 1, "year=1999").otherwise("other").alias("partition"),
        "ts", "overall_score", "overall_status", "violation_count",
    )


_AFTER = "least(100.0::DOUBLE, round(before_score + bad_count::DOUBLE / greatest(total_count, 1) * 50, 1))"
_SCORED_SQL = f"""scored AS (SELECT counts.*, coalesce(before_score, 0.0::DOUBLE) AS before_score
  FROM counts LEFT JOIN last ON last."partition" = counts."partition" WHERE bad_count > 0),
done AS (SELECT *, {_AFTER} AS after_score,
  'zone/table_name=lineitem/' || "partition" || '/issue_id=' || issue_id AS quarantine_path FROM scored)"""


def _remediations(spark, d):
    counts = Q.quarantine_counts(I.corrupted(spark, d), REQUESTS)
    when = F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")
    return Q.remediation_rows(counts, _stored_scans(spark, d), when, "zone")


@query(
    "after_score",
    f"""WITH {I.SCANS} SELECT evaluation_id, least(100.0::DOUBLE, round(overall_score + violation_count::DOUBLE
  / greatest(violation_count * 3, 1) * 50, 1)) AS after_score FROM scans""",
)
def after_score(spark, d):
    bad = F.col("violation_count")
    return I.scans(spark, d).select(
        "evaluation_id", Q.after_score(F.col("overall_score"), bad, bad * 3).alias("after_score")
    )


@query(
    "remediation_rows",
    f"""WITH {I.CORRUPT}, {_COUNTS_SQL}, {_SCANS_SQL}, {_SCORED_SQL}
SELECT issue_id, table_name, "partition", TIMESTAMP '2024-01-31 12:00:00' AS ts, 'quarantine' AS action_type,
  bad_count AS records_affected, total_count, before_score, after_score, filter_condition, quarantine_path FROM done""",
)
def remediation_rows(spark, d):
    return _remediations(spark, d)


@query(
    "remediation_decisions",
    f"""WITH {I.CORRUPT}, {_COUNTS_SQL}, {_SCANS_SQL}, {_SCORED_SQL},
t AS (SELECT *, 'Score: ' || before_score || ' → ' || after_score AS s, format('{{:,}}', bad_count) AS b,
  format('{{:,}}', total_count) AS n FROM done)
SELECT issue_id, 'remediation_executed' AS decision_type, 'Quarantined ' || b || ' records matching: '
  || filter_condition || '. ' || s || '.' AS reasoning,
  'quarantine_records (' || b || ' of ' || n || ' records isolated)' AS action_taken,
  s || '. Quarantined to ' || quarantine_path AS outcome FROM t""",
)
def remediation_decisions(spark, d):
    out = Q.remediation_decisions(_remediations(spark, d))
    return out.select(
        F.try_element_at("context", F.lit("issue_id")).alias("issue_id"), "decision_type", "reasoning",
        "action_taken", "outcome",
    )


@query(
    "recover_issue",
    f"""WITH {I.CORRUPT} SELECT {_ROW_SQL}, '{_QTY}' AS filter_condition,
  (SELECT count(*) FROM dirty WHERE {_MARCH} AND ({_QTY})) AS records_affected
FROM dirty WHERE {_MARCH} AND ({_QTY})""",
)
def recover_issue(spark, d):
    zone = Q.read_quarantine(spark, _zone(spark, d), I.BY)
    found = _round(Q.recover_issue(zone, _remediations(spark, d), "issue-qty"))
    return found.drop("issue_id", "table_name", "year", "month", "run_id", "written_on", "written_at")


@query(
    "isolation_metrics",
    f"""WITH {I.CORRUPT}, {_COUNTS_SQL}, {_SCANS_SQL}, {_SCORED_SQL}
SELECT 'RemediationActions' AS name, 1.0::DOUBLE AS value, 'Count' AS unit, TIMESTAMP '2024-01-31 12:00:00' AS ts FROM done
UNION ALL SELECT 'RecordsQuarantined', bad_count, 'Count', TIMESTAMP '2024-01-31 12:00:00' FROM done
UNION ALL SELECT 'DecisionCount', 1, 'Count', TIMESTAMP '2024-01-31 12:00:00' FROM done""",
)
def isolation_metrics(spark, d):
    """All requests from scan to zone, remediation rows, decisions and metric points."""
    path = scratch_dir(spark, "quarantine")
    when = F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")
    done = isolate(I.corrupted(spark, d), REQUESTS, _stored_scans(spark, d), path, I.BY, when)
    return done.metrics.drop("dimensions")


@query(
    "quarantine_requests",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '2024-01' WHEN 2 THEN 'user=' || user_id
    ELSE 'x/user=' || user_id END AS "partition", 'value > ' || user_id AS filter_condition,
  CASE event_id % 4 WHEN 0 THEN 'invalid partition spec '''', expected key=value/key=value'
    WHEN 1 THEN 'invalid partition spec ''2024-01'', expected key=value/key=value' END AS error FROM events""",
)
def quarantine_requests(spark, d):
    user, kind = F.col("user_id").cast("string"), F.col("event_id") % 4
    spec = (
        F.when(kind == 0, "").when(kind == 1, "2024-01").when(kind == 2, F.concat(F.lit("user="), user))
        .otherwise(F.concat(F.lit("x/user="), user))
    )
    return Q.check_requests(
        I.table(spark, d, "events").select(
            "event_id", spec.alias("partition"),
            F.concat(F.lit("  value > "), user, F.lit(" ")).alias("filter_condition"),
        )
    )


@query(
    "expire_quarantine",
    """SELECT event_id, user_id, strftime(ts, '%Y') AS year, event_type AS issue_id, ts AS written_at FROM events
WHERE ts >= TIMESTAMP '2024-04-14 12:00:00' - INTERVAL 90 DAY AND NOT (event_type = 'signup' AND user_id % 2 = 0)
UNION ALL SELECT event_id, user_id, strftime(ts, '%Y'), event_type || '_new', TIMESTAMP '2024-04-01' FROM events
WHERE event_type = 'signup' AND user_id % 2 = 0""",
)
def expire_quarantine(spark, d):
    """A zone with wholly expired, partly expired and live folders; the live rows are left."""
    path = scratch_dir(spark, "expire")
    events = I.table(spark, d, "events")
    even = (F.col("event_type") == "signup") & (F.col("user_id") % 2 == 0)
    old = F.when(even, F.lit("2023-12-01").cast("timestamp_ntz")).otherwise(F.col("ts"))
    rows = events.select(
        "event_id", "user_id", F.year("ts").cast("string").alias("year"),
        F.when(even, "signup_old").otherwise(F.col("event_type")).alias("issue_id"), old.alias("written_at"),
    )
    new = events.where(even).select(
        "event_id", "user_id", F.year("ts").cast("string").alias("year"),
        F.concat("event_type", F.lit("_new")).alias("issue_id"),
        F.lit("2024-04-01").cast("timestamp_ntz").alias("written_at"),
    )
    P.write_partitions(rows.unionByName(new), path, ["year", "issue_id"])
    T.expire_quarantine(spark, path, ["year", "issue_id"], F.lit("2024-04-14 12:00:00").cast("timestamp"))
    schema = "event_id bigint, user_id bigint, written_at timestamp_ntz, year string, issue_id string"
    return spark.read.schema(schema).parquet(path)


@query(
    "audit_append",
    """SELECT 'ev-' || lpad(event_id::VARCHAR, 8, '0') AS evaluation_id, 't_' || event_type AS table_name, ts,
  CAST(floor(epoch(ts)) AS BIGINT) + 90 * 86400 AS ttl, strftime(ts, '%Y-%m-%d') AS ds FROM events""",
)
def audit_append(spark, d):
    """A third of the rows, then all of them twice: every row is stored once."""
    path = scratch_dir(spark, "audit")
    rows = I.scans(spark, d)
    early = rows.where(F.col("ts") < F.lit("2024-01-11").cast("timestamp_ntz"))
    for batch in (early, rows, rows):
        A.append_audit(spark, batch, path, ["evaluation_id"])
    return spark.read.parquet(path).select("evaluation_id", "table_name", "ts", "ttl", "ds")


@query(
    "audit_append_indexed",
    """SELECT 'ev-' || lpad(event_id::VARCHAR, 8, '0') AS evaluation_id, 't_' || event_type AS table_name, ts,
  CAST(floor(epoch(ts)) AS BIGINT) + 90 * 86400 AS ttl, strftime(ts, '%Y-%m-%d') AS ds FROM events""",
)
def audit_append_indexed(spark, d):
    """Six overlapping batches, replays among them, merged to three runs at most on the way."""
    path = scratch_dir(spark, "audit-indexed")
    rows = I.scans(spark, d)
    part = F.pmod(F.xxhash64("evaluation_id"), F.lit(5))
    for batch in (rows.where(part < 2), rows.where(part == 3), rows.where(part.isin(1, 3)), rows.where(part == 2), rows, rows):
        J.append_indexed(spark, batch, path, ["evaluation_id"], max_runs=3)
    return J.read_indexed(spark, path).select("evaluation_id", "table_name", "ts", "ttl", "ds")


@query(
    "stored_history",
    f"""WITH {I.SUMMARY_SQL} SELECT "partition", CAST(overall_score AS BIGINT) AS overall_score, violation_count,
  1::BIGINT AS recency FROM summary""",
)
def stored_history(spark, d):
    """Scan results of every month, stored and then read as each partition's newest scan."""
    path = scratch_dir(spark, "scans")
    found = V.scan_results(I.evaluations(spark, d)).withColumn(
        "ts", F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")
    )
    A.append_audit(spark, found, path, ["evaluation_id", "ts"])
    newest = H.newest_per_key(spark.read.parquet(path), 1)
    return newest.select(
        "partition", "overall_score", "violation_count", F.col("recency").cast("bigint").alias("recency")
    )


@query(
    "restore_swapped",
    f"""WITH {I.FACT} SELECT year, month, count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM fact GROUP BY year, month""",
)
def restore_swapped(spark, d):
    """A table of corrupted months, restored from the clean ones by moving its partitions in the catalog."""
    path, log = scratch_dir(spark, "swapped"), scratch_dir(spark, "swaps")
    table = "swapped_" + path.rsplit("-", 1)[1]
    clean = I.fact(spark, d)
    dirty = inject_nulls(clean.where("l_linenumber < 3"), I.CONFIG["null_injection"], I.KEY, generator=I.GENERATOR)
    P.write_partitions(dirty, path, I.BY)
    P.create_fact_table(spark, table, I.LINEITEM_SCHEMA + ", year string, month string", path, I.BY)
    P.register_partitions(spark, table, P.existing_partitions(spark, path, I.BY), I.BY)
    whole = stored(clean.repartition(*I.BY), scratch_dir(spark, "clean"))
    W.restore_swapped(spark, table, whole, f"{path}-staging", log, I.BY)
    return spark.table(table).groupBy(*I.BY).agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))
