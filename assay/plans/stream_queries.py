"""Queries over streams. Each writes to a fresh folder with a fresh checkpoint, stops when the
input is used up, and returns what it reads back; the SQL is that of the batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.operators import metrics as M
from assay.operators import violations as V
from assay.plans import inputs as I
from assay.plans.registry import query
from assay.plans.response_queries import ALARMS_SQL
from assay.session import scratch_dir
from assay.sources.idindex import append_indexed, read_indexed
from assay.sources import results as R
from assay.streaming import alarms as L
from assay.streaming import arrivals as A
from assay.streaming import events as E

_NOW = "2024-01-30 12:00:00"


def _event_files(spark, d, copies=1):
    """Evaluation events of every month, in files as an event bus would drop them."""
    path = scratch_dir(spark, "events")
    found = I.evaluations(spark, d).select(
        F.lit("quality").alias("source"), F.lit("results available").alias("detail_type"),
        F.lit(_NOW).cast("timestamp").alias("ts"),
        "evaluation_id", "database", "table_name", "partition", "overall_state", "rule_results",
    )
    # A fifth of the bus carries something else.
    noise = found.where(F.col("partition").endswith("1")).withColumn("source", F.lit("other"))
    for _ in range(copies):
        found.unionByName(noise).write.mode("append").parquet(path)
    stream = E.read_stream(spark, path, spark.read.parquet(path).schema)
    return V.route_events(stream, "quality", "results available")


@query(
    "stream_violations",
    f"""WITH {I.VIOLATIONS_SQL} SELECT evaluation_id, "partition", type, severity, col AS "column", rule FROM violations""",
)
def stream_violations(spark, d):
    """Events → routed → violations, appended by foreachBatch."""
    root = scratch_dir(spark, "audit")
    E.run_available(E.violation_stream(_event_files(spark, d), root), scratch_dir(spark, "checkpoint"))
    stored = spark.read.parquet(f"{root}/violations")
    return stored.select(
        "evaluation_id", "partition", "type", "severity", F.array_join("affected_columns", ",").alias("column"), "rule"
    )


@query(
    "stream_scans",
    f"""WITH {I.SUMMARY_SQL} SELECT evaluation_id, "partition", CAST(overall_score AS BIGINT) AS overall_score,
  overall_status, violation_count FROM summary""",
)
def stream_scans(spark, d):
    """Every event sent twice: the audit ids hold the repeats back."""
    root = scratch_dir(spark, "audit")
    events = _event_files(spark, d, copies=2)
    E.run_available(E.violation_stream(events, root), scratch_dir(spark, "checkpoint"))
    return spark.read.parquet(f"{root}/scans").select(
        "evaluation_id", "partition", "overall_score", "overall_status", "violation_count"
    )


# Events as JSON texts, one per row of `events`: every tenth user's are cut off, every tenth user's are
# no objects. A completeness rule always fails, a row count for every third user.
_JSON_SQL = f"""j AS (SELECT *, user_id % 10 IN (0, 1) AS broken, 'ev-' || lpad(event_id::VARCHAR, 8, '0') AS id,
  CASE user_id % 10 WHEN 0 THEN '{{"evaluation_id": "ev-' || lpad(event_id::VARCHAR, 8, '0')
    WHEN 1 THEN '[' || event_id || ']' END AS bad_text,
  100 - CASE WHEN user_id % 2 = 0 THEN 20 ELSE 10 END - CASE WHEN user_id % 3 = 0 THEN 10 ELSE 0 END AS points
  FROM events)
SELECT CASE WHEN broken THEN 'malformed-' || md5(bad_text) ELSE id END AS evaluation_id,
  CASE WHEN NOT broken THEN 't_' || event_type END AS table_name,
  CASE WHEN NOT broken THEN points END::BIGINT AS overall_score,
  CASE WHEN NOT broken THEN {I.STATUS.format('points')} END AS overall_status,
  CASE WHEN NOT broken THEN 1 + (user_id % 3 = 0)::INT END::BIGINT AS violation_count,
  CASE WHEN broken THEN 'not a JSON event' END AS error FROM j"""


def _json_events(spark, d):
    user = F.col("user_id")
    id_ = F.concat(F.lit("ev-"), F.lpad(F.col("event_id").cast("string"), 8, "0"))
    metrics = F.create_map(F.lit("m"), F.when(user % 2 == 0, 0.93).otherwise(0.97))
    results = F.array(
        F.struct(F.lit('Completeness "c"').alias("rule"), F.lit("FAILED").alias("state"), metrics.alias("evaluated_metrics")),
        F.struct(
            F.lit("RowCount > 1").alias("rule"), F.when(user % 3 == 0, "FAILED").otherwise("PASSED").alias("state"),
            F.create_map().cast("map<string,double>").alias("evaluated_metrics"),
        ),
    )
    event = F.struct(
        id_.alias("evaluation_id"), F.concat(F.lit("t_"), "event_type").alias("table"),
        F.concat(F.lit("user="), user.cast("string")).alias("partition"), results.alias("rule_results"),
    )
    cut = F.concat(F.lit('{"evaluation_id": "'), id_)
    other = F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("]"))
    text = F.when(user % 10 == 0, cut).when(user % 10 == 1, other).otherwise(F.to_json(event))
    return I.table(spark, d, "events").select(text.alias("value"))


_JSON_COLUMNS = ["evaluation_id", "table_name", "overall_score", "overall_status", "violation_count", "error"]


def _with_errors(scans, errors):
    scans = scans.select(
        "evaluation_id", "table_name", F.col("overall_score").cast("bigint").alias("overall_score"),
        "overall_status", "violation_count", F.lit(None).cast("string").alias("error"),
    )
    return scans.unionByName(errors.select("evaluation_id", "error"), allowMissingColumns=True).select(*_JSON_COLUMNS)


@query("json_events", f"WITH {_JSON_SQL}")
def json_events(spark, d):
    """JSON events → scan results; malformed events become error rows and are not graded."""
    found = R.read_events(_json_events(spark, d))
    return _with_errors(V.scan_results(R.sound_events(found)), found.where(F.col("error").isNotNull()))


@query("stream_json_events", f"WITH {_JSON_SQL}")
def stream_json_events(spark, d):
    """The same from a stream of text files, some sent twice."""
    path, root = scratch_dir(spark, "json"), scratch_dir(spark, "audit")
    texts = _json_events(spark, d)
    texts.write.text(path)
    texts.where(F.length("value") % 2 == 0).write.mode("append").text(path)
    lines = E.read_stream(spark, path, "value string", source="text")
    events = R.read_events(lines.withColumn("ts", F.lit(_NOW).cast("timestamp")), carry=["ts"])
    E.run_available(E.violation_stream(events, root), scratch_dir(spark, "checkpoint"))
    return _with_errors(spark.read.parquet(f"{root}/scans"), spark.read.parquet(f"{root}/errors"))


def _events_stream(spark, d):
    """The events table, a file or a folder of files, as a stream."""
    batch = I.table(spark, d, "events")
    # A pattern, because a stream's path proper has to be a folder.
    stream = E.read_stream(spark, f"{d}/events.parquet*", batch.schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    """One action per id (user and type), however often and late the id comes back."""
    path = scratch_dir(spark, "actions")
    ids = _events_stream(spark, d).select("user_id", "event_type", "ts")
    E.run_available(E.write_once(ids, path, ["user_id", "event_type"]), scratch_dir(spark, "checkpoint"))
    return spark.read.parquet(path).select("user_id", "event_type")


@query("stream_dedup_indexed", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup_indexed(spark, d):
    """As `stream_dedup`, into a table whose ids are indexed."""
    path = scratch_dir(spark, "actions-indexed")
    ids = _events_stream(spark, d).select("user_id", "event_type", "ts")
    writer = E.write_once(ids, path, ["user_id", "event_type"], append=append_indexed)
    E.run_available(writer, scratch_dir(spark, "checkpoint"))
    return read_indexed(spark, path).select("user_id", "event_type")


@query(
    "stream_alarms",
    f"""WITH {I.METRICS}, w AS ({ALARMS_SQL})
SELECT * FROM w WHERE period_start + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def stream_alarms(spark, d):
    """5-minute windows of three alarms, emitted once the watermark has passed their end."""
    path = scratch_dir(spark, "alarms")
    points = I.metric_points(_events_stream(spark, d))
    windows = E.alarm_stream(points, M.alarm_table(spark, M.default_alarms("lineitem")))
    E.run_available(
        windows.writeStream.format("parquet").option("path", path).outputMode("append"),
        scratch_dir(spark, "checkpoint"),
    )
    out = spark.read.schema(windows.schema).parquet(path)
    return out.withColumns(
        {"period_start": F.col("period_start").cast("timestamp_ntz"), "value": F.round("value", 4)}
    )


@query(
    "stream_metric_windows",
    f"""WITH {I.METRICS}, w AS (SELECT name, time_bucket(INTERVAL 5 MINUTE, ts) AS period_start,
    round(avg(value), 8) AS average, min(value) AS minimum, max(value) AS maximum, round(sum(value), 4) AS total,
    count(*) AS sample_count FROM metrics GROUP BY ALL)
SELECT * FROM w
WHERE period_start + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def stream_metric_windows(spark, d):
    """5-minute windows per metric, emitted once the watermark has passed their end."""
    path = scratch_dir(spark, "windows")
    points = I.metric_points(_events_stream(spark, d))
    windows = E.metric_windows(points)
    E.run_available(
        windows.writeStream.format("parquet").option("path", path).outputMode("append"),
        scratch_dir(spark, "checkpoint"),
    )
    out = spark.read.schema(windows.schema).parquet(path)
    return out.select(
        "name", F.col("period_start").cast("timestamp_ntz").alias("period_start"),
        F.round("average", 8).alias("average"), "minimum", "maximum", F.round("total", 4).alias("total"),
        "sample_count",
    )


# Changes of state: a breach raises an alarm, a period that does not breach or has no data ends it.
_CHANGES = f"""w AS (SELECT *, epoch(period_start)::BIGINT AS start FROM ({ALARMS_SQL})),
horizon AS (SELECT max(ts) - INTERVAL 10 MINUTE AS h FROM events),
closed AS (SELECT *, coalesce(lag(breach) OVER o AND lag(start) OVER o = start - 300, false) AS was,
    coalesce(lead(start) OVER o = start + 300, false) AS goes_on
  FROM w, horizon WHERE period_start + INTERVAL 5 MINUTE <= h WINDOW o AS (PARTITION BY alarm ORDER BY start)),
changes AS (SELECT alarm, 'ALARM' AS state, period_start, value FROM closed WHERE breach AND NOT was
  UNION ALL SELECT alarm, 'OK', period_start, value FROM closed WHERE NOT breach AND was
  UNION ALL SELECT alarm, 'OK', period_start + INTERVAL 5 MINUTE, NULL FROM closed
  WHERE breach AND NOT goes_on AND period_start + INTERVAL 10 MINUTE <= h)
SELECT alarm, state, period_start, period_start + INTERVAL 5 MINUTE AS updated, value FROM changes"""


def _shown(changes):
    zoned = {c: F.col(c).cast("timestamp_ntz") for c in ("period_start", "updated")}
    return changes.withColumns({**zoned, "value": F.round("value", 4)})


@query("alarm_transitions", f"WITH {I.METRICS}, {_CHANGES}")
def alarm_transitions(spark, d):
    """Every change of three alarms, up to the point where a stream of the same points stands at its end."""
    points = I.metrics(spark, d)
    until = I.table(spark, d, "events").agg(F.max("ts").cast("timestamp") - F.expr("interval 10 minutes")).scalar()
    alarms = M.alarm_table(spark, M.default_alarms("lineitem"))
    return _shown(L.alarm_transitions(points, alarms, until))


@query("stream_alarm_transitions", f"WITH {I.METRICS}, {_CHANGES}")
def stream_alarm_transitions(spark, d):
    """The same from the stream: state per alarm, and a timer that ends an alarm that falls silent."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", L.ROCKSDB)
    path = scratch_dir(spark, "transitions")
    points = I.metric_points(_events_stream(spark, d))
    changes = L.transition_stream(points, M.alarm_table(spark, M.default_alarms("lineitem")))
    E.run_available(
        changes.writeStream.format("parquet").option("path", path).outputMode("append"), scratch_dir(spark, "checkpoint")
    )
    return _shown(spark.read.schema(changes.schema).parquet(path))


# Islands of arrivals with less than a quiet time between neighbours.
_SETTLED = """WITH a AS (SELECT event_type AS kind, user_id % 20 AS part, ts,
    coalesce(ts - lag(ts) OVER o > INTERVAL 30 MINUTE, true) AS starts FROM events
  WINDOW o AS (PARTITION BY event_type, user_id % 20 ORDER BY ts)),
n AS (SELECT *, sum(starts::INT) OVER (PARTITION BY kind, part ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM a),
s AS (SELECT kind, part, min(ts) AS first_arrival, max(ts) + INTERVAL 30 MINUTE AS settled_at, count(*) AS files
  FROM n GROUP BY kind, part, island)
SELECT * FROM s WHERE settled_at <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"""


@query("settled_partitions", _SETTLED)
def settled_partitions(spark, d):
    """Events as arrivals of a hundred partitions: every version that has come to rest, once."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", L.ROCKSDB)
    path = scratch_dir(spark, "settled")
    arrivals = _events_stream(spark, d).select(
        F.col("event_type").alias("kind"), (F.col("user_id") % 20).alias("part"), F.col("ts").cast("timestamp").alias("ts")
    )
    versions = A.settled(arrivals, ["kind", "part"])
    E.run_available(
        versions.writeStream.format("parquet").option("path", path).outputMode("append"), scratch_dir(spark, "checkpoint")
    )
    out = spark.read.schema(versions.schema).parquet(path)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_arrival", "settled_at")})
