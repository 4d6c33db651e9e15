"""Metric rows, statistics per period and alarms."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

# Metric names and units.
SCORE, ANOMALIES, ACTIONS = "OverallQualityScore", "AnomaliesDetected", "RemediationActions"
QUARANTINED, DECISIONS, DIMENSION_SCORE = "RecordsQuarantined", "DecisionCount", "QualityScore"
TOKEN_COST, TOOL_TIME = "AgentTokenCost", "ToolCallDuration"
PERIOD_SECONDS = 300
HOURS = 24


@dataclass(frozen=True)
class Alarm:
    name: str
    metric: str
    statistic: str
    threshold: float
    comparison: str
    dimensions: dict = field(default_factory=dict)
    period: int = PERIOD_SECONDS


def default_alarms(table: str, prefix: str = "quality-") -> list[Alarm]:
    # Statistics and thresholds.
    return [
        Alarm(f"{prefix}LowQualityScore", SCORE, "Minimum", 50.0, "<", {"TableName": table}),
        Alarm(f"{prefix}HighAnomalyCount", ANOMALIES, "Sum", 10.0, ">",
              {"TableName": table, "Severity": "CRITICAL"}),
        Alarm(f"{prefix}HighTokenCost", TOKEN_COST, "Sum", 1.0, ">"),
    ]


def alarm_table(spark: SparkSession, alarms: Sequence[Alarm]) -> DataFrame:
    rows = [(a.name, a.metric, a.dimensions, a.period, a.statistic, a.threshold, a.comparison) for a in alarms]
    return spark.createDataFrame(
        rows,
        "alarm string, metric string, alarm_dimensions map<string,string>, period int, "
        "statistic string, threshold double, comparison string",
    )


def _metric(rows: DataFrame, name: str, value, unit: str, ts: str = "ts", **dimensions: Column) -> DataFrame:
    pairs = [c for k, v in dimensions.items() for c in (F.lit(k), v.cast("string"))]
    return rows.select(
        F.col(ts).alias("ts"),
        F.lit(name).alias("name"),
        value.cast("double").alias("value"),
        F.lit(unit).alias("unit"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("dimensions"),
    )


def scan_metrics(scans: DataFrame) -> DataFrame:
    """Overall score of each scan, and its anomaly count if it has any.

    The severity of the anomalies is the scan's status, so a failing scan whose status is OK
    does not reach an alarm on CRITICAL. One pass: a scan explodes into its one or two points.
    """
    table = F.col("table_name")
    points = F.array_compact(
        F.array(
            F.struct(
                F.lit(SCORE).alias("name"), F.col("overall_score").cast("double").alias("value"),
                F.lit("Percent").alias("unit"), F.create_map(F.lit("TableName"), table).alias("dimensions"),
            ),
            F.when(
                F.col("violation_count") > 0,
                F.struct(
                    F.lit(ANOMALIES).alias("name"), F.col("violation_count").cast("double").alias("value"),
                    F.lit("Count").alias("unit"),
                    F.create_map(
                        F.lit("TableName"), table, F.lit("Severity"), F.col("overall_status")
                    ).alias("dimensions"),
                ),
            ),
        )
    )
    return scans.select("ts", F.inline(points))


def remediation_metrics(remediations: DataFrame) -> DataFrame:
    """Two points of each remediation, from one pass."""
    table = F.col("table_name")

    def point(name: str, value: Column, **dimensions: Column) -> Column:
        pairs = [x for k, v in dimensions.items() for x in (F.lit(k), v)]
        return F.struct(
            F.lit(name).alias("name"), value.cast("double").alias("value"), F.lit("Count").alias("unit"),
            F.create_map(*pairs).alias("dimensions"),
        )

    points = F.array(
        point(ACTIONS, F.lit(1), TableName=table, ActionType=F.col("action_type")),
        point(QUARANTINED, F.col("records_affected"), TableName=table),
    )
    return remediations.select("ts", F.inline(points))


def decision_metrics(decisions: DataFrame) -> DataFrame:
    return _metric(decisions, DECISIONS, F.lit(1), "Count", DecisionType=F.col("decision_type"))


def dimension_metrics(scores: DataFrame) -> DataFrame:
    """Score per check type, from `dimension_scores` rows with ts and table_name."""
    return _metric(
        scores, DIMENSION_SCORE, F.col("score"), "Percent", TableName=F.col("table_name"), CheckType=F.col("type")
    )


def metric_rows(scans: DataFrame, remediations: DataFrame, decisions: DataFrame) -> DataFrame:
    return (
        scan_metrics(scans)
        .unionByName(remediation_metrics(remediations))
        .unionByName(decision_metrics(decisions))
    )


def period_start(ts: Column, seconds: Column) -> Column:
    """Start of the period a time falls into; the length may differ from row to row."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds) * seconds)


def metric_stats(
    metrics: DataFrame,
    end: Column,
    hours: int = HOURS,
    period: int = PERIOD_SECONDS,
    by: Sequence[str] = ("name",),
) -> DataFrame:
    """All statistics per series and period over the hours before `end`."""
    ts = F.col("ts")
    recent = (ts >= end - F.expr(f"interval {hours} hours")) & (ts < end)
    return (
        metrics.where(recent)
        .groupBy(*by, F.window("ts", f"{period} seconds").alias("w"))
        .agg(
            F.avg("value").alias("average"),
            F.min("value").alias("minimum"),
            F.max("value").alias("maximum"),
            F.sum("value").alias("total"),
            F.count("value").alias("sample_count"),
        )
        .withColumn("period_start", F.col("w.start"))
        .drop("w")
    )


def matches(alarm_dimensions: Column, dimensions: Column) -> Column:
    """Are the alarm's dimensions among the metric's? An alarm without any matches all."""
    return F.forall(
        F.map_entries(alarm_dimensions),
        lambda e: F.coalesce(F.try_element_at(dimensions, e["key"]) == e["value"], F.lit(False)),
    )


def _breach(value: Column) -> Column:
    line, op = F.col("threshold"), F.col("comparison")
    return F.coalesce(
        F.when(op == "<", value < line)
        .when(op == "<=", value <= line)
        .when(op == ">", value > line)
        .when(op == ">=", value >= line),
        F.lit(False),
    )


ALARM_COLUMNS = ("alarm", "metric", "period", "statistic", "threshold", "comparison")


def alarm_windows(metrics: DataFrame, alarms: DataFrame) -> DataFrame:
    """One row per alarm and period with data: the statistic and whether it breaches.

    An equality on the metric name, with the dimensions compared on matching rows. `alarms` is
    configuration of a few local rows (see `alarm_table`), whose size Spark knows and broadcasts.
    """
    points = alarm_points(metrics, alarms).withColumn("period_start", period_start(F.col("ts"), F.col("period")))
    return alarm_values(points.groupBy(*ALARM_COLUMNS, "period_start"))


def alarm_points(metrics: DataFrame, alarms: DataFrame) -> DataFrame:
    """Metric points beside each alarm that watches them."""
    return metrics.join(alarms, F.col("name") == F.col("metric")).where(
        matches(F.col("alarm_dimensions"), F.col("dimensions"))
    )


def alarm_values(grouped: GroupedData) -> DataFrame:
    """The statistic each alarm asks for and whether it breaches, from points grouped by
    `ALARM_COLUMNS` and `period_start`."""
    return (
        grouped.agg(
            F.avg("value").alias("Average"),
            F.min("value").alias("Minimum"),
            F.max("value").alias("Maximum"),
            F.sum("value").alias("Sum"),
            F.count("value").cast("double").alias("SampleCount"),
        )
        .withColumn("value", _chosen())
        .withColumn("breach", _breach(F.col("value")))
        .select("alarm", "metric", "statistic", "threshold", "period_start", "value", "breach")
    )


def _chosen() -> Column:
    """The column that holds the statistic a row asks for."""
    value = F.lit(None).cast("double")
    for name in ("Average", "Minimum", "Maximum", "Sum", "SampleCount"):
        value = F.when(F.col("statistic") == name, F.col(name)).otherwise(value)
    return value


def alarm_states(metrics: DataFrame, alarms: DataFrame, as_of: Column, prefix: str = "") -> DataFrame:
    """State of every alarm in the last period that ended by `as_of`; `updated` is that end. No data is
    no breach.

    Only alarms whose name has the prefix; it is cut off for display.
    """
    wanted = alarms.where(F.col("alarm").startswith(prefix))
    # Alarms are a few rows of configuration; as a literal, the bound reaches the scan.
    longest = wanted.agg(F.max("period")).first()[0] or 0
    ts = F.col("ts")
    now = F.unix_seconds(as_of.cast("timestamp"))
    recent = metrics.where((ts >= as_of - F.make_dt_interval(secs=F.lit(2.0 * longest))) & (ts < as_of))
    last = (F.floor(now / F.col("period")) - 1) * F.col("period")
    windows = alarm_windows(recent, wanted).select("alarm", "period_start", "value", "breach")
    return (
        wanted.withColumn("period_start", F.timestamp_seconds(last))
        .join(windows, ["alarm", "period_start"], "left")
        .select(
            F.expr(f"substr(alarm, {len(prefix) + 1})").alias("alarm"),
            "metric",
            "threshold",
            "value",
            F.when(F.coalesce("breach", F.lit(False)), "ALARM").otherwise("OK").alias("state"),
            F.timestamp_seconds(F.unix_seconds("period_start") + F.col("period")).alias("updated"),
        )
    )


def metric_series(metrics: DataFrame, period: int = PERIOD_SECONDS) -> DataFrame:
    """Dashboard series per period: score average, anomalies by severity, remediations by type,
    score by check type, number of decisions, average tool time."""
    name, dims = F.col("name"), F.col("dimensions")
    split = (
        F.when(name == ANOMALIES, F.try_element_at(dims, F.lit("Severity")))
        .when(name == ACTIONS, F.try_element_at(dims, F.lit("ActionType")))
        .when(name == DIMENSION_SCORE, F.try_element_at(dims, F.lit("CheckType")))
        .otherwise("")
    )
    averaged = name.isin(SCORE, DIMENSION_SCORE, TOOL_TIME)
    shown = metrics.where(averaged | name.isin(ANOMALIES, ACTIONS, DECISIONS))
    return (
        shown.groupBy(
            "name", F.coalesce(split, F.lit("")).alias("series"), F.window("ts", f"{period} seconds").alias("w")
        )
        .agg(F.avg("value").alias("average"), F.sum("value").alias("total"))
        .select(
            F.col("w.start").alias("period_start"),
            "name",
            "series",
            F.when(averaged, F.col("average")).otherwise(F.col("total")).alias("value"),
        )
    )
