"""Rule results → violations → scores. Works on evaluations, batch or streaming alike.

An evaluation keeps its rule results in an array, so violations, score and status are array
expressions within its row: nothing here shuffles except the rollup per dimension.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.severity import (
    FAILED_STATES,
    classify_line,
    extract_column,
    is_failed,
    score,
    severity,
    status,
    type_of_rule,
)


def route_events(events: DataFrame, source: str, detail_type: str) -> DataFrame:
    """Evaluation events of one source and detail type, whatever the state of their run."""
    return events.where((F.col("source") == source) & (F.col("detail_type") == detail_type))


def failed_results(
    results: DataFrame, state: str = "state", states: Sequence[str] = FAILED_STATES
) -> DataFrame:
    """Rule results that failed, in any case. Raw records know FAIL only; ERROR is no failure."""
    return results.where(F.upper(F.col(state)).isin(*states))


def normalize_result(result: Column) -> Column:
    """A raw rule result struct as struct(rule, state, evaluated_metrics, description).

    Rule text is the description, else the name, else ''. A null metric becomes 0.0. The
    message gives way to the description when it is null or empty.
    """
    described = result["Description"]
    return F.struct(
        F.coalesce(described, result["Name"], F.lit("")).alias("rule"),
        F.when(is_failed(result["Result"]), "FAILED").otherwise(F.upper(result["Result"])).alias("state"),
        F.transform_values(
            result["EvaluatedMetrics"], lambda k, v: F.coalesce(v.try_cast("double"), F.lit(0.0))
        ).alias("evaluated_metrics"),
        F.coalesce(
            F.nullif(result["EvaluationMessage"], F.lit("")), described, F.lit("")
        ).alias("description"),
    )


def failed_evaluations(evaluations: DataFrame, results: DataFrame) -> DataFrame:
    """Evaluations with at least one failed result; the others stop here."""
    return evaluations.join(failed_results(results).select("evaluation_id"), "evaluation_id", "left_semi")


def _affected(text: Column, metrics: Column) -> Column:
    """The column a rule names; all of a key; of a schema the columns that changed."""
    changed = F.filter(
        F.transform(F.map_keys(metrics), lambda n: F.regexp_extract(n, r"^Column\.(.*)\.(?:Added|Removed|Retyped)$", 1)),
        lambda n: n != "",
    )
    kind = F.ltrim(text)
    return (
        F.when(kind.startswith('Uniqueness "'), F.regexp_extract_all(text, F.lit('"([^"]+)"'), F.lit(1)))
        .when(kind.startswith('SchemaMatch "') & (F.size(changed) > 0), changed)
        .otherwise(F.array(extract_column(text)))
    )


def _violation(result: Column, by_rule_table: bool) -> Column:
    text = F.coalesce(result["rule"], result["description"], F.lit(""))
    kind = type_of_rule(result["rule_type"]) if by_rule_table else classify_line(text)
    return F.struct(
        kind.alias("type"),
        severity(kind, result["evaluated_metrics"]).alias("severity"),
        _affected(text, result["evaluated_metrics"]).alias("affected_columns"),
        result["evaluated_metrics"].alias("observed_values"),
        text.alias("rule"),
    )


def with_violations(evaluations: DataFrame, by_rule_table: bool = False) -> DataFrame:
    """Evaluations with an array of their violations, score, status and violation count.

    `by_rule_table` takes the type from the rule table instead of the rule text.
    """
    failed = F.filter(
        F.coalesce(F.col("rule_results"), F.array()), lambda r: is_failed(r["state"])
    )
    out = evaluations.withColumn("violations", F.transform(failed, lambda r: _violation(r, by_rule_table)))

    def count(level: str) -> Column:
        return F.size(F.filter("violations", lambda v: v["severity"] == level))

    return (
        out.withColumn("overall_score", score(count("CRITICAL"), count("WARNING")))
        .withColumn("overall_status", status(F.col("overall_score")))
        .withColumn("violation_count", F.size("violations").cast("bigint"))
    )


def violations(evaluations: DataFrame, by_rule_table: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """One row per violation, with the columns of its evaluation named in `carry`.

    Failed results are unnested first and graded as flat columns: grading inside the array, as
    `with_violations` does, would make Catalyst carry the whole expression through the explode.
    """
    failed = F.filter("rule_results", lambda r: is_failed(r["state"]))
    flat = evaluations.select(
        "evaluation_id", "table_name", "partition", *carry, F.posexplode(failed).alias("position", "result")
    )
    graded = flat.withColumn("v", _violation(F.col("result"), by_rule_table))
    return graded.select("evaluation_id", "table_name", "partition", *carry, "position", "v.*")


def observed_values(violation_rows: DataFrame) -> DataFrame:
    """One row per violation and metric."""
    return violation_rows.select(
        "evaluation_id", "position", F.explode("observed_values").alias("metric", "value")
    )


def scan_results(evaluations: DataFrame, source: str = "rules", carry: Sequence[str] = ()) -> DataFrame:
    """One summary row per evaluation; without violations it scores 100, OK. `carry` names columns to keep.

    `needs_action` says whether anything failed: a status of OK alone does not.
    """
    return with_violations(evaluations).select(
        "evaluation_id",
        "database",
        "table_name",
        "partition",
        "overall_state",
        "overall_score",
        "overall_status",
        "violation_count",
        (F.col("violation_count") > 0).alias("needs_action"),
        F.lit(source).alias("source"),
        *carry,
    )


def score_violations(evaluations: DataFrame, violation_rows: DataFrame) -> DataFrame:
    """The same score from flat violation rows, for violations that come as a table."""
    counted = violation_rows.groupBy("evaluation_id").agg(
        F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        F.count_if(F.col("severity") == "WARNING").alias("warning"),
        F.count("*").alias("violation_count"),
    )
    points = score(F.coalesce("critical", F.lit(0)), F.coalesce("warning", F.lit(0)))
    return (
        evaluations.join(counted, "evaluation_id", "left")
        .withColumn("overall_score", points)
        .withColumn("overall_status", status(F.col("overall_score")))
        .withColumn("violation_count", F.coalesce("violation_count", F.lit(0)))
        .drop("critical", "warning")
    )


def dimension_scores(violation_rows: DataFrame) -> DataFrame:
    """Score, status and count per evaluation and violation type."""
    return (
        violation_rows.groupBy("evaluation_id", "table_name", "type")
        .agg(
            F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
            F.count_if(F.col("severity") == "WARNING").alias("warning"),
            F.count("*").alias("violation_count"),
        )
        .withColumn("score", score(F.col("critical"), F.col("warning")))
        .withColumn("status", status(F.col("score")))
        .drop("critical", "warning")
    )
