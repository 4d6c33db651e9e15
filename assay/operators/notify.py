"""Alert rows and audit decisions. Sending is not done here: alerts are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
SEVERITY_PREFIX = {"critical": "🚨 CRITICAL", "warning": "⚠️ WARNING", "info": "ℹ️ INFO"}
SUBJECT_LENGTH = 100
PREVIEW_LENGTH = 200
REASON_LENGTH = 100


def severity_prefix(severity: Column) -> Column:
    prefix = F.upper(severity)
    for name, text in SEVERITY_PREFIX.items():
        prefix = F.when(F.lower(severity) == name, text).otherwise(prefix)
    return prefix


def alerts(issues: DataFrame, app: str = "assay") -> DataFrame:
    """Rows of (issue_id, severity, message) with the subject line, cut to 100 characters."""
    subject = F.concat(
        F.lit(f"[{app}] "), severity_prefix(F.col("severity")), F.lit(": Data Quality Issue "),
        F.left("issue_id", F.lit(8)),
    )
    return issues.withColumn("subject", F.left(subject, F.lit(SUBJECT_LENGTH)))


def alert_decisions(alert_rows: DataFrame, channel: str = "alert", delivery: str = "issue_id") -> DataFrame:
    """The `notification_sent` decision of each alert. Alerts may name their table and partition."""
    severity, message = F.col("severity"), F.col("message")
    # The wording of the texts.

    def known(name: str, default: str) -> Column:
        return (F.col(name) if name in alert_rows.columns else F.lit(default)).alias(name)

    return alert_rows.select(
        F.lit("notification_sent").alias("decision_type"),
        known("table_name", "unknown"),
        known("partition", ""),
        F.create_map(
            F.lit("issue_id"), F.col("issue_id"),
            F.lit("severity"), severity,
            F.lit("message_preview"), F.left(message, F.lit(PREVIEW_LENGTH)),
        ).alias("context"),
        F.concat(
            F.upper(severity), F.lit(" alert sent for issue "), F.left("issue_id", F.lit(8)), F.lit(": "),
            F.left(message, F.lit(REASON_LENGTH)),
        ).alias("reasoning"),
        F.concat(F.lit(f"{channel} publish ("), severity, F.lit(")")).alias("action_taken"),
        F.concat(F.lit("Delivered: "), F.coalesce(F.col(delivery), F.lit(""))).alias("outcome"),
    )


def alert_severity(action: Column, severity: Column) -> Column:
    """Severity of the alert an action calls for, null for none; CRITICAL always alerts."""
    return (
        F.when((action == "quarantine_and_notify") | (severity == "CRITICAL"), "critical")
        .when((action == "notify_only") & (severity == "WARNING"), "warning")
        .when(action == "notify_only", "info")
    )


def decision_rows(decisions: DataFrame, context: str = "context") -> DataFrame:
    """Decision rows with table and partition taken from their context map."""
    def entry(key: str) -> Column:
        return F.try_element_at(F.col(context), F.lit(key))

    unknown = F.lit("unknown")
    return decisions.withColumns(
        {
            "table_name": F.coalesce(entry("table"), entry("table_name"), unknown),
            "partition": F.coalesce(entry("partition"), unknown),
        }
    )


def violation_decisions(violation_rows: DataFrame) -> DataFrame:
    """A `violation_detected` decision per violation, so that parsing leaves a trace of its own."""
    return violation_rows.select(
        F.lit("violation_detected").alias("decision_type"),
        "table_name",
        "partition",
        F.create_map(
            F.lit("evaluation_id"), F.col("evaluation_id"), F.lit("position"), F.col("position").cast("string")
        ).alias("context"),
        F.concat(F.col("severity"), F.lit(" "), F.col("type"), F.lit(" violation: "), F.col("rule")).alias(
            "reasoning"
        ),
        F.lit("parsed").alias("action_taken"),
        F.concat(F.lit("recorded for "), F.array_join("affected_columns", ", ")).alias("outcome"),
    )


def diagnosis_decisions(actions: DataFrame) -> DataFrame:
    """A `diagnosis_complete` decision per violation that an action was chosen for, with the probable
    cause where a diagnosis names one."""
    return actions.select(
        F.lit("diagnosis_complete").alias("decision_type"),
        "table_name",
        "partition",
        F.create_map(F.lit("evaluation_id"), F.col("evaluation_id"), F.lit("issue_id"), F.col("issue_id")).alias(
            "context"
        ),
        F.coalesce(
            "probable_cause",
            F.concat(
                F.col("severity"), F.lit(" "), F.col("type"), F.lit(" violation, "),
                F.col("failing_scans").cast("string"), F.lit(" failing scans on record"),
            ),
        ).alias("reasoning"),
        F.col("recommended_action").alias("action_taken"),
        F.concat(F.lit("confidence "), F.col("confidence")).alias("outcome"),
    )
