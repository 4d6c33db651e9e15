"""The response to evaluations, as one fixed plan of DataFrames.

evaluate → violations → history → diagnosis → action → alert → decision → metrics. The order that
an operator would follow by hand is the order of the frames here; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.operators import diagnosis as D
from assay.operators import history as H
from assay.operators import metrics as M
from assay.operators import notify as N
from assay.operators import quarantine as Q
from assay.operators import violations as V
from assay.session import scratch_dir


@dataclass(frozen=True)
class Response:
    scans: DataFrame
    violations: DataFrame
    actions: DataFrame
    alerts: DataFrame
    decisions: DataFrame
    metrics: DataFrame


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write a frame and read it back.

    For the evaluations: a few rows per partition that came from a scan of the whole table, and
    that several frames are made of. A written table also outlives lost executors.
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


ANSWER_IDS = ("evaluation_id", "position")


def actions(violation_rows: DataFrame, scans: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Violations with history, recommended action, confidence and alert severity.

    `answers` are parsed diagnoses by evaluation and position (`diagnosis.chosen`). Where there is one, its
    action, confidence, cause and details are taken; where there is none, or it names no known action, the
    default policy decides.
    """
    context = H.history_context(violation_rows, scans)
    policy, sure = D.recommend_action(F.col("severity")), D.confidence(F.col("failing_scans"))
    if answers is None:
        context = context.withColumn("diagnosis", F.lit(None).cast(_DIAGNOSIS))
    else:
        context = context.join(answers.select(*ANSWER_IDS, "diagnosis"), list(ANSWER_IDS), "left")
    answered = F.coalesce(F.col("diagnosis.recommended_action").isin(*D.ACTIONS), F.lit(False))
    action = F.when(answered, F.col("diagnosis.recommended_action")).otherwise(policy)
    return context.withColumns(
        {
            "recommended_action": action,
            "confidence": F.when(answered, F.coalesce("diagnosis.confidence", sure)).otherwise(sure),
            "probable_cause": F.when(answered, F.col("diagnosis.probable_cause")),
            "action_details": F.when(answered, F.col("diagnosis.action_details")),
            "alert_severity": N.alert_severity(action, F.col("severity")),
            "issue_id": F.md5(
                F.concat_ws("#", "evaluation_id", F.col("position").cast("string")).cast("binary")
            ),
        }
    ).drop("diagnosis")


_DIAGNOSIS = (
    "struct<probable_cause:string,confidence:string,recommended_action:string,action_description:string,"
    "explanation:string,parsed:boolean,action_details:string>"
)


def respond(
    evaluations: DataFrame, history: DataFrame, ts: Column, answers: DataFrame | None = None
) -> Response:
    """All frames that follow from evaluations, the stored scans and, if a model was asked, its answers.

    Pass evaluations through `stored` first: every frame below starts from them. The scans of
    these evaluations count as history too, as if they had been stored before the diagnosis.
    """
    scans = V.scan_results(evaluations).withColumn("ts", ts)
    shared = ["evaluation_id", "table_name", "partition", "ts", "overall_score", "overall_status", "violation_count"]
    violation_rows = V.violations(evaluations)
    acted = actions(violation_rows, history.select(*shared).unionByName(scans.select(*shared)), answers)
    # Alerts and decisions both start from it: the history is ranked once.
    acted = stored(acted, scratch_dir(evaluations.sparkSession, "actions"))
    message = F.concat(
        F.col("rule"), F.lit(" on "), F.col("table_name"), F.lit(" "), F.col("partition"), F.lit(": "),
        F.col("recommended_action"),
    )
    alert_rows = N.alerts(
        acted.where(F.col("alert_severity").isNotNull()).select(
            "issue_id", "table_name", "partition", F.col("alert_severity").alias("severity"), message.alias("message")
        )
    )
    decisions = (
        N.violation_decisions(violation_rows)
        .unionByName(N.diagnosis_decisions(acted))
        .unionByName(N.alert_decisions(alert_rows))
        .withColumn("ts", ts)
    )
    by_type = V.dimension_scores(violation_rows).withColumn("ts", ts)
    points = (
        M.scan_metrics(scans)
        .unionByName(M.dimension_metrics(by_type))
        .unionByName(M.decision_metrics(decisions))
    )
    return Response(scans, violation_rows, acted, alert_rows, decisions, points)


@dataclass(frozen=True)
class Isolation:
    counts: DataFrame
    remediations: DataFrame
    decisions: DataFrame
    metrics: DataFrame


def isolate(
    df: DataFrame, requests: Q.Requests, scans: DataFrame, path: str, keys: Sequence[str], ts: Column
) -> Isolation:
    """Copy the bad rows of all requests to the zone, with counts and everything that records it.

    The partitions in scope are read twice, whatever the number of requests: by the copy, whose filter
    is pushed down to the files, and by the counts, which need the predicates' columns only and are
    stored once for the frames made of them. The counts are an aggregate of their own, and not gathered
    during the copy, so that a repeated task cannot count twice.
    """
    Q.write_quarantine(df, requests, path, keys, ts)
    counts = stored(Q.quarantine_counts(df, requests), scratch_dir(df.sparkSession, "quarantine-counts"))
    remediations = Q.remediation_rows(counts, scans, ts, path)
    decisions = Q.remediation_decisions(remediations)
    points = M.remediation_metrics(remediations).unionByName(M.decision_metrics(decisions))
    return Isolation(counts, remediations, decisions, points)
