"""Diagnosis of violations: prompts, batch answers, their parsing and the default policy."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.operators.violations import with_violations

# Actions, answer fields and the fallback's text.
ACTIONS = ("quarantine_and_notify", "notify_only", "auto_resolve")
ANSWER_SCHEMA = (
    "probable_cause string, confidence string, recommended_action string, "
    "action_details string, explanation string, _corrupt_record string"
)
NOT_PARSED = "Could not parse structured diagnosis"

PROMPT_HEAD = "Find the likely cause of this data quality violation and recommend one action.\n\nViolation:\n"
PROMPT_HISTORY = "\n\nEarlier scans of the same partition:\n"
PROMPT_TAIL = (
    "\n\nAnswer with one JSON object and nothing else. Its keys: probable_cause, confidence "
    "(HIGH, MEDIUM or LOW), recommended_action (quarantine_and_notify, notify_only or auto_resolve), "
    "action_details (an object with a description), explanation."
)


def prompts(context: DataFrame) -> DataFrame:
    """A prompt per violation, from rows of `history_context`."""
    violation = F.to_json(
        F.struct(
            "type", "severity", F.col("table_name").alias("table"), "partition", "affected_columns",
            "observed_values", "rule", "evaluation_id",
        )
    )
    scans = F.transform(
        F.coalesce("scans", F.array()),
        lambda s: F.struct(s["evaluation_id"], s["overall_score"], s["overall_status"], s["violation_count"]),
    )
    history = F.to_json(F.struct("previous_scans", scans.alias("scans")))
    text = F.concat(
        F.lit(PROMPT_HEAD), violation, F.lit(PROMPT_HISTORY), history, F.lit(PROMPT_TAIL)
    )
    return context.withColumn("prompt", text)


def recommend_action(severity: Column) -> Column:
    """The default where no model is asked."""
    quarantine, notify, resolve = ACTIONS
    return F.when(severity == "CRITICAL", quarantine).when(severity == "WARNING", notify).otherwise(resolve)


def confidence(failing_scans: Column) -> Column:
    return F.when(failing_scans >= 3, "HIGH").when(failing_scans >= 1, "MEDIUM").otherwise("LOW")


def policy_answer(rule: Column, severity: Column, failing_scans: Column) -> Column:
    """The default policy in the form of a model's answer."""
    action = recommend_action(severity)
    return F.to_json(
        F.struct(
            F.concat(F.lit("rule not met: "), rule).alias("probable_cause"),
            confidence(failing_scans).alias("confidence"),
            action.alias("recommended_action"),
            F.struct(F.concat(action, F.lit(" for "), severity, F.lit(" violation")).alias("description")).alias("action_details"),
            F.concat(failing_scans.cast("string"), F.lit(" failing scans on record")).alias("explanation"),
        )
    )


def diagnose_batch(
    df: DataFrame,
    answer: Callable[[pd.Series], Sequence[str | None]],
    ids: Sequence[str],
    prompt: str = "prompt",
    partitions: int | None = None,
) -> DataFrame:
    """`ids` and the text that `answer` gives for each prompt, called once per Arrow batch.

    This is where a model call goes; the callable gets a batch of prompts so that it can send many at
    once. Only ids and prompts go through Arrow. `partitions` sets how many callers run side by side.
    """
    asked = df.select(*ids, F.col(prompt).alias("__prompt"))
    schema = T.StructType([*df.select(*ids).schema.fields, T.StructField("answer", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[list(ids)].assign(answer=list(answer(batch["__prompt"])))

    return (asked.repartition(partitions) if partitions else asked).mapInPandas(run, schema)


def parse_answer(answer: Column) -> Column:
    """struct of the diagnosis fields.

    A code fence is taken off first: its first line goes, and everything from the last fence
    on. JSON objects give their fields, lacking keys being null; any other text gives the
    fallback. `action_details` is kept whole, as JSON text, whatever it is; `action_description` is its
    description where it is an object that has one.
    """
    text = F.trim(F.regexp_replace(answer, r"^\s+|\s+$", ""))
    opened = F.regexp_replace(text, r"^```[^\n]*\n", "")
    closed = F.regexp_replace(opened, r"(?s)^(.*)```.*$", "$1")
    body = F.when(
        text.startswith("```"), F.regexp_replace(closed, r"^\s+|\s+$", "")
    ).otherwise(text)
    strict = {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = F.from_json(body, ANSWER_SCHEMA, strict)
    is_object = (
        body.startswith("{") & body.endswith("}") & parsed["_corrupt_record"].isNull()
    )
    no_break = text.startswith("```") & ~text.contains("\n")
    ok = F.coalesce(is_object & ~no_break, F.lit(False))
    fallback = F.when(no_break, text).otherwise(body)
    return F.struct(
        F.when(ok, parsed["probable_cause"]).otherwise(fallback).alias("probable_cause"),
        F.when(ok, parsed["confidence"]).otherwise("LOW").alias("confidence"),
        F.when(ok, parsed["recommended_action"]).otherwise("notify_only").alias("recommended_action"),
        F.when(ok, F.get_json_object(parsed["action_details"], "$.description"))
        .otherwise(NOT_PARSED)
        .alias("action_description"),
        F.when(ok, parsed["explanation"]).otherwise(fallback).alias("explanation"),
        ok.alias("parsed"),
        F.when(ok, parsed["action_details"]).alias("action_details"),
    )


def chosen(answers: DataFrame, ids: Sequence[str], answer: str = "answer") -> DataFrame:
    """Parsed answers by their ids, for `actions`; rows without an answer are left out."""
    return answers.where(F.col(answer).isNotNull()).select(*ids, parse_answer(F.col(answer)).alias("diagnosis"))


def shared_cause(evaluations: DataFrame) -> DataFrame:
    """Evaluations with violations, with the types and columns involved: diagnose them together.

    An evaluation's violations lie in its row, so this is no aggregation.
    """
    def distinct(of) -> Column:
        return F.array_sort(F.array_distinct(F.transform("violations", of)))

    return (
        with_violations(evaluations)
        .where(F.col("violation_count") > 0)
        .select(
            "evaluation_id",
            "table_name",
            "partition",
            "violation_count",
            distinct(lambda v: v["type"]).alias("types"),
            distinct(lambda v: F.get(v["affected_columns"], F.lit(0))).alias("columns"),
        )
    )
