"""Stored diagnosis answers: every distinct prompt is asked once, failures are kept apart and tried again.

The store is an append-only table of answers keyed by the hash of their prompt. A run asks the prompts that
have no answer there: repeats are combined before the shuffle, what is known drops out in an anti join, and the
rest is dealt over a bounded number of callers. A prompt that fails gives a row with its error and not the end
of its task, so a run that is broken off, or a model that is down for a while, costs the open prompts only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.sources.partitions import path_exists

STORED = "prompt_id string, answer string, error string, asked_at timestamp"


def prompt_id(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)


def stored_answers(spark: SparkSession, store: str) -> DataFrame:
    """One row per answered prompt: `prompt_id`, `answer`. Of several answers the earliest counts."""
    if not path_exists(spark, store):
        return spark.createDataFrame([], "prompt_id string, answer string")
    rows = spark.read.schema(STORED).parquet(store).where("error IS NULL")
    return rows.groupBy("prompt_id").agg(F.min_by("answer", F.struct("asked_at", "answer")).alias("answer"))


def open_prompts(df: DataFrame, store: str, prompt: str = "prompt") -> DataFrame:
    """`prompt_id` and `prompt` of the distinct prompts without a stored answer. A null prompt asks nothing."""
    asked = df.where(F.col(prompt).isNotNull()).select(prompt_id(prompt).alias("prompt_id"), F.col(prompt).alias("prompt"))
    return asked.dropDuplicates(["prompt_id"]).join(stored_answers(df.sparkSession, store).select("prompt_id"), "prompt_id", "left_anti")


def ask_open(
    df: DataFrame, answer: Callable[[pd.Series], Sequence[str]], store: str, prompt: str = "prompt", callers: int = 8,
    batch: int = 64,
) -> None:
    """Ask the open prompts and append what comes back, `callers` side by side, `batch` prompts a call.

    If a call fails its prompts are asked one by one, so that one bad prompt does not take others with it;
    one that fails alone, or is answered by nothing, is stored with its error. Each caller's rows are
    written when it is done with its share.
    """

    def one(text: str) -> tuple[str | None, str | None]:
        try:
            found = list(answer(pd.Series([text])))[0]
            return (None, "no answer") if found is None else (str(found), None)
        except Exception as failed:  # whatever the callable raises becomes the prompt's error
            return None, f"{type(failed).__name__}: {failed}"

    def many(texts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            found = list(answer(pd.Series(texts)))
            if len(found) == len(texts) and all(a is not None for a in found):
                return [(str(a), None) for a in found]
        except Exception:  # asked again one by one
            pass
        return [one(t) for t in texts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for start in range(0, len(rows), batch):
                part = rows.iloc[start : start + batch]
                found = many(part["prompt"].tolist())
                yield pd.DataFrame({
                    "prompt_id": part["prompt_id"].to_numpy(), "answer": [a for a, _ in found], "error": [e for _, e in found],
                    "asked_at": pd.Timestamp.now(tz="UTC"),
                })

    asked = open_prompts(df, store, prompt).repartition(callers)
    asked.mapInPandas(run, STORED).write.mode("append").parquet(store)


def answered(df: DataFrame, store: str, prompt: str = "prompt") -> DataFrame:
    """The rows of `df` with `answer`, null where their prompt has none."""
    found = stored_answers(df.sparkSession, store).withColumnRenamed("prompt_id", "_prompt_id")
    return df.join(found, prompt_id(prompt) == F.col("_prompt_id"), "left").drop("_prompt_id")
