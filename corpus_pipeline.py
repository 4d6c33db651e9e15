"""The corpus pipeline: a chain of the operators, each stage written and read again by the next.

toxicity (rejected documents go), line dedup (later occurrences of repeated windows go, and documents of
which nothing is left), MinHash near-dedup (one document of each class stays), benchmark decontamination
(leaking documents go), mixing (each document as often as the mix takes it: not at all, once or several
times). All stages return the columns of `documents`, extra ones included. Rows are told apart by key and text, so null and repeated keys
lose nothing to each other; empty tables pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.decontam import leaks
from assay.llm.frames import free_names, learns, table, written
from assay.llm.lines import dedup_lines
from assay.llm.minhash import one_of_each
from assay.llm.mixing import mix
from assay.llm.toxicity import learn, without_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = learn(docs, table(spark, sf_dir, "labels"), learns("doc_id", 3, 1))
    return without_toxic(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    before, removed = free_names(docs, "n_lines", "n_removed")
    found = dedup_lines(docs, counts=(before, removed))
    left = found.where((F.col(removed) == 0) | (F.col(removed) < F.col(before)))
    if "n_chars" in docs.columns:
        changed = F.col(removed) > 0
        kind = docs.schema["n_chars"].dataType
        left = left.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = F.struct(F.col("doc_id"), F.xxhash64("text"))
    named = docs.select(row.alias("row"), "text")
    found = leaks(named, table(spark, sf_dir, "benchmark"), key="row").where("consistent")
    leak = free_names(docs, "leak")[0]
    leaking = found.select(F.col("row").alias(leak)).distinct()
    return docs.join(leaking, row.eqNullSafe(F.col(leak)), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows alike in key, text and source are taken together, as often as all of them are."""
    row = F.struct(F.col("doc_id"), F.xxhash64("text"), F.col("source").alias("of"))
    taken = mix(docs.select(row.alias("row"), "text", "source"), key="row").groupBy("row").agg(
        F.sum("copies").alias("copies"), F.count("*").alias("rows")
    ).where("copies > 0")
    whole = docs.select(row.alias("own"), F.struct(*docs.columns).alias("whole"))
    met = whole.join(taken, F.col("own").eqNullSafe(F.col("row")))
    once = met.where("rows = 1").select("whole", "copies")
    alike = met.where("rows > 1").groupBy("own").agg(F.any_value("whole").alias("whole"), F.first("copies").alias("copies"))
    every = once.unionByName(alike.select("whole", "copies"))
    return every.select("whole", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select("whole.*")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", keep_one_of_each),
    ("benchmark_decontamination", drop_leaks),
    ("mixing", mix_sources),
]

# The learned toxicity scores and the near-duplicate classes are beyond SQL. Tests compare line dedup,
# near-dedup and mixing with direct versions, toxicity and decontamination with planted documents.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the whole `documents` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
