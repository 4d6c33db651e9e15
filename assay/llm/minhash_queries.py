"""Query of the near-duplicate classes."""

from pyspark.sql import DataFrame, SparkSession

from assay.llm.frames import table
from assay.llm.minhash import near_duplicates
from assay.llm.registry import query


@query("op1_minhash_near_dedup")
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "is_first")
