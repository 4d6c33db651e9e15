"""Query of the toxicity scores."""

from pyspark.sql import DataFrame, SparkSession

from assay.llm.frames import learns, table
from assay.llm.registry import query
from assay.llm.toxicity import toxicity


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learns("doc_id", 3, 1))
