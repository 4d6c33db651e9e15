"""Query of the language identification."""

from pyspark.sql import DataFrame, SparkSession

from assay.llm.frames import learns, table
from assay.llm.langid import identify
from assay.llm.registry import query


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), learns("doc_id", 5, 0))
