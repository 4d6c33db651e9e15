"""Query of the conversation repair. SQL has no such search; tests compare it with brute force."""

from pyspark.sql import DataFrame, SparkSession

from assay.llm.frames import table
from assay.llm.registry import query
from assay.llm.turns import damaged, repair


@query("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))
