"""Query of the masked pseudo-likelihood."""

from pyspark.sql import DataFrame, SparkSession

from assay.llm.frames import table
from assay.llm.pseudo_lm import pseudo_likelihood
from assay.llm.registry import query


@query("op9_lm_scoring")
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(table(spark, sf_dir, "documents"))
