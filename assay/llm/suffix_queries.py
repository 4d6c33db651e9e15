"""Query of the removal of repeated byte strings."""

from pyspark.sql import DataFrame, SparkSession

from assay.llm.frames import table
from assay.llm.registry import query
from assay.llm.suffix import remove_repeats


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
