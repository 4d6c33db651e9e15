"""Query of the token counts."""

from pyspark.sql import DataFrame, SparkSession

from assay.llm.frames import table
from assay.llm.registry import query
from assay.llm.tokens import token_counts

VOCABULARY = "byte_bpe_50k.json"


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
