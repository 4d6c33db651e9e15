"""Query of the mixing operator and its SQL."""

from pyspark.sql import DataFrame, SparkSession

from assay.llm.frames import table
from assay.llm.mixing import SEED, mix
from assay.llm.registry import query

SQL = rf"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('{SEED}|order|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS draw
  FROM documents
), named AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3)::INT + 1]::BIGINT AS weight
  FROM sized GROUP BY source
), filled AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(source_size) OVER (ORDER BY source_size::HUGEINT * 10 // weight, source NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS smaller,
         sum(weight) OVER (ORDER BY source_size::HUGEINT * 10 // weight, source NULLS LAST
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_onward
  FROM named
), shared AS (
  SELECT source, source_size, weight, stopped, rest_weight, total - coalesce(taken_up, 0) AS rest FROM (
    SELECT *, sum(CASE WHEN stopped THEN 3 * source_size END) OVER () AS taken_up,
           sum(CASE WHEN NOT stopped THEN weight END) OVER () AS rest_weight
    FROM (SELECT *, weight * (total - 3 * smaller) > 3 * source_size::HUGEINT * weight_onward AS stopped FROM filled))
), targets AS (
  SELECT source, source_size,
         CASE WHEN stopped THEN 3.0::DOUBLE * source_size::DOUBLE
              ELSE (weight * rest)::DOUBLE / rest_weight::DOUBLE END AS target,
         CASE WHEN stopped THEN 3::HUGEINT ELSE (weight * rest)::HUGEINT END AS num,
         CASE WHEN source_size = 0 THEN 0::HUGEINT WHEN stopped THEN 1::HUGEINT ELSE rest_weight::HUGEINT * source_size END AS den,
         ('0x' || substr(md5('{SEED}|offset|' || CASE WHEN source IS NULL THEN '0|' ELSE '1|' END
           || coalesce(source, '')), 1, 8))::HUGEINT AS shift
  FROM shared
), ranked AS (
  SELECT doc_id, source, size,
         (row_number() OVER (PARTITION BY source ORDER BY size, draw, doc_id NULLS LAST) - 1)::HUGEINT AS rank
  FROM sized
), counted AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN den = 0 THEN 0 ELSE ((rank + 1) * num + shift * den // 4294967296) // den
           - (rank * num + shift * den // 4294967296) // den END AS copies
  FROM ranked JOIN targets ON ranked.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target, copies::BIGINT AS copies, (copies * size)::BIGINT AS taken FROM counted
"""


@query("op3_mixing", SQL)
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "copies", "taken"
    )
