"""Query of the line deduplication and its SQL."""

from pyspark.sql import DataFrame, SparkSession

from assay.llm.frames import table
from assay.llm.lines import dedup_lines
from assay.llm.registry import query

SQL = """
WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), w AS (
  SELECT doc_id, place, lines[place : place + 2] AS held
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS place FROM d WHERE len(lines) >= 3)
), later AS (
  SELECT doc_id, place FROM w
  QUALIFY row_number() OVER (PARTITION BY held ORDER BY doc_id NULLS LAST, place) > 1
), covered AS (
  SELECT DISTINCT doc_id, place + k AS place FROM later, (VALUES (0), (1), (2)) AS v(k)
), l AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS place FROM d
), kept AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.place) AS text, count(*) AS n
  FROM l ANTI JOIN covered c ON l.doc_id = c.doc_id AND l.place = c.place GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines,
       (coalesce(len(lines), 0) - coalesce(n, 0))::BIGINT AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN coalesce(kept.text, '') END AS text
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


@query("op8_line_dedup", SQL)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")
