"""Query of the benchmark decontamination and its SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.decontam import LETTERS, NAME, NUMBER, NUMBERS, UNIT, UNITS, leaks
from assay.llm.frames import table
from assay.llm.registry import query

_UNITS = ", ".join(f"'{u}'" for u in UNITS)


def _words(rows: str) -> str:
    """Template words with the values of placeholders, from rows of (id, text)."""
    return rf"""
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY raw_at, sub_at) - 1 AS pos,
         CASE WHEN is_unit THEN '{UNIT}' ELSE word END AS word,
         CASE WHEN is_unit THEN word
              WHEN word = '{NUMBER}' THEN numbers[row_number() OVER (PARTITION BY id, word ORDER BY raw_at, sub_at)]
              WHEN word = '{NAME}' THEN named END AS value
  FROM (
    SELECT *, coalesce(lag(word) OVER (PARTITION BY id ORDER BY raw_at, sub_at), '') = '{NUMBER}' AND word IN ({_UNITS}) AS is_unit
    FROM (
      SELECT id, numbers, raw_at, named, unnest(parts) AS word, unnest(range(len(parts))) AS sub_at
      FROM (
        SELECT id, numbers, raw_at,
               CASE WHEN after_word THEN lower(regexp_extract(raw, '^[^\p{{L}}\p{{N}}{NUMBER}]*(\p{{Lu}}[\p{{L}}\p{{M}}]*)', 1)) END AS named,
               list_filter(regexp_split_to_array(lower(CASE WHEN after_word
                 THEN regexp_replace(raw, '^([^\p{{L}}\p{{N}}{NUMBER}]*)\p{{Lu}}[\p{{L}}\p{{M}}]*', '\1 {NAME} ') ELSE raw END),
                 '[^{LETTERS}{NUMBER}{NAME}{UNIT}]+'), lambda x: x <> '') AS parts
        FROM (
          SELECT *, NOT regexp_matches(coalesce(lag(raw) OVER (PARTITION BY id ORDER BY raw_at), '.'), '[.!?:]$') AS after_word
          FROM (
            SELECT id, numbers, unnest(raws) AS raw, unnest(range(len(raws))) AS raw_at
            FROM (
              SELECT id, regexp_extract_all(text, '{NUMBERS}') AS numbers,
                     list_filter(regexp_split_to_array(regexp_replace(text, '{NUMBERS}', ' {NUMBER} ', 'g'), '[ \t\r\n]+'), lambda x: x <> '') AS raws
              FROM ({rows}))))))
  )"""


SQL = f"""
WITH i AS ({_words("SELECT item_id AS id, text FROM benchmark")}),
d AS ({_words("SELECT doc_id AS id, text FROM documents")}),
iw AS (
  SELECT id, pos, held FROM (
    SELECT id, pos, list(word) OVER w AS held, sum((word IN ('{NUMBER}', '{NAME}', '{UNIT}'))::INT) OVER w AS filled
    FROM i WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
  WHERE len(held) = 5 AND 2 * filled <= 5
), n AS (SELECT id, count(*) AS n_windows FROM iw GROUP BY id),
dw AS (
  SELECT id, pos, list(word) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS held FROM d
), found AS (
  SELECT dw.id AS doc_id, iw.id AS item_id, iw.pos AS item_at, min(dw.pos) AS doc_at
  FROM dw JOIN iw USING (held) GROUP BY ALL
), pairs AS (
  SELECT doc_id, item_id, any_value(n_windows) AS n_windows, count(*) AS n_found, min(doc_at) AS first_word
  FROM found JOIN n ON found.item_id = n.id GROUP BY doc_id, item_id HAVING count(*) >= 0.8::DOUBLE * any_value(n_windows)
), aligned AS (
  SELECT DISTINCT doc_id, item_id, item_at + k AS item_at, doc_at + k AS doc_at
  FROM found JOIN pairs USING (doc_id, item_id), range(5) AS r(k)
), kinds AS (
  SELECT doc_id, item_id, i.word, count(*) AS n, count(DISTINCT (i.value, d.value)) AS pairs,
         count(DISTINCT i.value) AS items, count(DISTINCT d.value) AS docs
  FROM aligned JOIN i ON i.id = item_id AND i.pos = item_at JOIN d ON d.id = doc_id AND d.pos = doc_at AND d.word = i.word
  WHERE i.word IN ('{NUMBER}', '{NAME}', '{UNIT}') GROUP BY ALL
), slots AS (
  SELECT doc_id, item_id, sum(n) AS n_slots, bool_and(pairs = items AND pairs = docs) AS consistent FROM kinds GROUP BY ALL
)
SELECT doc_id, item_id, n_windows::BIGINT AS n_windows, n_found::BIGINT AS n_found, first_word::BIGINT AS first_word,
       coalesce(n_slots, 0)::BIGINT AS n_slots
FROM pairs LEFT JOIN slots USING (doc_id, item_id) WHERE coalesce(consistent, TRUE)
"""


@query("op7_decontamination", SQL)
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.where("consistent").select(
        "doc_id", "item_id", "n_windows", "n_found", F.col("first_word").cast("bigint").alias("first_word"), "n_slots"
    )
