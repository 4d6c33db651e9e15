"""Query of the vector code compression and its SQL."""

from pyspark.sql import DataFrame, SparkSession

from assay.llm.codes import ROUNDS, compress
from assay.llm.frames import table
from assay.llm.registry import query


def _sql() -> str:
    steps = [
        """kept AS (
  SELECT row_number() OVER () AS id, vec_id, label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """parts AS (
  SELECT id, p::INT AS part, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] AS w FROM kept, range(16) t(p))""",
        """entries0 AS (
  SELECT part, e::INT AS entry, w FROM parts
  JOIN (SELECT id, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept) USING (id) WHERE e < 64)""",
    ]
    for n in range(ROUNDS + 1):
        steps.append(f"""near{n} AS (
  SELECT id, part, w, min(far) AS far, arg_min(entry, far * 64 + entry) AS entry FROM (
    SELECT p.id, p.part, p.w, e.entry,
           list_sum(list_transform(list_zip(p.w, e.w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS far
    FROM parts p JOIN entries{n} e USING (part)) GROUP BY id, part, w)""")
        if n < ROUNDS:
            steps.append(f"""sums{n} AS (
  SELECT part, entry, list(mean ORDER BY i) AS mean FROM (
    SELECT part, entry, i, (sum(w[i]) - ((sum(w[i]) % count(*)) + count(*)) % count(*)) // count(*) AS mean
    FROM near{n}, range(1, len(w) + 1) t(i) GROUP BY part, entry, i) GROUP BY part, entry)""")
            steps.append(f"""entries{n + 1} AS (
  SELECT part, entry, coalesce(mean::BIGINT[], w) AS w FROM entries{n} LEFT JOIN sums{n} USING (part, entry))""")
    return f"""WITH {", ".join(steps)},
coded AS (
  SELECT id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(far)::BIGINT AS error
  FROM near{ROUNDS} GROUP BY id),
books AS (
  SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM entries{ROUNDS})
SELECT vec_id, label, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (id), books"""


@query("op12_vector_codes", _sql())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))
