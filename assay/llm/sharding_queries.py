"""Query of the sharding operator and its SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.frames import table
from assay.llm.registry import query
from assay.llm.sharding import LAW, OVERHEAD, SEED, SHARDS, interleave


def _crc_basis() -> list[int]:
    """Entries 1, 2, 4 .. 128 of the CRC-32 table, by its rule; the others are sums of these."""
    out = []
    for bit in range(8):
        value = 1 << bit
        for _ in range(8):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


def _crc_step(crc: str, byte: str) -> str:
    low = f"xor({crc}, {byte})"
    step = f"({crc} >> 8)"
    for bit, value in enumerate(_crc_basis()):
        step = f"xor({step}, (({low} >> {bit}) & 1) * {value})"
    return step


# The checksum is taken byte by byte, independently of any library.
SQL = f"""
WITH sized AS (
  SELECT doc_id, source, strlen(coalesce(text, '')) + {OVERHEAD} AS size,
    xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
        lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: {_crc_step('c', 'b')})) AS crc
  FROM documents
), ranked AS (
  SELECT *, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY
      ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || size || '|' || crc), 1, 15))::BIGINT,
      doc_id NULLS LAST, size, crc) - 1 AS rank
  FROM sized
), placed AS (
  SELECT *, row_number() OVER (ORDER BY (rank * bins + phase % bins)::DOUBLE / (n * bins)::DOUBLE, source NULLS LAST) - 1 AS place
  FROM (SELECT *, (1::BIGINT << (ceil(log2(total) / 2)::INT + 2)) AS bins, ('0x' || substr(md5('{SEED}|phase|'
    || CASE WHEN source IS NULL THEN '0|' ELSE '1|' END || coalesce(source, '')), 1, 8))::BIGINT AS phase
    FROM (SELECT *, count(*) OVER () AS total FROM ranked))
)
SELECT doc_id, source, size::BIGINT AS size, crc::BIGINT AS text_crc32, '{LAW}' AS law, shard::INT AS shard,
  (place - (shard * total + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard
FROM (SELECT *, place * {SHARDS} // total AS shard FROM placed)
"""


@query("op11_sharding", SQL)
def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
