"""Small helpers of the operators: table access, digests, written intermediate tables, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.session import scratch_dir

# Rows that one Arrow batch is cut into inside a task, so that Python objects of long texts stay few.
SLICE_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` stored once in the shared scratch folder and read back: its lineage ends there."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def long_hash(*columns: Column | str, salt: int = 0) -> Column:
    """64-bit hash; different salts give independent hashes of the same values."""
    return F.xxhash64(F.lit(salt), *columns)


def learns(key: str, modulus: int, held_out: int) -> Column:
    """Whether a row may be learned from: crc32 of its key as text, modulo `modulus`, is not `held_out`.

    A row without a key counts as held out: it is never learned from.
    """
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus != held_out, F.lit(False))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front where a column of `df` is called so already (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def sliced(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `limit` bytes of text each (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        if column.nbytes <= limit:
            yield batch
            continue
        lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        start = size = 0
        for row, length in enumerate(lengths):
            if size and size + length > limit:
                yield batch.slice(start, row - start)
                start, size = row, 0
            size += length
        yield batch.slice(start, n - start)
