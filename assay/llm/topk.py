"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are ordered by length and packed into buckets of neighbouring lengths; queries are packed into
blocks. The bucket of the longest vectors gives each query a first threshold (its k-th score there).
A block meets only buckets whose longest vector can still reach a threshold of the block. Within a pair,
each query has a local cosine threshold, threshold / (query length x longest length of the bucket):

- above 1 the bucket is skipped,
- at COSINE_FOR_COORDINATES and above, vectors whose largest query coordinates lie outside the range that
  this cosine allows are pruned,
- below, vectors too short for the threshold are pruned (a suffix of the bucket).

What is left is verified by its exact integer product. Blocks and buckets hold a bounded number of rows,
and a pair returns k rows for each query at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.frames import written

BUCKET_ROWS = 1024
BLOCK_ROWS = 512
FOCUS = 3
COSINE_FOR_COORDINATES = 0.5
SLACK = 1e-9
EXACT = 2**53
PACKED = "id string, longest double, n int, width int, ids binary, vectors binary, lengths binary"


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null if the vector or a component is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return F.when(vector.isNotNull() & finite, whole)


def _pack(rows: int):
    """Rows (key, v, length) of a sorted partition → packed rows of at most `rows` vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, float]] = []

        def packed() -> pa.RecordBatch:
            width = max((len(v) for _, v, _ in held), default=0)
            vectors = np.zeros((len(held), width), np.int64)
            for n, (_, v, _) in enumerate(held):
                vectors[n, : len(v)] = v
            lengths = np.array([x for _, _, x in held])
            arrays = [
                [uuid4().hex], [float(lengths.max())], [len(held)], [width],
                [np.array([k for k, _, _ in held], np.int64).tobytes()], [vectors.tobytes()], [lengths.tobytes()],
            ]
            kinds = [pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            names = ["id", "longest", "n", "width", "ids", "vectors", "lengths"]
            return pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(arrays, kinds)], names=names)

        for batch in batches:
            keys, lengths = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            lists = batch.column(1)
            values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *lists.value_lengths().to_pylist()])
            for n, key in enumerate(keys):
                held.append((key, values[ends[n] : ends[n + 1]], lengths[n]))
                if len(held) == rows:
                    yield packed()
                    held.clear()
        if held:
            yield packed()

    return run


class Packed:
    """A packed row as arrays."""

    def __init__(self, n: int, width: int, ids: bytes, vectors: bytes, lengths: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.vectors = np.frombuffer(vectors, np.int64).reshape(n, width)
        self.lengths = np.frombuffer(lengths, np.float64)
        self.width = width
        self.longest = float(self.lengths.max()) if n else 0.0
        # abs() of the least 64-bit number is itself; as float it is right.
        self.largest = float(np.abs(self.vectors.astype(np.float64)).max()) if self.vectors.size else 0.0


def products(left: Packed, row: int | slice, right: Packed, columns: np.ndarray | slice) -> np.ndarray:
    """Exact inner products; numbers beyond 64 bits are cut to its ends. Missing components count as 0."""
    width = min(left.width, right.width)
    a, b = left.vectors[row, :width], right.vectors[columns, :width]
    if left.largest * right.largest * max(1, width) < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T if width else np.zeros((*a.shape[:-1], len(b)), object)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def best(ids: np.ndarray, scores: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) with different ids, ties to the smaller id, without `own`."""
    out: list[tuple[int, int]] = []
    seen = {own}
    # ~score is -score - 1, which no 64-bit score overflows.
    for n in np.lexsort((ids, ~scores)):
        if (key := int(ids[n])) not in seen:
            seen.add(key)
            out.append((int(scores[n]), key))
            if len(out) == k:
                break
    return out


def focus_candidates(query: np.ndarray, length: float, unit: np.ndarray, cosine: float, focus: int = FOCUS) -> np.ndarray:
    """Which unit vectors may have `cosine` or more with the query, judged by its largest coordinates.

    A vector within the angle b of the query, which is at the angle a from an axis, is at an angle of
    a - b to a + b from that axis.
    """
    width = min(len(query), unit.shape[1])
    keep = np.ones(len(unit), bool)
    within = np.arccos(np.clip(cosine, -1, 1))
    for f in np.argsort(-np.abs(query[:width]), kind="stable")[:focus]:
        angle = np.arccos(np.clip(query[f] / length, -1, 1))
        low, high = np.cos(min(np.pi, angle + within)), np.cos(max(0.0, angle - within))
        keep &= (unit[:, f] >= low - SLACK) & (unit[:, f] <= high + SLACK)
    return keep


def match(queries: Packed, thresholds: np.ndarray, bucket: Packed, k: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """For each query by its row: its k best of the bucket that reach its threshold."""
    unit = None
    by_length: list[int] = []
    for q, (length, threshold) in enumerate(zip(queries.lengths, thresholds)):
        reach = length * bucket.longest
        cosine = threshold / reach if reach > 0 else (-1.0 if threshold <= 0 else 2.0)
        if cosine > 1 + SLACK:
            continue
        if cosine < COSINE_FOR_COORDINATES:
            by_length.append(q)
            continue
        if unit is None:
            unit = bucket.vectors / np.where(bucket.lengths > 0, bucket.lengths, 1)[:, None]
        found = np.flatnonzero(focus_candidates(queries.vectors[q].astype(np.float64), length, unit, cosine))
        scores = products(queries, q, bucket, found)
        reached = scores >= threshold
        yield q, best(bucket.ids[found[reached]], scores[reached], int(queries.ids[q]), k)
    if not by_length:
        return
    # One product of the queries with the longest prefix of the bucket that any of them needs.
    least = [thresholds[q] / queries.lengths[q] if queries.lengths[q] > 0 else -np.inf for q in by_length]
    prefix = int(np.searchsorted(-bucket.lengths, -(min(least) * (1 - SLACK) - SLACK), side="right")) if min(least) > 0 else len(bucket.ids)
    rows = np.array(by_length)
    table = products(queries, rows, bucket, slice(0, prefix))
    for q, scores in zip(by_length, table):
        reached = np.flatnonzero(scores >= thresholds[q])
        yield q, best(bucket.ids[reached], scores[reached], int(queries.ids[q]), k)


def _with_thresholds(blocks: DataFrame, seed: DataFrame, k: int) -> DataFrame:
    """Each block with the queries' thresholds from the first bucket, and the least length that can reach one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Packed(row["n"], row["width"], row["ids"], row["vectors"], row["lengths"])
                start = Packed(row["s_n"], row["s_width"], row["s_ids"], row["s_vectors"], row["s_lengths"])
                thresholds = np.full(row["n"], -np.inf)
                for q, found in match(block, thresholds, start, k):
                    if len(found) == k:
                        thresholds[q] = found[-1][0]
                with np.errstate(divide="ignore", invalid="ignore"):
                    reach = np.where(thresholds > 0, thresholds / block.lengths, 0.0)
                least = float(reach.min()) * (1 - SLACK)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in (
                        (row["n"], pa.int32()), (row["width"], pa.int32()), (row["ids"], pa.binary()),
                        (row["vectors"], pa.binary()), (row["lengths"], pa.binary()),
                        (thresholds.tobytes(), pa.binary()), (least, pa.float64()),
                    )],
                    names=["n", "width", "ids", "vectors", "lengths", "thresholds", "reach"],
                )

    # One bucket: at most BUCKET_ROWS vectors.
    first = F.broadcast(seed.select(*[F.col(c).alias(f"s_{c}") for c in ("n", "width", "ids", "vectors", "lengths")]))
    joined = blocks.join(first)
    return joined.mapInArrow(
        run, "n int, width int, ids binary, vectors binary, lengths binary, thresholds binary, reach double"
    )


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256,
    bucket_rows: int = BUCKET_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """`query_id`, `rank` (from 1), `vec_id`, `score`: each query's k largest integer inner products.

    Candidates are all rows but those with the query's own key; ties go to the smaller key. A vector
    that is null or holds a null or a component that is not finite takes no part, nor does a null key.
    Shorter vectors count as if filled up with zeros. A key that repeats is listed once, with its best
    score. A query with fewer than k candidates has them all. Empty tables give an empty one.
    """
    rows = vectors.where(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("key"), quantized(F.col(vector), scale).alias("v"), is_query.alias("is_query")
    ).where(F.col("v").isNotNull())
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = rows.withColumn("length", length)

    def packed(df: DataFrame, n: int, label: str) -> DataFrame:
        ordered = [F.col("length").desc(), F.col("key")]
        # Equal lengths are told apart by the key, so a vector that repeats fills no single range.
        ranged = df.select("key", "v", "length").repartitionByRange(*ordered).sortWithinPartitions(*ordered)
        return written(ranged.mapInArrow(_pack(n), PACKED), label)

    buckets = packed(rows, bucket_rows, "topk-buckets")
    blocks = packed(rows.where("is_query"), block_rows, "topk-queries")
    seed = buckets.orderBy(F.col("longest").desc(), "id").limit(1)
    blocks = written(_with_thresholds(blocks, seed, k), "topk-thresholds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for row in batch.to_pylist():
                block = Packed(row["n"], row["width"], row["ids"], row["vectors"], row["lengths"])
                bucket = Packed(row["b_n"], row["b_width"], row["b_ids"], row["b_vectors"], row["b_lengths"])
                for q, found in match(block, np.frombuffer(row["thresholds"]), bucket, k):
                    out += [(int(block.ids[q]), key, score) for score, key in found]
            columns = [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

    side = buckets.select("longest", *[F.col(c).alias(f"b_{c}") for c in ("n", "width", "ids", "vectors", "lengths")])
    # Blocks of queries meet whole buckets here: a query set against all rows, pruned by length.
    pairs = blocks.join(side, F.col("longest") >= F.col("reach")).drop("longest", "reach")
    found = pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    scored = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
