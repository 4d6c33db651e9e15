"""Vector code compression: product codes whose nearest entries are found with a tree over the entries.

A vector becomes integers, is cut into equal consecutive parts, and each part is coded by the nearest entry
of its position's codebook. Codebooks start as the parts of the vectors with the smallest keys and are
refined by rounds of assigning and averaging, all in whole numbers.

The nearest entry comes from a geometric near-neighbour access tree (GNAT) over the entries of a position:
a node has split points, every other entry of the node belongs to its nearest split point, and for each
split point and each such group the least and largest distance between them are stored. A query's distance
to one split point then rules out each group whose whole range is further away than the best entry so far.
Ranges and distances are rounded outward to whole numbers and a group goes only if its bound is strictly
greater, so what ties stays and is settled by exact integer distances, then by the lower index.

Vectors stay where they are: every round is one map over them that gives a sum per part and entry and task.
The driver sees codebooks only: `entries` times the width of a vector.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from assay.llm.frames import written
from assay.llm.topk import quantized

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SPLITS = 8
# Distances are held in units of 1 / UNIT; their squares, times UNIT squared, stay below 2**62.
UNIT = 16
SQUARE_BITS = 52
STEP_ROWS = 4096


def floor_root(squares: np.ndarray) -> np.ndarray:
    """The whole part of the square root of whole numbers below 2**62, exactly."""
    root = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    root -= root * root > squares
    root += (root + 1) * (root + 1) <= squares
    return root


def rounded(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances in units, rounded down and up, of squared distances."""
    scaled = squares * (UNIT * UNIT)
    low = floor_root(scaled)
    return low, low + (low * low < scaled)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of `a` to `b`."""
    gap = a - b
    return np.einsum("...i,...i->...", gap, gap)


@dataclass
class Node:
    """Split points by index, the distance ranges of each to each group, and the groups' own trees."""

    splits: list[int]
    low: np.ndarray
    high: np.ndarray
    below: list[Node | None] = field(default_factory=list)


class Tree:
    """The access tree over the rows of `entries`."""

    def __init__(self, entries: np.ndarray, splits: int = SPLITS):
        self.entries = entries
        self.n_splits = splits
        self.root = self._node(list(range(len(entries)))) if len(entries) else None

    def _node(self, members: list[int]) -> Node:
        points = self.entries[members]
        # Split points: the first member, then always the one furthest from those chosen.
        chosen = [0]
        near = squared(points, points[0])
        while len(chosen) < min(self.n_splits, len(members)):
            near[chosen] = -1
            chosen.append(int(np.argmax(near)))
            near = np.minimum(near, squared(points, points[chosen[-1]]))
        to_split = np.stack([squared(points, points[c]) for c in chosen])
        owner = np.argmin(to_split, axis=0)
        owner[chosen] = np.arange(len(chosen))
        low, high = (np.zeros((len(chosen), len(chosen)), np.int64) for _ in range(2))
        below: list[Node | None] = []
        for j, centre in enumerate(chosen):
            group = np.flatnonzero(owner == j)
            rest = group[group != centre]
            for i in range(len(chosen)):
                # What is left of a split point's own group once its distance is known is the rest.
                held = rest if i == j and len(rest) else group
                down, up = rounded(to_split[i, held])
                low[i, j], high[i, j] = down.min(), up.max()
            below.append(self._node([members[m] for m in rest]) if len(rest) else None)
        return Node([members[c] for c in chosen], low, high, below)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each query's nearest entry, ties to the lower index."""
        n = len(queries)
        best, index = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        waiting = [(self.root, np.arange(n))]
        while waiting:
            node, rows = waiting.pop()
            alive = np.ones((len(rows), len(node.splits)), bool)
            for i, entry in enumerate(node.splits):
                at = np.flatnonzero(alive[:, i])
                if not len(at):
                    continue
                asked = rows[at]
                far = squared(queries[asked], self.entries[entry])
                nearer = (far < best[asked]) | ((far == best[asked]) & (entry < index[asked]))
                best[asked[nearer]], index[asked[nearer]] = far[nearer], entry
                down, up = rounded(far)
                bound = np.maximum(down[:, None] - node.high[i], node.low[i] - up[:, None])
                alive[at] &= (bound <= 0) | (bound * bound <= (best[asked] * (UNIT * UNIT))[:, None])
            waiting += [
                (child, rows[alive[:, j]]) for j, child in enumerate(node.below) if child and alive[:, j].any()
            ]
        return index, best


def limit_of(width: int) -> int:
    """The largest component for which squared distances of whole vectors stay exact."""
    return math.isqrt(2**SQUARE_BITS // max(width, 1))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers, filled up with zeros and cut to the exact range."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    limit = limit_of(width)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = np.clip(values, -limit, limit)
    return out


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, STEP_ROWS):
            yield batch.slice(start, STEP_ROWS)


def _sums(kept: DataFrame, books: np.ndarray) -> list:
    """Count and componentwise sums per part and entry of what each entry is nearest to."""
    parts, entries, wide = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(book) for book in books]
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, wide), np.int64)
        for batch in _steps(batches):
            rows = _matrix(batch.column(0), parts * wide).reshape(-1, parts, wide)
            for p, tree in enumerate(trees):
                index, _ = tree.nearest(np.ascontiguousarray(rows[:, p]))
                counts[p] += np.bincount(index, minlength=entries)
                np.add.at(sums[p], index, rows[:, p])
        p, e = np.nonzero(counts)
        columns = [p, e, counts[p, e], *sums[p, e].T]
        names = ["part", "entry", "n", *[f"s{i}" for i in range(wide)]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    schema = ", ".join(f"{c} bigint" for c in ("part", "entry", "n", *[f"s{i}" for i in range(wide)]))
    totals = [F.sum(F.col(f"s{i}").cast("decimal(20,0)")).alias(f"s{i}") for i in range(wide)]
    return kept.select("v").mapInArrow(run, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect()


def train(kept: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (part, entry, component) of `kept` (key, v)."""
    first = kept.orderBy(F.col("key").asc_nulls_last(), "v").select("v").limit(entries).collect()
    limit = limit_of(width)
    books = np.zeros((len(first), width), np.int64)
    for n, row in enumerate(first):
        books[n, : len(row["v"])] = [max(-limit, min(limit, x)) for x in row["v"]]
    books = np.ascontiguousarray(books.reshape(len(first), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        for row in _sums(kept, books):
            books[row["part"], row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(books.shape[2])]
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = 256,
) -> DataFrame:
    """`key`, `label`, `code`, `error`, `label_error` and `codebooks_sha256` of every vector kept.

    Vectors that are null or hold a null or a component that is not finite go. Codes are two hex digits a
    part; `error` is the squared distance to the coded vector, `label_error` its sum over rows of one
    label, null labels together. Codebooks start from the `entries` smallest keys (null keys last, rows of
    one key by their vectors), or from all rows if there are fewer; repeated rows count each for itself and
    stay as rows. Shorter vectors count as if filled up with zeros to the longest one, and that to a
    multiple of `parts`; vectors without components have zeros alone. Components beyond
    `limit_of(width)` (some 2**23 at 64 components) are cut to it, so that every distance is exact. Ties
    go to the lower index. An empty table gives an empty one. Columns of other names are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's index has two hex digits: 1 to 256 entries")
    kept = vectors.select(
        F.col(key).alias("key"), F.col(label).alias("label"), quantized(F.col(vector), scale).alias("v")
    ).where(F.col("v").isNotNull())
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    width = parts * max(1, -(-(longest or 0) // parts))
    books = train(kept, width, parts, entries, rounds) if longest is not None else np.zeros((parts, 0, 1), np.int64)
    wide = width // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Tree(book) for book in books]
        digits = np.array([f"{n:02x}" for n in range(256)])
        for batch in _steps(batches):
            rows = _matrix(batch.column(2), width).reshape(-1, parts, wide)
            error = np.zeros(len(rows), np.int64)
            code = np.empty((len(rows), parts), "U2")
            for p, tree in enumerate(trees):
                index, far = tree.nearest(np.ascontiguousarray(rows[:, p]))
                error += far
                code[:, p] = digits[index]
            joined = code.view(f"U{2 * parts}").ravel().tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(joined, pa.string()), pa.array(error, pa.int64())],
                names=["key", "label", "code", "error"],
            )

    schema = StructType(
        [*kept.schema.fields[:2], StructField("code", StringType()), StructField("error", LongType())]
    )
    coded = written(kept.mapInArrow(run, schema), "vector-codes")
    by_label = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label"))).select(
        F.col("key").alias(key), F.col("label").alias(label), "code", "error", "label_error",
        F.lit(digest(books)).alias("codebooks_sha256"),
    )
