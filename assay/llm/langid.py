"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. An n-gram is bound by
multiplying its letters' vectors, each rotated by its place; a text is the sum (bundle) of its n-grams,
and a language is the sum of its texts. The predicted language has the prototype with the largest cosine.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.frames import sliced

DIMENSIONS = 512
GRAM = 3
SEED = 17
UNDETERMINED = "und"
# One prototype a language comes to the driver and goes to every task: 4 KB each. More language
# values than this are taken for a wrong column and raise.
MAX_LANGUAGES = 10_000
# Texts bundled together inside a task; tables of one block are of this order.
BLOCK_CHARS = 1 << 20
DENSE_CODES = 1 << 24


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


@lru_cache(maxsize=1 << 15)
def letter_vector(code: int, dimensions: int, seed: int) -> np.ndarray:
    """The random vector of a letter; code 0 is the gap between words."""
    draws = np.random.Generator(np.random.PCG64([seed, code])).integers(0, 2, dimensions, dtype=np.int8)
    return (2 * draws - 1).astype(np.int8)


def _codes(text: str) -> np.ndarray:
    """Lower-case letters as code points, each run of other characters as one gap (0), gaps at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.where(_letters()[points], points, 0)
    points = np.concatenate(([0], points, [0]))
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0)
    return points[keep]


class Block:
    """The n-grams of some texts: their columns, their bound vectors, and the columns of each text."""

    def __init__(self, texts: list[str], dimensions: int, seed: int, gram: int = GRAM):
        codes = [_codes(t) for t in texts]
        alphabet = np.unique(np.concatenate([np.unique(c) for c in codes])) if codes else np.zeros(0, np.int64)
        size = max(1, len(alphabet))
        grams = []
        for c in codes:
            ids = np.searchsorted(alphabet, c)
            n = max(0, len(ids) - gram + 1)
            code = np.zeros(n, np.int64)
            for k in range(gram):
                code = code * size + ids[k : k + n]
            grams.append(code)
        flat = np.concatenate(grams) if grams else np.zeros(0, np.int64)
        if size**gram <= DENSE_CODES:
            seen = np.zeros(size**gram, bool)
            seen[flat] = True
            self.distinct = np.flatnonzero(seen)
            place = np.zeros(size**gram, np.int32)
            place[self.distinct] = np.arange(len(self.distinct))
            self.columns = [place[g] for g in grams]
        else:
            self.distinct = np.unique(flat)
            self.columns = [np.searchsorted(self.distinct, g) for g in grams]
        base = np.stack([letter_vector(int(c), dimensions, seed) for c in alphabet]) if len(alphabet) else None
        vectors, rest = np.ones((len(self.distinct), dimensions), np.int8), self.distinct
        for k in range(gram):  # the last letter is not rotated, the one before by one place, and so on
            rest, letter = np.divmod(rest, size)
            if base is not None:
                vectors *= np.roll(base, k, axis=1)[letter]
        self.vectors = vectors.astype(np.float32)

    def bundle(self, text: int) -> np.ndarray:
        counts = np.bincount(self.columns[text], minlength=len(self.distinct))
        used = np.flatnonzero(counts)
        return counts[used].astype(np.float32) @ self.vectors[used]

    def bundle_all(self, texts: list[int]) -> np.ndarray:
        counts = np.bincount(np.concatenate([self.columns[t] for t in texts]), minlength=len(self.distinct))
        return counts.astype(np.float64) @ self.vectors


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    return sliced(batches, "text", limit)


def learn_prototypes(
    docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED
) -> dict[str, np.ndarray]:
    """The summed vector of every language. Sums are added up inside each task first, so what is
    shuffled is one vector for each task and language, whatever the share of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in blocks(batches):
            block = Block(batch.column(0).to_pylist(), dimensions, seed)
            by_lang: dict[str, list[int]] = {}
            for n, value in enumerate(batch.column(1).to_pylist()):
                by_lang.setdefault(value, []).append(n)
            for value, members in by_lang.items():
                sums[value] = sums.get(value, 0) + block.bundle_all(members)
        for value, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([value] * dimensions, pa.string()), pa.array(range(dimensions), pa.int32()), pa.array(total)],
                names=["lang", "place", "total"],
            )

    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")
    )
    parts = rows.mapInArrow(run, "lang string, place int, total double")
    summed = parts.groupBy("lang", "place").agg(F.sum("total").alias("total"))
    limit = MAX_LANGUAGES * dimensions
    found = summed.limit(limit + 1).toArrow()
    if found.num_rows > limit:
        raise ValueError(f"more than {MAX_LANGUAGES} values in {lang!r}: this is no column of languages")
    out: dict[str, np.ndarray] = {}
    for value, place, total in zip(*(found.column(n).to_pylist() for n in ("lang", "place", "total"))):
        out.setdefault(value, np.zeros(dimensions))[place] = total
    return dict(sorted(out.items()))


def identify(
    docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang",
    dimensions: int = DIMENSIONS, seed: int = SEED,
) -> DataFrame:
    """`key`, `held_out`, `lang_pred`, `score` of every text, one row per row of `docs`.

    `learn` marks the rows whose `lang` may be read (never null); the others are `held_out`. `score` is
    the cosine with the best prototype, cut to 0 to 1; ties go to the smaller name. A text that is null
    or has no letter is `und` with score 0, and so is every text where there is nothing to learn from.
    Repeated rows are predicted each; columns of other names are not read.
    """
    prototypes = learn_prototypes(docs.where(learn), text, lang, dimensions, seed)
    names = list(prototypes)
    matrix = np.stack(list(prototypes.values())) if names else np.zeros((0, dimensions))
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = matrix / np.where(norms == 0, 1, norms)
    kind = dict(docs.select(key).dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            block = Block(texts, dimensions, seed)
            found, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            for n, columns in enumerate(block.columns):
                if not names or not len(columns):  # a text with a letter has two gaps and so an n-gram
                    continue
                vector = block.bundle(n).astype(np.float64)
                length = np.linalg.norm(vector)
                cosines = matrix @ vector / length if length else np.zeros(len(names))
                best = int(np.argmax(np.round(cosines, 12)))  # the last bits depend on the row
                found[n], scores[n] = names[best], float(min(1.0, max(0.0, cosines[best])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                names=["key", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col(key).alias("key"), (~learn).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("key", key)
