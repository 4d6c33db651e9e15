"""Toxicity by a learned lexicon, matched with Levenshtein automata on a trie.

Learning: of a bounded sample of labelled texts, words and word stems that toxic texts hold and others
do not become the lexicon. Matching: the words of a text run through the lexicon's trie together with the
word's Levenshtein automaton, which finds entries within a few edits; words that clean sample texts hold
are ordinary even if they resemble an entry. Every hit counts with its weight, less if it is a misspelling,
and much less if the words around it report or quote it. A logistic curve, fitted to the sample, turns the
sum into a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.frames import sliced, written

# Labelled rows that are learned from: those with the least hashes of their keys.
SAMPLE_ROWS = 20_000
LEAST_SUPPORT = 6
LEAST_LOG_ODDS = 4.0
STEMS = (3, 4, 5, 6, 7, 8)
THRESHOLD = 0.7
MISSPELLED, REPORTED = 0.7, 0.25
# Misspelled forms are looked for of entries with at least this weight (1 is the surest entry); what
# resembles a rarely seen entry is more often another word.
SURE = 0.85
CONTEXT = 6
QUOTES = "\"“”„«»‘’'"
REPORTING = frozenset(
    "said says say called calls calling wrote writes word words term terms quote quoted quoting insult insults slur slurs"
    " sagte nannte wort dit appelle mot dijo llama palabra".split()
)
REMEMBERED = 1_000_000
_STRIP = re.compile(r"^[^\w@$*]+|[^\w@$*]+$")


def edits_allowed(entry: str) -> int:
    return 0 if len(entry) < 5 else 1 if len(entry) < 9 else 2


class LevenshteinAutomaton:
    """Accepts the strings within `limit` edits of `word`; swapping two neighbours is one edit.

    A state is the set of (place, edits, swapping) reached; `swapping` is 1 between the two characters
    of a swap.
    """

    def __init__(self, word: str, limit: int):
        self.word, self.limit = word, limit
        self.memory: dict[tuple[frozenset, str], frozenset] = {}

    def _closed(self, states: set[tuple[int, int, int]]) -> frozenset:
        out = set(states)
        for place, edits, swapping in states:  # characters of the word that are left out
            if not swapping:
                out.update((place + n, edits + n, 0) for n in range(1, min(self.limit - edits, len(self.word) - place) + 1))
        return frozenset(out)

    def start(self) -> frozenset:
        return self._closed({(0, 0, 0)})

    def step(self, state: frozenset, char: str) -> frozenset:
        if (known := self.memory.get((state, char))) is not None:
            return known
        out, word = set(), self.word
        for place, edits, swapping in state:
            if swapping:
                if word[place] == char:
                    out.add((place + 2, edits, 0))
                continue
            if place < len(word) and word[place] == char:
                out.add((place + 1, edits, 0))
            if edits < self.limit:
                out.add((place, edits + 1, 0))
                if place < len(word):
                    out.add((place + 1, edits + 1, 0))
                if place + 1 < len(word) and word[place + 1] == char:
                    out.add((place, edits + 1, 1))
        self.memory[state, char] = closed = self._closed(out)
        return closed

    def edits(self, state: frozenset) -> int | None:
        return min((e for p, e, swapping in state if p == len(self.word) and not swapping), default=None)


def _lasting_pieces(entry: str, limit: int) -> list[str]:
    """Strings of which every form of `entry` within `limit` edits holds one: of limit + 1 pieces one stays
    whole, unless characters are swapped across cuts, and then the pieces beside them stay but for that."""
    if not limit:
        return []
    cut = [len(entry) * n // (limit + 1) for n in range(limit + 2)]
    out = [entry[a:b] for a, b in zip(cut, cut[1:])]
    for first in range(1, limit + 1):
        for last in range(first, limit + 1):
            chars = list(entry)
            for at in cut[first : last + 1]:
                chars[at - 1], chars[at] = chars[at], chars[at - 1]
            out.append("".join(chars[cut[first - 1] : cut[last + 1]]))
    return out


@dataclass
class Lexicon:
    """Words and stems (`word*`) with their weights, as a trie; ordinary words match nothing misspelled."""

    weights: dict[str, float]
    ordinary: frozenset = frozenset()
    known: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.stems = {e[:-1]: w for e, w in self.weights.items() if e.endswith("*")}
        self.stem_sizes = sorted({len(s) for s in self.stems})
        self.words = {e: w for e, w in self.weights.items() if not e.endswith("*")}
        self.trie: dict = {}
        pieces = set()
        for entry in (e for e, w in self.words.items() if w >= SURE):
            node = self.trie
            for char in entry:
                node = node.setdefault(char, {})
            node[""] = entry
            pieces.update(_lasting_pieces(entry, edits_allowed(entry)))
        self.near = re.compile("|".join(map(re.escape, sorted(pieces)))) if pieces else None

    def nearest(self, word: str) -> tuple[int, str] | None:
        """The entry with the fewest edits (ties to the smaller name) that the word may be a form of."""
        if not self.near or not self.near.search(word):
            return None
        automaton = LevenshteinAutomaton(word, 2)
        best, todo = None, [(self.trie, automaton.start())]
        while todo:
            node, state = todo.pop()
            for char, child in node.items():
                if char == "":
                    edits = automaton.edits(state)
                    if edits is not None and edits <= edits_allowed(child) and (best is None or (edits, child) < best):
                        best = (edits, child)
                elif after := automaton.step(state, char):
                    todo.append((child, after))
        return best

    def weight(self, token: str) -> float:
        """Weight of a token as it stands between white space; 0 if it matches nothing."""
        if (known := self.known.get(token)) is not None:
            return known
        word = _STRIP.sub("", token)
        found = self.words.get(word, 0.0)
        if not found:
            found = max((self.stems.get(word[:n], 0.0) for n in self.stem_sizes if len(word) >= n), default=0.0)
        if not found and 3 < len(word) < 64 and word not in self.ordinary and (near := self.nearest(word)):
            found = MISSPELLED * self.words[near[1]]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.known[token] = found
        return found

    def strength(self, text: str) -> float:
        """Sum of the weights of all hits of a whole text, by their context."""
        tokens = text.lower().split()
        get, weight = self.known.get, self.weight
        weights = [w if (w := get(t)) is not None else weight(t) for t in tokens]
        return sum(w * self._context(tokens, n) for n, w in enumerate(weights) if w)

    def _context(self, tokens: list[str], place: int) -> float:
        before = tokens[max(0, place - CONTEXT) : place]
        around = before + tokens[place : place + CONTEXT + 1]
        if any(_STRIP.sub("", t) in REPORTING for t in before):
            return REPORTED
        opened = any(t[0] in QUOTES for t in [*before, tokens[place]])
        closed = any(t.rstrip(".,;:!?")[-1:] in QUOTES and len(t) > 1 for t in around[len(before) :])
        return REPORTED if opened and closed else 1.0


def features(strength: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(strength)), np.log1p(4 * strength)], axis=1)


def fit(strength: np.ndarray, toxic: np.ndarray, ridge: float = 0.1, steps: int = 60) -> np.ndarray:
    """Coefficients of the logistic curve by Newton's method with a small ridge."""
    x, beta = features(strength), np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (toxic - p) - ridge * beta
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        change = np.linalg.solve(curve, slope)
        beta = beta + np.clip(change, -2, 2)
        if np.abs(change).max() < 1e-9:
            break
    return beta


@dataclass
class Model:
    lexicon: Lexicon
    beta: np.ndarray
    constant: float | None = None  # the score where there was nothing to tell apart

    def scores(self, texts: list[str | None]) -> list[float]:
        if self.constant is not None:
            return [self.constant] * len(texts)
        strength = np.array([self.lexicon.strength(t) if t else 0.0 for t in texts])
        return (1 / (1 + np.exp(-np.clip(features(strength) @ self.beta, -30, 30)))).tolist()


def _terms(text: str) -> set[str]:
    words = {_STRIP.sub("", t) for t in text.lower().split()} - {""}
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def _counted_terms(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in sliced(batches, "text"):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[toxic].update(_terms(text))
        for toxic, counter in enumerate(counts):
            if counter:
                n = len(counter)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(counter), pa.string()), pa.array([toxic] * n, pa.int32()), pa.array(list(counter.values()), pa.int64())],
                    names=["term", "toxic", "n"],
                )

    return sample.select("text", "toxic").mapInArrow(run, "term string, toxic int, n bigint")


def learn(
    docs: DataFrame, labels: DataFrame, learn_from: Column, key: str = "doc_id", text: str = "text", label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """The model from at most `sample_rows` labelled rows for which `learn_from` (over `key`) holds."""
    chosen = (
        labels.where(learn_from & F.col(label).isin(0, 1))
        .select(F.col(key).alias("key"), F.col(label).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("key"), "key", "toxic")
        .limit(sample_rows)
    )
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    # At most `sample_rows` pairs of numbers.
    sample = written(texts.join(F.broadcast(chosen), "key").select("text", "toxic"), "toxicity-sample")
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    if not clean or not toxic:
        return Model(Lexicon({}), np.zeros(2), float(toxic > 0))
    counted = _counted_terms(sample).groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("k1"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("k0"),
    )
    odds = F.log((F.col("k1") + 0.5) / (toxic + 1)) - F.log((F.col("k0") + 0.5) / (clean + 1))
    found = counted.withColumn("odds", odds).where((F.col("k1") >= LEAST_SUPPORT) & (F.col("odds") >= LEAST_LOG_ODDS))
    terms = {r["term"]: r["odds"] for r in found.collect()}  # bounded by the sample
    stems = {t[:-1] for t in terms if t.endswith("*")}

    def covered(term: str) -> bool:  # by a shorter stem
        word = term.rstrip("*")
        return any(word[:n] in stems for n in STEMS if n < len(word))

    # A stem that only ever was one word is that word.
    single = {t for t in terms if t.endswith("*") and sum(w.startswith(t[:-1]) for w in terms if not w.endswith("*")) == 1}
    stems -= {t[:-1] for t in single}
    kept = {t: o for t, o in terms.items() if t not in single and not covered(t)}
    top = max(kept.values(), default=1.0)
    weights = {t: max(0.5, o / top) for t, o in kept.items()}
    return _fitted(sample, Lexicon(_needed(sample, weights)))


def _needed(sample: DataFrame, weights: dict[str, float]) -> dict[str, float]:
    """The sure entries, and those others that enough toxic texts without a sure entry hold. A rare word
    of a toxic text that has many copies is not one of them."""
    sure = Lexicon({t: w for t, w in weights.items() if w >= SURE})
    others = [t for t, w in weights.items() if w < SURE]
    if not others:
        return weights

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in sliced(batches, "text"):
            for text in batch.column(0).to_pylist():
                if not any(sure.weight(t) for t in text.lower().split()):
                    counts.update(_terms(text).intersection(others))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"]
        )

    parts = sample.where("toxic = 1").select("text").mapInArrow(held, "term string, n bigint")
    found = parts.groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_SUPPORT).collect()
    return {t: w for t, w in weights.items() if w >= SURE} | {r["term"]: weights[r["term"]] for r in found}


def _fitted(sample: DataFrame, lexicon: Lexicon) -> Model:
    """Words of clean sample texts become ordinary, then the curve is fitted to the sample's sums."""

    def resembling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            words = {_STRIP.sub("", t) for text in batch.column(0).to_pylist() for t in text.lower().split()}
            near = [w for w in words if 3 < len(w) < 64 and w not in lexicon.words and lexicon.nearest(w)]
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.string())], names=["word"])

    clean = sample.where("toxic = 0").select("text").mapInArrow(resembling, "word string").distinct()
    model = Lexicon(lexicon.weights, frozenset(r["word"] for r in clean.collect()))

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            sums = [model.strength(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.float64()), batch.column(1)], names=["strength", "toxic"])

    rows = sample.select("text", "toxic").mapInArrow(strengths, "strength double, toxic int")
    # Few different sums: equal ones come as one row.
    table = rows.groupBy("strength", "toxic").count().orderBy("strength", "toxic").collect()
    strength = np.repeat([r["strength"] for r in table], [r["count"] for r in table])
    toxic = np.repeat([float(r["toxic"]) for r in table], [r["count"] for r in table])
    return Model(model, fit(strength, toxic))


def toxicity(
    docs: DataFrame, labels: DataFrame, learn_from: Column, key: str = "doc_id", text: str = "text", label: str = "toxic",
    threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """`key`, `held_out`, `score`, `predicted` of every text, one row per row of `docs`.

    `learn_from` is a condition on `key` (never null); rows without it are `held_out`, their labels are
    not read. A null or empty text has no hit and the lowest score. Without labels of both kinds every
    score is 0, or 1 if all labels are 1. Labels other than 0 and 1 are passed over; repeated rows are
    scored each, repeated labels count each. Columns of other names are not read.
    """
    model = learn(docs, labels, learn_from, key, text, label, sample_rows)
    kind = dict(docs.select(key).dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            scores = model.scores(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()),
                 pa.array([int(s >= threshold) for s in scores], pa.int32())],
                names=["key", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col(key).alias("key"), (~learn_from).alias("held_out"), F.col(text).alias("text"))
    schema = f"key {kind}, held_out boolean, score double, predicted int"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def without_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, with all their columns, whose texts score below `threshold`."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            scores = model.scores(batch.column(place).to_pylist())
            yield batch.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
