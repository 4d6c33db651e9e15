"""Masked pseudo-likelihood of texts with a bidirectional window network.

Every token is predicted from the two tokens on either side of it, itself left out. The vocabulary has no
unknown words: a word is one of 2^16 - 1 hash buckets, numbered by falling frequency, 256 of them to a class, and

    log P(token | window) = log P(class | window) + log P(token | class, window)

Both terms are softmaxes of one hidden layer: each neighbour's own embedding times a gate of its place, summed,
through tanh. So every neighbour word bears on every token's probability. Before training, the biases are the
corpus' frequencies and the weights are 0: the network starts as the unigram model.

Training hides every place of every text once and predicts it. Texts are split once, into a table of their
buckets, two bytes a token. Equal ones are one row with a count and are dealt by hash to shards of about SHARD
tokens; each shard makes the windows of its texts, equal ones one with a count, and trains a copy of the network
on all of them in numpy, in an order set by hashes. Spark averages the copies row by row, weighted by how much
each shard has seen of a row. What reaches the driver is one network of PARAMETERS rows. The order and the layout
of the documents do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.frames import sliced, written

BUCKETS = 1 << 16
SIDE = 256  # classes, and buckets of a class
OUTSIDE = 0  # the bucket of places outside the text
PLACES = (-2, -1, 1, 2)
HIDDEN, RATE, SEED = 16, 0.2, 11
ONE_IN, SHARD = 1, 1 << 21
LEAST, BATCH, STEPS = 1 << 12, 1 << 15, 64  # windows of a step, and steps of a shard that is not small
ROUNDS = 1
CHUNK, ROWS = 1 << 17, 1 << 9  # tokens scored at once, and of them in one product
SAFE = 80.0  # scores within it do not overflow as exponentials of 32 bits
# Rows of the network: gates of the places, embeddings of neighbours, classes, words within classes. The last
# column is the bias of the latter two.
GATES = slice(0, len(PLACES))
INPUT = slice(GATES.stop, GATES.stop + BUCKETS)
CLASS = slice(INPUT.stop, INPUT.stop + SIDE)
WORD = slice(CLASS.stop, CLASS.stop + BUCKETS)
PARAMETERS = WORD.stop


def buckets(text: str) -> np.ndarray:
    """The hash buckets of a text's words."""
    words = " ".join(text.lower().split()).encode("utf-8", "surrogatepass")
    return np.array([*map(crc32, words.split(b" "))] if words else [], np.int64) % (BUCKETS - 1) + 1


def neighbours(tokens: np.ndarray, outside: int) -> np.ndarray:
    """The tokens at PLACES around each token."""
    reach = PLACES[-1]
    padded = np.full(len(tokens) + 2 * reach, outside, np.int64)
    padded[reach : reach + len(tokens)] = tokens
    return np.stack([padded[reach + p : reach + p + len(tokens)] for p in PLACES], axis=1)


def _mixed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A hash of windows, in numpy's wrapping 64-bit arithmetic."""
    x = context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def packed(around: np.ndarray) -> np.ndarray:
    """Four 16-bit buckets as one 64-bit number."""
    out = np.zeros(len(around), np.uint64)
    for column in around.T:
        out = (out << np.uint64(16)) | column.astype(np.uint64)
    return out.view(np.int64)


def unpacked(context: np.ndarray) -> np.ndarray:
    bits = context.view(np.uint64)
    return np.stack([(bits >> np.uint64(s)) & np.uint64(0xFFFF) for s in (48, 32, 16, 0)], axis=1).astype(np.int64)


def untrained(counts: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The rank of every bucket, and the network that predicts by frequency alone."""
    order = np.lexsort((np.arange(BUCKETS), -counts))
    rank = np.empty(BUCKETS, np.int64)
    rank[order] = np.arange(BUCKETS)
    mass = (counts[order] + 1.0).reshape(SIDE, SIDE)
    of_class = mass.sum(axis=1)
    params = np.zeros((PARAMETERS, HIDDEN + 1), np.float32)
    rng = np.random.Generator(np.random.PCG64(seed))
    params[: INPUT.stop, :HIDDEN] = rng.normal(0, 0.5, (INPUT.stop, HIDDEN))
    params[CLASS, HIDDEN] = np.log(of_class / of_class.sum())
    params[WORD, HIDDEN] = np.log(mass / of_class[:, None]).ravel()
    return rank, params


def _hidden(params: np.ndarray, around: np.ndarray) -> np.ndarray:
    hidden = np.zeros((len(around), HIDDEN + 1), params.dtype)
    embeddings = params[INPUT]
    gates = np.repeat(params[GATES][:, None], min(ROWS, len(around)), axis=1)  # as wide as a block: one product, not one a row
    for at in range(0, len(around), ROWS):
        block = hidden[at : at + ROWS]
        for near, gate in zip(around[at : at + ROWS].T, gates):
            embedded = embeddings.take(near, axis=0)
            embedded *= gate[: len(near)]
            block += embedded
    np.tanh(hidden, out=hidden)
    hidden[:, HIDDEN] = 1  # the bias
    return hidden


def _bounded(weights: np.ndarray) -> bool:
    """Whether no hidden layer, its values being within 1, gives scores beyond SAFE."""
    return bool((np.abs(weights) @ np.ones(HIDDEN + 1, weights.dtype)).max() <= SAFE)


def _exponentials(scores: np.ndarray, bounded: bool) -> np.ndarray | None:
    """Puts exp of the scores in their place; rows that it shifts, as exp could overflow, are returned with their shifts."""
    shift = None if bounded or (scores.max() <= SAFE and scores.min() >= -SAFE) else scores.max(axis=1)
    if shift is not None:
        scores -= shift[:, None]
    np.exp(scores, out=scores)
    return shift


def _picked(hidden: np.ndarray, weights: np.ndarray, column: np.ndarray, bounded: bool) -> np.ndarray:
    """The log-softmax of one column of each row's scores."""
    out, ones = np.empty(len(hidden), hidden.dtype), np.ones(SIDE, hidden.dtype)
    for at in range(0, len(hidden), ROWS):
        block = slice(at, at + ROWS)
        scores = hidden[block] @ weights.T
        out[block] = scores[np.arange(len(scores)), column[block]]
        shift = _exponentials(scores, bounded)
        out[block] -= np.log(scores @ ones) if shift is None else np.log(scores @ ones) + shift
    return out


def _errors(
    hidden: np.ndarray, weights: np.ndarray, column: np.ndarray, share: np.ndarray, bounded: bool
) -> tuple[np.ndarray, np.ndarray]:
    """What the softmax less what is right, times each row's share, sends back to the hidden layer and the weights.

    Shares and sums of the softmax multiply the narrow hidden rows, not the wide rows of scores.
    """
    back, gradient, ones = np.empty_like(hidden), np.zeros_like(weights), np.ones(SIDE, hidden.dtype)
    for at in range(0, len(hidden), ROWS):
        block = slice(at, at + ROWS)
        error = hidden[block] @ weights.T
        _exponentials(error, bounded)
        sums = error @ ones
        error[np.arange(len(error)), column[block]] -= sums
        scale = share[block] / sums[:, None]
        np.multiply(error @ weights, scale, out=back[block])
        gradient += error.T @ (hidden[block] * scale)
    return back, gradient


def _by_class(words: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """The places of the words in order of class, and the classes among them, each with its part of that order."""
    classes = (words // SIDE).astype(np.uint8)
    order = np.argsort(classes, kind="stable")
    ends = np.cumsum(np.bincount(classes, minlength=SIDE))
    return order, [(c, slice(start, end)) for c, (start, end) in enumerate(zip([0, *ends], ends)) if start < end]


def log_probabilities(params: np.ndarray, around: np.ndarray, words: np.ndarray) -> np.ndarray:
    """log P(word | window) of ranks `words` with neighbours `around`."""
    out = np.empty(len(words))
    within, bounded = params[WORD].reshape(SIDE, SIDE, HIDDEN + 1), _bounded(params[CLASS.start :])
    for start in range(0, len(words), CHUNK):
        order, classes = _by_class(words[start : start + CHUNK])
        order += start
        hidden, own = _hidden(params, around[order]), words[order]
        log_p = _picked(hidden, params[CLASS], own // SIDE, bounded)
        for c, part in classes:
            log_p[part] += _picked(hidden[part], within[c], own[part] % SIDE, bounded)
        out[order] = log_p
    return out


class Training:
    """A copy of the network that one shard trains: Adagrad, and how much each row has been seen."""

    def __init__(self, params: np.ndarray):
        self.params, self.squares = params.copy(), np.ones_like(params)
        self.seen = np.zeros(len(params))

    def _move(self, rows, gradient: np.ndarray, seen) -> None:
        self.squares[rows] += gradient * gradient
        self.params[rows] -= RATE * gradient / np.sqrt(self.squares[rows])
        self.seen[rows] += seen

    def step(self, around: np.ndarray, words: np.ndarray, n: np.ndarray) -> None:
        """One step up the log-likelihood of windows that occurred `n` times."""
        order, classes = _by_class(words)
        around, words, n = around[order], words[order], n[order]
        share = (n / n.mean()).astype(np.float32)[:, None]
        hidden, bounded = _hidden(self.params, around), _bounded(self.params[CLASS.start :])
        back, of_classes = _errors(hidden, self.params[CLASS], words // SIDE, share, bounded)
        for c, part in classes:
            rows = slice(WORD.start + c * SIDE, WORD.start + (c + 1) * SIDE)
            of_hidden, of_words = _errors(hidden[part], self.params[rows], words[part] % SIDE, share[part], bounded)
            back[part] += of_hidden
            self._move(rows, of_words, n[part].sum())
        self._move(CLASS, of_classes, n.sum())
        back *= 1 - hidden * hidden
        back[:, HIDDEN] = 0
        self._move_inputs(around, back, n)

    def _move_inputs(self, around: np.ndarray, back: np.ndarray, n: np.ndarray) -> None:
        """Moves the gates and embeddings by what came `back` to the hidden layer."""
        gates, embeddings = self.params[GATES], self.params[INPUT]
        near, columns = np.ascontiguousarray(around.T), np.ascontiguousarray(back.T)
        of_gates = np.stack([np.einsum("ij,ij->j", back, embeddings.take(ids, axis=0)) for ids in near])
        ids, of_inputs = near.ravel(), np.zeros_like(embeddings)
        for k in range(HIDDEN):
            of_inputs[:, k] = np.bincount(ids, np.outer(gates[:, k], columns[k]).ravel(), BUCKETS)
        self._move(GATES, of_gates, n.sum())
        self._move(INPUT, of_inputs, np.bincount(ids, np.tile(n, len(PLACES)), BUCKETS))


@dataclass
class Model:
    rank: np.ndarray  # of each bucket by falling frequency
    params: np.ndarray

    def log_probabilities(self, texts: list[np.ndarray]) -> list[float]:
        """The summed log-probability of each text's buckets."""
        ranked = [self.rank[t] for t in texts]
        if not sum(map(len, ranked)):
            return [0.0] * len(texts)
        around = np.concatenate([neighbours(t, self.rank[OUTSIDE]) for t in ranked])
        each = np.cumsum(np.concatenate(([0.0], log_probabilities(self.params, around, np.concatenate(ranked)))))
        ends = np.cumsum([0, *map(len, ranked)])
        return (each[ends[1:]] - each[ends[:-1]]).tolist()


def _groups(texts: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """The texts, some at a time: enough to fill a chunk."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= CHUNK:
            yield group
            group, size = [], 0
    if group:
        yield group


def _tokens(column: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
    """The buckets of each text of a column of `bucketed`."""
    for value in column:
        yield np.frombuffer(value.as_buffer(), np.uint16).astype(np.int64)


def bucketed(docs: DataFrame, key: str | None, text: str) -> DataFrame:
    """`key` and `tokens` of every row of `docs`: its buckets, two bytes each; no text has none."""
    kind = dict(docs.select(key).dtypes)[key] if key else "int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            tokens = [buckets(t or "").astype(np.uint16).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.binary())], names=["key", "tokens"])

    rows = docs.select((F.col(key) if key else F.lit(None).cast("int")).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, tokens binary")


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs: added up in each task, then summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for group in _groups(_tokens(batch.column(0))):
                counts += np.bincount(np.concatenate(group), minlength=BUCKETS)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(counts[held])], names=["bucket", "n"])

    rows = texts.select("tokens").mapInArrow(run, "bucket int, n bigint")
    table = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    out = np.zeros(BUCKETS, np.int64)
    out[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return out


def _windows(texts: list[np.ndarray], one_in: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`context` and `word` of the windows whose hash hides their middle (all, if `one_in` is 1), that hash, and their text."""
    words = np.concatenate(texts)
    context = packed(np.concatenate([neighbours(t, OUTSIDE) for t in texts]))
    mixed = _mixed(context, words)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    hidden = slice(None) if one_in == 1 else mixed % np.uint64(one_in) == 0
    return context[hidden], words[hidden], mixed[hidden], text[hidden]


def masked_windows(docs: DataFrame, text: str, one_in: int = ONE_IN) -> DataFrame:
    """`context`, `word`, `n` of the windows that training hides, counted over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in _groups(_tokens(batch.column(0))):
                context, words, *_ = _windows(group, one_in)
                yield pa.RecordBatch.from_arrays([pa.array(context), pa.array(words.astype(np.int32))], names=["context", "word"])

    rows = bucketed(docs, None, text).select("tokens").mapInArrow(run, "context bigint, word int")
    return rows.groupBy("context", "word").agg(F.count("*").alias("n"))


def _shard_windows(table: pa.Table, one_in: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`context`, `word` and number of a shard's windows, equal ones as one, in an order set by their hashes."""
    copies, parts = table.column("n").to_numpy(), []
    at = 0
    for group in _groups(_tokens(table.column("tokens"))):
        context, words, mixed, text = _windows(group, one_in)
        parts.append((context, words.astype(np.uint16), mixed, copies[at + text]))
        at += len(group)
    context, words, mixed, n = (np.concatenate(column) for column in zip(*parts))
    order = np.argsort(mixed)
    same = np.flatnonzero(mixed[order[1:]] == mixed[order[:-1]])
    if ((context[order[same]] != context[order[same + 1]]) | (words[order[same]] != words[order[same + 1]])).any():
        order = np.lexsort((words, context, mixed))  # windows of one hash
    context, words, n = context[order], words[order].astype(np.int64), n[order]
    first = np.flatnonzero((np.diff(context, prepend=~context[:1]) != 0) | (np.diff(words, prepend=-1) != 0))
    return context[first], words[first], np.add.reduceat(n, first) if len(first) else n


def _trained(texts: DataFrame, shards: int, model: Model, one_in: int, passes: int) -> np.ndarray:
    """The network after each shard has gone over its windows, averaged."""
    values = [f"v{j}" for j in range(HIDDEN + 1)]

    def run(table: pa.Table) -> pa.Table:
        context, word, n = _shard_windows(table, one_in)
        size = min(BATCH, max(LEAST, len(word) // STEPS))
        training = Training(model.params)
        for _ in range(passes):
            for start in range(0, len(word), size):
                part = slice(start, start + size)
                training.step(model.rank[unpacked(context[part])], model.rank[word[part]], n[part])
        rows = np.flatnonzero(training.seen)
        columns = [pa.array(training.params[rows, j]) for j in range(HIDDEN + 1)]
        return pa.table([pa.array(rows.astype(np.int32)), pa.array(training.seen[rows]), *columns], names=["row", "seen", *values])

    schema = "row int, seen double, " + ", ".join(f"{v} float" for v in values)
    shard = F.pmod(F.xxhash64("tokens"), F.lit(shards)).cast("int")
    dealt = texts.where(F.length("tokens") > 0).withColumn("shard", shard).groupBy("shard", "tokens").agg(F.count("*").alias("n"))
    copies = dealt.groupBy("shard").applyInArrow(run, schema)
    means = copies.groupBy("row").agg(*[(F.sum(F.col(v) * F.col("seen")) / F.sum("seen")).cast("float").alias(v) for v in values])
    table = means.toArrow()  # PARAMETERS rows at most
    params = model.params.copy()
    params[table.column("row").to_numpy()] = np.stack([table.column(v).to_numpy() for v in values], axis=1)
    return params


def fit(docs: DataFrame, text: str = "text", one_in: int = ONE_IN, passes: int = 1, rounds: int = ROUNDS) -> Model:
    """The network trained on all texts; with `rounds` 0 the unigram model."""
    return fit_bucketed(written(bucketed(docs, None, text), "buckets"), one_in, passes, rounds)


def fit_bucketed(texts: DataFrame, one_in: int = ONE_IN, passes: int = 1, rounds: int = ROUNDS) -> Model:
    """`fit` on a table of `bucketed`."""
    counts = bucket_counts(texts)
    rank, params = untrained(counts)
    model = Model(rank, params)
    shards = 1 + int(counts.sum()) // SHARD
    for _ in range(rounds):
        model = Model(rank, _trained(texts, shards, model, one_in, passes))
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `n_tokens`, `log_prob`, `mean_log_prob` of every text, one row per row of `docs`.

    A null or empty text has no tokens, the sum 0 and a null mean. Repeated rows are scored each (equal texts
    may differ in the last digits of 32-bit arithmetic). Columns of other names are not read.
    """
    return score_bucketed(bucketed(docs, key, text), model, key)


def score_bucketed(texts: DataFrame, model: Model, key: str) -> DataFrame:
    """`score` on a table of `bucketed`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, sums = [], []
            for group in _groups(_tokens(batch.column(1))):
                tokens += map(len, group)
                sums += model.log_probabilities(group)
            means = [s / n if n else None for s, n in zip(sums, tokens)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens, pa.int64()), pa.array(sums, pa.float64()), pa.array(means, pa.float64())],
                names=["key", "n_tokens", "log_prob", "mean_log_prob"],
            )

    schema = f"key {dict(texts.dtypes)['key']}, n_tokens bigint, log_prob double, mean_log_prob double"
    return texts.select("key", "tokens").mapInArrow(run, schema).withColumnRenamed("key", key)


def pseudo_likelihood(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all texts under the network trained on all of them; see `fit` and `score`. Texts are split once."""
    texts = written(bucketed(docs, key, text), "buckets")
    return score_bucketed(texts, fit_bucketed(texts), key)
