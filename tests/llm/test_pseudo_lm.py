"""Pseudo-likelihood: scores against loops, gradients against differences, training against frequencies."""

import math
import random
from zlib import crc32

import numpy as np
import pytest

import assay.llm.pseudo_lm as L
from tests.llm.frames import ODD, documents


def direct(model, text):
    """The score by loops over the places of a text."""
    ids = [int(model.rank[crc32(w.encode()) % (L.BUCKETS - 1) + 1]) for w in text.lower().split()]
    p = model.params.astype(float)
    total = 0.0
    for at, word in enumerate(ids):
        state = np.zeros(L.HIDDEN)
        for j, step in enumerate((-2, -1, 1, 2)):
            near = ids[at + step] if 0 <= at + step < len(ids) else int(model.rank[0])
            state += p[j, :-1] * p[4 + near, :-1]
        state = np.append(np.tanh(state), 1.0)
        first_class = 4 + L.BUCKETS
        classes = p[first_class : first_class + 256] @ state
        first_word = first_class + 256 + 256 * (word // 256)
        words = p[first_word : first_word + 256] @ state
        total += classes[word // 256] - math.log(np.exp(classes).sum()) + words[word % 256] - math.log(np.exp(words).sum())
    return total


def mean(df):
    rows = df.collect()
    return sum(r.log_prob for r in rows) / sum(r.n_tokens for r in rows)


@pytest.fixture(scope="module")
def fitted(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs, L.fit(docs)


def test_scores_equal_loops(fitted):
    docs, model = fitted
    got = {r.doc_id: r for r in L.score(docs, model).collect()}
    for r in docs.limit(20).collect():
        assert got[r.doc_id].log_prob == pytest.approx(direct(model, r.text), rel=1e-5)
        assert got[r.doc_id].n_tokens == len(r.text.lower().split())


def test_probabilities_sum_to_one(fitted):
    _, model = fitted
    around = np.tile(np.array([[5, 900, 17, 40_000]]), (L.BUCKETS, 1))
    assert np.exp(L.log_probabilities(model.params, around, np.arange(L.BUCKETS))).sum() == pytest.approx(1, abs=1e-3)


def test_every_neighbour_word_bears_on_the_score(fitted):
    """Neighbours of one class are told apart, on either side and at either distance."""
    _, model = fitted
    around = np.full((5, 4), 10)
    around[[1, 2, 3, 4], [0, 1, 2, 3]] = 11
    assert len(set(np.round(L.log_probabilities(model.params, around, np.full(5, 3)), 6))) == 5


def test_held_out_texts_are_likelier_than_under_frequencies(fitted):
    docs, _ = fitted
    held = docs.where("doc_id % 5 = 0").cache()
    rest = docs.where("doc_id % 5 <> 0").cache()
    assert mean(L.score(held, L.fit(rest, one_in=2, passes=2))) > mean(L.score(held, L.fit(rest, rounds=0))) + 0.1


def test_gradient_equals_differences():
    rng = np.random.default_rng(3)
    _, params = L.untrained(rng.integers(0, 50, L.BUCKETS))
    params[L.CLASS.start :, :-1] = rng.normal(0, 0.3, (L.PARAMETERS - L.CLASS.start, L.HIDDEN))
    around, words, n = rng.integers(0, 600, (7, 4)), rng.integers(0, 600, 7), np.array([1, 2, 1, 5, 1, 1, 3])
    loss = lambda p: -(L.log_probabilities(p, around, words) * n / n.mean()).sum()
    moves = {}
    training = L.Training(params)
    training._move = lambda rows, gradient, seen: moves.update(
        {int(r): g for r, g in zip(np.arange(L.PARAMETERS)[rows], gradient)}
    )
    training.step(around, words, n)
    wide = params.astype(np.float64)
    asked = [0, 3, L.INPUT.start + int(around[2, 1]), L.CLASS.start + int(words[0]) // 256, L.WORD.start + int(words[3])]
    for row in asked:
        for column in (0, 9, L.HIDDEN - 1):
            up, down = wide.copy(), wide.copy()
            up[row, column] += 1e-5
            down[row, column] -= 1e-5
            assert moves[row][column] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=1e-3, abs=1e-4)


def test_both_sides_help(spark):
    draw = random.Random(1)
    rows = []
    for n in range(300):  # the middle word follows from both neighbours together
        words = []
        for _ in range(30):
            a, b = draw.choice("pq"), draw.choice("rs")
            words += [a, a + b, b]
        rows.append((n, " ".join(words)))
    docs = documents(spark, rows)
    trained, plain = L.score(docs, L.fit(docs, one_in=1, passes=40)), L.score(docs, L.fit(docs, rounds=0))
    assert mean(trained) > mean(plain) + 1


def test_windows_are_counted_over_all_texts(spark):
    docs = documents(spark, [(1, "a b c"), (2, "a b c"), (3, None), (4, "c")])
    got = L.masked_windows(docs, "text", 1).collect()
    assert sorted(r.n for r in got) == [1, 2, 2, 2]
    around = np.array([[1, 2, 3, 65_535], [65_535, 0, 9, 8]])
    assert np.array_equal(L.unpacked(L.packed(around)), around)


def test_order_of_rows_does_not_matter(spark):
    rows = [(n, f"a{n % 7} b{n % 3} c{n % 5} a{n % 2}") for n in range(200)]
    docs = documents(spark, rows)
    one, other = L.fit(docs, one_in=1), L.fit(docs.repartition(5).orderBy("text"), one_in=1)
    assert np.array_equal(one.rank, other.rank) and np.array_equal(one.params, other.params)


def test_shards_are_averaged(spark, monkeypatch):
    rows = [(n, f"a{n % 7} b{n % 3} c{n % 5} a{n % 2}") for n in range(200)]
    docs = documents(spark, rows)
    monkeypatch.setattr(L, "SHARD", 30)
    assert mean(L.score(docs, L.fit(docs, one_in=1, passes=20))) > mean(L.score(docs, L.fit(docs, rounds=0))) + 0.1


def test_odd_rows(spark):
    got = L.pseudo_likelihood(documents(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[2].n_tokens == by[3].n_tokens == by[4].n_tokens == 0 and by[2].log_prob == 0.0 and by[2].mean_log_prob is None
    assert by[6].n_tokens == 40_000 and math.isfinite(by[6].log_prob)
    assert by[1].log_prob == pytest.approx(by[8].log_prob, rel=1e-5) and by[1].log_prob < 0
    assert L.pseudo_likelihood(documents(spark, [])).count() == 0


def test_every_place_is_trained_on(spark):
    docs = documents(spark, [(n, " ".join(f"w{n}x{k}" for k in range(100))) for n in range(4)])
    assert sum(r.n for r in L.masked_windows(docs, "text", L.ONE_IN).collect()) == 400
    model, start = L.fit(docs, passes=2), L.fit(docs, rounds=0)
    used = model.rank[[crc32(f"w{n}x{k}".encode()) % (L.BUCKETS - 1) + 1 for n in range(4) for k in range(100)]]
    assert (model.params[L.INPUT][used] != start.params[L.INPUT][used]).any(axis=1).all()


class Counted(np.ndarray):
    """An array that counts the elements of wide rows, those of scores, which operations other than products go over."""

    wide = 0

    def __array_ufunc__(self, ufunc, method, *inputs, out=None, **more):
        plain = [x.view(np.ndarray) if isinstance(x, Counted) else x for x in inputs]
        if ufunc is not np.matmul and np.ndim(plain[0]) == 2 and plain[0].shape[1] == L.SIDE:
            Counted.wide += plain[0].size
        if out is not None:
            more["out"] = tuple(x.view(np.ndarray) if isinstance(x, Counted) else x for x in out)
        result = getattr(ufunc, method)(*plain, **more)
        return result.view(Counted) if isinstance(result, np.ndarray) else result


def test_scores_are_gone_over_once():
    rng, n = np.random.default_rng(5), 3000
    _, params = L.untrained(rng.integers(0, 50, L.BUCKETS))
    around, words = rng.integers(0, L.BUCKETS, (n, 4)), rng.integers(0, 1000, n)
    scores = 2 * n * L.SIDE  # of the classes, and of the words of a class
    training = L.Training(params)
    training.params = training.params.view(Counted)
    Counted.wide = 0
    training.step(around, words, np.ones(n, np.int64))
    assert scores <= Counted.wide < 2 * scores
    Counted.wide = 0
    L.log_probabilities(params.view(Counted), around, words)
    assert scores <= Counted.wide < 2 * scores


def test_large_scores_do_not_overflow():
    rng = np.random.default_rng(6)
    _, params = L.untrained(rng.integers(0, 50, L.BUCKETS))
    params[L.CLASS.start :, :-1] = rng.normal(0, 60, (L.PARAMETERS - L.CLASS.start, L.HIDDEN))
    around, words = rng.integers(0, L.BUCKETS, (300, 4)), rng.integers(0, L.BUCKETS, 300)
    wide = L.log_probabilities(params.astype(np.float64), around, words)
    assert L.log_probabilities(params, around, words) == pytest.approx(wide, rel=1e-3, abs=1e-2)
    training = L.Training(params)
    training.step(around, words, np.ones(300, np.int64))
    assert np.isfinite(training.params).all()


def test_buckets_are_checksums_of_words():
    for text in ("", " \n", "A b c\x1cd", "İX ΣΣ e\x00f \udc80", "a a  B"):
        words = [crc32(w.encode("utf-8", "surrogatepass")) % (L.BUCKETS - 1) + 1 for w in text.lower().split()]
        assert L.buckets(text).tolist() == words
