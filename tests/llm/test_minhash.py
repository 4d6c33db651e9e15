"""DartMinHash signatures and near-duplicate classes against all pairs."""

import random
import re

import numpy as np
import pytest

from assay.llm.minhash import band_keys, near_duplicates, one_of_each, rare_pairs, shingle_sets, signatures
from tests.llm.frames import ODD, documents


def test_agreement_is_the_weighted_similarity():
    rng, k = np.random.default_rng(1), 128
    errors = []
    for _ in range(60):
        n = int(rng.integers(3, 300))
        elements = rng.integers(0, 2**63, n, dtype=np.uint64)
        a, b = rng.integers(1, 9, n).astype(float), rng.integers(1, 9, n).astype(float)
        table = signatures(np.concatenate([elements, elements]), np.concatenate([a, b]), np.array([n, n]), k)
        errors.append((table[0] == table[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07


def test_signatures_do_not_depend_on_the_block():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 400, 40)
    elements, ends = rng.integers(0, 2**63, sizes.sum(), dtype=np.uint64), np.cumsum(sizes)
    together = signatures(elements, np.ones(len(elements)), sizes, 96)
    assert (together > 0).all()
    for n in (0, 7, 39):
        own = elements[ends[n] - sizes[n] : ends[n]]
        assert (signatures(own, np.ones(len(own)), sizes[n : n + 1], 96)[0] == together[n]).all()
    assert band_keys(together, 24, 4).shape == (40, 24)


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def classes(docs, similarity=0.8):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in docs if (w := words(t))}
    label = {i: i for i, _ in docs}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {i: root(i) for i in label}


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(3)
    make = lambda n: [f"w{draw.randint(0, 400)}" for _ in range(n)]
    docs, key = [], 0
    for size, copies, edits in ((120, 60, 2), (80, 30, 4), (300, 40, 9), (30, 20, 1), (10, 15, 1)):
        base = make(size)
        for _ in range(copies):
            text = list(base)
            for _ in range(draw.randint(0, edits)):
                text[draw.randrange(size)] = f"x{draw.randint(0, 10**6)}"
            docs.append((key, " ".join(text)))
            key += 1
    for _ in range(60):
        docs.append((key, " ".join(make(draw.randint(1, 150)))))
        key += 1
    draw.shuffle(docs)
    return docs


def test_classes_against_all_pairs(spark, corpus):
    got = {r.doc_id: r.class_id for r in near_duplicates(documents(spark, corpus)).collect()}
    assert got == classes(corpus)


def test_one_of_each_stays(spark, corpus):
    docs = documents(spark, corpus)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes(corpus).values()))


def test_odd_rows(spark):
    more = [*ODD, (20, "ONE two, three: four five six seven!"), (None, "a text without a key, and a few words more")]
    got = near_duplicates(documents(spark, more)).collect()
    assert len(got) == len(more)
    by = {r.doc_id: r for r in got}
    assert by[1].class_id == by[8].class_id == by[20].class_id == 1
    assert by[2].class_id == 2 and by[3].class_id == 3 and by[4].class_id == 4 and by[5].raw is None
    kept = [(r.doc_id, r.text) for r in one_of_each(documents(spark, more)).collect()]
    assert [i for i, _ in kept].count(1) == 1 and not {8, 20} & {i for i, _ in kept}
    assert len([t for i, t in kept if i is None]) == 2  # one with words, one null
    assert near_duplicates(documents(spark, [])).count() == 0 and one_of_each(documents(spark, [])).count() == 0


def test_pairs_within_a_crowd_of_less_similar_texts(spark):
    draw, docs = random.Random(5), []
    for family in range(2):
        shared = [f"f{family}w{n}" for n in range(100)]
        for member in range(70):
            own = [f"x{draw.randint(0, 10**9)}" for _ in range(13)]
            docs.append((len(docs), " ".join(shared + own)))  # 96 of 122 shingles with any other
            if member < 30:  # 97 of 121 with this one
                docs.append((len(docs), " ".join(shared + own[:1] + [f"y{draw.randint(0, 10**9)}" for _ in range(12)])))
    expected = classes(docs)
    assert len(set(expected.values())) == len(docs) - 60
    got = {r.doc_id: r.class_id for r in near_duplicates(documents(spark, docs)).collect()}
    assert got == expected


def test_two_texts_under_one_key_are_two_nodes(spark):
    a, b = (" ".join(f"{c}{n}" for n in range(30)) for c in "ab")
    docs = documents(spark, [(5, a), (5, b), (1, b + " more"), (7, "nothing like it at all here")] + [(None, b)] * 3)
    got = sorted((r.doc_id is None, r.doc_id, r.class_id) for r in near_duplicates(docs).collect())
    assert got == [(False, 1, 1), (False, 5, 1), (False, 5, 5), (False, 7, 7), *[(True, None, 1)] * 3]
    kept = sorted((r.doc_id, r.text) for r in one_of_each(docs).collect())
    assert kept == sorted([(1, b + " more"), (5, a), (7, "nothing like it at all here")])


def test_names_of_the_user_are_free(spark):
    names = ("_words", "_h1", "_key", "_w1", "_worded", "row", "key", "raw", "of_key", "copies", "id", "bucket", "component")
    docs = documents(spark, [(1, "one two three four five six"), (2, "one two three four five six"), (3, None)], extra=False)
    docs = docs.selectExpr("*", *[f"'mine' AS {n}" for n in names])
    kept = one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert {r.component for r in kept.collect()} == {"mine"}


def test_rare_pairs_miss_none_and_skip_the_crowd(spark):
    draw = random.Random(9)
    sets = {}
    for family in range(3):
        shared = [draw.randrange(2**60) for _ in range(draw.choice([40, 90, 150]))]
        for member in range(60):
            own = [draw.randrange(2**60) for _ in range(round(len(shared) * draw.choice([0.02, 0.1, 0.14, 0.3])))]
            sets[len(sets)] = shared[: len(shared) - draw.choice([0, 0, 5])] + own
    for n in range(20):
        sets[len(sets)] = [draw.randrange(40) for _ in range(1)] + [1000 + n // 2]
    component = {i: i - i % draw.choice([1, 1, 2, 7]) for i in sets}
    nodes = spark.createDataFrame(list(component.items()), "id bigint, component bigint")
    held = spark.createDataFrame([(i, sorted(set(x))) for i, x in sets.items()], "id bigint, shingles array<bigint>")
    got = {tuple(sorted((r.a, r.b))) for r in rare_pairs(nodes, held, 0.8).collect()}
    want, near = set(), 0
    for a in sets:
        for b in range(a):
            x, y = set(sets[a]), set(sets[b])
            if component[a] != component[b] and len(x & y) >= 0.8 * len(x | y):
                want.add((b, a))
            near += len(x & y) >= 0.7 * len(x | y)
    assert want and want <= got and len(got) < near
    # All of a crowd just below the similarity: no pair at all.
    crowd = {n: list(range(96)) + [10**6 + 13 * n + k for k in range(13)] for n in range(300)}
    nodes = spark.createDataFrame([(n, n) for n in crowd], "id bigint, component bigint")
    held = spark.createDataFrame(list(crowd.items()), "id bigint, shingles array<bigint>")
    assert rare_pairs(nodes, held, 0.8).count() == 0


def test_words_are_no_key_of_a_shuffle(spark, corpus):
    docs = documents(spark, corpus)
    nodes = spark.createDataFrame([(1, (1, 2))], "id bigint, row struct<key:bigint,raw:bigint>")
    plan = shingle_sets(docs, nodes, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "split(" in line and ("Exchange" in line or "Join" in line)]
