"""Language identification: held-out accuracy, and what it may not look at."""

import numpy as np
from pyspark.sql import functions as F

from assay.llm.frames import learns, table
from assay.llm.langid import identify, letter_vector
from tests.llm.frames import ODD, documents


def test_held_out_accuracy_and_no_leak(spark, sf_dir):
    docs, learn = table(spark, sf_dir, "documents"), learns("doc_id", 5, 0)
    got = {r.doc_id: r for r in identify(docs, learn).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in got if got[i].held_out]
    assert len(held) > 100 and sum(got[i].lang_pred == truth[i] for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    # Languages of held-out rows are not read.
    changed = docs.withColumn("lang", F.when(learn, F.col("lang")).otherwise("zz"))
    assert {r.doc_id: r for r in identify(changed, learn).collect()} == got


def test_odd_rows(spark):
    got = identify(documents(spark, ODD), F.coalesce(F.col("doc_id") != 7, F.lit(False))).collect()
    assert len(got) == len(ODD)
    texts = {r.doc_id: r for r in got if r.doc_id is not None}
    for n in (2, 3, 4, 5):
        assert (texts[n].lang_pred, texts[n].score) == ("und", 0.0)
    assert texts[1].lang_pred == texts[8].lang_pred == "en" and texts[7].held_out
    nothing = identify(documents(spark, ODD), F.lit(False)).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and all(r.held_out for r in nothing)
    assert identify(documents(spark, []), F.lit(True)).count() == 0


def test_ties_go_to_the_smaller_name(spark):
    same = documents(spark, [(n, "the same words", lang) for n, lang in enumerate(("b", "a", "c"))])
    assert {r.lang_pred for r in identify(same, F.lit(True)).collect()} == {"a"}


def direct_vector(text, dimensions, seed):
    """Sum of the bound letter vectors of all trigrams, letter by letter."""
    spaced, out = [0], np.zeros(dimensions, np.int64)
    for letter in text.lower():
        code = ord(letter) if letter.isalpha() else 0
        if code or spaced[-1]:
            spaced.append(code)
    if spaced[-1]:
        spaced.append(0)
    for n in range(len(spaced) - 2):
        bound = np.ones(dimensions, np.int64)
        for k, code in enumerate(spaced[n : n + 3]):
            bound *= np.roll(letter_vector(code, dimensions, seed).astype(np.int64), 2 - k)
        out += bound
    return out


def test_against_a_direct_version(spark, sf_dir):
    rows = [(r.doc_id, r.text[:400], r.lang) for r in table(spark, sf_dir, "documents").orderBy("doc_id").limit(150).collect()]
    rows += [(1000 + n, t, "xx") for n, t in enumerate(["北京 Ünï", "a", "ab cd", "1 2 3", "Ǆ ǅ x"])]
    learn, dimensions, seed = F.col("doc_id") % 3 != 0, 64, 5
    got = {r.doc_id: r for r in identify(documents(spark, rows), learn, dimensions=dimensions, seed=seed).collect()}
    own = {i: direct_vector(t, dimensions, seed) for i, t, _ in rows}
    sums = {}
    for i, _, lang in rows:
        if i % 3 and lang is not None:
            sums[lang] = sums.get(lang, 0) + own[i]
    for i, text, _ in rows:
        if not any(c.isalpha() for c in text):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        cosine = {lang: own[i] @ s / np.linalg.norm(own[i]) / np.linalg.norm(s) for lang, s in sums.items()}
        best = max(cosine.values())
        assert cosine[got[i].lang_pred] >= best - 1e-9 and abs(got[i].score - max(0.0, best)) < 1e-6
