"""Toxicity: the automaton against edit distances, learning, context, and what it may not look at."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assay.llm.frames import learns, table
from assay.llm.toxicity import LevenshteinAutomaton, Lexicon, fit, toxicity
from tests.llm.frames import ODD, documents


def distance(a, b):
    """Edits with swaps of neighbours."""
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7), st.integers(0, 2))
def test_automaton_accepts_what_is_near(word, other, limit):
    automaton = LevenshteinAutomaton(word, limit)
    state = automaton.start()
    for char in other:
        state = automaton.step(state, char)
    found, true = automaton.edits(state), distance(word, other)
    assert found == (true if true <= limit else None)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10), st.integers(0, 10), st.sampled_from("sinortc"), st.integers(0, 3), st.integers(0, 3))
def test_no_form_is_passed_over(p, q, char, first, second):
    """Every form within the allowed edits is found, swaps across the pieces included."""
    entry = "disgusting"

    def edit(word, at, kind):
        at = min(at, len(word) - 1)
        return [word[:at] + char + word[at:], word[:at] + word[at + 1 :], word[:at] + char + word[at + 1 :],
                word[:at] + word[at + 1 : at + 2] + word[at : at + 1] + word[at + 2 :]][kind]

    form = edit(edit(entry, p, first), q, second)
    wanted = distance(entry, form) <= 2
    assert (Lexicon({entry: 1.0}).nearest(form) is not None) == wanted


LEXICON = Lexicon({"scoundrel": 1.0, "rogue": 1.0, "knave*": 0.8, "vile": 1.0}, frozenset({"rogues"}))


@pytest.mark.parametrize(
    "token, weight",
    [("scoundrel", 1.0), ("Scoundrel!!".lower(), 1.0), ("scuondrel", 0.7), ("scondrl", 0.7), ("sc0undr3l", 0.7), ("rogeu", 0.7),
     ("rogues", 0.0), ("knaveish", 0.8), ("vil", 0.0), ("vile,", 1.0), ("village", 0.0), ("", 0.0), ("x" * 500, 0.0)],
)
def test_forms_of_words(token, weight):
    assert LEXICON.weight(token) == pytest.approx(weight)


def test_quotation_counts_less_than_abuse():
    abuse = LEXICON.strength("you are a rogue and a scoundrel")
    assert abuse == 2.0
    assert LEXICON.strength('the word "rogue" is old') < 0.5 and LEXICON.strength("he said rogue to them") < 0.5
    assert LEXICON.strength("well “rogue” it is") < 0.5


def test_curve_rises():
    strength = np.array([0.0] * 90 + [1.0] * 5 + [3.0] * 5)
    beta = fit(strength, (strength > 0).astype(float))
    assert beta[1] > 0


def test_held_out_accuracy_and_no_leak(spark, sf_dir):
    docs, labels, learn = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learns("doc_id", 3, 1)
    got = {r.doc_id: r for r in toxicity(docs, labels, learn).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in truth if got[i].held_out]
    assert sum(got[i].predicted == truth[i] for i in held) / len(held) > 0.93
    assert not any(got[i].predicted and not truth[i] for i in held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    flipped = labels.withColumn("toxic", F.when(learn, F.col("toxic")).otherwise(1 - F.col("toxic")))
    blind = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("q"))
    again = {r.doc_id: r for r in toxicity(blind, flipped, learn).collect()}
    assert all(again[i].score == pytest.approx(got[i].score) for i in got)


def test_odd_rows(spark):
    draw = random.Random(1)
    words = [f"plain{n}" for n in range(50)]
    rows = [(100 + n, " ".join(draw.choices(words, k=20)) + (" rogue" if n % 4 == 0 else "")) for n in range(200)]
    labels = spark.createDataFrame(
        [(100 + n, int(n % 4 == 0)) for n in range(200)] + [(1, None), (2, 0), (2, 0), (9, 7), (None, 1)], "doc_id bigint, toxic int"
    ).selectExpr("*", "'x' AS text", "'x' AS key")
    docs = documents(spark, [*rows, *ODD, (50, "a ROGUE!"), (51, "a rgoue")])
    got = toxicity(docs, labels, learns("doc_id", 3, 1)).collect()
    assert len(got) == len(rows) + len(ODD) + 2
    scores = {r.doc_id: r.score for r in got}
    assert scores[2] == scores[3] == min(scores.values()) < 0.3 and scores[50] > scores[51] > scores[3]
    nothing = toxicity(docs, labels.limit(0), learns("doc_id", 3, 1)).collect()
    assert {r.score for r in nothing} == {0.0}
    assert toxicity(documents(spark, []), labels, learns("doc_id", 3, 1)).count() == 0
