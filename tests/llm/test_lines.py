"""Line dedup against a direct version."""

import random

from assay.llm.lines import dedup_lines
from tests.llm.frames import ODD, documents


def direct(docs, window=3):
    """Kept lines per document, documents in order of their keys."""
    seen, out = set(), {}
    for key, text in sorted(docs):
        lines, gone = text.split("\n"), set()
        for n in range(len(lines) - window + 1):
            held = tuple(lines[n : n + window])
            if held in seen:
                gone.update(range(n, n + window))
            seen.add(held)
        out[key] = "\n".join(line for n, line in enumerate(lines) if n not in gone)
    return out


def test_against_a_direct_version(spark):
    draw = random.Random(4)
    docs = [(n, "\n".join(draw.choice("abc") for _ in range(draw.randint(1, 12)))) for n in range(150)]
    docs += [(500, "x\nx\nx\nx\nx\nx"), (501, "head\nx\nx\nx\ntail"), (502, "\n\n\n\n"), (503, "q\nr\n")]
    got = dedup_lines(documents(spark, docs)).collect()
    want = direct(docs)
    assert {r.doc_id: r.text for r in got} == want
    for r in got:
        before = dict(docs)[r.doc_id].count("\n") + 1
        assert r.n_lines == before and r.lang == "en" and r.lines == "x"
        assert r.n_removed == before - (r.text.count("\n") + 1 if r.n_removed < before else 0)


def test_odd_rows(spark):
    docs = documents(spark, [*ODD, (10, "a\nb\nc"), (10, "a\nb\nc"), (10, "z\na\nb\nc"), (11, "a\r\nb\nc"), (None, "a\nb\nc")])
    got = dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"] and got.count() == len(ODD) + 5
    texts = {(r.doc_id, r.n_lines): r.text for r in got.collect()}
    assert texts[2, 0] is None and texts[3, 1] == "" and texts[None, 3] == ""
    # One of two texts under a key comes first; repeated rows lose nothing to each other.
    assert {texts[10, 3], texts[10, 4]} in ({"a\nb\nc", "z"}, {"", "z\na\nb\nc"})
    assert dedup_lines(documents(spark, [])).count() == 0
    plain = dedup_lines(docs, counts=("_a", "_b"))
    assert plain.columns == [*docs.columns, "_a", "_b"]


def test_names_of_the_user_are_free(spark):
    docs = documents(spark, [(1, "a\nb\nc"), (2, "a\nb\nc\nd")], extra=False).selectExpr(
        "*", *[f"'mine' AS {n}" for n in ("_places", "_key", "_text_hash", "_lines", "_kept", "places", "text_hash", "kept", "no_key")]
    )
    got = dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    assert {(r.doc_id, r.text, r._kept, r.kept, r.places) for r in got.collect()} == {(1, "a\nb\nc", *["mine"] * 3), (2, "d", *["mine"] * 3)}
