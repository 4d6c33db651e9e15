"""Suffix sorting and removal of repeated byte strings against a direct version."""

import hashlib

import numpy as np
import pytest

import assay.llm.suffix as S
from tests.llm.frames import ODD, documents


@pytest.mark.parametrize("size", [0, 1, 2, 50, 3000])
@pytest.mark.parametrize("letters", [1, 2, 60])
def test_two_stage_order(size, letters):
    data = np.random.default_rng(size).integers(1, 1 + letters, size).astype(np.uint8)
    order, text = S.two_stage_order(data, 10), data.tobytes()
    assert sorted(order.tolist()) == list(range(size))
    held = [text[p : p + 10] for p in order]
    assert held == sorted(held)
    if size:
        shared = S.common_prefixes(data, order, 16)
        for n, common in enumerate(shared[:50].tolist()):
            a, b = text[order[n] :], text[order[n + 1] :]
            assert a[:common] == b[:common] and (common == 16 or a[: common + 8] != b[: common + 8])


def direct(docs, length=100):
    seen, out = set(), {}
    for key, text in sorted(docs):
        data = (text or "").encode()
        covered = np.zeros(len(data) + 1, int)
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                covered[p] += 1
                covered[p + length] -= 1
            seen.add(window)
        gone = np.cumsum(covered[:-1]) > 0
        rest = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
        out[key] = (len(data), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest())
    return out


def corpus():
    rng = np.random.default_rng(1)
    phrase = "a common phrase that is fairly long and stands in many documents, again and again, wherever one looks "
    docs = []
    for n in range(90):
        numbers = " ".join(map(str, rng.integers(0, 99, int(rng.integers(0, 90)))))
        docs.append((n, "abc " * int(rng.integers(0, 80)) + phrase * int(rng.integers(0, 3)) + numbers))
    return [*docs, (500, docs[3][1]), (501, ""), (502, "é" * 300), (503, "x" + "é" * 300), (504, "z" * 99), (505, "z" * 101)]


@pytest.mark.parametrize("limit", [S.LIMIT, 2])
def test_against_a_direct_version(spark, monkeypatch, limit):
    monkeypatch.setattr(S, "LIMIT", limit)
    docs = corpus()
    got = S.remove_repeats(documents(spark, docs)).collect()
    want = direct(docs)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:5] for r in S.remove_repeats(docs).collect()}
    assert got == direct([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark):
    text = " ".join(f"a{n}b" for n in range(80))
    docs = documents(spark, [*ODD, (30, text), (30, text), (30, text + " and more of it"), (None, text), (None, text)])
    got = S.remove_repeats(docs).collect()
    assert len(got) == len(ODD) + 5
    by = sorted((r.n_bytes, r.n_removed) for r in got if r.doc_id == 30)
    n = len(text)
    assert by == [(n, 0), (n, 0), (n + 15, 0)]  # one place in the order, so none is earlier
    assert [(r.n_bytes, r.n_removed) for r in got if r.doc_id is None and r.n_bytes > n - 1] == [(n, n), (n, n)]
    assert S.remove_repeats(documents(spark, [])).count() == 0
