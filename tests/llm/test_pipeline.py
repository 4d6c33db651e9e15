"""The pipeline: what each stage removes and keeps, on planted and on odd documents."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assay.llm.frames import written
from assay.llm.mixing import mix
from tests.llm.frames import ODD, documents
from tests.llm.test_lines import direct
from tests.llm.test_minhash import classes

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def planted(spark, sf_dir):
    """Clean documents, toxic ones, repeated passages, near copies and benchmark passages."""
    item = next(r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if len(r.text.split()) > 40)
    draw = random.Random(8)
    make = lambda n: " ".join("".join(draw.choices("bcdfgklmnprst", k=2)) + draw.choice("aeiou") * 2 for _ in range(n))
    passage = "\n".join(make(20) for _ in range(4))
    rows = [(n, "\n".join(make(15) for _ in range(6))) for n in range(40)]
    rows += [(100, make(30) + " you idiot pathetic moron " + make(30)), (101, make(10) + "\nworthless idiot\n" + make(10))]
    rows += [(200 + n, f"{make(12)}\n{passage}\n{make(12)}") for n in range(3)]
    rows += [(300 + n, make(5) + f". {item} " + make(9)) for n in range(3)]
    rows += [(400, rows[5][1].replace("\n", " ")), (401, rows[6][1].replace("\n", " ") + " tail")]
    return rows


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_toxic_documents_go(spark, sf_dir, planted):
    own = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = own.unionByName(documents(spark, planted, extra=False).withColumn("doc_id", F.col("doc_id") + 10**6))
    kept = set(ids(STAGES["toxicity"](spark, docs, sf_dir)))
    mine = {i for i, _ in planted}
    assert mine - {i - 10**6 for i in kept if i >= 10**6} == {100, 101}


def test_repeated_passages_go(spark, sf_dir, planted):
    docs = documents(spark, [*planted, (900, planted[0][1])])
    got = STAGES["line_dedup"](spark, docs, sf_dir)
    assert got.columns == docs.columns
    want = direct([*planted, (900, planted[0][1])])
    assert {r.doc_id: r.text for r in got.collect()} == {i: t for i, t in want.items() if i != 900}
    assert all(r.n_chars == len(r.text) for r in got.collect())


def test_one_of_each_class_stays(spark, sf_dir, planted):
    got = STAGES["minhash_near_dedup"](spark, documents(spark, planted), sf_dir)
    assert ids(got) == sorted(set(classes(planted).values())) and 400 not in ids(got)


def test_leaks_go(spark, sf_dir, planted):
    got = STAGES["benchmark_decontamination"](spark, documents(spark, planted), sf_dir)
    assert ids(got) == sorted(i for i, _ in planted if not 300 <= i < 303)


def test_run_equals_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, sf_dir), f"test-{name}")
        assert docs.columns == before.columns and 0 < docs.count()
        if name != "mixing":
            assert docs.count() <= before.count()
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(str, docs.collect()))


def test_the_mix_is_emitted(spark, sf_dir):
    rows = [(n, f"text {n} " * (1 + n % 5), "en", f"s{n % 3 if n % 4 else 0}") for n in range(300)]
    docs = documents(spark, [*rows, rows[0], rows[0], (None, "w", "en", None)])
    want, row = Counter(), F.struct("doc_id", F.xxhash64("text"), F.col("source").alias("of")).alias("row")
    for r in mix(docs.select(row, "text", "source"), key="row").collect():
        want[r.row.doc_id] += r.copies
    got = Counter(r.doc_id for r in STAGES["mixing"](spark, docs, sf_dir).collect())
    assert got == +want and max(got.values()) > 1 and any(r[0] not in got for r in rows)


@pytest.mark.parametrize("name", list(STAGES)[1:])
def test_names_of_the_user_are_free(spark, sf_dir, name):
    names = ("_row", "row", "leak", "whole", "own", "copies", "rows", "n_lines", "n_removed", "_lines_removed", "_key", "of")
    docs = documents(spark, [(1, "one two three"), (2, "four five six seven eight nine")], extra=False)
    docs = docs.selectExpr("*", *[f"'mine' AS {n}" for n in names])
    got = STAGES[name](spark, docs, sf_dir)
    assert got.columns == docs.columns and all(r.copies == r._row == "mine" for r in got.collect())


@pytest.mark.parametrize("name", list(STAGES))
def test_odd_rows(spark, sf_dir, name):
    docs = documents(spark, ODD)
    got = STAGES[name](spark, docs, sf_dir)
    assert got.columns == docs.columns
    if name == "mixing":
        assert got.count() > 0 and {r.text for r in got.collect()} <= {r.text for r in docs.collect()}
    else:
        assert got.count() == {"minhash_near_dedup": len(ODD) - 2}.get(name, len(ODD))
    assert STAGES[name](spark, documents(spark, []), sf_dir).count() == 0
