"""Stored answers: asked once, failures apart, runs that can be carried on."""

from assay.operators import answers as S


def frame(spark, prompts):
    return spark.createDataFrame(list(enumerate(prompts)), "id int, prompt string").repartition(3)


def test_each_prompt_is_asked_once(spark, tmp_path):
    store, calls = str(tmp_path / "store"), spark.sparkContext.accumulator(0)
    df = frame(spark, ["a", "b", "a", None, "c", "a"])

    def model(texts):
        calls.add(len(texts))
        return "<" + texts + ">"

    assert S.answered(df, store).where("answer IS NOT NULL").count() == 0
    S.ask_open(df, model, store, callers=2)
    assert calls.value == 3
    S.ask_open(df.union(frame(spark, ["d"])), model, store)
    assert calls.value == 4
    assert {(r.prompt, r.answer) for r in S.answered(df, store).collect()} == {("a", "<a>"), ("b", "<b>"), ("c", "<c>"), (None, None)}


def test_failing_prompts_are_stored_with_their_error_and_asked_again(spark, tmp_path):
    store = str(tmp_path / "store")
    df = frame(spark, [f"p{n}" for n in range(20)])

    def down(texts):
        if texts.isin(["p3", "p7"]).any():
            raise ValueError("down")
        return [None if t == "p9" else t.upper() for t in texts]

    S.ask_open(df, down, store, callers=2, batch=5)
    errors = {r.error for r in spark.read.parquet(store).where("error IS NOT NULL").collect()}
    assert errors == {"ValueError: down", "no answer"}
    assert sorted(r.prompt for r in S.open_prompts(df, store).collect()) == ["p3", "p7", "p9"]
    S.ask_open(df, lambda texts: texts.str.upper(), store)
    assert S.open_prompts(df, store).isEmpty() and {r.answer for r in S.answered(df, store).collect()} == {f"P{n}" for n in range(20)}
    # An answer that was stored twice counts once, the earliest.
    spark.read.parquet(store).where("error IS NULL").selectExpr("prompt_id", "'late' AS answer", "error", "asked_at + interval 1 day AS asked_at").write.mode("append").parquet(store)
    assert S.answered(df, store).where("answer = 'late'").isEmpty() and S.answered(df, store).count() == 20
