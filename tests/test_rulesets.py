"""Rulesets with keys and schemas on small frames, and their plans."""

import pytest
from pyspark.sql import functions as F

from assay.operators import rules as R
from assay.operators import rulesets as S
from assay.operators.violations import scan_results, violations


def results(df, lines, by=("p",), **kw):
    spark = df.sparkSession
    out = S.evaluate(df, R.load_rules(spark, lines, ruleset=True), list(by), "t", **kw)
    return {(r.partition, r.rule): (r.state, r.evaluated_metrics) for r in R.rule_results(out).collect()}


def stored(spark, *versions):
    rows = [("lake", t, v, list(c.items())) for t, v, c in versions]
    return spark.createDataFrame(rows, "database string, table_name string, version int, columns array<struct<name:string,type:string>>")


def test_lines_of_a_ruleset(spark):
    rule = R.load_rules(spark, ['Uniqueness "a", "b c","d" >= 0.9'], ruleset=True)[0]
    assert (rule.rule_type, rule.keys, rule.op, rule.lo) == ("Uniqueness", ("a", "b c", "d"), ">=", 0.9)
    rule = R.load_rules(spark, ['  SchemaMatch "t",'], ruleset=True)[0]
    assert (rule.rule_type, rule.column) == ("SchemaMatch", "t")
    for wrong in ('Uniqueness "a" "b" > 1', 'Uniqueness "a"', "SchemaMatch t", 'Uniqueness "a", > 1'):
        with pytest.raises(ValueError):
            R.load_rules(spark, [wrong], ruleset=True)
    with pytest.raises(ValueError):
        R.load_rules(spark, ['Uniqueness "a" > 1'])


def test_chains():
    assert S.key_chains([("a",), ("b", "a"), ("a", "b", "c"), ("c", "a"), ("d",)]) == [
        [("a", "b", "c"), ("a", "b"), ("a",)], [("a", "c")], [("d",)],
    ]


def test_shares_of_rows_that_do_not_repeat(spark):
    rows = [("x", n % 9, n % 2, float(n)) for n in range(18)] + [("x", None, 1, 1.0)] * 2 + [("y", 1, 1, None)] + [(None, 1, 1, 2.0)] * 4
    df = spark.createDataFrame(rows, "p string, a int, b int, v double")
    lines = ['Uniqueness "a", "b" >= 0.95', 'Uniqueness "b" > 0.5', 'Uniqueness "v" >= 0.9', 'Completeness "v" >= 1', 'Mean "v" > 0', "RowCount > 2"]
    got = results(df, lines)
    assert got["p=x", lines[0]] == ("PASSED", {"Column.a,b.Uniqueness": 19 / 20})
    assert got["p=x", lines[1]] == ("FAILED", {"Column.b.Uniqueness": 2 / 20})
    assert got["p=x", lines[2]] == ("PASSED", {"Column.v.Uniqueness": 18 / 20})
    assert got["p=y", lines[3]] == ("FAILED", {"Column.v.Completeness": 0.0})
    nothing = next(k for k in got if k[1] == lines[0] and k[0] not in ("p=x", "p=y"))
    assert got[nothing][1] == {"Column.a,b.Uniqueness": 1 / 4} and got[nothing[0], lines[5]] == ("PASSED", {"Dataset.RowCount": 4.0})
    whole = results(df, lines, by=())
    assert whole[next(k for k in whole if k[1] == lines[5])] == ("PASSED", {"Dataset.RowCount": 25.0})


def test_row_wise_metrics_equal_those_without_keys(spark):
    df = spark.range(5000).selectExpr("id % 7 AS p", "id % 100 AS a", "if(id % 3 = 0, null, id * 0.5D) AS v", "timestamp_seconds(id) AS t")
    lines = ['Completeness "v" >= 0.98', 'Mean "v" between 0 and 5', 'ColumnValues "v" between 3 and 2000', 'DataFreshness "t" <= 1',
             'ColumnExists "v"', 'ColumnExists "w"', 'Mean "w" > 1', "RowCount > 714"]
    as_of = F.lit("1970-01-01 03:00:00").cast("timestamp")
    plain = R.rule_results(R.evaluate(df, R.load_rules(spark, lines), ["p"], "t", as_of=as_of))
    want = {(r.partition, r.rule): (r.state, r.evaluated_metrics) for r in plain.collect()}
    got = results(df, [*lines, 'Uniqueness "a" > 2'], as_of=as_of)
    assert {k: v for k, v in got.items() if not k[1].startswith("Uniq")} == want
    assert results(df, lines, as_of=as_of) == want


def test_severities(spark):
    def graded(repeats):
        df = spark.createDataFrame([(n,) for n in range(100 - repeats)] + [(0,)] * repeats, "a int")
        out = S.evaluate(df, R.load_rules(spark, ['Uniqueness "a" >= 0.99'], ruleset=True), [], "t")
        return [r.severity for r in violations(out).collect()], scan_results(out).first().overall_score

    assert [graded(n) for n in (0, 4, 7, 11)] == [([], 100), (["WARNING"], 90), (["WARNING"], 90), (["CRITICAL"], 80)]


def test_schemas_against_their_baselines(spark):
    df = spark.createDataFrame([("x", 1, 1.0)], "p string, a int, v double")
    now = {"p": "string", "a": "int", "v": "double"}
    older = stored(
        spark, ("same", 1, {"q": "int"}), ("same", 12, now), ("same", 3, {"q": "int"}), ("less", 1, {"p": "string", "a": "int"}),
        ("more", 1, {**now, "z": "int"}), ("typed", 1, {**now, "a": "bigint"}),
    )
    names = ("same", "less", "more", "typed", "none")
    rules = R.load_rules(spark, [f'SchemaMatch "{n}"' for n in names], ruleset=True)
    out = S.evaluate(df, rules, ["p"], "t", baselines=older)
    got = {r.column: (r.state, r.evaluated_metrics) for r in R.rule_results(out).collect()}
    assert got == {
        "same": ("PASSED", {}), "less": ("FAILED", {"Column.v.Added": 1.0}), "more": ("FAILED", {"Column.z.Removed": 1.0}),
        "typed": ("FAILED", {"Column.a.Retyped": 1.0}), "none": ("FAILED", None),
    }
    found = {r.rule: (r.type, r.severity, r.affected_columns) for r in violations(out).collect()}
    assert found['SchemaMatch "less"'] == ("schema", "WARNING", ["v"])
    assert found['SchemaMatch "more"'] == ("schema", "CRITICAL", ["z"]) and found['SchemaMatch "none"'][1:] == ("CRITICAL", ["none"])
    with pytest.raises(ValueError):
        S.evaluate(df, rules, ["p"], "t")


def test_one_scan_and_one_wide_shuffle(spark, tmp_path):
    spark.range(1000).selectExpr("id % 3 AS p", "id AS a", "id % 5 AS b", "id * 1.0 AS v", "'unread' AS u").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    rules = R.load_rules(spark, ['Uniqueness "a", "b" > 0', 'Uniqueness "a" > 0', 'Mean "v" > 0'], ruleset=True)
    plan = S.evaluate(df, rules, ["p"], "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Expand" not in plan and "Join" not in plan
    assert "u:string" not in plan and "partial_count" in plan
