"""Rule evaluation: metrics per partition in one aggregate, then pass or fail per rule."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.severity import uniqueness_severity
from assay.functions.text import partition_text

RULE_SCHEMA = (
    "rule_id int, rule_type string, column string, op string, lo double, hi double, rule_text string"
)
RESULT_SCHEMA = (
    "array<struct<rule_id:int,rule:string,rule_type:string,column:string,state:string,"
    "evaluated_metrics:map<string,double>,description:string>>"
)


@dataclass(frozen=True)
class Rule:
    """One row of the rule table."""

    rule_id: int
    rule_type: str
    column: str | None = None
    op: str | None = None
    lo: float | None = None
    hi: float | None = None
    rule_text: str = ""

    @property
    def keys(self) -> tuple[str, ...]:
        """The columns of a rule that names several, as `a","b`."""
        return tuple(re.split(r'"\s*,\s*"', self.column)) if self.column else ()


# The ruleset of the trip table.
TRIP_RULES = (
    'Completeness "tpep_pickup_datetime" >= 0.98',
    'Completeness "tpep_dropoff_datetime" >= 0.98',
    'Completeness "passenger_count" >= 0.70',
    'Completeness "trip_distance" >= 0.98',
    'Completeness "fare_amount" >= 0.98',
    "RowCount > 100000",
    'Mean "fare_amount" between 5 and 100',
    'Mean "trip_distance" between 0.5 and 50',
    'ColumnExists "tpep_pickup_datetime"',
    'ColumnExists "tpep_dropoff_datetime"',
    'ColumnExists "passenger_count"',
    'ColumnExists "fare_amount"',
    'ColumnExists "trip_distance"',
)


# The forms of a rule line. Types with a column, types with a comparison.
COLUMN_TYPES = ("Completeness", "Mean", "ColumnExists", "DataFreshness", "ColumnValues")
PLAIN_TYPES = ("RowCount",)
_NUMBER = r"([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
_BOUND = rf"(?:(>=|<=|>|<|=)\s*{_NUMBER}|between\s+{_NUMBER}\s+and\s+{_NUMBER})"
_LINE = (
    rf'^\s*(?:((?:{"|".join(t for t in COLUMN_TYPES if t != "ColumnExists")}))\s+"([^"]+)"\s+{_BOUND}'
    rf'|(ColumnExists)\s+"([^"]+)"|({"|".join(PLAIN_TYPES)})\s+{_BOUND})\s*,?\s*$'
)
# The further forms of a ruleset: rows told apart by one or several columns, a schema against its baseline.
KEYED_TYPE, SCHEMA_TYPE = "Uniqueness", "SchemaMatch"
_SET_LINE = (
    rf'^\s*(?:({KEYED_TYPE})\s+"([^"]+(?:"\s*,\s*"[^"]+)*)"\s+{_BOUND}|({SCHEMA_TYPE})\s+"([^"]+)")\s*,?\s*$'
)


def rule_fields(text: Column, ruleset: bool = False) -> list[Column]:
    """rule_type, column, op, lo, hi and error of a rule line.

    The whole line has to match a form; one that does not has `error` set and all else null, so that
    nothing is read out of a part of it. `ruleset` adds the forms that `rulesets.evaluate` knows.
    """

    def part(*groups: int, of_set: Sequence[int] = ()) -> Column:
        found = [F.regexp_extract(text, _LINE, g) for g in groups]
        found += [F.regexp_extract(text, _SET_LINE, g) for g in of_set if ruleset]
        return F.coalesce(*[F.nullif(f, F.lit("")) for f in found])

    low = part(5, 12, of_set=[5])
    lone = part(4, 11, of_set=[4])
    known = text.rlike(_LINE) | text.rlike(_SET_LINE) if ruleset else text.rlike(_LINE)
    return [
        part(1, 7, 9, of_set=[1, 7]).alias("rule_type"),
        part(2, 8, of_set=[2, 8]).alias("column"),
        F.coalesce(part(3, 10, of_set=[3]), F.when(low.isNotNull(), "between")).alias("op"),
        F.coalesce(lone, low).try_cast("double").alias("lo"),
        part(6, 13, of_set=[6]).try_cast("double").alias("hi"),
        F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("not a rule: "), F.coalesce(text, F.lit("null")))).alias("error"),
    ]


def rules_from_text(lines: DataFrame, text: str = "rule_text", ruleset: bool = False) -> DataFrame:
    """A table of rule lines with the rule columns, and `error` where a line is no rule, beside the text."""
    fields = rule_fields(F.col(text), ruleset)
    return lines.select(*[c for c in lines.columns if c != text], *fields, F.col(text).alias("rule_text"))


def load_rules(spark: SparkSession, lines: Sequence[str], ruleset: bool = False) -> list[Rule]:
    """Rule objects of a ruleset's lines; a line that is no rule raises. A ruleset is configuration: a few lines."""
    frame = spark.createDataFrame(list(enumerate(lines, 1)), "rule_id int, rule_text string")
    rows = [row.asDict() for row in rules_from_text(frame, ruleset=ruleset).orderBy("rule_id").collect()]
    errors = [row.pop("error") for row in rows]
    if wrong := [e for e in errors if e]:
        raise ValueError("; ".join(wrong))
    return [Rule(**row) for row in rows]


def read_ruleset(spark: SparkSession, path: str, ruleset: bool = False) -> list[Rule]:
    """The rules of a ruleset file: one rule per line between the brackets."""
    lines = [row["value"].strip().rstrip(",") for row in spark.read.text(path).collect()]
    return load_rules(spark, [line for line in lines if line and not line.endswith(("[", "]"))], ruleset)


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [(r.rule_id, r.rule_type, r.column, r.op, r.lo, r.hi, r.rule_text) for r in rules]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def named(column: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def completeness(column: str) -> Column:
    return F.count(named(column)) / F.nullif(F.count(F.lit(1)), F.lit(0))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def freshness_hours(column: str, as_of: Column) -> Column:
    """Hours between a reference time and the newest value."""
    return (micros(as_of) - micros(F.max(named(column)))) / F.lit(3.6e9)


def outside(column: str, lo: float, hi: float) -> Column:
    return (named(column) < lo) | (named(column) > hi)


def _metric(rule: Rule, columns: Sequence[str], as_of: Column | None) -> tuple[str | None, Column]:
    """Metric key and aggregate of one rule; a column that is not there gives a null metric."""
    null = F.lit(None).cast("double")
    if rule.rule_type == "RowCount":
        return "Dataset.RowCount", F.count(F.lit(1)).cast("double")
    there = rule.column in columns
    if rule.rule_type == "ColumnExists":
        return None, F.max(F.lit(1.0 if there else 0.0))
    c = rule.column
    if rule.rule_type == "Completeness":
        return f"Column.{c}.Completeness", completeness(c) if there else F.max(null)
    if rule.rule_type == "Mean":
        return f"Column.{c}.Mean", F.avg(named(c)) if there else F.max(null)
    if rule.rule_type == "DataFreshness":
        if as_of is None:
            raise ValueError(f"{rule.rule_text!r} needs as_of: freshness is not measured by the wall clock")
        return f"Column.{c}.Freshness.Hours", freshness_hours(c, as_of) if there else F.max(null)
    if rule.rule_type == "ColumnValues":
        ratio = F.count_if(outside(c, rule.lo, rule.hi)) / F.nullif(F.count(named(c)), F.lit(0)) if there else F.max(null)
        return f"Column.{c}.OutlierRatio", ratio
    if rule.rule_type in (KEYED_TYPE, SCHEMA_TYPE):
        raise ValueError(f"{rule.rule_text!r} is a rule of rulesets.evaluate")
    raise ValueError(f"no such rule type: {rule.rule_text!r}")


def _text(value: str | None) -> str:
    """A SQL literal."""
    if value is None:
        return "cast(null as string)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _passes(rule: Rule, metric: str, inclusive: bool) -> str:
    """SQL condition of a rule on its metric; a null metric does not pass."""
    if rule.rule_type == "ColumnExists":
        test = f"{metric} = 1D"
    elif rule.rule_type == SCHEMA_TYPE:
        test = f"cardinality({metric}) = 0"
    elif rule.rule_type == "ColumnValues":
        test = f"{metric} = 0D"
    elif rule.op == "between":
        lower, upper = (">=", "<=") if inclusive else (">", "<")
        test = f"{metric} {lower} {float(rule.lo)!r}D and {metric} {upper} {float(rule.hi)!r}D"
    elif rule.op in (">=", ">", "<=", "<", "="):
        test = f"{metric} {rule.op} {float(rule.lo)!r}D"
    else:
        raise ValueError(f"no such comparator: {rule.rule_text!r}")
    return f"coalesce({test}, false)"


def _result(rule: Rule, metric_key: str | None, metric: str, inclusive: bool) -> str:
    """SQL struct of one rule's result, from its metric's column."""
    passed = _passes(rule, metric, inclusive)
    metrics = f"map({_text(metric_key)}, {metric})" if metric_key else "cast(null as map<string,double>)"
    if rule.rule_type == SCHEMA_TYPE:
        metrics = metric
    return (
        f"named_struct('rule_id', {rule.rule_id}, 'rule', {_text(rule.rule_text)}, "
        f"'rule_type', {_text(rule.rule_type)}, 'column', {_text(','.join(rule.keys) or None)}, "
        f"'state', if({passed}, 'PASSED', 'FAILED'), 'evaluated_metrics', {metrics}, "
        f"'description', if({passed}, '', {_text('not met: ' + rule.rule_text)}))"
    )


def evaluate(
    df: DataFrame,
    rules: Sequence[Rule],
    by: Sequence[str],
    table: str,
    database: str = "lake",
    as_of: Column | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """One row per partition, with all rule results in an array.

    All rules share one hash aggregate over the columns they name, so a partition that holds a
    third of the rows is combined map-side like any other, and one scan answers the ruleset.
    `as_of` may use the partition columns. `inclusive` concerns the bounds of `between`.
    """
    metrics = [_metric(rule, df.columns, as_of) for rule in rules]
    grouped = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        *[aggregate.alias(f"m_{i}") for i, (_, aggregate) in enumerate(metrics)],
    )
    return evaluation_rows(grouped, rules, [key for key, _ in metrics], by, table, database, inclusive)


def evaluation_rows(
    grouped: DataFrame, rules: Sequence[Rule], metric_keys: Sequence[str | None], by: Sequence[str], table: str,
    database: str = "lake", inclusive: bool = True,
) -> DataFrame:
    """Evaluations from one row per partition with `row_count` and the metric of rule i in `m_i`."""
    results = [_result(rule, key, f"m_{i}", inclusive) for i, (rule, key) in enumerate(zip(rules, metric_keys))]
    out = grouped.select(
        *by,
        F.lit(database).alias("database"),
        F.lit(table).alias("table_name"),
        partition_text(list(by)).alias("partition"),
        "row_count",
        F.expr(f"array({', '.join(results)})").cast(RESULT_SCHEMA).alias("rule_results"),
    )
    failed = F.exists("rule_results", lambda r: r["state"] == "FAILED")
    return out.withColumn("overall_state", F.when(failed, "FAILED").otherwise("PASSED")).withColumn(
        "evaluation_id", F.md5(F.concat_ws("#", "database", "table_name", "partition").cast("binary"))
    )


def rule_results(evaluations: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per evaluation and rule."""
    return evaluations.select("evaluation_id", "table_name", "partition", *keep, F.inline("rule_results"))


def single_metric(metrics: Column) -> Column:
    """The value of a metric map that holds one entry."""
    return F.get(F.map_values(metrics), F.lit(0))


def column_profile(df: DataFrame, column: str, lo: float, hi: float, by: Sequence[str]) -> DataFrame:
    """Outliers of one column per partition: count, ratio, smallest and largest value found."""
    return df.groupBy(*by).agg(
        F.count(column).alias("value_count"),
        F.count_if(outside(column, lo, hi)).alias("outlier_count"),
        (F.count_if(outside(column, lo, hi)) / F.nullif(F.count(column), F.lit(0))).alias("outlier_ratio"),
        F.min(column).alias("min_found"),
        F.max(column).alias("max_found"),
    )


def uniqueness(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Share of rows per partition that repeat an earlier row's key, with its severity.

    The only rule that shuffles by key. Two plain aggregates: the first counts per key and is
    combined map-side, so a key that fills a third of the table reaches the shuffle as one row
    per task; the second sees one row per distinct key.
    """
    groups = df.groupBy(*by, *[k for k in keys if k not in by]).agg(F.count(F.lit(1)).alias("copies"))
    share = F.lit(1.0) - F.col("distinct_rows") / F.col("row_count")
    return (
        groups.groupBy(*by)
        .agg(F.sum("copies").alias("row_count"), F.count(F.lit(1)).alias("distinct_rows"))
        .withColumn("duplicate_share", share)
        .withColumn("severity", F.coalesce(uniqueness_severity(F.col("duplicate_share")), F.lit("OK")))
    )


def schema_columns(df: DataFrame, database: str, table: str) -> DataFrame:
    """(database, table_name, name, type) of a frame's own schema."""
    rows = [(database, table, f.name, f.dataType.simpleString()) for f in df.schema]
    return df.sparkSession.createDataFrame(rows, "database string, table_name string, name string, type string")


def schema_drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Columns that differ between two (database, table_name, name, type) frames.

    Removed and retyped columns are CRITICAL, added ones WARNING.
    """
    on = ["database", "table_name", "name"]
    both = baseline.select(*on, F.col("type").alias("old_type")).join(
        current.select(*on, F.col("type").alias("new_type")), on, "full_outer"
    )
    change = (
        F.when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type").isNull(), "added")
        .when(F.col("old_type") != F.col("new_type"), "retyped")
    )
    return (
        both.withColumn("change", change)
        .where(F.col("change").isNotNull())
        .withColumn("severity", F.when(F.col("change") == "added", "WARNING").otherwise("CRITICAL"))
    )


def missing_columns(required: Sequence[str], df: DataFrame) -> DataFrame:
    """Required columns that a frame lacks, by its schema alone."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(c,) for c in required], "name string")
    return wanted.join(spark.createDataFrame([(c,) for c in df.columns], "name string"), "name", "left_anti")


def calibrate(
    metrics: DataFrame, by: Sequence[str], value: str = "value", quantile: float = 0.0, margin: float = 0.02
) -> DataFrame:
    """Thresholds from a metric's own past: a low quantile over clean partitions, less a margin.

    `metrics` holds one row per partition and metric, so the exact percentile is cheap.
    """
    return metrics.groupBy(*by).agg(
        F.count(value).alias("partitions"),
        (F.percentile(value, F.lit(quantile)) - margin).alias("threshold"),
    )


def row_count_check(counts: DataFrame, share: float) -> DataFrame:
    """Partitions whose `row_count` exceeds a share of the median over all partitions.

    The median is a scalar subquery over one row per partition.
    """
    median = counts.agg(F.percentile("row_count", F.lit(0.5))).scalar()
    return counts.withColumn("threshold", F.lit(share) * median).withColumn(
        "passed", F.col("row_count") > F.col("threshold")
    )
