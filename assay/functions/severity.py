"""Rule text → type and column; metrics → severity; counts → score and status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lines of severity and status.
MISSING_PCT_LINES = (5, 2)
STALE_HOURS_LINES = (72, 24)
OUTLIER_RATIO_LINE = 0.01
DUPLICATE_PCT_LINES = (10, 5)
CRITICAL_PENALTY, WARNING_PENALTY = 20, 10
STATUS_LINES = (50, 80)

FAILED_STATES = ("FAILED", "FAIL")


def classify_rule(text: Column) -> Column:
    """Violation type by substring, first match decides.

    The column name is part of the searched text, so a column called `freshness_x` counts as
    freshness; use the rule table's own type where that matters (`type_of_rule`).
    """
    low = F.lower(text)
    return (
        F.when(low.contains("completeness"), "completeness")
        .when(low.contains("freshness"), "freshness")
        .when(low.contains("columnvalues") | low.contains("between"), "distribution")
        .when(low.contains("columnexists"), "schema")
        .otherwise("unknown")
    )


def type_of_rule(rule_type: Column) -> Column:
    """Violation type from the rule table's type column instead of the rule text."""
    return (
        F.when(rule_type == "Completeness", "completeness")
        .when(rule_type == "DataFreshness", "freshness")
        .when(rule_type.isin("ColumnValues", "Mean"), "distribution")
        .when(rule_type == "Uniqueness", "uniqueness")
        .when(rule_type.isin("ColumnExists", "SchemaMatch"), "schema")
        .otherwise("unknown")
    )


def classify_line(text: Column) -> Column:
    """`classify_rule`, with the rules that only rulesets have told by the start of their line."""
    start = F.ltrim(text)
    return (
        F.when(start.startswith('Uniqueness "'), "uniqueness")
        .when(start.startswith('SchemaMatch "'), "schema")
        .otherwise(classify_rule(text))
    )


def extract_column(text: Column) -> Column:
    """The first quoted name, else `unknown`."""
    name = F.regexp_extract(text, '"([^"]+)"', 1)
    return F.when(name == "", "unknown").otherwise(name)


def _first_hit(metrics: Column, grade) -> Column:
    """The grade of the first metric that has one, in map order; none → WARNING."""
    grades = F.transform(F.map_entries(metrics), lambda e: grade(e["value"]))
    return F.coalesce(F.get(F.filter(grades, lambda g: g.isNotNull()), F.lit(0)), F.lit("WARNING"))


def _over(value: Column, lines: tuple) -> Column:
    return F.when(value > lines[0], "CRITICAL").when(value > lines[1], "WARNING")


def completeness_severity(metrics: Column) -> Column:
    return _first_hit(metrics, lambda v: _over((F.lit(1.0) - v) * 100, MISSING_PCT_LINES))


def freshness_severity(metrics: Column) -> Column:
    return _first_hit(metrics, lambda v: _over(v, STALE_HOURS_LINES))


def distribution_severity(metrics: Column) -> Column:
    """CRITICAL where any metric named like an outlier ratio is over the line.

    A Mean rule has no such metric and so is never CRITICAL.
    """
    over = F.exists(
        F.map_entries(metrics),
        lambda e: F.lower(e["key"]).contains("outlier") & (e["value"] > OUTLIER_RATIO_LINE),
    )
    return F.when(F.coalesce(over, F.lit(False)), "CRITICAL").otherwise("WARNING")


def uniqueness_severity(duplicate_share: Column) -> Column:
    return _over(duplicate_share * 100, DUPLICATE_PCT_LINES)


def uniqueness_metric_severity(metrics: Column) -> Column:
    """Of metrics that say which share of the rows does not repeat an earlier one."""
    return _first_hit(metrics, lambda v: uniqueness_severity(F.lit(1.0) - v))


def schema_severity(metrics: Column) -> Column:
    """WARNING where all that the metrics name are columns added, else CRITICAL."""
    names = F.map_keys(metrics)
    added = (F.size(names) > 0) & F.forall(names, lambda n: n.endswith(".Added"))
    return F.when(F.coalesce(added, F.lit(False)), "WARNING").otherwise("CRITICAL")


def severity(violation_type: Column, metrics: Column) -> Column:
    return (
        F.when(violation_type == "completeness", completeness_severity(metrics))
        .when(violation_type == "freshness", freshness_severity(metrics))
        .when(violation_type == "distribution", distribution_severity(metrics))
        .when(violation_type == "uniqueness", uniqueness_metric_severity(metrics))
        .when(violation_type == "schema", schema_severity(metrics))
        .otherwise("WARNING")
    )


def is_failed(state: Column) -> Column:
    return F.coalesce(F.upper(state).isin(*FAILED_STATES), F.lit(False))


def score(critical: Column, warning: Column) -> Column:
    """100 less 20 per CRITICAL and 10 per WARNING violation, at least 0."""
    loss = critical * CRITICAL_PENALTY + warning * WARNING_PENALTY
    return F.greatest(F.lit(0), F.lit(100) - loss).cast("bigint")


def status(score_column: Column) -> Column:
    """Note that one CRITICAL violation scores 80 and so is OK; see `needs_action`."""
    critical, warning = STATUS_LINES
    return (
        F.when(score_column < critical, "CRITICAL")
        .when(score_column < warning, "WARNING")
        .otherwise("OK")
    )


def compare(value: Column, op: Column, lo: Column, hi: Column, inclusive: bool = True) -> Column:
    """Does the metric satisfy the comparator? A null metric or an unknown comparator does not."""
    between = (value >= lo) & (value <= hi) if inclusive else (value > lo) & (value < hi)
    verdict = (
        F.when(op == ">=", value >= lo)
        .when(op == ">", value > lo)
        .when(op == "<=", value <= lo)
        .when(op == "<", value < lo)
        .when(op == "=", value == lo)
        .when(op == "between", between)
    )
    return F.coalesce(verdict, F.lit(False))
