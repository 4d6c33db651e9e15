"""Mergeable states of rule metrics.

A metric is finished from a few numbers about its rows, and these numbers of two sets of rows give those of
both together: counts and sums add up, the newest is the newest of both. So a table can be aggregated in
levels, or file by file and stored, and every rule is answered by merging.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from assay.operators.rules import Rule, micros, named, outside

ROWS = "rows"


@dataclass(frozen=True)
class State:
    """How a number is taken from rows, and which aggregate merges it."""

    update: Column
    merge: Callable[[str], Column] = F.sum


def _count(c: str) -> str:
    return f"count({c})"


def _sum(c: str) -> str:
    return f"sum({c})"


def _newest(c: str) -> str:
    return f"newest({c})"


def _outside(rule: Rule) -> str:
    return f"outside({rule.column}, {float(rule.lo)!r}, {float(rule.hi)!r})"


def states_of(rules: Sequence[Rule], columns: Sequence[str]) -> dict[str, State]:
    """The states that the row-wise rules need, by name; rules on columns that are not there need none."""
    found = {ROWS: State(F.count(F.lit(1)))}
    for rule in rules:
        c = rule.column
        if c not in columns:
            continue
        if rule.rule_type in ("Completeness", "Mean", "ColumnValues"):
            found[_count(c)] = State(F.count(named(c)))
        if rule.rule_type == "Mean":
            found[_sum(c)] = State(F.sum(named(c).cast("double")))
        if rule.rule_type == "ColumnValues":
            found[_outside(rule)] = State(F.count_if(outside(c, rule.lo, rule.hi)))
        if rule.rule_type == "DataFreshness":
            found[_newest(c)] = State(micros(F.max(named(c))), F.max)
    return found


def metric_from(
    rule: Rule, columns: Sequence[str], as_of: Column | None, state: Callable[[str], Column]
) -> tuple[str | None, Column]:
    """Metric key and value of a row-wise rule from merged states; a column that is not there gives null."""
    c, null = rule.column, F.lit(None).cast("double")
    there = c in columns
    if rule.rule_type == "RowCount":
        return "Dataset.RowCount", state(ROWS).cast("double")
    if rule.rule_type == "ColumnExists":
        return None, F.lit(1.0 if there else 0.0)
    if rule.rule_type == "Completeness":
        return f"Column.{c}.Completeness", state(_count(c)) / F.nullif(state(ROWS), F.lit(0)) if there else null
    if rule.rule_type == "Mean":
        return f"Column.{c}.Mean", state(_sum(c)) / F.nullif(state(_count(c)), F.lit(0)) if there else null
    if rule.rule_type == "ColumnValues":
        ratio = state(_outside(rule)) / F.nullif(state(_count(c)), F.lit(0)) if there else null
        return f"Column.{c}.OutlierRatio", ratio
    if rule.rule_type == "DataFreshness":
        if as_of is None:
            raise ValueError(f"{rule.rule_text!r} needs as_of: freshness is not measured by the wall clock")
        hours = (micros(as_of) - state(_newest(c))) / F.lit(3.6e9) if there else null
        return f"Column.{c}.Freshness.Hours", hours
    raise ValueError(f"not a row-wise rule: {rule.rule_text!r}")
