"""Rulesets with rules on keys and on the schema, beside the row-wise ones.

`Uniqueness "a", "b" >= t` needs a count per key, so its plan has two levels: rows are grouped by partition
and key, and the groups by partition. The row-wise rules' states ride along through the first level and are
merged in the second, so one scan and one shuffle answer both. Both levels combine map-side: a key that
fills a third of the table reaches the shuffle as one row per task, and there is no Expand. Keys that
contain one another (`a, b` and `a`) are levels of one chain; others take a scan each, of their columns only.

`SchemaMatch "table"` compares the frame's own schema with the stored baseline of that table: a few rows,
joined as one value.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.operators.history import latest_baseline
from assay.operators.rules import KEYED_TYPE, SCHEMA_TYPE, Rule, evaluate as evaluate_rows, evaluation_rows, named, schema_columns, schema_drift
from assay.operators.states import ROWS, State, metric_from, states_of

Keys = tuple[str, ...]


def key_chains(key_sets: Sequence[Keys]) -> list[list[Keys]]:
    """Key sets as chains, each set containing the next; equal sets once, whatever their order."""
    chains: list[list[Keys]] = []
    for keys in sorted({tuple(sorted(set(k))) for k in key_sets}, key=lambda k: (-len(k), k)):
        home = next((c for c in chains if set(keys) < set(c[-1])), None)
        if home is None:
            chains.append([keys])
        else:
            home.append(keys)
    return chains


def _column(i: int) -> str:
    return f"_state_{i}"


def _distinct(keys: Keys) -> str:
    return "_distinct_" + "_".join(c.encode().hex() for c in keys)


def _chain(df: DataFrame, by: Sequence[str], states: dict[str, State], chain: list[Keys]) -> DataFrame:
    """One row per partition with the merged states and, for each key set, its number of distinct keys."""
    carried = {_column(i): (s.update, s.merge) for i, s in enumerate(states.values())}
    level, counts = df, []
    for keys in [*chain, ()]:
        on = [*by, *[k for k in keys if k not in by]]
        updates = [update.alias(name) for name, (update, _) in carried.items()]
        if level is not df:
            updates = [merge(name).alias(name) for name, (_, merge) in carried.items()]
            updates += [F.sum(name).alias(name) for name in counts]
            counts.append(_distinct(previous))
            updates.append(F.count(F.lit(1)).alias(counts[-1]))
        # A level must have something to aggregate; keys alone are a distinct.
        grouped = level.groupBy(*[named(c) for c in on])
        level = grouped.agg(*updates) if updates else level.select(*[named(c) for c in on]).distinct()
        previous = keys
    return level


def merged_states(df: DataFrame, by: Sequence[str], states: dict[str, State], key_sets: Sequence[Keys]) -> DataFrame:
    """One row per partition: `_state_i` and a count of distinct keys per key set."""
    first, *others = key_chains(key_sets) or [[]]
    out = _chain(df, by, states, first)
    for chain in others:
        renamed = _chain(df, by, {}, chain)
        for i, c in enumerate(by):
            renamed = renamed.withColumnRenamed(c, f"_by_{i}")
        same = [named(c).eqNullSafe(F.col(f"_by_{i}")) for i, c in enumerate(by)]
        # One row per partition on both sides; a table without partitions is one row and one row.
        out = out.join(renamed, reduce(lambda a, b: a & b, same)) if same else out.crossJoin(renamed)
        out = out.drop(*[f"_by_{i}" for i in range(len(by))])
    return out


def drift_metrics(df: DataFrame, baselines: DataFrame, database: str, table: str) -> DataFrame:
    """One row, `changes`: a map with an entry `Column.x.Added`, `.Removed` or `.Retyped` per changed column.

    Null if there is no baseline of the table. `baselines` has database, table_name, version and
    columns array<struct<name,type>>; the newest version counts.
    """
    own = (F.col("database") == database) & (F.col("table_name") == table)
    newest = latest_baseline(baselines.where(own)).select("database", "table_name", F.inline("columns"))
    drift = schema_drift(newest, schema_columns(df, database, table))
    label = F.concat(F.lit("Column."), F.col("name"), F.lit("."), F.initcap("change"))
    # At most one entry per column of either schema.
    entries = F.array_sort(F.collect_list(F.struct(label.alias("key"), F.lit(1.0).alias("value"))))
    found = drift.agg(F.map_from_entries(entries).alias("changes"))
    there = newest.agg((F.count("*") > 0).alias("there"))
    return found.crossJoin(there).select(F.when(F.col("there"), F.col("changes")).alias("changes"))


def evaluate(
    df: DataFrame, rules: Sequence[Rule], by: Sequence[str], table: str, database: str = "lake",
    as_of: Column | None = None, inclusive: bool = True, baselines: DataFrame | None = None,
) -> DataFrame:
    """`rules.evaluate` for rulesets that may also hold Uniqueness and SchemaMatch rules.

    The metric of Uniqueness is the share of rows that do not repeat an earlier row's key; null is a value
    like any other. A key column that is not there gives a null metric, which fails. SchemaMatch passes if
    no column was added, removed or retyped since the newest baseline; without a baseline it fails.
    """
    keyed = [r for r in rules if r.rule_type == KEYED_TYPE]
    schemas = [r for r in rules if r.rule_type == SCHEMA_TYPE]
    if not keyed and not schemas:
        return evaluate_rows(df, rules, by, table, database, as_of, inclusive)
    columns = df.columns
    states = states_of([r for r in rules if r.rule_type not in (KEYED_TYPE, SCHEMA_TYPE)], columns)
    key_sets = [r.keys for r in keyed if all(k in columns for k in r.keys)]
    merged = merged_states(df, by, states, key_sets)
    number = {name: F.col(_column(i)) for i, name in enumerate(states)}
    for i, name in enumerate(dict.fromkeys(r.column for r in schemas)):
        if baselines is None:
            raise ValueError("SchemaMatch rules need the stored baselines")
        changes = drift_metrics(df, baselines, database, name).withColumnRenamed("changes", f"_changes_{i}")
        merged = merged.crossJoin(F.broadcast(changes))  # one row
        number[SCHEMA_TYPE + name] = F.col(f"_changes_{i}")

    def metric(rule: Rule) -> tuple[str | None, Column]:
        if rule.rule_type == SCHEMA_TYPE:
            return None, number[SCHEMA_TYPE + rule.column]
        if rule.rule_type != KEYED_TYPE:
            return metric_from(rule, columns, as_of, number.__getitem__)
        key = f"Column.{','.join(rule.keys)}.Uniqueness"
        if rule.keys not in key_sets:
            return key, F.lit(None).cast("double")
        return key, F.col(_distinct(tuple(sorted(set(rule.keys))))) / F.nullif(number[ROWS], F.lit(0))

    metrics = [metric(r) for r in rules]
    grouped = merged.select(
        *[named(c) for c in by], number[ROWS].alias("row_count"), *[m.alias(f"m_{i}") for i, (_, m) in enumerate(metrics)]
    )
    return evaluation_rows(grouped, rules, [k for k, _ in metrics], by, table, database, inclusive)
