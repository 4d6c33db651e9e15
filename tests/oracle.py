"""Compare a registered query with its SQL: names, types, row count and values."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        files = f"{file}/*.parquet" if file.is_dir() else str(file)
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{files}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    return value


def compare(spark, con, sf_dir: str, fn, sql: str) -> None:
    got = fn(spark, sf_dir)
    want = con.sql(sql)
    names = sorted(got.columns)
    assert names == sorted(want.columns), (names, sorted(want.columns))
    types = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in got.schema}
    wanted = dict(zip(want.columns, [str(t) for t in want.types]))
    assert types == wanted, {n: (types[n], wanted[n]) for n in names if types[n] != wanted[n]}
    order = [want.columns.index(n) for n in names]
    left = Counter(tuple(_cell(row[n]) for n in names) for row in got.collect())
    right = Counter(tuple(_cell(row[i]) for i in order) for row in want.fetchall())
    if left != right:
        only_left, only_right = left - right, right - left
        raise AssertionError(
            f"{sum(left.values())} vs {sum(right.values())} rows, {sum(only_left.values())} differ\n"
            f"columns {names}\nspark {sorted(map(str, only_left))[:4]}\nsql   {sorted(map(str, only_right))[:4]}"
        )
    assert left, "no rows"
