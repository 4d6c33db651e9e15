"""Evaluation from stored states: only files that are new are read, the rest is merged.

The store is an append-only table with one row per data file and partition: the file's path, size and time,
the states of `states.py` as a map, and quantile sketches of chosen columns. What is evaluated are the rows
whose file is there now, as it was when it was read. So a file that went takes its states with it, one that
was replaced is read again, and a refresh that is repeated, or that failed half-way, changes nothing: rows
stored twice are one. A rule that needs a state which a file's row lacks makes the file new.

Files are listed by Spark, without their content. Names of new files come to the driver, a batch at a time,
as the scan needs them there; data never does.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.operators.rules import Rule, evaluation_rows, named
from assay.operators.states import ROWS, metric_from, states_of
from assay.sources.partitions import path_exists

FILE = ("file", "file_size", "file_time")
# Files per scan; all of them in one scan where nothing is stored yet.
BATCH_FILES = 10_000
# KLL sketches of this size are off by about 0.33 % of the rows in rank (99 % confidence).
SKETCH_SIZE = 800
_STORED = "states map<string,double>, sketches map<string,binary>"


def _plain(path: Column) -> Column:
    """A file's path spelled alike by listing and scan: decoded, one slash after `file:`."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/+", "file:/")


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and time of the Parquet files below a path."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    spelled = F.replace(F.replace(F.col("path"), F.lit("%"), F.lit("%25")), F.lit("+"), F.lit("%2B"))
    return found.select(
        F.col("path").alias("name"), _plain(spelled).alias("file"), F.col("length").alias("file_size"),
        F.col("modificationTime").alias("file_time"),
    )


def _schema_of(schema: str, by: Sequence[str]) -> T.StructType:
    whole = T.StructType.fromDDL(schema)
    stored = T.StructType.fromDDL(f"file string, file_size bigint, file_time timestamp, {_STORED}")
    return T.StructType([*[whole[c] for c in by], *stored])


def stored_states(spark: SparkSession, store: str, schema: str, by: Sequence[str]) -> DataFrame:
    kind = _schema_of(schema, by)
    return spark.read.schema(kind).parquet(store) if path_exists(spark, store) else spark.createDataFrame([], kind)


def _complete(needed: Sequence[str], sketches: Sequence[str]) -> Column:
    """Does a stored row answer what is asked? A file without rows answers everything."""

    def holds(column: str, names: Sequence[str]) -> Column:
        return F.size(F.array_except(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.map_keys(column))) == 0

    return (F.col("states")[ROWS] == 0) | (holds("states", needed) & holds("sketches", sketches))


def file_states(df: DataFrame, by: Sequence[str], rules: Sequence[Rule], sketches: Sequence[str] = ()) -> DataFrame:
    """States per file and partition of a scan, in one aggregate."""
    states = states_of(rules, df.columns)
    meta = F.col("_metadata")
    keyed = df.select(
        "*", _plain(meta["file_path"]).alias("file"), meta["file_size"].alias("file_size"),
        meta["file_modification_time"].alias("file_time"),
    )
    updates = [s.update.cast("double").alias(f"s{i}") for i, s in enumerate(states.values())]
    updates += [
        F.kll_sketch_agg_double(named(c).cast("double"), F.lit(SKETCH_SIZE)).alias(f"k{i}") for i, c in enumerate(sketches)
    ]
    found = keyed.groupBy(*[named(c) for c in by], *FILE).agg(*updates)

    def as_map(names: Iterable[str], letter: str, kind: str) -> Column:
        pairs = [x for i, n in enumerate(names) for x in (F.lit(n), F.col(f"{letter}{i}"))]
        return (F.create_map(*pairs) if pairs else F.create_map()).cast(f"map<string,{kind}>")

    return found.select(*[named(c) for c in by], *FILE, as_map(states, "s", "double").alias("states"), as_map(sketches, "k", "binary").alias("sketches"))


def new_files(
    spark: SparkSession, path: str, store: str, schema: str, by: Sequence[str], rules: Sequence[Rule],
    sketches: Sequence[str] = (),
) -> DataFrame:
    """Files whose present content has no complete states."""
    needed = list(states_of(rules, T.StructType.fromDDL(schema).names))
    known = stored_states(spark, store, schema, by).where(_complete(needed, sketches)).select(*FILE).distinct()
    return listed_files(spark, path).join(known, list(FILE), "left_anti")


def refresh(
    spark: SparkSession, path: str, store: str, schema: str, by: Sequence[str], rules: Sequence[Rule],
    sketches: Sequence[str] = (),
) -> int:
    """Read the new files' states into the store; returns how many files were read."""
    reader = spark.read.schema(schema).option("basePath", path)
    kind = _schema_of(schema, by)
    read, first = 0, not path_exists(spark, store)
    names = (r["name"] for r in new_files(spark, path, store, schema, by, rules, sketches).select("name").toLocalIterator())
    while batch := list(names if first else islice(names, BATCH_FILES)):
        # Paths are literal here: braces and stars in a name are no patterns.
        scan = reader.option("__globPaths__", "false").parquet(*([path] if first else batch))
        found = file_states(scan, by, rules, sketches).to(kind)
        found.write.mode("append").parquet(store)
        _mark_empty(spark, batch, path, store, schema, by)
        read, first = read + len(batch), False
    return read


def _mark_empty(spark: SparkSession, batch: list[str], path: str, store: str, schema: str, by: Sequence[str]) -> None:
    """Files of the batch that have no row get one with zero rows, so that they are not read again."""
    known = stored_states(spark, store, schema, by).select(*FILE)
    left = listed_files(spark, path).join(known, list(FILE), "left_anti").where(F.col("name").isin(batch) if len(batch) <= 1000 else F.lit(True))
    kind = _schema_of(schema, by)
    empty = left.select(*FILE).select(
        *[F.lit(None).cast(kind[c].dataType).alias(c) for c in by], *FILE,
        F.create_map(F.lit(ROWS), F.lit(0.0)).alias("states"), F.create_map().cast("map<string,binary>").alias("sketches"),
    )
    rows = empty.limit(1).count()
    if rows:
        empty.write.mode("append").parquet(store)


def live_states(
    spark: SparkSession, path: str, store: str, schema: str, by: Sequence[str], needed: Sequence[str] = (),
    sketches: Sequence[str] = (),
) -> DataFrame:
    """The stored rows of the files that are there, one per file and partition."""
    rows = stored_states(spark, store, schema, by).where(_complete(needed, sketches) & (F.col("states")[ROWS] > 0))
    there = rows.join(listed_files(spark, path).select(*FILE), list(FILE), "left_semi")
    once = there.groupBy(*FILE, *[named(c) for c in by]).agg(F.any_value(F.struct("states", "sketches")).alias("r"))
    return once.select(*FILE, *[named(c) for c in by], "r.*")


def evaluate_stored(
    spark: SparkSession, path: str, store: str, schema: str, by: Sequence[str], rules: Sequence[Rule], table: str,
    database: str = "lake", as_of: Column | None = None, inclusive: bool = True,
) -> DataFrame:
    """`rules.evaluate` of the table at `path` from its stored states. `refresh` comes first.

    A file without states would be left out silently, so that raises instead. Rules on keys need the rows;
    they are no part of this.
    """
    columns = T.StructType.fromDDL(schema).names
    states = states_of(rules, columns)
    if missing := new_files(spark, path, store, schema, by, rules).limit(1).collect():
        raise ValueError(f"no states of {missing[0]['name']!r}; refresh first")
    live = live_states(spark, path, store, schema, by, list(states))
    merged = live.groupBy(*[named(c) for c in by]).agg(
        *[s.merge(F.col("states")[name]).alias(f"s{i}") for i, (name, s) in enumerate(states.items())]
    )
    number = {name: F.col(f"s{i}") for i, name in enumerate(states)}
    metrics = [metric_from(r, columns, as_of, number.__getitem__) for r in rules]
    grouped = merged.select(
        *[named(c) for c in by], number[ROWS].cast("bigint").alias("row_count"),
        *[m.alias(f"m_{i}") for i, (_, m) in enumerate(metrics)],
    )
    return evaluation_rows(grouped, rules, [k for k, _ in metrics], by, table, database, inclusive)
