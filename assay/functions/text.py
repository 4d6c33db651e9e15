"""Partition texts, cell coercion and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how Spark names the folder of a null partition value.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def partition_of_predicate(predicate: Column) -> Column:
    """`year='2025' AND month='09'` → `year=2025/month=09`; null or no pair → ''."""
    pair = F.lit(r"(\w+)\s*=\s*'([^']*)'")
    text = F.coalesce(predicate, F.lit(""))
    keys = F.regexp_extract_all(text, pair, F.lit(1))
    values = F.regexp_extract_all(text, pair, F.lit(2))
    return F.array_join(F.zip_with(keys, values, lambda k, v: F.concat(k, F.lit("="), v)), "/")


def partition_pairs(spec: Column) -> Column:
    """The `key=value` pieces of a partition text; pieces without `=` are dropped."""
    return F.filter(F.split(spec, "/"), lambda p: p.contains("="))


def predicate_of_partition(spec: Column) -> Column:
    """`year=2025/month=09` → `year='2025' AND month='09'`, for logs and requests."""
    pieces = F.transform(
        partition_pairs(spec),
        lambda p: F.concat(F.split(p, "=")[0], F.lit("='"), F.split(p, "=")[1], F.lit("'")),
    )
    return F.array_join(pieces, " AND ")


def partition_text(by: list[str]) -> Column:
    """`k=v/k=v` of the named columns; a null is spelled as its folder, never left out."""
    values = [F.coalesce(F.col(c).cast("string"), F.lit(NULL_PARTITION)) for c in by]
    return F.concat_ws("/", *[F.concat(F.lit(f"{c}="), v) for c, v in zip(by, values)])


def year_month_of_filename(name: Column) -> Column:
    """struct(year, month) of the first `yyyy-mm` in a file name, null where there is none."""
    pattern = r"(\d{4})-(\d{2})"
    year = F.regexp_extract(name, pattern, 1)
    return F.when(
        year != "", F.struct(year.alias("year"), F.regexp_extract(name, pattern, 2).alias("month"))
    )


def coerce_cell(cell: Column) -> Column:
    """struct(kind, as_double, as_long, as_text) of a text cell.

    Empty → null; with a point → double; else integer; else the text stays. The patterns keep
    Spark's wider number syntax (`1.5d`) out; `_` between digits is allowed.
    """
    plain = F.replace(cell, F.lit("_"), F.lit(""))
    real = r"^\s*[+-]?(\d+(_\d+)*\.(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?\s*$"
    whole = r"^\s*[+-]?\d+(_\d+)*\s*$"
    as_double = F.when(cell.rlike(real), F.trim(plain).try_cast("double"))
    as_long = F.when(cell.rlike(whole), F.trim(plain).try_cast("bigint"))
    filled = cell.isNotNull() & (cell != "")
    return F.struct(
        F.when(~filled, "null")
        .when(as_double.isNotNull(), "double")
        .when(as_long.isNotNull(), "long")
        .otherwise("text")
        .alias("kind"),
        as_double.alias("as_double"),
        as_long.alias("as_long"),
        F.when(filled & as_double.isNull() & as_long.isNull(), cell).alias("as_text"),
    )


def label(name: Column) -> Column:
    """`null_share` → `Null Share`: only initials change."""
    spaced = F.replace(name, F.lit("_"), F.lit(" "))
    words = F.transform(
        F.split(spaced, " "),
        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2147483647)),
    )
    return F.array_join(words, " ")
