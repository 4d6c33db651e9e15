"""Line deduplication over overlapping windows of consecutive lines.

Every window of three lines is hashed; of windows that occur more than once, the first occurrence (in
order of document key and place) stays and the lines that any later occurrence covers go. Repeats are
counted with a map-side combine, and the join that marks later occurrences may be split by AQE, so a
window that a third of all documents hold costs no single task its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.frames import free_names, long_hash

WINDOW = 3


def _lines(text: str):
    return F.split(F.col(text), "\n", -1)


def line_windows(docs: DataFrame, key: str, text: str, window: int = WINDOW) -> DataFrame:
    """Every window: the document (`no_key`, `key`, `text_hash`), its `place`, and 128 bits of hash."""
    lines = docs.select(
        F.col(key).isNull().alias("no_key"), F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"),
        _lines(text).alias("lines"),
    ).where(F.size("lines") >= window)

    def at(place):
        held = [F.get(F.col("lines"), place + k) for k in range(window)]
        return F.struct(
            place.cast("int").alias("place"), long_hash(*held, salt=1).alias("h1"), long_hash(*held, salt=2).alias("h2")
        )

    places = F.sequence(F.lit(0), F.size("lines") - window)
    return lines.select("no_key", "key", "text_hash", F.explode(F.transform(places, at)).alias("w")).select(
        "no_key", "key", "text_hash", "w.place", "w.h1", "w.h2"
    )


def repeated_places(windows: DataFrame) -> DataFrame:
    """The places of later occurrences, as one sorted array per document."""
    own = F.struct("no_key", "key", "text_hash", "place")
    firsts = (
        windows.groupBy("h1", "h2")
        .agg(F.min(own).alias("first"), F.max(own).alias("last"))
        .where(F.col("first") != F.col("last"))
        .select("h1", "h2", "first")
    )
    later = windows.join(firsts, ["h1", "h2"]).where(own != F.col("first"))
    return later.groupBy("no_key", "key", "text_hash").agg(F.sort_array(F.collect_set("place")).alias("places"))


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
    counts: tuple[str, str] = ("n_lines", "n_removed"),
) -> DataFrame:
    """All rows and columns of `docs` with `text` reduced to the kept lines, and two numbers of lines added (`counts`).

    A document with fewer lines than a window, an empty or a null text keeps what it has (null: 0 lines).
    Rows that repeat both key and text count as one document, so none of them loses lines to the other;
    rows with equal keys and different texts are ordered by a hash of the text. Null keys come last.
    Columns that are named like the added ones are replaced. An empty table gives an empty one.
    """
    kept_columns = [c for c in docs.columns if c not in counts]
    rows = docs.select(*kept_columns)
    no_key, own_key, text_hash, found, lines, left = free_names(rows, "no_key", "key", "text_hash", "places", "lines", "kept")
    places = repeated_places(line_windows(rows, key, text, window)).withColumnsRenamed(
        {"no_key": no_key, "key": own_key, "text_hash": text_hash, "places": found}
    )
    same = (
        F.col(key).eqNullSafe(F.col(own_key)) & (F.xxhash64(text) == F.col(text_hash))
        & (F.col(key).isNull() == F.col(no_key))
    )
    joined = rows.join(places, same, "left").withColumn(lines, _lines(text))
    # Covered lines merge into spans; what stays lies between the end of one window and the next start.
    starts = F.concat(F.array(F.lit(0)), F.transform(found, lambda p: p + window))
    ends = F.concat(F.col(found), F.array(F.size(lines)))
    gaps = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda g: g["a"] < g["b"])
    kept = F.flatten(F.transform(gaps, lambda g: F.slice(F.col(lines), g["a"] + 1, g["b"] - g["a"])))
    held = joined.withColumn(left, F.when(F.col(found).isNull(), F.col(lines)).otherwise(kept))
    n_lines = F.coalesce(F.size(lines), F.lit(0))
    return held.select(
        *[
            F.when(F.col(found).isNull(), F.col(text)).otherwise(F.array_join(left, "\n")).alias(text)
            if c == text else F.col(c)
            for c in kept_columns
        ],
        F.when(F.col(text).isNull(), 0).otherwise(n_lines).cast("bigint").alias(counts[0]),
        F.when(F.col(text).isNull(), 0).otherwise(n_lines - F.size(left)).cast("bigint").alias(counts[1]),
    )
