"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question with other values has the same
template. Windows of five template words are hash-joined with those of the benchmark; a document leaks an
item if it holds at least 0.8 of the item's windows and the placeholders' values map one to one. Where the
first places of the windows fail that, every occurrence is judged by itself: for each shift of the item
against the document, the windows' nearest places.

- number: a run of digits, with `.`, `,`, `:` or `/` between digits
- name: a capitalised word after a word that does not end a sentence
- unit: one of UNITS right after a number

The three private-use characters that stand for placeholders read as such if a text holds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.frames import written

WINDOW = 5
SIMILARITY = 0.8
NUMBER, NAME, UNIT = "", "", ""
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "feet", "foot", "miles", "mile", "meters", "metres",
    "mg", "g", "kg", "grams", "pounds", "lb", "tons", "ml", "l", "liters", "litres", "gallons",
    "s", "ms", "seconds", "minutes", "min", "hours", "h", "days", "weeks", "months", "years",
    "dollars", "euros", "cents", "usd", "eur", "percent", "degrees", "kmh", "mph", "w", "kw", "v",
)
LETTERS = r"\p{L}\p{M}\p{N}"
NUMBERS = r"[0-9]+(?:[.,:/][0-9]+)*"
NAMES = r"(?<=[^ \t\r\n.!?:])([ \t\r\n]+[^ \t\r\n\p{L}\p{N}" + NUMBER + r"]*)(\p{Lu}[\p{L}\p{M}]*)"
UNIT_AFTER = NUMBER + rf"([^{LETTERS}{NUMBER}{NAME}]*)({'|'.join(UNITS)})(?![{LETTERS}])"
BETWEEN = rf"[^{LETTERS}{NUMBER}{NAME}{UNIT}]+"
# Benchmark windows are broadcast up to this number (16 bytes of key and place each); beyond it the
# join shuffles both sides.
BROADCAST_WINDOWS = 1_000_000


def _steps(text: Column) -> tuple[Column, Column, Column]:
    """The text with numbers, then names (lower case), then units replaced."""
    numbers = F.regexp_replace(text, NUMBERS, f" {NUMBER} ")
    names = F.lower(F.regexp_replace(numbers, NAMES, f"$1 {NAME} "))
    return numbers, names, F.regexp_replace(names, UNIT_AFTER, f"{NUMBER}$1 {UNIT} ")


def template_words(text: Column) -> Column:
    return F.array_remove(F.split(_steps(text)[2], BETWEEN), "")


def template_slots(text: Column, words: Column) -> Column:
    """Every placeholder: its place among the words, its kind and its value, in no certain order."""
    numbers, names, _ = _steps(text)
    found = {
        NUMBER: F.regexp_extract_all(text, F.lit(f"({NUMBERS})"), F.lit(1)),
        NAME: F.transform(F.regexp_extract_all(numbers, F.lit(NAMES), F.lit(2)), F.lower),
        UNIT: F.regexp_extract_all(names, F.lit(UNIT_AFTER), F.lit(2)),
    }
    place = F.sequence(F.lit(0), F.size(words) - 1)

    def of_kind(kind: str, values: Column) -> Column:
        places = F.filter(place, lambda i: F.get(words, i) == kind)
        return F.zip_with(
            places, values, lambda p, v: F.struct(p.alias("place"), F.lit(kind).alias("kind"), v.alias("value"))
        )

    every = F.concat(*[of_kind(kind, values) for kind, values in found.items()])
    # Private-use characters of the text itself have no value to pair with.
    paired = F.filter(every, lambda s: s["place"].isNotNull() & s["value"].isNotNull())
    return F.when(F.size(words) > 0, paired)


def _windows(words: Column, window: int) -> Column:
    """(place, hash) of every window; a text of fewer words has none."""
    return F.when(
        F.size(words) >= window,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - window),
            lambda i: F.struct(i.alias("place"), F.xxhash64(F.slice(words, i + 1, window)).alias("hash")),
        ),
    )


def benchmark_windows(benchmark: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """`item`, `n_windows`, `item_place`, `hash` of the windows in use: those with at most half placeholders."""
    words = benchmark.select(F.col(key).alias("item"), template_words(F.col(text)).alias("words"))
    rows = words.select("item", F.size("words").alias("n"), "words", F.explode(_windows(F.col("words"), window)).alias("w"))
    kinds = F.array(*map(F.lit, (NUMBER, NAME, UNIT)))
    filled = F.size(F.filter(F.slice("words", F.col("w.place") + 1, window), lambda x: F.array_contains(kinds, x)))
    used = rows.where(2 * filled <= window).select("item", F.col("w.place").alias("item_place"), F.col("w.hash").alias("hash"))
    sizes = used.groupBy(F.col("item").alias("of_item")).agg(F.count("*").alias("n_windows"))
    return used.join(sizes, F.col("item").eqNullSafe(F.col("of_item"))).select("item", "n_windows", "item_place", "hash")


def leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, similarity: float = SIMILARITY,
) -> DataFrame:
    """Pairs of documents and benchmark items that reach `similarity`.

    Columns: `key`, `item_key`, `n_windows` (of the item), `n_found` (of them in the document),
    `first_word` (place of the first one), `n_slots` and `consistent` (whether each value of the item
    stands for one value of the document and the reverse, by kind; true without placeholders). They speak of
    the first place of every window if that is consistent or no single occurrence is, else of the fullest
    consistent occurrence.

    Null and empty texts, and items without a usable window, are in no pair. Rows that repeat a key
    count as one document, of which an occurrence lies in one text; a null key is a key. Other columns are not read; empty tables give no pairs.
    """
    items = written(benchmark_windows(benchmark, item_key, item_text, window), "benchmark-windows")
    if items.count() <= BROADCAST_WINDOWS:
        items = F.broadcast(items)
    words = docs.where(F.col(text).isNotNull()).select(
        F.col(key).alias("doc"), template_words(F.col(text)).alias("words")
    )
    windows = words.select("doc", F.explode(_windows(F.col("words"), window)).alias("w"))
    found = (
        windows.select("doc", F.col("w.place").alias("place"), F.col("w.hash").alias("hash"))
        .join(items, "hash")
        .groupBy("doc", "item", "item_place")
        .agg(F.first("n_windows").alias("n_windows"), F.min("place").alias("place"))
    )
    pairs = (
        found.groupBy("doc", "item")
        .agg(
            F.first("n_windows").alias("n_windows"), F.count("*").alias("n_found"), F.min("place").alias("first_word"),
            F.collect_list(F.struct("item_place", "place")).alias("places"),  # at most the item's windows
        )
        .where(F.col("n_found") >= F.lit(similarity) * F.col("n_windows"))
    )
    pairs = written(pairs, "leak-pairs")
    slots = _slot_check(pairs, docs, benchmark, key, text, item_key, item_text, window)
    same = F.col("doc").eqNullSafe(F.col("s_doc")) & F.col("item").eqNullSafe(F.col("s_item"))
    checked = pairs.join(slots, same, "left").select(
        "doc", "item", "n_windows", "n_found", "first_word", F.coalesce("n_slots", F.lit(0)).cast("bigint").alias("n_slots"),
        F.coalesce("consistent", F.lit(True)).alias("consistent"),
    )
    checked = written(checked, "leak-checked")
    doubtful = checked.where(~F.col("consistent"))
    if not doubtful.isEmpty():
        single = _consistent_occurrences(doubtful, docs, benchmark, items, key, text, item_key, item_text, window, similarity)
        joined = checked.join(single, same, "left")
        checked = joined.select(
            "doc", "item", "n_windows", *[F.coalesce("o_" + c, c).alias(c) for c in ("n_found", "first_word", "n_slots")],
            (F.col("consistent") | F.col("o_n_found").isNotNull()).alias("consistent"),
        )
    return checked.withColumnsRenamed({"doc": key, "item": item_key})


def _slot_check(
    pairs: DataFrame, docs: DataFrame, benchmark: DataFrame, key: str, text: str, item_key: str, item_text: str,
    window: int,
) -> DataFrame:
    """`s_doc`, `s_item`, `n_slots`, `consistent` of the pairs whose common windows hold placeholders."""

    named = pairs.select(F.col("doc").alias("of_doc")).distinct()
    texts = docs.select(F.col(key).alias("d"), F.col(text).alias("text"))
    wanted = texts.join(named, F.col("d").eqNullSafe(F.col("of_doc")), "left_semi")
    in_docs = _slots(wanted, "doc_value", "d")
    in_items = _slots(benchmark.select(F.col(item_key).alias("i"), F.col(item_text).alias("text")), "item_value", "i")
    aligned = (
        pairs.select("doc", "item", F.explode("places").alias("p"))
        .select("doc", "item", "p", F.explode(F.sequence(F.lit(0), F.lit(window - 1))).alias("k"))
        .select("doc", "item", (F.col("p.item_place") + F.col("k")).alias("item_at"), (F.col("p.place") + F.col("k")).alias("doc_at"))
        .distinct()
    )
    here = F.col("doc").eqNullSafe(F.col("d"))
    return _agreement(aligned, in_docs, here, in_items, "doc", "item").withColumnsRenamed({"doc": "s_doc", "item": "s_item"})


def _slots(rows: DataFrame, value: str, *of: str) -> DataFrame:
    """`of`, `at`, `kind` and `value` of every placeholder of `text`."""
    listed = rows.withColumn("words", template_words(F.col("text"))).select(
        *of, F.explode(template_slots(F.col("text"), F.col("words"))).alias("s")
    )
    return listed.select(*of, F.col("s.place").alias("at"), F.col("s.kind").alias("kind"), F.col("s.value").alias(value))


def _agreement(aligned: DataFrame, in_docs: DataFrame, here: Column, in_items: DataFrame, *of: str) -> DataFrame:
    """`n_slots` and `consistent` for each `of`, from the placeholders at `item_at` and `doc_at`."""
    matched = (
        aligned.join(in_items.withColumnRenamed("at", "i_at"), F.col("item").eqNullSafe(F.col("i")) & (F.col("item_at") == F.col("i_at")))
        .join(
            in_docs.withColumnRenamed("kind", "d_kind"),
            here & (F.col("doc_at") == F.col("at")) & (F.col("kind") == F.col("d_kind")),
        )
        .groupBy(*of, "kind", "item_value", "doc_value")
        .agg(F.count("*").alias("n"))
    )
    by_kind = matched.groupBy(*of, "kind").agg(
        F.sum("n").alias("n"), F.count("*").alias("pairs"),
        F.count_distinct("item_value").alias("items"), F.count_distinct("doc_value").alias("docs"),
    )
    return by_kind.groupBy(*of).agg(
        F.sum("n").alias("n_slots"),
        F.every((F.col("pairs") == F.col("items")) & (F.col("pairs") == F.col("docs"))).alias("consistent"),
    )


def _consistent_occurrences(
    doubtful: DataFrame, docs: DataFrame, benchmark: DataFrame, items: DataFrame, key: str, text: str, item_key: str,
    item_text: str, window: int, similarity: float,
) -> DataFrame:
    """`s_doc`, `s_item`, `o_n_found`, `o_first_word`, `o_n_slots` of the doubtful pairs with a consistent occurrence.

    A shift is the place of a window in the document less that in the item. Every shift that occurs is tried:
    each window of the item takes its place with the nearest shift, and as many of the nearest windows as
    `similarity` needs, with all that are as near, are the occurrence.
    """
    named = doubtful.select(F.col("doc").alias("of_doc")).distinct()
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("d"), F.xxhash64(text).alias("part"), F.col(text).alias("text"))
    wanted = texts.join(named, F.col("d").eqNullSafe(F.col("of_doc")), "left_semi").dropDuplicates(["d", "part"])
    wanted = written(wanted, "doubtful-texts")
    windows = wanted.select("d", "part", F.explode(_windows(template_words(F.col("text")), window)).alias("w"))
    asked = doubtful.select(F.col("doc").alias("of_doc"), F.col("item").alias("of_item"))
    met = windows.select("d", "part", F.col("w.place").alias("place"), F.col("w.hash").alias("hash")).join(items, "hash").join(
        asked, F.col("d").eqNullSafe(F.col("of_doc")) & F.col("item").eqNullSafe(F.col("of_item")), "left_semi"
    )
    pair = F.struct(F.col("d").alias("doc"), "part", "item")
    seen = written(
        met.select(pair.alias("pair"), "n_windows", "item_place", (F.col("place") - F.col("item_place")).alias("shift")), "occurrences"
    )
    shifts = seen.select(F.col("pair").alias("of"), F.col("shift").alias("at")).distinct()
    held = seen.select("pair", "n_windows", "item_place").distinct()
    asking = held.join(shifts, F.col("pair").eqNullSafe(F.col("of"))).select(
        "pair", "n_windows", "item_place", "at", F.lit(None).cast("int").alias("shift")
    )
    places = asking.unionByName(seen.withColumn("at", F.col("shift")))
    each = Window.partitionBy("pair", "item_place")

    def last(order: Column) -> Column:
        reached = each.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        return F.last("shift", ignorenulls=True).over(reached)

    near = places.withColumn("below", last(F.col("at"))).withColumn("above", last(F.col("at").desc())).where(F.col("shift").isNull())
    down, up = F.col("at") - F.col("below"), F.col("above") - F.col("at")
    near = near.withColumn("far", F.least(down, up)).withColumn("taken", F.when(down == F.col("far"), F.col("below")).otherwise(F.col("above")))
    rank = F.rank().over(Window.partitionBy("pair", "at").orderBy("far"))
    taken = near.withColumn("rank", rank).where(F.col("rank") - 1 < F.lit(similarity) * F.col("n_windows")).select(
        "pair", "n_windows", F.col("at").alias("shift"), "item_place", (F.col("item_place") + F.col("taken")).alias("place")
    )
    taken = written(taken, "shifted-windows")
    full = taken.groupBy("pair", "shift").agg(
        F.first("n_windows").alias("n_windows"), F.count("*").alias("o_n_found"), F.min("place").alias("o_first_word")
    ).where(F.col("o_n_found") >= F.lit(similarity) * F.col("n_windows"))
    aligned = taken.select(
        "pair", "shift", F.col("pair.doc").alias("doc"), F.col("pair.part").alias("of_part"), F.col("pair.item").alias("item"),
        "item_place", "place", F.explode(F.sequence(F.lit(0), F.lit(window - 1))).alias("k"),
    ).select(
        "pair", "shift", "doc", "of_part", "item", (F.col("item_place") + F.col("k")).alias("item_at"), (F.col("place") + F.col("k")).alias("doc_at")
    ).distinct()
    here = F.col("doc").eqNullSafe(F.col("d")) & (F.col("of_part") == F.col("part"))
    in_items = _slots(benchmark.select(F.col(item_key).alias("i"), F.col(item_text).alias("text")), "item_value", "i")
    agreement = _agreement(aligned, _slots(wanted, "doc_value", "d", "part"), here, in_items, "pair", "shift")
    agreement = agreement.select(F.col("pair").alias("of"), F.col("shift").alias("by"), "n_slots", "consistent")
    judged = full.join(agreement, F.col("pair").eqNullSafe(F.col("of")) & (F.col("shift") == F.col("by")), "left")
    fullest = F.max(F.struct("o_n_found", (-F.col("o_first_word")).alias("o_before"), F.coalesce("n_slots", F.lit(0)).cast("bigint").alias("o_n_slots")))
    best = judged.where(F.coalesce("consistent", F.lit(True))).groupBy("pair.doc", "pair.item").agg(fullest.alias("best"))
    return best.select(
        F.col("doc").alias("s_doc"), F.col("item").alias("s_item"), "best.o_n_found",
        (-F.col("best.o_before")).alias("o_first_word"), "best.o_n_slots",
    )
