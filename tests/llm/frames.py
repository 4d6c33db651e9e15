"""Document frames for the tests: odd rows, and extra columns named like those the operators use."""

CLASHING = ("key", "hash", "size", "score", "n_windows", "words", "places", "lines", "class_id", "held_out", "n_bytes", "doc")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows, extra=True):
    """Rows of (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.selectExpr("*", *[f"'x' AS {c}" for c in CLASHING]) if extra else df


LONG = " ".join(f"word{n} other{n % 7}." for n in range(20_000))
ODD = [
    (1, "one two three four five six seven"),
    (1, "one two three four five six seven"),  # a repeated row
    (2, None),
    (3, ""),
    (None, "a text without a key, and a few words more"),
    (None, None),
    (4, "   \n\n \t "),
    (5, "!!! ... ???"),
    (6, LONG),
    (7, "naïve café 北京 😀 \u0000  x"),
    (8, "one two three four five six seven", None, None),
    (9, "one"),
]


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
