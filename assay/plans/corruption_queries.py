"""Queries over table corruption. Whole tables, row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.operators import corrupt as C
from assay.plans import inputs as I
from assay.plans.registry import query

_KEYS = ", ".join(I.KEY)
_NOISY = ["l_quantity", "l_extendedprice", "l_discount"]


def _rounded(df, columns, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _rounded_sql(columns, digits=4):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


@query(
    "inject_nulls",
    f"WITH {I.FACT}, {I.NULLED} SELECT {_KEYS}, l_tax, l_extendedprice, l_discount, l_quantity FROM nulled",
)
def inject_nulls(spark, d):
    out = C.inject_nulls(I.fact(spark, d), I.CONFIG["null_injection"], I.KEY, generator=I.GENERATOR)
    return out.select(*I.KEY, "l_tax", "l_extendedprice", "l_discount", "l_quantity")


@query(
    "inject_outliers",
    f"""WITH {I.FACT}, o AS ({I.OUTLIERS} FROM fact)
SELECT {_KEYS}, {_rounded_sql(['l_tax', *_NOISY])} FROM o""",
)
def inject_outliers(spark, d):
    out = C.inject_outliers(I.fact(spark, d), I.CONFIG["outlier_injection"], I.KEY, generator=I.GENERATOR)
    return _rounded(out.select(*I.KEY, "l_tax", *_NOISY), ["l_tax", *_NOISY])


@query(
    "inject_outliers_integer",
    f"""WITH {I.FACT} SELECT {_KEYS}, CASE WHEN {I.u('outlier', '0')} < 0.25::DOUBLE
    THEN round_even(-10.0::DOUBLE + {I.u('outlier_value', 'l_qty')} * 1010.0::DOUBLE, 0)::BIGINT
    ELSE l_quantity::BIGINT END AS l_qty FROM fact""",
)
def inject_outliers_integer(spark, d):
    """Draws that go into an integer column are rounded, half to even."""
    whole = I.fact(spark, d).withColumn("l_qty", F.col("l_quantity").cast("bigint"))
    config = {"enabled": True, "rules": [{"column": "l_qty", "min": -10.0, "max": 1000.0, "inject_rate": 0.25}]}
    return C.inject_outliers(whole, config, I.KEY, generator=I.GENERATOR).select(*I.KEY, "l_qty")


@query(
    "inject_rules_in_turn",
    f"""WITH {I.FACT}, one AS (SELECT *, CASE WHEN {I.u('outlier', '0', 0)} < 0.2::DOUBLE
    THEN {I.u('outlier_value', 'l_tax')} * 10.0::DOUBLE - 10.0::DOUBLE ELSE l_tax END AS first_tax FROM fact)
SELECT {_KEYS}, round(CASE WHEN {I.u('outlier', '0', 1)} < 0.1::DOUBLE
    THEN [99.0, 98.0][floor({I.u('outlier_value', 'l_tax#1')} * 2)::INT + 1]::DOUBLE ELSE first_tax END, 4) AS l_tax,
  CASE WHEN {I.u('null', '0', 0)} < 0.2::DOUBLE OR {I.u('null', '0', 1)} < 0.3::DOUBLE THEN NULL
    ELSE l_quantity END AS l_quantity FROM one""",
)
def inject_rules_in_turn(spark, d):
    """Two rules on one column, of values and of nulls: both take effect, the later one over the earlier."""
    rules = [
        {"column": "l_tax", "min": -10.0, "max": 0.0, "inject_rate": 0.2},
        {"column": "l_tax", "values": [99.0, 98.0], "inject_rate": 0.1},
    ]
    nulls = [{"column": "l_quantity", "null_rate": 0.2}, {"column": "l_quantity", "null_rate": 0.3}]
    out = C.inject_outliers(I.fact(spark, d), {"enabled": True, "rules": rules}, I.KEY, generator=I.GENERATOR)
    out = C.inject_nulls(out, {"enabled": True, "columns": nulls}, I.KEY, generator=I.GENERATOR)
    return _rounded(out.select(*I.KEY, "l_tax", "l_quantity"), ["l_tax"])


_EXACT = I.copies("exacts", "fact", 0.03, 0.0)


@query(
    "inject_exact_duplicates",
    f"WITH {I.FACT}, {_EXACT} SELECT {', '.join(I.COLUMNS)} FROM exacts",
)
def inject_exact_duplicates(spark, d):
    config = {"enabled": True, "exact_duplicates": 0.03}
    return C.inject_duplicates(I.fact(spark, d), config, I.KEY, generator=I.GENERATOR).select(*I.COLUMNS)


_NEAR = I.copies("nears", "fact", 0.0, 0.02)


@query(
    "inject_near_duplicates",
    f"""WITH {I.FACT}, {_NEAR}, noisy AS ({I.NOISE} FROM nears)
SELECT {_KEYS}, {_rounded_sql(_NOISY, 6)} FROM noisy""",
)
def inject_near_duplicates(spark, d):
    config = {"enabled": True, "near_duplicates": 0.02}
    out = C.inject_duplicates(I.fact(spark, d), config, I.KEY, generator=I.GENERATOR)
    return _rounded(out.select(*I.KEY, *_NOISY), _NOISY, 6)


@query(
    "inject_exact_count",
    f"""WITH {I.FACT}, r AS (SELECT *, row_number() OVER (ORDER BY md5('42|exact||' || row_key), row_key) AS rn,
    count(*) OVER () AS n FROM fact)
SELECT {_KEYS}, unnest(CASE WHEN rn <= floor(n * 0.03::DOUBLE) THEN [0, 1] ELSE [0] END) AS copy FROM r""",
)
def inject_exact_count(spark, d):
    """The exact number of copies, int(n * rate), found without a global sort."""
    keyed = I.fact(spark, d).withColumn(C.KEY, C.row_key(I.KEY))
    config = {"enabled": True, "exact_duplicates": 0.03}
    out = C.inject_duplicates(keyed, config, [C.KEY], exact_count=True)
    return out.select(*I.KEY, F.col(C.KEY).endswith("|x").cast("int").alias("copy"))


@query(
    "inject_stale",
    f"""WITH {I.FACT} SELECT {_KEYS}, CASE WHEN {I.u('stale', '0')} < 0.1::DOUBLE
    THEN l_shipdate - INTERVAL 7 DAY ELSE l_shipdate END AS l_shipdate FROM fact""",
)
def inject_stale(spark, d):
    config = {**I.CONFIG["freshness_issues"], "enabled": True}
    return C.inject_stale(I.fact(spark, d), config, I.KEY, generator=I.GENERATOR).select(*I.KEY, "l_shipdate")


@query(
    "inject_format",
    f"""WITH {I.FACT}, f AS ({I.FORMATS} FROM fact)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag FROM f""",
)
def inject_format(spark, d):
    out = C.inject_format(I.fact(spark, d), I.CONFIG["format_violations"], I.KEY, generator=I.GENERATOR)
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")


@query(
    "inject_drift",
    """SELECT l_orderkey, l_partkey, l_suppkey::VARCHAR AS l_suppkey, l_linenumber, l_quantity,
  l_extendedprice AS l_price, l_discount, l_tax, l_returnflag, l_shipdate, 0.0::DOUBLE AS surcharge_v2
FROM lineitem""",
)
def inject_drift(spark, d):
    config = {**I.CONFIG["schema_drift"], "enabled": True}
    return C.inject_drift(I.table(spark, d, "lineitem"), config)


@query(
    "restore_integers",
    """SELECT l_orderkey, CASE WHEN l_linenumber < 7 THEN l_partkey END AS l_partkey, l_suppkey,
  round_even(l_linenumber / 2.0::DOUBLE, 0)::INT AS l_linenumber FROM lineitem""",
)
def restore_integers(spark, d):
    """Integer columns that became text, halves or partly unreadable come back rounded or null."""
    clean = I.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    bent = clean.select(
        "l_orderkey",
        F.when(F.col("l_linenumber") < 7, F.col("l_partkey").cast("string")).otherwise("n/a").alias("l_partkey"),
        F.col("l_suppkey").cast("double").alias("l_suppkey"),
        (F.col("l_linenumber") / 2).alias("l_linenumber"),
    )
    return C.restore_integers(bent, clean.schema)


@query(
    "corrupt_table",
    f"""WITH {I.CORRUPT} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus,
  l_shipdate, year, month, {_rounded_sql(['l_tax', *_NOISY])} FROM dirty""",
)
def corrupt_table(spark, d):
    """All enabled stages in order; every row of the result."""
    return _rounded(I.corrupted(spark, d), ["l_tax", *_NOISY])


@query(
    "corruption_report",
    f"""WITH {I.CORRUPT} SELECT year, month, count(*) FILTER (row_key NOT LIKE '%|x%' AND row_key NOT LIKE '%|n')
    AS rows_before, count(*) AS rows_after,
  count(*) FILTER (row_key LIKE '%|x') AS exact_copies, count(*) FILTER (row_key LIKE '%|n') AS near_copies
FROM dirty GROUP BY year, month""",
)
def corruption_report(spark, d):
    return C.corruption_report(I.corrupted(spark, d, keep_key=True), I.BY)


_SHARES = {"l_tax": 0.15 * 0.98, "l_extendedprice": 0.08 * 0.97, "l_discount": 0.05 * 0.99, "l_quantity": 0.03 * 0.98}


@query(
    "corruption_rates",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS rows_before, true AS nulls_as_configured FROM lineitem"
        for c in _SHARES
    ),
)
def corruption_rates(spark, d):
    """The whole chain with the fast generator, which SQL cannot repeat draw by draw: the share of
    nulls left in each column lies within five standard deviations of what the config asks for."""
    config = {**I.CONFIG, "generator": "xxhash64"}
    out = C.corrupt(I.fact(spark, d), config, I.KEY, keep_key=True)
    before = ~F.col(C.KEY).endswith("|x") & ~F.col(C.KEY).endswith("|n")
    one = out.where(before).agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in _SHARES])
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col("n").alias("rows_before"),
            (F.abs(F.col(c) / F.col("n") - p) < 5 * F.sqrt(F.lit(p * (1 - p)) / F.col("n"))).alias(
                "nulls_as_configured"
            ),
        )
        for c, p in _SHARES.items()
    ]
    return one.select(F.inline(F.array(*rows)))
