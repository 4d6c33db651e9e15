"""Audit tables with an index of their ids: an append opens only files that may hold an id of its batch.

Every append writes a run: its rows, sorted by id, in a folder of their own. The index has a row per stretch
of ids of a file, some STRETCH ids each at most, with a Bloom filter of BITS bits over them. A batch's ids meet the stretches they
would lie in by equality, the filters rule out nearly all of them, and the few files left are opened, for the
id column only, and decide exactly. A run counts once its line stands in the log, which is written last: what
an attempt left behind that failed before is never seen, so a replay stores what is missing and no more.

Runs are merged by size (`compact`), so that each id meets few of them. Layout: `runs/run=*`, `index/run=*`,
`log/run=*`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from assay.sources.audit import BUCKET, audit_rows
from assay.sources.partitions import path_exists

STRETCH = 1024
BITS = 16 * STRETCH
HASHES = 6
PREFIX = 3
MAX_RUNS = 16
LOG = "run string, n bigint, depth int, replaces array<string>"
INDEX = "depth int, stretch bigint, file string, words map<int,bigint>, run string"
_ID_BITS = 60


def _stretch(id_: Column, depth: Column) -> Column:
    """The number that the first `depth` bits of an id make. Ids are hex digits, so this keeps their order."""
    return F.call_function("shiftright", F.conv(F.substring(id_, 1, _ID_BITS // 4), 16, 10).cast("bigint"), F.lit(_ID_BITS) - depth)


def _positions(hashed: Column) -> list[Column]:
    """The bits of a Bloom filter that an id of this hash sets."""
    first, step = hashed.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(hashed, 33)
    return [(first + i * step) % BITS for i in range(HASHES)]


def _word(position: Column) -> Column:
    return F.floor(position / 64).cast("int")


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (position % 64).cast("int"))


def live_runs(spark: SparkSession, path: str) -> list:
    """Log rows of the runs that count; a few, as runs are merged."""
    if not path_exists(spark, f"{path}/log"):
        return []
    rows = spark.read.schema(LOG).parquet(f"{path}/log").collect()
    gone = {name for row in rows for name in row["replaces"]}
    return sorted((r for r in rows if r["run"] not in gone), key=lambda r: (r["n"], r["run"]))


def read_indexed(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of an audit table; None where nothing was ever stored."""
    runs = [f"{path}/runs/run={r['run']}" for r in live_runs(spark, path)]
    return spark.read.parquet(*runs) if runs else None


def possible_files(spark: SparkSession, ids: DataFrame, path: str) -> list[str]:
    """Files that may hold one of the ids (`audit_id`): all that do, and one in a thousand of the others met."""
    runs = live_runs(spark, path)
    if not runs:
        return []
    index = spark.read.schema(INDEX).option("basePath", f"{path}/index").parquet(*[f"{path}/index/run={r['run']}" for r in runs])
    depths = sorted({r["depth"] for r in runs})
    # Of an id only its stretch and its hash travel.
    asked = ids.select(
        F.xxhash64("audit_id").alias("hashed"),
        F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _stretch(F.col("audit_id"), F.lit(d)).alias("stretch")) for d in depths])).alias("at"),
    ).select("hashed", "at.*")
    met = asked.join(index, ["depth", "stretch"])
    # One term a bit: the first that is not set ends it.
    held = reduce(
        lambda a, b: a & b,
        [F.coalesce(F.try_element_at("words", _word(p)), F.lit(0)).bitwiseAND(_bit(p)) != 0 for p in _positions(F.col("hashed"))],
    )
    return [row["file"] for row in met.where(held).select("file").distinct().toLocalIterator()]


def _index_run(spark: SparkSession, path: str, run: str, replaces: Sequence[str] = ()) -> int:
    """Index the rows of a run, then log it. Returns how many there are."""
    rows = spark.read.parquet(f"{path}/runs/run={run}").select("audit_id", F.col("_metadata.file_path").alias("file"))
    n = rows.count()
    if not n and not replaces:
        return 0
    depth = max(0, math.ceil(math.log2(max(n, 1) / STRETCH)))
    # Bits are counted in BITS whatever a stretch holds, so one pass makes them; a file's hash stands for its path.
    key = ["stretch", "file_hash"]
    placed = rows.select(
        _stretch(F.col("audit_id"), F.lit(depth)).alias("stretch"), F.xxhash64("file").alias("file_hash"),
        F.explode(F.array(*_positions(F.xxhash64("audit_id")))).alias("p"),
    )
    words = placed.groupBy(*key, _word(F.col("p")).alias("at")).agg(F.bit_or(_bit(F.col("p"))).alias("word"))
    # A stretch has BITS / 64 words at most.
    found = words.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("at", "word"))).alias("words"))
    files = rows.select("file").distinct().withColumn("file_hash", F.xxhash64("file"))
    found = found.join(F.broadcast(files), "file_hash")
    found.select(F.lit(depth).alias("depth"), "stretch", "file", "words").write.parquet(f"{path}/index/run={run}")
    line = spark.createDataFrame([(n, depth, list(replaces))], "n bigint, depth int, replaces array<string>")
    line.coalesce(1).write.parquet(f"{path}/log/run={run}")
    return n


def _write_run(rows: DataFrame, path: str, run: str) -> None:
    """Ids are dealt by their first PREFIX digits, so that those of a stretch lie together. Ids are hashes, so this
    is even without a sample of them, for which the rows would be worked out once more."""
    dealt = rows.repartition(F.substring("audit_id", 1, PREFIX)).sortWithinPartitions("audit_id")
    dealt.write.parquet(f"{path}/runs/run={run}")


def append_indexed(
    spark: SparkSession, rows: DataFrame, path: str, natural_key: Sequence[str], ts: str = "ts", max_runs: int = MAX_RUNS
) -> int:
    """Append the rows whose id is not stored yet; returns how many. Of rows with one id the earliest stays.

    One writer at a time, as for `append_audit`. Runs are merged when there are more than `max_runs`.
    """
    new = audit_rows(rows, natural_key, ts).drop(BUCKET).persist(StorageLevel.DISK_ONLY)
    try:
        files = possible_files(spark, new, path)
        fresh = new
        if files:
            known = spark.read.schema("audit_id string").parquet(*files)
            fresh = new.join(known, "audit_id", "left_anti")
        run = uuid4().hex
        _write_run(fresh, path, run)
        stored = _index_run(spark, path, run)
    finally:
        new.unpersist()
    if len(live_runs(spark, path)) > max_runs:
        compact(spark, path)
    return stored


def compact(spark: SparkSession, path: str, factor: int = 2) -> None:
    """Merge small runs into one, as long as the next larger is no more than `factor` times their sum.

    A run at least doubles whenever it is rewritten, so a row is rewritten some log2(table / batch) times.
    Merged runs are left out as soon as the new one is logged, and removed then.
    """
    runs = live_runs(spark, path)
    merged, total = [], 0
    for r in runs:
        if len(merged) >= 2 and r["n"] > factor * total:
            break
        merged.append(r["run"])
        total += r["n"]
    if len(merged) < 2:
        return
    run = uuid4().hex
    _write_run(spark.read.parquet(*[f"{path}/runs/run={r}" for r in merged]), path, run)
    _index_run(spark, path, run, merged)
    for old in merged:
        # The log line goes first: what is left of a run without one is never read.
        for part in ("log", "index", "runs"):
            target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}/run={old}")
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
