"""Wall time of the headline queries, as one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the number of cores, BENCH_RUNS the runs per query
(the median counts). Every row of a result is computed and dropped (`noop`). Tables are laid out once,
outside the clock: `lineitem` in as many files as there are cores, and a corrupted copy of it partitioned by
month, which rules and quarantine read.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from assay.operators import corrupt as C  # noqa: E402
from assay.operators import quarantine as Q  # noqa: E402
from assay.operators import rules as R  # noqa: E402
from assay.operators import violations as V  # noqa: E402
from assay.plans import inputs as I  # noqa: E402
from assay.plans.catalog import QUERIES  # noqa: E402
from assay.plans.source_queries import REQUESTS  # noqa: E402
from assay.session import build_session, scratch_dir  # noqa: E402
from assay.sources.partitions import write_partitions  # noqa: E402

FAST = {**I.CONFIG, "generator": "xxhash64"}
PLAIN = [
    "corruption_rates", "inject_exact_count", "rule_uniqueness", "history_context", "metric_stats", "alarm_days",
    "ingest_partitions", "stream_alarms",
]


def headline(spark: SparkSession, sf_dir: str, cpus: int) -> dict[str, Callable[[], DataFrame]]:
    root = scratch_dir(spark, "bench")
    for name in ("lineitem", "orders", "events"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(cpus).write.parquet(f"{root}/{name}.parquet")
    write_partitions(C.corrupt(I.fact(spark, root), FAST, I.KEY), f"{root}/dirty", I.BY)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in I.fact(spark, root).schema)

    def dirty() -> DataFrame:
        return spark.read.schema(schema).parquet(f"{root}/dirty")

    def found() -> DataFrame:
        return R.evaluate(dirty(), I.RULES, I.BY, I.TABLE, as_of=I.month_end())

    def zone() -> DataFrame:
        path = scratch_dir(spark, "bench-zone")
        Q.write_quarantine(dirty(), REQUESTS, path, I.BY, F.lit("2024-01-31 12:00:00").cast("timestamp_ntz"))
        return Q.read_quarantine(spark, path, I.BY)

    own = {
        "evaluate_ruleset": found,
        "scan_results": lambda: V.scan_results(found()),
        "corrupt_table": lambda: C.corrupt(I.fact(spark, root), FAST, I.KEY),
        "quarantine_counts": lambda: Q.quarantine_counts(dirty(), REQUESTS),
        "quarantine_rows": zone,
    }
    return own | {name: lambda name=name: QUERIES[name](spark, root) for name in PLAIN}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = headline(spark, sf_dir, int(cpus))

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name]().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {name: round(statistics.median(run(name) for _ in range(runs)), 3) for name in queries}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": int(cpus),
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
