"""Isolation of bad rows: copy, counts, remediation rows and recovery.

Raw data is never changed: quarantine copies rows, and `clean_rows` is the complement for
downstream use. A predicate that is null on a row does not make it bad.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from hashlib import md5
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.text import partition_pairs
from assay.operators.history import before_score
from assay.operators.retention import DAY, remove_folders, with_folder
from assay.session import scratch_dir
from assay.sources.partitions import path_exists, write_partitions
from assay.sources.tables import parse_partition, partition_filter


@dataclass(frozen=True)
class Request:
    """Quarantine the rows of one partition that satisfy a SQL predicate."""

    table_name: str
    partition: str
    filter_condition: str
    issue_id: str = ""

    @property
    def issue(self) -> str:
        """The issue id given, else one derived from the request, the same on every run."""
        made = md5(f"{self.table_name}#{self.partition}#{self.filter_condition}".encode()).hexdigest()
        return self.issue_id or made

    @property
    def scope(self) -> Column:
        return partition_filter(self.partition)

    @property
    def bad(self) -> Column:
        return is_bad(self.filter_condition)


def is_bad(condition: str) -> Column:
    return F.coalesce(F.expr(f"({condition.strip()})"), F.lit(False))


def _any(predicates: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates)


def bad_rows(df: DataFrame, request: Request) -> DataFrame:
    """The plain predicate is used here: as a filter it drops nulls by itself and can be pushed
    down to the scan, which a coalesce around it could not."""
    return df.where(request.scope).where(F.expr(f"({request.filter_condition.strip()})"))


def clean_rows(df: DataFrame, request: Request) -> DataFrame:
    """The partition without its bad rows; rows on which the predicate is null stay."""
    return df.where(request.scope).where(~request.bad)


# Distinct predicates of one pass: each is an expression of its plan. More take several passes.
MAX_PREDICATES = 200
# Partitions in scope that become a filter of the plan; beyond that the join with the scopes prunes.
MAX_SCOPES = 100
Requests = Sequence[Request] | DataFrame


@dataclass(frozen=True)
class _Requested:
    """Requests of one call as a table: `number`, `issue_id`, `table_name`, `partition`, `filter_condition`,
    `run_id`, `predicate` (its place in `predicates`), and a column per partition key, by set of keys."""

    predicates: list[str]
    by_keys: dict[tuple[str, ...], DataFrame]
    scopes: list[dict[str, str]] | None

    @property
    def wanted(self) -> Column:
        """Rows that any predicate may concern, in scope as far as the plan can say.

        Of each set of keys, the values of a key are one list, and so are its partitions: however many
        there are, a row's keys, which may be expressions, are worked out twice.
        """
        if self.scopes is None:
            return F.lit(True)
        named: dict[tuple[str, ...], list[dict[str, str]]] = {}
        for one in self.scopes:
            named.setdefault(tuple(sorted(one)), []).append(one)
        return _any([_in_scope(keys, scopes) for keys, scopes in named.items()])


def _in_scope(keys: Sequence[str], scopes: Sequence[dict[str, str]]) -> Column:
    texts = [F.col(k).cast("string") for k in keys]
    lists = [text.isin(sorted({one[k] for one in scopes})) for k, text in zip(keys, texts)]
    if len(keys) > 1:
        whole = F.concat(*[part for text in texts for part in (F.lit("/"), text)])
        lists.append(whole.isin(sorted({"".join(f"/{one[k]}" for k in keys) for one in scopes})))
    return reduce(lambda a, b: a & b, lists)


def _kept(spark: SparkSession, requests: Requests) -> Requests:
    """Requests given as a table, stored once: what they are derived from is not read again for each step."""
    if not isinstance(requests, DataFrame):
        return requests
    path = scratch_dir(spark, "requests")
    requests.select("issue_id", "table_name", "partition", "filter_condition").write.parquet(path)
    return spark.read.parquet(path)


def _requested(spark: SparkSession, requests: Requests) -> _Requested:
    columns = ("issue_id", "table_name", "partition", "filter_condition")
    if isinstance(requests, DataFrame):
        given = requests.select(F.coalesce("issue_id", F.lit("")).alias("issue_id"), *columns[1:])
        given = given.withColumn("number", F.xxhash64(*columns))
    else:
        for r in requests:
            parse_partition(r.partition)  # a broken scope raises before anything is read
        rows = [(r.issue_id, r.table_name, r.partition, r.filter_condition, n) for n, r in enumerate(requests)]
        given = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns) + ", number bigint")
    pairs = F.filter(F.split("partition", "/"), lambda p: p.contains("="))
    made = F.md5(F.concat_ws("#", "table_name", "partition", "filter_condition").cast("binary"))
    table = given.where(F.size(pairs) > 0).select(
        "number", F.when(F.col("issue_id") == "", made).otherwise(F.col("issue_id")).alias("issue_id"),
        "table_name", "partition", "filter_condition", run_id(F.col("filter_condition")).alias("run_id"),
        F.trim("filter_condition").alias("condition"),
        F.map_from_entries(
            F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1), F.substr(p, F.instr(p, "=") + 1)))
        ).alias("scope"),
    ).withColumn("keys", F.array_sort(F.map_keys("scope")))
    # Predicates, sets of keys and a few scopes: bounded lists that shape the plan.
    predicates = sorted(row["condition"] for row in table.select("condition").distinct().collect())
    numbered = F.array_position(F.array(*map(F.lit, predicates)), F.col("condition")) if predicates else F.lit(0)
    by_keys = {}
    for row in table.select("keys").distinct().collect():
        keys = tuple(row["keys"])
        own = table.where(F.col("keys") == F.array(*map(F.lit, keys)))
        by_keys[keys] = own.select(
            "number", "issue_id", "table_name", "partition", "filter_condition", "run_id", numbered.cast("int").alias("predicate"),
            *[F.col("scope")[k].alias(f"key_{k}") for k in keys],
        )
    scopes = [dict(row["scope"]) for row in table.select("scope", F.to_json("scope").alias("j")).dropDuplicates(["j"]).limit(MAX_SCOPES + 1).collect()]
    return _Requested(predicates, by_keys, scopes if len(scopes) <= MAX_SCOPES else None)


def in_passes(requests: Requests) -> Iterator[Requests]:
    """The requests in parts of at most MAX_PREDICATES different predicates each.

    Of a table, the predicates of one part are on the driver at a time.
    """
    if not isinstance(requests, DataFrame):
        named: dict[str, list[Request]] = {}
        for r in requests:
            parse_partition(r.partition)  # a broken scope raises before anything is written
            named.setdefault(r.filter_condition.strip(), []).append(r)
        groups = [named[c] for c in sorted(named)]
        for n in range(0, len(groups), MAX_PREDICATES):
            yield [r for group in groups[n : n + MAX_PREDICATES] for r in group]
        return
    condition = F.trim("filter_condition")
    rows = requests.select(condition.alias("c")).where("c IS NOT NULL").distinct().toLocalIterator()
    while part := [row["c"] for row in islice(rows, MAX_PREDICATES)]:
        yield requests.where(condition.isin(part))


def run_id(condition: Column) -> Column:
    """The folder of a request's copy within its issue: requests with other predicates have others."""
    return F.left(F.md5(F.trim(condition).cast("binary")), F.lit(12))


def _on_keys(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).cast("string") == F.col(f"key_{k}") for k in keys])


def _tagged(df: DataFrame, requests: Requests) -> DataFrame:
    """Bad rows with `hits`, an array of (number, issue_id, run_id) of the requests they belong to.

    The predicates are one filter, pushed down to the scan. The requests of a partition lie in one row
    of a small table that is joined by the partition keys, so the plan does not grow with them.
    """
    asked = _requested(df.sparkSession, requests)
    if not asked.predicates:
        return df.where(F.lit(False)).withColumn("hits", F.lit(None).cast("array<struct<number:bigint,issue_id:string,run_id:string>>"))
    names = df.columns
    out = df.where(asked.wanted & _any([F.expr(f"({p})") for p in asked.predicates]))
    lists = []
    for n, (keys, own) in enumerate(asked.by_keys.items()):
        entry = F.struct("number", "predicate", "issue_id", "run_id")
        scope = own.groupBy(*[f"key_{k}" for k in keys]).agg(F.sort_array(F.collect_list(entry)).alias(f"requests_{n}"))
        how = "inner" if len(asked.by_keys) == 1 else "left"
        out = out.join(scope, _on_keys(keys), how).drop(*[f"key_{k}" for k in keys])
        lists.append(F.coalesce(f"requests_{n}", F.array()))
    holds = F.array(*[is_bad(p) for p in asked.predicates])
    mine = F.filter(F.sort_array(F.concat(*lists)), lambda r: F.element_at(F.col("__holds"), r["predicate"]))
    hits = F.transform(mine, lambda r: F.struct(r["number"], r["issue_id"], r["run_id"]))
    tagged = out.withColumn("__holds", holds).withColumn("hits", hits).where(F.size("hits") > 0)
    return tagged.select(*names, "hits")


def tag_issues(df: DataFrame, requests: Requests) -> DataFrame:
    """Bad rows of several requests in one pass, each with the ids of all issues it belongs to.

    One plan holds all different predicates, as a row's issues are to stand together.
    """
    issues = F.array_distinct(F.transform("hits", lambda h: h["issue_id"]))
    return _tagged(df, _kept(df.sparkSession, requests)).withColumn("issue_ids", issues).drop("hits")


def quarantine_counts(df: DataFrame, requests: Requests) -> DataFrame:
    """Bad, total and remaining rows of every request, from one aggregate over the predicates'
    columns and the partitions in scope (for each set of keys that requests name, and each pass of
    predicates). Exact also when tasks are repeated. Requests whose partition text names no partition
    have no row."""
    passes = [_counts(df, part) for part in in_passes(_kept(df.sparkSession, requests))] or [_counts(df, [])]
    return reduce(DataFrame.unionByName, passes)


def _counts(df: DataFrame, requests: Requests) -> DataFrame:
    asked = _requested(df.sparkSession, requests)
    parts = []
    for keys, own in asked.by_keys.items():
        counted = df.where(asked.wanted).groupBy(*[F.col(k).cast("string").alias(f"key_{k}") for k in keys]).agg(
            F.count("*").alias("total"), F.array(*[F.count_if(is_bad(p)) for p in asked.predicates]).alias("bad")
        )
        parts.append(own.join(counted, [f"key_{k}" for k in keys], "left"))
    zero = F.lit(0).cast("bigint")
    bad, total = F.coalesce(F.element_at("bad", F.col("predicate")), zero), F.coalesce("total", zero)
    schema = (
        "issue_id string, table_name string, partition string, filter_condition string, bad_count bigint, "
        "total_count bigint, remaining_count bigint"
    )
    rows = [
        p.select(
            "issue_id", "table_name", "partition", "filter_condition", bad.alias("bad_count"),
            total.alias("total_count"), (total - bad).alias("remaining_count"),
        )
        for p in parts
    ]
    return reduce(DataFrame.unionByName, rows) if rows else df.sparkSession.createDataFrame([], schema)


def write_quarantine(
    df: DataFrame, requests: Requests, path: str, keys: Sequence[str], written_at: Column
) -> None:
    """Copy bad rows to `path/table_name=/<keys>/issue_id=/run_id=/written_on=/`.

    A run is one predicate under an issue, so several requests of an issue keep their rows apart. What
    a request has stored before goes first, so that a replay leaves one copy, and none if nothing matches
    any more; the rows stay in the source, and a replay after a failure stores them again. Requests of one
    call must concern one source table.
    """
    for part in in_passes(_kept(df.sparkSession, requests)):
        _write_pass(df, part, path, keys, written_at)


def _write_pass(df: DataFrame, requests: Requests, path: str, keys: Sequence[str], written_at: Column) -> None:
    spark = df.sparkSession
    asked = _requested(spark, requests)
    tables = {r["table_name"] for own in asked.by_keys.values() for r in own.select("table_name").distinct().limit(2).collect()}
    if not tables:
        return
    (table,) = tables
    if path_exists(spark, path):
        zone = read_quarantine(spark, path, keys).where(F.col("table_name") == table)
        runs = reduce(
            DataFrame.unionByName,
            [
                with_folder(zone).join(
                    (own.select("issue_id", "run_id", *[f"key_{k}" for k in named]).distinct()),
                    (zone["issue_id"] == own["issue_id"]) & (zone["run_id"] == own["run_id"]) & _on_keys(named),
                    "left_semi",
                ).select("folder")
                for named, own in asked.by_keys.items()
            ],
        )
        remove_folders(spark, runs.distinct())
    tagged = (
        _tagged(df, requests)
        .withColumn("hit", F.explode(F.array_distinct(F.transform("hits", lambda h: F.struct(h["issue_id"], h["run_id"])))))
        .withColumns(
            {
                "table_name": F.lit(table), "issue_id": F.col("hit.issue_id"), "run_id": F.col("hit.run_id"),
                "written_at": written_at, DAY: F.date_format(written_at, "yyyy-MM-dd"),
            }
        )
        .drop("hits", "hit")
    )
    write_partitions(tagged, path, zone_keys(keys), mode="overwrite")


def zone_keys(keys: Sequence[str]) -> list[str]:
    """The folder levels of the zone."""
    return ["table_name", *keys, "issue_id", "run_id", DAY]


def after_score(before: Column, bad: Column, total: Column) -> Column:
    return F.least(F.lit(100.0), F.round(before + bad / F.greatest(total, F.lit(1)) * 50, 1))


def issue_path(root: str) -> Column:
    return F.concat_ws(
        "/", F.lit(root), F.concat(F.lit("table_name="), "table_name"), "partition",
        F.concat(F.lit("issue_id="), "issue_id"),
    )


def remediation_rows(counts: DataFrame, scans: DataFrame, ts: Column, path: str) -> DataFrame:
    """One remediation row per request that matched rows, with the score before and after."""
    return (
        before_score(counts.where(F.col("bad_count") > 0), scans)
        .withColumn("after_score", after_score(F.col("before_score"), F.col("bad_count"), F.col("total_count")))
        .select(
            "issue_id",
            "table_name",
            "partition",
            ts.alias("ts"),
            F.lit("quarantine").alias("action_type"),
            F.col("bad_count").alias("records_affected"),
            "total_count",
            "before_score",
            "after_score",
            "filter_condition",
            issue_path(path).alias("quarantine_path"),
        )
    )


def remediation_decisions(remediations: DataFrame) -> DataFrame:
    """The audit decision that goes with each remediation."""
    r = F.col
    # The wording of the texts.
    scores = F.concat(
        F.lit("Score: "), r("before_score").cast("string"), F.lit(" → "), r("after_score").cast("string")
    )
    affected, total = F.format_number("records_affected", 0), F.format_number("total_count", 0)
    return remediations.select(
        F.lit("remediation_executed").alias("decision_type"),
        "table_name",
        "partition",
        "ts",
        F.create_map(
            F.lit("issue_id"), r("issue_id"),
            F.lit("filter_condition"), r("filter_condition"),
            F.lit("before_score"), r("before_score").cast("string"),
            F.lit("after_score"), r("after_score").cast("string"),
        ).alias("context"),
        F.concat(
            F.lit("Quarantined "), affected, F.lit(" records matching: "), r("filter_condition"),
            F.lit(". "), scores, F.lit("."),
        ).alias("reasoning"),
        F.concat(
            F.lit("quarantine_records ("), affected, F.lit(" of "), total, F.lit(" records isolated)")
        ).alias("action_taken"),
        F.concat(scores, F.lit(". Quarantined to "), r("quarantine_path")).alias("outcome"),
    )


def check_requests(requests: DataFrame) -> DataFrame:
    """Requests as a table, with `error` set where the partition text names no partition."""
    pairs = partition_pairs(F.col("partition"))
    message = F.concat(
        F.lit("invalid partition spec '"), F.col("partition"), F.lit("', expected key=value/key=value")
    )
    return requests.withColumn("error", F.when(F.size(F.coalesce(pairs, F.array())) == 0, message)).withColumn(
        "filter_condition", F.trim("filter_condition")
    )


def read_quarantine(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The quarantine zone with text partition keys."""
    found = spark.read.option("basePath", path).parquet(path).schema
    texts = set(zone_keys(keys))
    schema = ", ".join(
        f"`{f.name}` {'string' if f.name in texts else f.dataType.simpleString()}" for f in found
    )
    return spark.read.option("basePath", path).schema(schema).parquet(path)


def recover_issue(zone: DataFrame, remediations: DataFrame, issue_id: str) -> DataFrame:
    """Quarantined rows of one issue, with the lineage its newest remediation row kept.

    The issue id is a partition of the zone, so only its folder is read. The lineage is one row
    by construction, hence the broadcast.
    """
    kept = F.struct("issue_id", "filter_condition", "records_affected")
    lineage = (
        remediations.where(F.col("issue_id") == issue_id)
        .agg(F.max_by(kept, "ts").alias("r"))
        .where(F.col("r").isNotNull())
        .select("r.*")
    )
    return zone.where(F.col("issue_id") == issue_id).join(F.broadcast(lineage), "issue_id", "inner")
