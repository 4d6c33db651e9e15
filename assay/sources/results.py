"""Evaluation results: raw records and evaluation events from JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.text import partition_of_predicate
from assay.operators.violations import normalize_result

# The shapes of the input records.
_CATALOG_TABLE = (
    "struct<DatabaseName:string,TableName:string,AdditionalOptions:struct<pushDownPredicate:string>>"
)
# Metric values may be quoted numbers; they are read as text and cast.
_RAW_RESULTS = (
    "array<struct<Name:string,Description:string,Result:string,"
    "EvaluatedMetrics:map<string,string>,EvaluationMessage:string>>"
)
RECORD_SCHEMA = (
    "detail struct<state:string,score:double,context:struct<databaseName:string,tableName:string>>, "
    f"DataSource map<string,{_CATALOG_TABLE}>, "
    f"RuleResults {_RAW_RESULTS}, _corrupt_record string"
)
EVENT_SCHEMA = (
    "evaluation_id string, database string, table string, partition string, overall_state string, "
    "rule_results array<struct<rule:string,state:string,evaluated_metrics:map<string,string>,"
    "description:string>>"
)


def _filled(*candidates: Column | str) -> Column:
    return F.coalesce(*[F.nullif(c if isinstance(c, Column) else F.lit(c), F.lit("")) for c in candidates])


def read_results(
    records: DataFrame, json: str = "value", default_database: str = "lake", default_table: str = "unknown"
) -> DataFrame:
    """Result records (one JSON text per row) as evaluations.

    The id is spelled `resultID` or `resultId`; both are read by path, since one struct cannot
    hold the two. A record without an id, or one that is no JSON, keeps its row with `error` set.
    """
    text = F.col(json)
    rec = F.from_json(text, RECORD_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record"})
    parsed = records.select(
        _filled(
            F.get_json_object(text, "$.detail.resultID"), F.get_json_object(text, "$.detail.resultId")
        ).alias("evaluation_id"),
        rec.alias("rec"),
    )
    # The data source is keyed by its kind; whichever kind it is, it describes one table.
    source = F.get(F.map_values("rec.DataSource"), F.lit(0))
    context = F.col("rec.detail.context")
    out = parsed.select(
        "evaluation_id",
        _filled(source["DatabaseName"], context["databaseName"], default_database).alias("database"),
        _filled(source["TableName"], context["tableName"], default_table).alias("table_name"),
        partition_of_predicate(source["AdditionalOptions"]["pushDownPredicate"]).alias("partition"),
        F.coalesce("rec.detail.state", F.lit("UNKNOWN")).alias("run_state"),
        F.transform(
            F.coalesce("rec.RuleResults", F.array().cast(_RAW_RESULTS)), normalize_result
        ).alias("rule_results"),
        F.when(F.col("rec._corrupt_record").isNotNull(), "not a JSON record")
        .when(F.col("evaluation_id").isNull(), "no result id")
        .alias("error"),
    )
    failed = F.exists("rule_results", lambda r: r["state"] == "FAILED")
    return out.withColumn("overall_state", F.when(failed, "FAILED").otherwise("PASSED"))


def _event_result(result: Column) -> Column:
    return F.struct(
        result["rule"].alias("rule"),
        result["state"].alias("state"),
        F.transform_values(result["evaluated_metrics"], lambda k, v: v.try_cast("double")).alias(
            "evaluated_metrics"
        ),
        result["description"].alias("description"),
    )


def read_events(
    events: DataFrame, json: str = "value", default_database: str = "lake", carry: Sequence[str] = ()
) -> DataFrame:
    """Evaluation events (one JSON text per row), with the parser's defaults for absent fields.

    A text that is no JSON object, or whose fields have other types, keeps its row: `error` is set, and its
    id is a hash of the text, so that such events are told apart. Columns named in `carry` stay.
    """
    options = {"columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = F.from_json(F.col(json), f"{EVENT_SCHEMA}, _corrupt_record string", options).alias("e")
    event = events.select(F.col(json).alias("_text"), *carry, parsed)
    broken = F.col("e").isNull() | F.col("e._corrupt_record").isNotNull() | ~F.trim("_text").startswith("{")
    unknown = F.lit("unknown")
    hashed = F.concat(F.lit("malformed-"), F.md5(F.coalesce("_text", F.lit("")).cast("binary")))

    def field(name: str, default: Column) -> Column:
        return F.when(_yes(broken), default).otherwise(F.coalesce(F.col(f"e.{name}"), default)).alias(name)

    return event.select(
        F.when(_yes(broken), hashed).otherwise(F.coalesce("e.evaluation_id", unknown)).alias("evaluation_id"),
        field("database", F.lit(default_database)),
        field("table", unknown).alias("table_name"),
        field("partition", unknown),
        field("overall_state", F.lit("UNKNOWN")),
        F.when(~_yes(broken), F.transform("e.rule_results", _event_result)).alias("rule_results"),
        F.when(_yes(broken), F.lit("not a JSON event")).alias("error"),
        *carry,
    )


def _yes(condition: Column) -> Column:
    """`condition` with null read as true: a text that is null is broken too."""
    return F.coalesce(condition, F.lit(True))


def sound_events(events: DataFrame) -> DataFrame:
    """The events that were read; the others (`error` set) are kept apart and never graded as passed."""
    return events.where(F.col("error").isNull()).drop("error")
