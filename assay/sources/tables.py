"""The fact table: schema, whole scan and scan of one partition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The trip table's columns. The partition keys are declared as text, because
# inference would read month=03 as the number 3.
TRIP_SCHEMA = (
    "VendorID int, tpep_pickup_datetime timestamp, tpep_dropoff_datetime timestamp, "
    "passenger_count bigint, trip_distance double, RatecodeID bigint, store_and_fwd_flag string, "
    "PULocationID int, DOLocationID int, payment_type bigint, fare_amount double, extra double, "
    "mta_tax double, tip_amount double, tolls_amount double, improvement_surcharge double, "
    "total_amount double, congestion_surcharge double, Airport_fee double, "
    "year string, month string"
)
ZONES = ("raw", "staging", "curated", "quarantine")


def zone_path(root: str, zone: str, table: str) -> str:
    if zone not in ZONES:
        raise ValueError(f"no such zone: {zone!r}")
    return f"{root.rstrip('/')}/{zone}/{table}"


def read_fact(spark: SparkSession, path: str, schema: str = TRIP_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def parse_partition(spec: str) -> dict[str, str]:
    """`year=2025/month=09` as a dict. Pieces without `=` are dropped; none left is an error,
    so that a broken scope never turns into the whole table."""
    pairs = dict(piece.split("=", 1) for piece in spec.split("/") if "=" in piece)
    if not pairs:
        raise ValueError(f"invalid partition spec {spec!r}, expected key=value/key=value")
    return pairs


def partition_filter(spec: str) -> Column:
    """Equalities on the partition columns, which Catalyst turns into partition pruning."""
    return reduce(lambda a, b: a & b, [F.col(k) == v for k, v in parse_partition(spec).items()])


def read_partition(spark: SparkSession, path: str, spec: str, schema: str = TRIP_SCHEMA) -> DataFrame:
    return read_fact(spark, path, schema).where(partition_filter(spec))
