"""Synthetic records for load tests: numbered payloads padded to a size, dealt to a number of route keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def generated(spark: SparkSession, n: int, payload_bytes: int = 128, route_keys: int = 0, level: str = "INFO") -> DataFrame:
    """level, payload, route_key, n of ``n`` records; with no route keys these are empty."""
    text = F.rpad(F.concat(F.lit("bench-log-"), F.col("id").cast("string"), F.lit(" ")), payload_bytes, "b")
    key = F.concat(F.lit("route-"), (F.col("id") % route_keys).cast("string")) if route_keys else F.lit("")
    return spark.range(n).select(F.lit(level).alias("level"), text.alias("payload"), key.alias("route_key"), F.col("id").alias("n"))
