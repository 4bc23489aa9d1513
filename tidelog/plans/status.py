"""Rendering of query results and the engine's status as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.config import EngineConfig
from tidelog.functions.text import json_string
from tidelog.operators import delivery, routing, rules
from tidelog.sources import recovery
from tidelog.sources import segments as seg


def record_json() -> Column:
    """A record as one JSON object; a missing source offset is shown as false and 0, attributes in order of names."""
    pairs = F.array_sort(F.map_entries("attributes"))
    shown = F.array_join(F.transform(pairs, lambda e: F.concat(json_string(e["key"]), F.lit(":"), json_string(e["value"]))), ",")
    item = lambda name, c: F.concat(F.lit(f'"{name}":'), c)
    flag = lambda c: F.when(c, "true").otherwise("false")
    return F.concat(F.lit("{"), F.concat_ws(
        ",",
        item("crc", F.col("crc").cast("string")), item("timestamp", json_string(F.col("timestamp"))), item("shard", F.col("shard").cast("string")),
        item("has_sequence", flag(F.col("has_sequence"))), item("sequence", F.col("sequence").cast("string")), item("level", json_string(F.col("level"))),
        item("payload", json_string(F.col("payload"))), item("agent_id", json_string(F.col("agent_id"))), item("source_id", json_string(F.col("source_id"))),
        item("has_source_offset", flag(F.col("source_offset").isNotNull())), item("source_offset", F.coalesce(F.col("source_offset"), F.lit(0)).cast("string")),
        item("ingest_timestamp", json_string(F.col("ingest_timestamp"))), item("attributes", F.concat(F.lit("{"), shown, F.lit("}"))),
    ), F.lit("}"))


def export_batch(rows: DataFrame, agent_id: str | None) -> DataFrame:
    """shard, body: query results as the batch that a sink would get, one for each shard."""
    made = rows.groupBy("shard").agg(
        F.min("sequence").alias("first_sequence"), (F.max("sequence") + 1).alias("next_sequence"),
        F.sort_array(F.collect_list(F.struct("sequence", "payload"))).alias("_rows"),
    ).withColumn("records", F.col("_rows.payload"))
    return made.select("shard", delivery.delivery_json(F.lit(agent_id or "query-export")).alias("body"))


def status(spark: SparkSession, config: EngineConfig, manager: dict[str, int] | None = None, reason: str = "none") -> DataFrame:
    """One row: health and its reason, the configuration that routes, the counters of a read of all segments, and the log manager's.

    manager: the log manager's counters, as an agent has them; without them those of a recovery now.
    """
    if manager is None:
        ends, manager = recovery.recovered(spark, config)
        reason = next((r["mode"].removeprefix("full_scan_") for r in reversed(ends) if r["mode"].startswith("full_scan")), "none")
    found = seg.segments(spark, config.log_dir, config.archive_dir, config.file_prefix)
    ring_size = config.shards * config.virtual_nodes if config.routing == "consistent_hashing" else 0
    rows = seg.read_statistics(spark, found).withColumns({n: F.lit(manager.get(n, 0)).cast("long") for n in recovery.COUNTERS})
    recent = {"checkpoint_failures": F.col("checkpoint_write_failures")}
    rows = rows.withColumns(recent)
    rows = rows.withColumns({"health": rules.health_status(), "health_reason": rules.health_reason(), "health_reason_basis": rules.health_basis()}).drop(*recent)
    return rows.withColumns({
        "recovery_fallback_reason": F.lit(reason), "log_dir": F.lit(config.log_dir), "archive_dir": F.lit(config.archive_dir), "file_prefix": F.lit(config.file_prefix),
        "shard_count": F.lit(config.shards), "routing": F.lit(config.routing), "ring_size": F.lit(ring_size),
        "virtual_nodes": F.lit(config.virtual_nodes), "crc_class": F.lit(config.crc_class),
    })


def route_json(config: EngineConfig, key: str) -> dict:
    points = routing.ring(config.shards, config.virtual_nodes) if config.routing == "consistent_hashing" else None
    return routing.route(key, config.shards, points)
