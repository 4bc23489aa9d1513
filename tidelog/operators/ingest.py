"""Ingest: request bodies to records, size limits, multi-line records and source offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions.running import STEP, carried, totals_before

# Attributes that are taken from a record's top level, and names of levels.
PROMOTED = ("service", "host", "trace_id")
LEVEL_NAMES = {"warn": "WARN", "warning": "WARN", "error": "ERROR", "err": "ERROR"}


def level(name: Column) -> Column:
    out = F.lit("INFO")
    for word, shown in LEVEL_NAMES.items():
        out = F.when(F.lower(name) == word, shown).otherwise(out)
    return out


def bodies(requests: DataFrame, body: str = "body") -> DataFrame:
    """One row for each record of a body: a JSON object, ``{"records": [objects]}``, or plain text.

    If an element of ``records`` is no object, the body is one record.
    """
    v = F.try_parse_json(body)
    items = F.try_variant_get(v, "$.records", "array<variant>")
    whole = F.array(F.col(body))
    texts = F.transform(items, lambda x: F.to_json(x))
    batch = F.size(items) > 0
    batch = batch & F.forall(texts, lambda t: t.startswith("{"))
    return requests.withColumn("record", F.explode(F.when(F.coalesce(batch, F.lit(False)), texts).otherwise(whole)))


def normalised(rows: DataFrame, record: str = "record", agent_id: str = "") -> DataFrame:
    """route_key, level, payload, agent_id, source_id, ingest_timestamp, attributes of each record text."""
    rows = rows.withColumn("_v", F.when(F.col(record).startswith("{"), F.try_parse_json(record)))
    text = lambda key: F.nullif(F.try_variant_get("_v", f"$.{key}", "string"), F.lit(""))
    own = F.coalesce(F.try_variant_get("_v", "$.attributes", "map<string,string>"), F.create_map().cast("map<string,string>"))
    extra = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), text(k).alias("value")) for k in PROMOTED]), lambda e: e["value"].isNotNull() & ~F.array_contains(F.map_keys(own), e["key"]))
    return rows.withColumns({
        "route_key": F.coalesce(text("route_key"), text("service"), F.lit("")),
        "level": level(F.coalesce(text("level"), F.lit(""))),
        "payload": F.coalesce(text("payload"), text("message"), F.col(record)),
        "agent_id": F.coalesce(text("agent_id"), F.lit(agent_id)),
        "source_id": F.coalesce(text("source_id"), F.lit("")),
        "ingest_timestamp": F.coalesce(text("ingest_timestamp"), text("timestamp"), F.lit("")),
        "attributes": F.map_from_entries(F.concat(F.map_entries(own), extra)),
    }).drop("_v")


def limited(rows: DataFrame, batch: str, order: str, text: str, most_message: int, most_buffer: int) -> DataFrame:
    """``rows`` with decision: accept, message_too_large, or buffer_too_large where the batch's bytes up to here are too many."""
    size = F.octet_length(text)
    rows = totals_before(rows, batch, order, "_upto", size)
    decision = F.when(size > most_message, "message_too_large").when(F.col("_upto") + size > most_buffer, "buffer_too_large").otherwise("accept")
    return rows.withColumn("decision", decision).drop("_upto")


def line_offsets(rows: DataFrame, source: str, order: str, text: str) -> DataFrame:
    """``rows`` with source_offset: where each line begins in its source."""
    return totals_before(rows, source, order, "source_offset", F.octet_length(text) + 1)


def multiline(rows: DataFrame, batch: str, order: str, text: str, starts: str, most_lines: int, step: int = STEP) -> DataFrame:
    """batch, first (order of its first line), record: lines merged until the next that begins with ``starts``.

    An empty pattern starts a record at every line. A record of ``most_lines`` lines ends there and
    the next line begins another, so long runs are cut by position. Positions are counted in ranges of
    ``step`` of the order column and shifted by the ranges before.
    """
    line = F.col(text)
    begins = F.lit(True) if starts == "" else line.startswith(starts)
    own = W.partitionBy(batch, "_range").orderBy(order)
    local = rows.withColumn("_range", F.floor(F.col(order) / step)).withColumn("_at", F.row_number().over(own) - 1)
    local = local.withColumn("_start", F.max(F.when(begins, F.col("_at"))).over(own.rowsBetween(W.unboundedPreceding, 0)))
    before = W.partitionBy(batch).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    bases = local.groupBy(batch, "_range").agg(F.count("*").alias("_n"), F.max("_start").alias("_last"))
    bases = bases.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    bases = bases.withColumn("_open", F.max(F.col("_base") + F.col("_last")).over(before)).drop("_n", "_last")
    placed = carried(local, bases, [batch, "_range"])
    placed = placed.withColumn("_start", F.coalesce(F.col("_base") + F.col("_start"), "_open", F.lit(0)))
    placed = placed.withColumn("_part", F.floor((F.col("_base") + F.col("_at") - F.col("_start")) / most_lines))
    merged = placed.groupBy(batch, "_start", "_part").agg(
        F.min(order).alias("first"), F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t")))).alias("_l")
    )
    return merged.select(batch, "first", F.array_join(F.col("_l.t"), "\n").alias("record"))
