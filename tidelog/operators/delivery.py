"""Delivery: batches for sinks, replay from saved offsets, and the JSON that sinks take."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions.text import json_escaped, json_string


def merged_offsets(shared: DataFrame, own: DataFrame) -> DataFrame:
    """(shard, next_sequence) of both tables; a shard's own entry wins over the shared one."""
    right = own.select("shard", F.col("next_sequence").alias("_own"))
    return shared.join(right, "shard", "full_outer").select("shard", F.coalesce("_own", "next_sequence").alias("next_sequence"))


def pending(records: DataFrame, offsets: DataFrame) -> DataFrame:
    """Records at or after their shard's saved offset, all of a shard without one."""
    saved = offsets.select("shard", F.col("next_sequence").alias("_next"))
    return records.join(saved, "shard", "left").where(F.col("sequence") >= F.coalesce("_next", F.lit(0))).drop("_next")


def first_of_shard(records: DataFrame, n: int) -> DataFrame:
    """The ``n`` lowest sequences of each shard; Spark cuts them to ``n`` per task before the shuffle."""
    nth = F.row_number().over(W.partitionBy("shard").orderBy("sequence"))
    return records.withColumn("_n", nth).where(F.col("_n") <= n).drop("_n")


def batches(records: DataFrame, size: int) -> DataFrame:
    """shard, batch_no, first_sequence, next_sequence, records: every ``size`` sequences of a shard are a batch.

    A batch is a key of its own, so a hot shard is many groups of bounded size.
    """
    rows = records.withColumn("batch_no", F.floor(F.col("sequence") / size).cast("long"))
    made = rows.groupBy("shard", "batch_no").agg(
        F.min("sequence").alias("first_sequence"),
        (F.max("sequence") + 1).alias("next_sequence"),
        F.sort_array(F.collect_list(F.struct("sequence", "payload"))).alias("_rows"),
    )
    return made.select("shard", "batch_no", "first_sequence", "next_sequence", F.col("_rows.payload").alias("records"))


def replay_batches(records: DataFrame, offsets: DataFrame, size: int) -> DataFrame:
    """One batch per shard: its first ``size`` pending records."""
    rows = first_of_shard(pending(records, offsets), size)
    made = rows.groupBy("shard").agg(
        F.min("sequence").alias("first_sequence"),
        (F.max("sequence") + 1).alias("next_sequence"),
        F.sort_array(F.collect_list(F.struct("sequence", "payload"))).alias("_rows"),
    )
    return made.select("shard", "first_sequence", "next_sequence", F.col("_rows.payload").alias("records"))


def delivery_json(agent_id: Column) -> Column:
    """A batch as JSON; records are numbered on from the first sequence."""
    item = lambda r, i: F.concat(
        F.lit('{"sequence":'), (F.col("first_sequence") + i).cast("string"), F.lit(',"message":'), json_string(r), F.lit("}")
    )
    return F.concat(
        F.lit('{"agent_id":'), json_string(agent_id),
        F.lit(',"shard":'), F.col("shard").cast("string"),
        F.lit(',"first_sequence":'), F.col("first_sequence").cast("string"),
        F.lit(',"next_sequence":'), F.col("next_sequence").cast("string"),
        F.lit(',"records":['), F.array_join(F.transform("records", item), ","), F.lit("]}"),
    )


def body_text(agent_id: str, shard: int, first_sequence: int, next_sequence: int, records: tuple[str, ...]) -> str:
    """The text of delivery_json() for a batch that the driver holds."""
    rows = [{"sequence": first_sequence + i, "message": r} for i, r in enumerate(records)]
    body = {"agent_id": agent_id, "shard": shard, "first_sequence": first_sequence, "next_sequence": next_sequence, "records": rows}
    return json.dumps(body, ensure_ascii=False, separators=(",", ":"))


def kafka_json(topic: Column, agent_id: Column) -> Column:
    """A batch as the message that a Kafka side process sends: topic, key and value."""
    key = F.concat_ws(":", F.col("shard").cast("string"), F.col("first_sequence").cast("string"))
    return F.concat(
        F.lit('{"topic":'), json_string(topic), F.lit(',"key":'), json_string(key), F.lit(',"value":'), delivery_json(agent_id), F.lit("}")
    )


def object_name(prefix: Column) -> Column:
    span = F.concat_ws("-", F.col("first_sequence").cast("string"), F.col("next_sequence").cast("string"))
    return F.concat(prefix, F.lit("/shard-"), F.col("shard").cast("string"), F.lit("/"), span, F.lit(".json"))


def manifest_json(prefix: Column, agent_id: Column) -> Column:
    """A batch as an object-store manifest: object, commit marker and body."""
    name = object_name(prefix)
    return F.concat(
        F.lit('{"object":'), json_string(name), F.lit(',"commit_marker":'), json_string(F.concat(name, F.lit(".commit"))),
        F.lit(',"body":'), delivery_json(agent_id), F.lit("}"),
    )


def simple_json(records: Column) -> Column:
    item = lambda r: F.concat(F.lit('{"message":'), json_string(r), F.lit("}"))
    return F.concat(F.lit('{"records":['), F.array_join(F.transform(records, item), ","), F.lit("]}"))


def envelope_json(message: Column, agent_id: Column, source_id: Column, source_offset: Column, ingest_timestamp: Column, attributes: Column) -> Column:
    """The agent's envelope of a message; what is empty is left out, attributes are in order of their names."""
    some = lambda key, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f',"{key}":'), json_string(c)))
    pairs = F.array_sort(F.map_entries(attributes))
    shown = F.array_join(F.transform(pairs, lambda e: F.concat(json_string(e["key"]), F.lit(":"), json_string(e["value"]))), ",")
    return F.concat_ws(
        "",
        F.lit('{"message":"'), json_escaped(message), F.lit('"'),
        some("agent_id", agent_id), some("source_id", source_id),
        F.when(source_offset.isNotNull(), F.concat(F.lit(',"source_offset":'), source_offset.cast("string"))),
        some("ingest_timestamp", ingest_timestamp),
        F.when(F.size(attributes) > 0, F.concat(F.lit(',"attributes":{'), shown, F.lit("}"))),
        F.lit("}"),
    )


def deduplicated(delivered: DataFrame) -> DataFrame:
    """What a receiver keeps of redelivered batches: one of each agent, shard and span."""
    return delivered.dropDuplicates(["agent_id", "shard", "first_sequence", "next_sequence"])
