"""Streaming pipelines: append, multi-line records with carried state, delivery, recent counters, duplicates."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelog.config import EngineConfig
from tidelog.functions.codec import timestamp_text
from tidelog.operators import delivery, routing
from tidelog.sources import state, writer

# HTTP answers after which a delivery is tried again.
RETRYABLE = (408, 425, 429, 500, 502, 503, 504)


def appender(config: EngineConfig, owner: str | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over (route_key, level, payload, n): each batch becomes one archived segment of every shard.

    Sequences and archive stamps go on from what any writer before has stored in ``_state`` beside the
    segments. A batch of an ``owner`` (the streaming query's id, or one of its own, if not given) first stores its plan, the
    stamp and the first sequence of each shard, so that a batch that is run again writes the same names
    and nothing is doubled. One writer at a time may append to a folder.
    """
    points = routing.ring(config.shards, config.virtual_nodes) if config.routing == "consistent_hashing" else None
    alone = uuid.uuid4().hex

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        index = "n" if config.empty_route_key == "round_robin" else None
        rows = routing.routed(batch, "route_key", config.shards, points, index=index).persist()
        try:
            # One row for each shard.
            counts = {r["shard"]: r["count"] for r in rows.groupBy("shard").count().collect()}
            if not counts:
                return
            name = owner or spark.sparkContext.getLocalProperty("sql.streaming.queryId") or alone
            first, stamp = _planned(state.Store(spark, f"{config.archive_dir}/_state"), name, batch_id, counts)
            base = F.element_at(F.create_map(*[F.lit(x) for shard in sorted(first) for x in (shard, first[shard])]), F.col("shard"))
            numbered = writer.sequenced(rows, "n", base).withColumn("timestamp", timestamp_text(F.current_timestamp()))
            writer.write_archive(writer.encoded_lines(numbered, config), config.archive_dir, config.file_prefix, stamp, config.compress_archives)
        finally:
            rows.unpersist()

    return append


def _planned(store: state.Store, owner: str, batch_id: int, counts: dict[int, int]) -> tuple[dict[int, int], int]:
    """First sequence of each shard and the stamp of a batch: those stored for it, or the next ones, which are then taken."""
    known = store.read(f"plan.{owner}")
    if known is not None and (plan := json.loads(known))["batch"] == batch_id:
        return {int(s): n for s, n in plan["first"].items()}, plan["stamp"]
    head = json.loads(store.read("head") or '{"next": {}, "stamp": 0}')
    after = {int(s): n for s, n in head["next"].items()}
    first = {s: after.get(s, 0) for s in counts}
    stamp = max(head["stamp"] + 1, int(time.time() * 1000))
    # The numbers are taken before the plan names them: a crash in between leaves a gap, never the same number twice.
    store.write("head", json.dumps({"next": after | {s: n + counts[s] for s, n in first.items()}, "stamp": stamp}))
    store.write(f"plan.{owner}", json.dumps({"batch": batch_id, "first": first, "stamp": stamp}))
    return first, stamp


def multiline(lines: DataFrame, key: str, starts: str, most_lines: int, quiet_ms: int | None = None) -> DataFrame:
    """key, record: lines of a stream merged until the next that begins with ``starts``, across micro-batches.

    The open record of a key waits in state for its next line. With ``quiet_ms`` it is also given out
    after that time without one; Spark then makes a micro-batch at every trigger, so start such a
    stream with a trigger of some seconds. A key's lines of one micro-batch are sorted together.
    """

    def merge(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        out = []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [name[0]], "record": ["\n".join(held)]})
            return
        for line in pd.concat(list(frames)).sort_values("source_offset", kind="stable")["line"]:
            if held and (not starts or line.startswith(starts) or len(held) >= most_lines):
                out.append("\n".join(held))
                held = []
            held.append(line)
        state.update((held,))
        if quiet_ms is not None:
            state.setTimeoutDuration(quiet_ms)
        yield pd.DataFrame({key: [name[0]] * len(out), "record": out})

    return lines.groupBy(key).applyInPandasWithState(
        merge, f"{key} string, record string", "held array<string>", "append",
        GroupStateTimeout.NoTimeout if quiet_ms is None else GroupStateTimeout.ProcessingTimeTimeout,
    )


def recent_counts(events: DataFrame, ts: str, key: str, late: str = "10 minutes") -> DataFrame:
    """key, window, n of a stream: five-minute windows that begin at every minute, late rows up to ``late``."""
    return events.withWatermark(ts, late).groupBy(key, F.window(ts, "5 minutes", "1 minute")).agg(F.count("*").alias("n"))


def deduplicated(delivered: DataFrame, ts: str, late: str = "10 minutes") -> DataFrame:
    """A stream of deliveries without repeated (agent_id, shard, first_sequence, next_sequence)."""
    return delivered.withWatermark(ts, late).dropDuplicatesWithinWatermark(["agent_id", "shard", "first_sequence", "next_sequence"])


def http_sink(
    url: str, timeout: float = 5.0, tries: int = 5, pause: float = 0.2, most_pause: float = 5.0,
    headers: dict[str, str] | None = None, retryable: tuple[int, ...] = RETRYABLE,
) -> Callable[[str], None]:
    """Posts a body with ``headers``; answers in ``retryable`` and lost connections are tried again after growing pauses."""

    def send(body: str) -> None:
        for k in range(tries):
            try:
                request = urllib.request.Request(url, body.encode(), {"Content-Type": "application/json"} | (headers or {}))
                with urllib.request.urlopen(request, timeout=timeout):
                    return
            except urllib.error.HTTPError as e:
                if e.code not in retryable or k == tries - 1:
                    raise
            except OSError:
                if k == tries - 1:
                    raise
            time.sleep(min(most_pause, pause * 2**k))

    return send


def stdout_sink(body: str) -> None:
    print(body, flush=True)


def null_sink(body: str) -> None:
    del body


def object_sink(folder: str) -> Callable[[DataFrame], None]:
    """Writes batches (with body) as JSON lines under ``folder`` by shard; Spark's _SUCCESS is the commit marker."""

    def send(made: DataFrame) -> None:
        made.select("shard", F.col("body").alias("value")).write.mode("append").partitionBy("shard").text(folder)

    return send


def deliver(records: DataFrame, offsets: DataFrame, agent_id: str, size: int, send: Callable[[str], None]) -> DataFrame:
    """Send every pending record in batches of ``size`` sequences and give the offsets after them.

    A shard's batches are sent in order by one task, shards side by side. Offsets count only after all
    are sent, so a failure sends again what was sent (at least once) and a receiver drops repeats by span.
    """
    made = delivery.batches(delivery.pending(records, offsets), size).withColumn("body", delivery.delivery_json(F.lit(agent_id)))
    made = made.select("shard", "first_sequence", "next_sequence", "body").persist()

    def run(rows) -> None:
        for row in rows:
            send(row["body"])

    made.repartition("shard").sortWithinPartitions("shard", "first_sequence").select("body").foreachPartition(run)
    after = made.groupBy("shard").agg(F.max("next_sequence").alias("next_sequence"))
    return delivery.merged_offsets(offsets, after)
