"""The agent: sources into segments, segments to a sink, with stored offsets, upkeep and counters.

Records come in as request bodies in a landing folder or as lines of followed files. Each source is a
streaming query whose offsets Spark commits after the append. Delivery goes round by round: a shard's
stored pending batch first, otherwise its next records; the batch is stored, sent by one of a bounded
number of workers, and then the offset is stored and the pending batch removed. So a crash sends again
what may have been sent (at least once).
"""

from __future__ import annotations

import threading
import time
from collections import Counter
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.config import EngineConfig
from tidelog.operators import delivery, ingest, rules
from tidelog.plans.records import ReadQuery, read_records
from tidelog.sources import maintenance, recovery, state
from tidelog.streaming import pipelines
from tidelog.streaming import sources as streams

# Names of the agent's counters, and of the sinks.
COUNTERS = (
    "accepted", "rejected", "source_read", "source_committed", "source_rotations", "source_dropped", "udp_dropped", "malformed_ingest", "sink_sent", "sink_failed",
    "sink_retries", "sink_backlog_records", "sink_dispatch_queue_batches", "sink_dispatch_active_workers", "last_sink_latency_ms", "sink_latency_average_ms",
    "backpressure_pause_duration_ms", "disk_backpressure", "dynamic_backpressure",
)
SINKS = {"": "none", "none": "none", "http": "http", "stdout": "stdout", "kafka": "kafka", "object_store": "object_store", "object-store": "object_store", "s3": "object_store"}
ACK_MODES = ("write_ack", "sync_ack")


def sink_kind(name: str) -> str:
    if name not in SINKS:
        raise ValueError("the sink must be none, http, stdout, kafka or object_store")
    return SINKS[name]


class Agent:
    """Runs sources, delivery and upkeep over one engine's folders; ``limits`` are those of rules.backpressure, 0 or absent is off."""

    def __init__(
        self, spark: SparkSession, config: EngineConfig, send: Callable[[str], None] = pipelines.null_sink, agent_id: str = "agent",
        workers: int = 4, pause: float = 0.2, most_pause: float = 5.0, limits: dict[str, int] | None = None, trigger: str = "1 second",
    ) -> None:
        self.spark, self.config, self.send, self.agent_id = spark, config, send, agent_id
        self.workers, self.pause, self.most_pause, self.limits, self.trigger = workers, pause, most_pause, limits or {}, trigger
        self.stats, self.manager = Counter(dict.fromkeys(COUNTERS, 0)), Counter(dict.fromkeys(recovery.COUNTERS, 0))
        self.state = state.Store(spark, f"{config.archive_dir.rstrip('/')}/_state")
        self.reason, self._paused, self._failures, self._lock = "none", None, Counter(), threading.Lock()
        self.queries: list = []
        self.recovered: list[dict] = []

    # Sources

    def start(self, landing: str | None = None, follow: list[str] | None = None) -> None:
        """Recover the active segments, then start a query for the landing folder and one for followed files."""
        maintenance.remove_leftovers(self.spark, self.config.log_dir)
        self.recovered, found = recovery.recovered(self.spark, self.config)
        self.manager.update(found)
        self.manager.update(recovery.checkpointed(self.spark, self.config, self.recovered))
        if landing:
            bodies = self.spark.readStream.schema("value string").option("maxFilesPerTrigger", 1000).option("wholetext", True).text(landing, wholetext=True)
            self._run("landing", bodies.select(F.col("value").alias("body"), F.lit("landing").alias("source_id")))
        if follow:
            streams.register(self.spark)
            lines = self.spark.readStream.format("tail").option("path", ",".join(follow)).load()
            self._run("follow", lines.select(F.col("line").alias("body"), "source_id", "source_offset"))

    def _run(self, name: str, rows: DataFrame) -> None:
        add = pipelines.appender(self.config, f"{self.agent_id}-{name}")

        def put(batch: DataFrame, batch_id: int) -> None:
            self.wait()
            made = enveloped(batch, self.agent_id).withColumn("n", F.monotonically_increasing_id()).persist()
            try:
                n = made.count()
                add(made, batch_id)
                self._count(source_read=n, source_committed=n, accepted=n)
            finally:
                made.unpersist()

        where = f"{self.config.archive_dir.rstrip('/')}/_state/{self.agent_id}-{name}"
        self.queries.append(rows.writeStream.foreachBatch(put).option("checkpointLocation", where).trigger(processingTime=self.trigger).start())

    def stop(self) -> None:
        for query in self.queries:
            query.stop()

    # Delivery

    def round(self) -> int:
        """Send one batch of each shard that has one pending; the number of records sent. Bounded by shards times sink_batch_size."""
        offsets = state.read_offsets(self.state)
        batches = {s: p for s in range(max(1, self.config.shards)) if (p := state.read_pending(self.state, s)) is not None}
        saved = self.spark.createDataFrame(list(offsets.items()), "shard int, next_sequence long")
        rows = read_records(self.spark, self.config.log_dir, self.config.archive_dir, self.config.file_prefix, ReadQuery(limit=None))
        rows = delivery.pending(rows, saved).persist()
        try:
            self.stats["sink_backlog_records"] = rows.count()
            for r in delivery.replay_batches(rows, saved, self.config.sink_batch_size).collect():
                if r["shard"] not in batches:
                    batches[r["shard"]] = state.PendingBatch(r["shard"], r["first_sequence"], r["next_sequence"], tuple(r["records"]))
                    self.state.write(f"pending.{r['shard']}", batches[r["shard"]].text())
        finally:
            rows.unpersist()
        self.stats["sink_dispatch_queue_batches"] = len(batches)
        with ThreadPoolExecutor(self.workers) as pool:
            return sum(pool.map(self._sent, batches.values()))

    def _sent(self, batch: state.PendingBatch) -> int:
        body = delivery.body_text(self.agent_id, batch.shard, batch.first_sequence, batch.next_sequence, batch.records)
        began = time.monotonic()
        self._count(sink_dispatch_active_workers=1)
        try:
            self.send(body)
        except Exception:
            with self._lock:
                self.stats["sink_failed"] += 1
                self._failures[batch.shard] += 1
            return 0
        finally:
            self._count(sink_dispatch_active_workers=-1, sink_dispatch_queue_batches=-1)
        took = int(1000 * (time.monotonic() - began))
        with self._lock:
            self._failures[batch.shard] = 0
            self.stats["sink_sent"] += len(batch.records)
            self.stats["last_sink_latency_ms"] = took
            was = self.stats["sink_latency_average_ms"]
            self.stats["sink_latency_average_ms"] = took if not was else (7 * was + took) // 8
        state.write_offsets(self.state, {batch.shard: batch.next_sequence})
        self.state.delete(f"pending.{batch.shard}")
        return len(batch.records)

    def deliver(self, stop: Callable[[], bool]) -> None:
        """Rounds until ``stop`` says so, with growing pauses while nothing can be sent."""
        idle = 0
        while not stop():
            idle = 0 if self.round() else idle + 1
            if idle:
                self._count(sink_retries=1 if any(self._failures.values()) else 0)
                time.sleep(min(self.most_pause, self.pause * 2 ** min(idle - 1, 16)))

    # Upkeep

    def upkeep(self, now_ms: int | None = None) -> list[str]:
        """Rotate, compress and delete segments as configured; the deleted ones."""
        now = int(time.time() * 1000) if now_ms is None else now_ms
        self.manager.update(recovery.rotated(self.spark, self.config, now))
        return recovery.retained(self.spark, self.config, now)

    # Backpressure

    def pressure(self) -> str:
        """The first pressure at or over its limit, none if all are below."""
        used = maintenance.directory_size(self.spark, self.config.archive_dir) + maintenance.directory_size(self.spark, self.config.log_dir) if self.limits.get("disk_quota") else 0
        now = {
            "disk_quota": used, "pending_bytes": 0, "sink_backlog": self.stats["sink_backlog_records"], "sink_failures": max(self._failures.values(), default=0),
            "sink_latency": self.stats["last_sink_latency_ms"], "sink_latency_average": self.stats["sink_latency_average_ms"],
        }
        return next((k for k in rules.PRESSURES if self.limits.get(k) and now[k] >= self.limits[k]), "none")

    def wait(self, most_seconds: float = 30.0) -> None:
        """Hold a source back while there is pressure, for ``most_seconds`` at most, and account for the pause."""
        until = time.monotonic() + most_seconds
        while (reason := self.pressure()) != "none" and time.monotonic() < until:
            if self._paused is None:
                self._paused = time.monotonic()
                self._count(**{"disk_backpressure" if reason == "disk_quota" else "dynamic_backpressure": 1})
            self.reason = reason
            time.sleep(self.pause)
        if self._paused is not None:
            self._count(backpressure_pause_duration_ms=int(1000 * (time.monotonic() - self._paused)))
            self._paused = None
        self.reason = reason

    def _count(self, **more: int) -> None:
        with self._lock:
            for name, n in more.items():
                self.stats[name] += n

    def status(self) -> dict:
        """Counters of the agent and of its log manager, the pressure, and how recovery went."""
        last = next((r["mode"].removeprefix("full_scan_") for r in reversed(self.recovered) if r["mode"].startswith("full_scan")), "none")
        return {n: self.stats[n] for n in COUNTERS} | {n: self.manager[n] for n in recovery.COUNTERS} | {"backpressure_reason": self.reason, "recovery_fallback_reason": last}


def enveloped(batch: DataFrame, agent_id: str) -> DataFrame:
    """route_key, level and payload (the agent's envelope) of bodies (body, source_id, maybe source_offset)."""
    if "source_offset" not in batch.columns:
        batch = batch.withColumn("source_offset", F.lit(None).cast("long"))
    own = batch.withColumnRenamed("source_id", "_source")
    rows = ingest.normalised(ingest.bodies(own.where("trim(body) <> ''")), agent_id=agent_id)
    source = F.when(F.col("source_id") != "", F.col("source_id")).otherwise(F.col("_source"))
    stamp = F.when(F.col("ingest_timestamp") != "", F.col("ingest_timestamp")).otherwise(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    body = delivery.envelope_json(F.col("payload"), F.col("agent_id"), source, F.col("source_offset"), stamp, F.col("attributes"))
    return rows.select("route_key", "level", body.alias("payload"))
