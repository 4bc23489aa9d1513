"""Registered queries: one or more per operator, over records derived from ``events`` or from other tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.config import EngineConfig
from tidelog.functions import text as tx
from tidelog.functions.codec import RecordFormat, decoded, encoded, level_name, sanitised, sequence_of, timestamp_text
from tidelog.functions.hashing import crc_hex, fnv1a64, unsigned
from tidelog.operators import delivery, ingest, reports, routing, rules
from tidelog.plans.records import ReadQuery, matching, read_records
from tidelog.sources import maintenance, recovery
from tidelog.sources import segments as seg
from tidelog.sources import writer

SHARDS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log records of events before they are numbered."""
    e = table(spark, sf_dir, "events")
    e = e.withColumn("route_key", F.concat(F.lit("user-"), F.col("user_id").cast("string")))
    e = routing.hashed_keys(e, "route_key").withColumn("shard", routing.modulo_shard(F.col("hash"), SHARDS))
    return e.select(
        "event_id", "user_id", "value", "shard", "route_key", "hash", "ts",
        timestamp_text(F.col("ts")).alias("timestamp"),
        F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN").otherwise("INFO").alias("level"),
        F.concat(F.lit("agent-"), (F.col("user_id") % 5).cast("string")).alias("agent_id"),
        F.col("event_type").alias("source_id"),
        F.col("event_id").alias("source_offset"),
        F.col("props").alias("payload"),
        F.lit(True).alias("has_sequence"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log records of events: routed by user, numbered per shard in order of event_id."""
    return writer.sequenced(_routed(spark, sf_dir), "event_id")


SHOWN = ["shard", "sequence", "timestamp", "level", "payload", "agent_id", "source_id", "source_offset"]


def _read(q: ReadQuery) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = records(spark, sf_dir)
        if q.shard is not None:
            rows = rows.where(F.col("shard") == q.shard)
        rows = matching(rows, q).select(*SHOWN)
        return rows if q.limit is None else rows.orderBy("shard", "sequence").limit(q.limit)

    return run


def encode_full_crc(spark, sf_dir):
    rows = records(spark, sf_dir)
    line = encoded(RecordFormat(), F.col("timestamp"), F.col("shard"), F.col("sequence"), F.col("level"), F.col("payload"))
    return rows.select("shard", "sequence", line.alias("line"))


def encode_header_crc(spark, sf_dir):
    rows = records(spark, sf_dir)
    line = encoded(RecordFormat(crc="header"), F.col("timestamp"), F.col("shard"), F.col("sequence"), F.col("level"), F.col("payload"))
    return rows.select("shard", "sequence", line.alias("line"))


def codec_roundtrip(spark, sf_dir):
    """Encode, damage every seventh line's payload, decode: what survives."""
    rows = records(spark, sf_dir)
    line = encoded(RecordFormat(), F.col("timestamp"), F.col("shard"), F.col("sequence"), F.col("level"), F.col("payload"))
    lines = rows.select("event_id", F.when(F.col("event_id") % 7 == 0, F.concat(line, F.lit("?"))).otherwise(line).alias("line"))
    return decoded(lines, hashes=False).where("valid").select("event_id", "timestamp", F.col("shard").cast("long").alias("shard"), "sequence", "level", "payload")


def sanitize_payload(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sanitised(F.coalesce("text", F.lit(""))).alias("payload"))


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded lines of every shard with their place in a segment: 500 lines a segment, every 997th damaged."""
    rows = records(spark, sf_dir)
    line = encoded(RecordFormat(), F.col("timestamp"), F.col("shard"), F.col("sequence"), F.col("level"), F.col("payload"))
    damaged = F.when(F.col("sequence") % 997 == 300, F.concat(line, F.lit("!"))).otherwise(line)
    return rows.select(
        F.concat_ws(".", F.col("shard").cast("string"), F.floor(F.col("sequence") / 500).cast("string")).alias("seg_path"),
        (F.col("sequence") % 500).alias("line_no"), damaged.alias("line"),
    )


def verify_prefix(spark, sf_dir):
    return seg.verified_prefix(decoded(_written(spark, sf_dir), hashes=False))


def reader_stats(spark, sf_dir):
    rows = decoded(_written(spark, sf_dir), hashes=False).select("seg_path", "line_no", "valid")
    first = rows.groupBy("seg_path").agg(F.min(F.when(~F.col("valid"), F.col("line_no"))).alias("bad"), F.count("*").alias("n"))
    return first.agg(
        F.count("*").alias("segments_read"), F.sum(F.coalesce("bad", "n")).alias("records_returned"),
        F.count("bad").alias("corrupted_segments"),
    )


#: Checksum class of each shard's files; those of the last shard have none, so damage there can't be seen.
_CLASSES = ("full", "header", "payload_hash", "none")


def _segment_files(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Log and archive folder of segments with all records: 500 lines a file, plain and compressed by turns, the last of a shard active.

    Every 997th line's checksum is damaged. Files lie in the shared folder, for this call alone, until the session ends.
    """
    rows = records(spark, sf_dir)
    field = [F.col(c) for c in ("timestamp", "shard", "sequence", "level")]
    line = F.lit(None).cast("string")
    for shard, kind in enumerate(_CLASSES):
        own = encoded(RecordFormat(crc=kind), *field, F.when(F.col("shard") == shard, F.col("payload")))
        if kind != "none":
            own = F.when(F.col("sequence") % 997 == 300, F.concat(F.lit("crc=?"), F.substring(own, 6, 2**31 - 1))).otherwise(own)
        line = F.when(F.col("shard") == shard, own).otherwise(line)
    # Numbers run from 0 without a gap.
    last = _routed(spark, sf_dir).groupBy("shard").agg(F.floor((F.count("*") - 1) / 500).alias("last"))
    block = F.floor(F.col("sequence") / 500)
    stem = F.concat(F.lit("shard-"), F.col("shard").cast("string"))
    end = F.when(block % 2 == 0, ".log.gz").otherwise(".log")
    name = F.when(block == F.col("last"), F.concat(stem, F.lit(".log"))).otherwise(F.concat(stem, F.lit("."), (block + 1000).cast("string"), F.lit(".0"), end))
    # Joined by shard, a shard's records would all lie in one task; there are only as many rows as shards to send.
    placed = rows.join(F.broadcast(last), "shard").select(name.alias("name"), "sequence", line.alias("line"))
    folder = maintenance.scratch(spark, "segments")
    logs, archive = f"{folder}/logs", f"{folder}/archive"
    held = placed.persist()
    writer.write_named(held, folder, lambda name: f"{'logs' if re.fullmatch('shard-[0-9]+[.]log', name) else 'archive'}/{name}")
    held.unpersist()
    return logs, archive


def _from_files(q: ReadQuery) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = read_records(spark, *_segment_files(spark, sf_dir), "shard", q)
        return rows.select(F.col("shard").cast("int").alias("shard"), "sequence", "timestamp", "level", "payload", "archived", F.element_at(F.split("path", "/"), -1).alias("file"))

    return run


def segments_statistics(spark, sf_dir):
    logs, archive = _segment_files(spark, sf_dir)
    return seg.read_statistics(spark, seg.segments(spark, logs, archive, "shard"))


def segments_verify(spark, sf_dir):
    logs, archive = _segment_files(spark, sf_dir)
    found = seg.segments(spark, logs, archive, "shard")
    rows = seg.verified_prefix(decoded(seg.lines(spark, [r["path"] for r in found.select("path").collect()])))
    return rows.select(F.element_at(F.split("seg_path", "/"), -1).alias("file"), "valid_records", "next_sequence", "valid_size")


def segments_recovery(spark, sf_dir):
    """Where recovery finds the end of each active segment."""
    logs, archive = _segment_files(spark, sf_dir)
    ends, _ = recovery.recovered(spark, EngineConfig(log_dir=logs, archive_dir=archive))
    return spark.createDataFrame([(e["shard"], e["mode"], e["next_sequence"], e["logical_size"]) for e in ends], "shard int, mode string, next_sequence long, logical_size long")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of segment files made of orders: plain and compressed, archived and active, and other files."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    stem = F.concat(F.lit("/var/log/shard-"), (F.col("o_custkey") % 4).cast("string"))
    stamp = F.concat(F.lit("."), (1000 + F.col("o_custkey") % 50).cast("string"), F.lit("."), (F.col("o_orderkey") % 9).cast("string"))
    name = (
        F.when(F.col("o_orderkey") % 11 == 0, F.concat(stem, F.lit(".log")))
        .when(F.col("o_orderkey") % 13 == 0, F.concat(stem, F.lit(".log.gz")))
        .when(F.col("o_orderkey") % 17 == 0, F.concat(stem, F.lit("x.log")))
        .when(F.col("o_orderstatus") == "F", F.concat(stem, stamp, F.lit(".log.gz")))
        .otherwise(F.concat(stem, stamp, F.lit(".log")))
    )
    return o.select(name.alias("path")).distinct()


def segment_catalog(spark, sf_dir):
    return seg.described(_files(spark, sf_dir), "shard").select("path", F.col("shard_id").cast("long").alias("shard_id"), "archived", "compressed", "timestamp_ms", "rotation_index")


def archive_dedup(spark, sf_dir):
    return seg.without_twins(seg.described(_files(spark, sf_dir), "shard")).select("path")


def segment_sort(spark, sf_dir):
    return seg.ranked(seg.without_twins(seg.described(_files(spark, sf_dir), "shard"))).select("path", "rank")


def retention_topn(spark, sf_dir):
    rows = seg.without_twins(seg.described(_files(spark, sf_dir), "shard")).withColumn("modified_ms", F.col("timestamp_ms") * 1000)
    return writer.expired(rows, F.lit(1_045_000), 30, 5).select("path")


def rotation_assign(spark, sf_dir):
    lines = encode_full_crc(spark, sf_dir)
    return writer.rotation(lines, 64 << 10).groupBy("shard", "rotation_index").agg(F.count("*").alias("n"), F.min("sequence").alias("first_sequence"))


def route_modulo(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("route_key"))
    out = routing.routed(e, "route_key", SHARDS)
    return out.select("event_id", "shard", F.col("hash").cast("string").alias("hash"))


def route_ring_asof(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("route_key"))
    out = routing.routed(c, "route_key", SHARDS, routing.ring(SHARDS, 64))
    return out.select("c_custkey", "shard", F.col("token").cast("string").alias("token"))


def route_empty_policy(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 3 == 0, "").otherwise(F.concat(F.lit("user-"), F.col("user_id").cast("string"))).alias("route_key"))
    local = routing.routed(e, "route_key", SHARDS, local_shard=7).select("event_id", F.col("shard").alias("local_shard"), "used_local_fallback")
    turn = routing.routed(e, "route_key", SHARDS, index="event_id").select("event_id", F.col("shard").alias("round_robin_shard"))
    return local.join(turn, "event_id")


def hash_text(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", unsigned(fnv1a64(F.col("n_name"))).cast("string").alias("hash"), crc_hex(F.col("n_name")).alias("crc"))


def shard_counts(spark, sf_dir):
    return records(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n"), F.max("sequence").alias("last_sequence"))


def sequence_assign(spark, sf_dir):
    return records(spark, sf_dir).select("event_id", "shard", "sequence")


def delivery_batch(spark, sf_dir):
    made = delivery.batches(records(spark, sf_dir), 128)
    return made.select("shard", "batch_no", "first_sequence", "next_sequence", F.size("records").cast("long").alias("n"), F.array_join("records", "\n").alias("records"))


def _offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    shared = r.where("r_regionkey < 3").select(F.col("r_regionkey").alias("shard"), (F.col("r_regionkey").cast("long") * 12 + 7).alias("next_sequence"))
    own = r.where("r_regionkey in (0, 3, 4)").select(F.col("r_regionkey").alias("shard"), (F.col("r_regionkey").cast("long") * 4 + 11).alias("next_sequence"))
    return delivery.merged_offsets(shared, own)


def offsets_merge(spark, sf_dir):
    return _offsets(spark, sf_dir)


def replay_from_offsets(spark, sf_dir):
    made = delivery.replay_batches(records(spark, sf_dir), _offsets(spark, sf_dir), 50)
    return made.select("shard", "first_sequence", "next_sequence", delivery.delivery_json(F.lit("replay")).alias("body"))


def pending_counts(spark, sf_dir):
    return delivery.pending(records(spark, sf_dir), _offsets(spark, sf_dir)).groupBy("shard").agg(F.count("*").alias("n"))


def sink_batch_json(spark, sf_dir):
    made = delivery.batches(records(spark, sf_dir), 20)
    return made.select("shard", "batch_no", delivery.delivery_json(F.lit("agent-1")).alias("body"))


def kafka_envelope(spark, sf_dir):
    made = delivery.batches(records(spark, sf_dir), 20)
    return made.select("shard", "batch_no", delivery.kafka_json(F.lit("logs"), F.lit("agent-1")).alias("body"))


def object_manifest(spark, sf_dir):
    made = delivery.batches(records(spark, sf_dir), 20)
    return made.select("shard", "batch_no", delivery.manifest_json(F.lit("agent"), F.lit("agent-1")).alias("body"))


def dedupe_delivery(spark, sf_dir):
    made = delivery.batches(records(spark, sf_dir), 64).select(F.lit("agent-1").alias("agent_id"), "shard", "first_sequence", "next_sequence")
    return delivery.deduplicated(made.unionByName(made.where("shard < 2")))


def envelope_render(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    body = delivery.envelope_json(
        F.col("props"), F.lit("agent-1"), F.when(F.col("user_id") % 2 == 0, F.col("event_type")), F.when(F.col("user_id") % 3 == 0, F.col("event_id")), F.lit(""),
        F.when(F.col("user_id") % 5 == 0, F.create_map(F.lit("zone"), F.lit("b"), F.lit("host"), F.col("event_type"))).otherwise(F.create_map().cast("map<string,string>")),
    )
    return e.select("event_id", body.alias("body"))


def envelope_decode(spark, sf_dir):
    rows = envelope_render(spark, sf_dir).select("event_id", F.concat(F.lit("payload="), F.col("body")).alias("line"))
    out = decoded(rows, hashes=False)
    return out.select("event_id", "payload", "agent_id", "source_id", "source_offset", F.coalesce(F.get(F.map_values(F.map_filter("attributes", lambda k, v: k == "host")), 0), F.lit("")).alias("host"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    q = lambda k, c: F.concat(F.lit(f'"{k}":'), tx.json_string(c))
    one = F.concat(
        F.lit("{"), F.concat_ws(",", q("message", F.col("props")), q("level", F.col("event_type")), q("service", F.concat(F.lit("svc-"), (F.col("user_id") % 7).cast("string"))),
        F.when(F.col("user_id") % 2 == 0, q("route_key", F.concat(F.lit("r-"), F.col("user_id").cast("string")))), F.lit('"attributes":{"env":"test","host":"h1"}')), F.lit("}"),
    )
    body = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"records":['), one, F.lit(","), one, F.lit("]}"))).when(F.col("event_id") % 3 == 1, one).otherwise(F.col("event_type"))
    return e.select("event_id", body.alias("body"))


def ingest_normalize(spark, sf_dir):
    rows = ingest.normalised(ingest.bodies(_requests(spark, sf_dir)))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return rows.select("event_id", "route_key", "level", "payload", shown.alias("attributes"))


def multiline_merge(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text is not null")
    lines = c.select("conv_id", F.posexplode(F.split("text", "\n")).alias("n", "line"), "turn")
    lines = lines.withColumn("ord", F.col("turn") * 100_000 + F.col("n"))
    return ingest.multiline(lines, "conv_id", "ord", "line", "T", 3)


def source_limits(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") / 100).cast("long").alias("batch"), F.concat("event_type", "props").alias("line"))
    return ingest.limited(e, "batch", "event_id", "line", 16, 1200).groupBy("decision").agg(F.count("*").alias("n"))


def source_offset_running(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("props").alias("line"))
    return ingest.line_offsets(e, "event_type", "event_id", "line").select("event_id", "source_offset")


def _minute(ts: str) -> Column:
    """Whole minutes since 1970 of a time without zone."""
    return F.floor(F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))") / 60_000_000).cast("long")


def _minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", _minute("ts").alias("minute"), F.lit(1).alias("n"))


def health_window(spark, sf_dir):
    return rules.recent_sums(_minutes(spark, sf_dir), "event_type", "minute", "n")


def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(u % 31 == 0, 1).otherwise(0).alias("checkpoint_failures"), F.when(u % 37 == 0, 1).otherwise(0).alias("gzip_archive_failures"),
        (u % 6).alias("recovery_fallbacks"), (u % 5).alias("gzip_read_errors"), (u % 13).alias("corrupted_segments"), (u % 2).alias("corrupted_lines"),
    )


def health_status(spark, sf_dir):
    return _counters(spark, sf_dir).select("event_id", rules.health_status().alias("status"), rules.health_reason().alias("reason"))


_LIMITS = {"disk_quota": 95, "pending_bytes": 64, "sink_backlog": 40, "sink_failures": 9, "sink_latency": 0, "sink_latency_average": 300}


def backpressure_decision(spark, sf_dir):
    u = F.col("user_id")
    e = table(spark, sf_dir, "events").select(
        "event_id", (u % 100).alias("disk_quota"), (u % 70).alias("pending_bytes"), (u % 43).alias("sink_backlog"),
        (u % 11).alias("sink_failures"), u.alias("sink_latency"), (F.col("value") * 4).alias("sink_latency_average"),
    )
    return e.select("event_id", rules.backpressure(_LIMITS).alias("reason"))


def ewma_latency(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "event_id", F.floor(F.col("value") * 100).cast("long").alias("x"))
    return rules.ewma(e, "event_type", "event_id", "x")


def percentile_nearest_rank(spark, sf_dir):
    return rules.rank_percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def rate_alerts(spark, sf_dir):
    samples = rules.recent_sums(_minutes(spark, sf_dir), "event_type", "minute", "n").select("event_type", (F.col("minute") * 60).alias("at_second"), F.col("lifetime").alias("value"), "recent")
    rows = rules.rates(samples, "event_type", "at_second", "value")
    return rows.select("event_type", "at_second", F.round("rate", 9).alias("rate"), rules.held_for(rows, "event_type", "at_second", F.col("recent") > 1, 300).alias("firing"))


def pause_durations(spark, sf_dir):
    states = backpressure_decision(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).alias("agent")), "event_id")
    return rules.reason_durations(states, "agent", "event_id", "reason")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_linenumber").alias("shards"), F.col("l_returnflag").alias("scenario"), F.col("l_quantity").alias("throughput"))


def scaling_efficiency(spark, sf_dir):
    return reports.efficiency(_runs(spark, sf_dir))


def benchmark_rollup(spark, sf_dir):
    return _runs(spark, sf_dir).groupBy("scenario", "shards").agg(
        F.count("*").alias("runs"), F.round(F.avg("throughput"), 6).alias("average"), F.min("throughput").alias("least"), F.max("throughput").alias("most")
    )


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a benchmark made of lineitem: some took no time at all."""
    elapsed = F.when(F.col("l_suppkey") % 7 == 0, 0).otherwise(F.floor("l_extendedprice")).cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("scenario"), F.col("l_linestatus").alias("target"), (F.col("l_linenumber") * 64).alias("payload"),
        reports.throughput(F.col("l_partkey"), elapsed).alias("throughput"), F.col("l_quantity").alias("submit_us"),
        (F.col("l_quantity") * 3).alias("p95_us"), (F.col("l_quantity") * 8).alias("p99_us"),
    )


def regression_report(spark, sf_dir):
    return reports.profile(_measured(spark, sf_dir), ["scenario", "target"])


def profile_report(spark, sf_dir):
    return reports.profile(_measured(spark, sf_dir), ["scenario", "target", "payload"])


def soak_report(spark, sf_dir):
    return reports.soak(_measured(spark, sf_dir))


def scanner_report(spark, sf_dir):
    """Snapshots of runs made of events; every third run never gets its messages through."""
    u, n = F.col("user_id"), F.col("event_id")
    run = u % 40
    snapshots = table(spark, sf_dir, "events").select(
        run.alias("run"), F.when(run % 3 == 0, 1 << 40).otherwise(700).alias("messages"), run.alias("started_ms"), (n + 40).alias("at_ms"), n.alias("committed"),
        (n - u % 9).alias("sent"), F.floor("value").cast("long").alias("backlog"), (u % 17 - 4).alias("queue_batches"), (n % 5).alias("active_workers"),
    )
    return reports.scanner(snapshots)


def queue_depths(spark, sf_dir):
    """Most that waited in each of four queues: views are taken out, all else is put in."""
    change = F.when(F.col("event_type") == "view", -1).otherwise(1)
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("queue"), "event_id", change.alias("change"))
    return reports.queue_peaks(e, "queue", "event_id", "change")


def verify_totals(spark, sf_dir):
    return recovery.totals(verify_prefix(spark, sf_dir))


def sequence_only(spark, sf_dir):
    """Sequence numbers taken from lines alone; those of every fifth line are unreadable, of every seventh missing."""
    rows = encode_header_crc(spark, sf_dir)
    line = F.when(F.col("sequence") % 5 == 0, F.replace("line", F.lit("\tseq="), F.lit("\tseq=x"))).when(F.col("sequence") % 7 == 0, F.regexp_replace("line", "\tseq=[0-9]+", "")).otherwise(F.col("line"))
    return rows.select("shard", F.col("sequence").alias("written"), sequence_of(line).alias("sequence"))


def level_names(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", level_name(F.col("user_id") % 5).alias("level"))


def aligned_sizes(spark, sf_dir):
    """Sizes of pages as written in blocks, and how much of each block's end is padding."""
    size, block = F.octet_length(F.coalesce("html", F.lit(""))).cast("long"), F.when(F.col("page_id") % 4 == 0, 0).otherwise(4096).cast("long")
    pages = table(spark, sf_dir, "pages").select("page_id", size.alias("size"), writer.aligned(size, block).alias("written"))
    return pages.select("page_id", "written", (F.col("written") - F.col("size")).alias("padding"))


def writer_metrics(spark, sf_dir):
    return encode_full_crc(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("submitted_messages"), F.sum(F.octet_length("line") + 1).cast("long").alias("submitted_bytes"))


def url_endpoints(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), "^https?://([^/]*)", "http://$1:8080").alias("url"))
    at = tx.http_endpoint(F.col("url"))
    return p.select("page_id", at["host"].alias("host"), at["port"].alias("port"), at["path"].alias("path"))


def set_operations(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a, b = e.where("event_type = 'view'").select("user_id"), e.where("event_type = 'click'").select("user_id")
    return a.union(b).distinct().select("user_id", F.lit("either").alias("kind")).unionByName(a.exceptAll(b).groupBy("user_id").count().select("user_id", F.lit("more").alias("kind")))


def alert_rules(spark, sf_dir):
    return rules.alerts(_counters(spark, sf_dir), "event_id")


def quota_decisions(spark, sf_dir):
    u = F.col("user_id")
    quota, low = F.when(u % 4 == 0, 0).otherwise(90), F.when(u % 3 == 0, 0).otherwise(40)
    return table(spark, sf_dir, "events").select(
        "event_id", rules.quota_exceeded(u % 100, quota).alias("exceeded"), rules.can_resume(u % 100, quota, low).alias("can_resume"),
        rules.over_watermark(u % 100, quota, low, u % 2 == 0).alias("must_wait"),
    )


def directory_sizes(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.octet_length("html").cast("long").alias("size")).where("url is not null")
    return maintenance.sizes(files)


def query_jitter(spark, sf_dir):
    """Latency of two methods: spread, p99, and the mean of warm runs over that of cold ones."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("method"), F.floor("o_totalprice").cast("long").alias("us"), (F.col("o_orderkey") % 2 == 0).alias("cold")
    )
    spread = o.groupBy("method").agg(
        F.min("us").alias("least"), F.max("us").alias("most"), F.round(F.avg("us"), 6).alias("average"),
        F.round(F.avg(F.when(~F.col("cold"), F.col("us"))) / F.avg(F.when(F.col("cold"), F.col("us"))), 9).alias("warm_to_cold"),
    )
    return spread.join(rules.rank_percentiles(o, ["method"], "us", {"p99": 0.99}), "method")


def header_filter(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Host: "), "p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("X-Part: "), "p_name")).otherwise(F.col("p_name")).alias("line"))
    return p.where(tx.header_valid(F.col("line"))).select("p_partkey", "line")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "records_shard_limit": _read(ReadQuery(shard=2, seq_from=10, seq_to=500)),
    "records_seq_range": _read(ReadQuery(seq_from=100, seq_to=300, limit=None)),
    "records_time_range": _read(ReadQuery(time_from="2024-01-02", time_to="2024-01-03 12:00:00", limit=None)),
    "records_by_source": _read(ReadQuery(source_id="error", limit=None)),
    "records_by_agent": _read(ReadQuery(agent_id="agent-3", seq_to=900, limit=None)),
    "records_empty_predicate": _read(ReadQuery(source_id="")),
    "records_limit_zero": _read(ReadQuery(limit=0)),
    "segments_read_back": _from_files(ReadQuery(limit=None)),
    "segments_file_order": _from_files(ReadQuery(shard=2, seq_from=480)),
    "segments_active_only": _from_files(ReadQuery(include_archive=False, limit=None)),
} | {
    f.__name__: f
    for f in (
        segments_statistics, segments_verify, segments_recovery, encode_full_crc, encode_header_crc, codec_roundtrip, sanitize_payload, verify_prefix, reader_stats, segment_catalog, archive_dedup,
        segment_sort, retention_topn, rotation_assign, route_modulo, route_ring_asof, route_empty_policy, hash_text, shard_counts,
        sequence_assign, delivery_batch, offsets_merge, replay_from_offsets, pending_counts, sink_batch_json, kafka_envelope,
        object_manifest, dedupe_delivery, envelope_render, envelope_decode, ingest_normalize, multiline_merge, source_limits,
        source_offset_running, health_window, health_status, backpressure_decision, ewma_latency, percentile_nearest_rank, rate_alerts,
        pause_durations, scaling_efficiency, benchmark_rollup, writer_metrics, url_endpoints, set_operations,
        alert_rules, quota_decisions, directory_sizes, query_jitter, header_filter, regression_report, profile_report, soak_report,
        scanner_report, queue_depths, verify_totals, sequence_only, level_names, aligned_sizes,
    )
}
