"""Recovery and rotation of active segments: where each ends, its checkpoint, and its way into the archive."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.config import EngineConfig
from tidelog.functions.codec import decoded
from tidelog.sources import segments as seg
from tidelog.sources import state, writer

#: Bytes after a checkpoint up to which the driver scans the rest itself; beyond, the segment is scanned by tasks.
MOST_TAIL = 16 << 20

COUNTERS = (
    "rotate_operations", "checkpoint_write_successes", "checkpoint_write_failures", "recovery_fallbacks", "recovery_from_checkpoints", "recovery_full_scans",
    "recovery_empty_files", "gzip_archive_successes", "gzip_archive_failures", "recovery_fallback_incomplete_checkpoint", "recovery_fallback_stale_checkpoint",
)


def _active(spark: SparkSession, config: EngineConfig) -> list:
    return seg.described(seg.listing(spark, config.log_dir), config.file_prefix).where("not archived").orderBy("shard_id").collect()


def recovered(spark: SparkSession, config: EngineConfig) -> tuple[list[dict], Counter]:
    """Where each active segment's intact beginning ends: shard, mode, next_sequence, logical_size, rotation_index; and the log manager's counters.

    A good checkpoint leaves the bytes after it to scan, any other the whole segment. Whole scans of all
    segments are one job. One row for each shard.
    """
    store, metrics = state.Store(spark, config.log_dir), Counter(dict.fromkeys(COUNTERS, 0))
    out, whole = [], []
    for s in _active(spark, config):
        name = s["path"].rsplit("/", 1)[1]
        text = store.read(f"{name}.checkpoint")
        found = None if text is None else state.Checkpoint.parsed(text)
        if s["size"] == 0:
            metrics["recovery_empty_files"] += 1
            out.append({"shard": s["shard_id"], "mode": "empty_file", "next_sequence": 0, "logical_size": 0, "rotation_index": 0})
            continue
        mode, start, sequence = state.recovery_mode(found, s["size"])
        if text is not None and mode != "from_checkpoint":
            metrics["recovery_fallbacks"] += 1
            metrics["recovery_fallback_" + mode.removeprefix("full_scan_")] += 1
        row = {"shard": s["shard_id"], "mode": mode, "next_sequence": sequence, "logical_size": start, "rotation_index": found.rotation_index if found else 0}
        if mode == "from_checkpoint" and s["size"] - start <= MOST_TAIL:
            metrics["recovery_from_checkpoints"] += 1
            more = _scanned(spark, store.tail(name, start))
            if more["n"]:
                row |= {"next_sequence": sequence + more["n"] if more["next"] is None else more["next"], "logical_size": start + more["size"]}
        else:
            metrics["recovery_full_scans"] += 1
            whole.append((s["path"], row))
        out.append(row)
    if whole:
        rows = decoded(seg.lines(spark, [p for p, _ in whole]))
        ends = {r["seg_path"].rsplit("/", 1)[1]: r for r in seg.verified_prefix(rows).collect()}
        for path, row in whole:
            end = ends.get(path.rsplit("/", 1)[1])
            row |= {"next_sequence": end["next_sequence"] if end else 0, "logical_size": end["valid_size"] if end else 0}
    return out, metrics


def _scanned(spark: SparkSession, data: bytes) -> dict:
    """Intact records at the beginning of some bytes: their number, size, and the sequence after the last."""
    lines = data.split(b"\n")[:-1]
    rows = spark.createDataFrame([("tail", k, x.decode("utf-8", "replace")) for k, x in enumerate(lines)], "seg_path string, line_no long, line string")
    found = seg.before_damage(decoded(rows)).where("line <> ''").orderBy("line_no").select("line_no", "has_sequence", "sequence").collect()
    if not found:
        return {"n": 0, "size": 0, "next": None}
    last = found[-1]
    return {"n": len(found), "size": sum(len(x) + 1 for x in lines[: last["line_no"] + 1]), "next": last["sequence"] + 1 if last["has_sequence"] else None}


def checkpointed(spark: SparkSession, config: EngineConfig, ends: list[dict]) -> Counter:
    """Store a checkpoint beside every segment that ``ends`` (of recovered()) describes."""
    store, metrics = state.Store(spark, config.log_dir), Counter()
    for end in ends:
        try:
            made = state.Checkpoint(end["logical_size"], end["next_sequence"], end["rotation_index"])
            store.write(f"{config.file_prefix}-{end['shard']}.log.checkpoint", made.text())
            metrics["checkpoint_write_successes"] += 1
        except Exception:
            metrics["checkpoint_write_failures"] += 1
    return metrics


def aligned(size: int, alignment: int) -> int:
    """``size`` rounded up to a multiple; 0 leaves it."""
    return size if not alignment else -(-size // alignment) * alignment


def rotated(spark: SparkSession, config: EngineConfig, now_ms: int) -> Counter:
    """Move active segments that are large or old enough to the archive, compressed if so configured.

    The archived name carries ``now_ms`` and the shard's next rotation index; sequences go on.
    """
    store, metrics = state.Store(spark, config.log_dir), Counter()
    old = seg.described(seg.listing(spark, config.archive_dir), config.file_prefix).where("archived")
    turn = {r["shard_id"]: r["n"] for r in old.groupBy("shard_id").agg((F.max("rotation_index") + 1).alias("n")).collect()}
    for s in _active(spark, config):
        large = config.rotate_size_bytes and s["size"] >= config.rotate_size_bytes
        aged = config.rotate_interval_seconds and now_ms - s["modified_ms"] >= 1000 * config.rotate_interval_seconds
        if not s["size"] or not (large or aged):
            continue
        name = s["path"].rsplit("/", 1)[1]
        goal = f"{config.archive_dir.rstrip('/')}/{config.file_prefix}-{s['shard_id']}.{now_ms}.{turn.get(s['shard_id'], 0)}.log"
        store.move(name, goal)
        store.delete(f"{name}.checkpoint")
        metrics["rotate_operations"] += 1
        if config.compress_archives:
            try:
                compressed(spark, goal)
                metrics["gzip_archive_successes"] += 1
            except Exception:
                metrics["gzip_archive_failures"] += 1
    return metrics


def compressed(spark: SparkSession, path: str) -> str:
    """Replace an archived segment by its gzip copy, which stands complete before the plain file goes."""
    folder, name = path.rsplit("/", 1)
    stage = f"{folder}/_{name}.gz.tmp"
    rows = seg.lines(spark, [path]).repartition(1).sortWithinPartitions("line_no").select("line")
    rows.write.mode("overwrite").option("compression", "gzip").option("lineSep", "\n").text(stage)
    made = state.Store(spark, stage)
    part = next(n for n in made.names() if n.startswith("part-"))
    made.move(part, f"{path}.gz")
    store = state.Store(spark, folder)
    store.delete(name)
    store.drop(f"_{name}.gz.tmp")
    return f"{path}.gz"


def retained(spark: SparkSession, config: EngineConfig, now_ms: int) -> list[str]:
    """Delete archived segments beyond the retention and name them."""
    every = seg.described(seg.listing(spark, config.archive_dir), config.file_prefix)
    gone = [r["path"] for r in writer.expired(every, F.lit(now_ms), config.retention_seconds, config.max_archived_files_per_shard).collect()]
    store = state.Store(spark, config.archive_dir)
    for path in gone:
        store.delete(path.rsplit("/", 1)[1])
    return sorted(gone)


def totals(prefixes: DataFrame) -> DataFrame:
    """One row over verified prefixes: segments, valid_records, valid_size."""
    return prefixes.agg(
        F.count("*").alias("segments"), F.coalesce(F.sum("valid_records"), F.lit(0)).alias("valid_records"), F.coalesce(F.sum("valid_size"), F.lit(0)).alias("valid_size")
    )
