import time

from pyspark.sql import functions as F

from tidelog import agent
from tidelog.config import EngineConfig
from tidelog.functions.codec import level_name, sequence_of
from tidelog.plans import status
from tidelog.plans.records import ReadQuery, read_records
from tidelog.sources import recovery, state


def test_recovery_scans_after_a_good_checkpoint_only(spark, tmp_path):
    logs = tmp_path / "l"
    logs.mkdir()
    config = EngineConfig(log_dir=str(logs), archive_dir=str(tmp_path / "a"))
    first = "seq=0\tpayload=a\n"
    (logs / "shard-0.log").write_text(first + "seq=1\tpayload=b\nBROKEN")
    (logs / "shard-0.log.checkpoint").write_text(state.Checkpoint(len(first), 1, 4).text())
    (logs / "shard-1.log").write_text("seq=5\tpayload=a\ncrc=00000000\tpayload=x\n")
    (logs / "shard-1.log.checkpoint").write_text("sequence=999999\n")
    (logs / "shard-2.log").write_text("payload=a\n")
    (logs / "shard-2.log.checkpoint").write_text(state.Checkpoint(5000, 9, 0).text())
    (logs / "shard-3.log").write_text("")
    ends, metrics = recovery.recovered(spark, config)
    got = {e["shard"]: (e["mode"], e["next_sequence"], e["logical_size"]) for e in ends}
    assert got == {
        0: ("from_checkpoint", 2, 2 * len(first)), 1: ("full_scan_incomplete_checkpoint", 6, len(first)),
        2: ("full_scan_stale_checkpoint", 1, 10), 3: ("empty_file", 0, 0),
    }
    assert (metrics["recovery_fallbacks"], metrics["recovery_full_scans"], metrics["recovery_from_checkpoints"], metrics["recovery_empty_files"]) == (2, 2, 1, 1)
    assert metrics["recovery_fallback_stale_checkpoint"] == metrics["recovery_fallback_incomplete_checkpoint"] == 1
    assert recovery.checkpointed(spark, config, ends)["checkpoint_write_successes"] == 4
    again, metrics = recovery.recovered(spark, config)
    assert metrics["recovery_from_checkpoints"] == 3 and metrics["recovery_fallbacks"] == 0 and [e["next_sequence"] for e in again] == [2, 6, 1, 0]
    row = status.status(spark, config).first().asDict()
    assert len(row) >= 24 and row["health"] in ("degraded", "unhealthy") and row["health_reason_basis"] == "recent_window"


def test_rotation_compression_and_retention(spark, tmp_path):
    logs, archive = tmp_path / "l", tmp_path / "a"
    logs.mkdir()
    archive.mkdir()
    config = EngineConfig(log_dir=str(logs), archive_dir=str(archive), rotate_size_bytes=100, compress_archives=True, max_archived_files_per_shard=2)
    text = "".join(f"seq={i}\tpayload=row {i}\n" for i in range(20))
    (logs / "shard-0.log").write_text(text)
    (logs / "shard-1.log").write_text("payload=short\n")
    for k in (1, 2, 3):
        (archive / f"shard-0.{k}.0.log").write_text("payload=old\n")
    got = recovery.rotated(spark, config, 99)
    assert got["rotate_operations"] == got["gzip_archive_successes"] == 1
    assert sorted(p.name for p in logs.iterdir() if p.name.endswith("log")) == ["shard-1.log"] and (archive / "shard-0.99.1.log.gz").exists() and not (archive / "shard-0.99.1.log").exists()
    rows = read_records(spark, str(logs), str(archive), "shard", ReadQuery(shard=0, seq_from=0, limit=None)).collect()
    assert [r["sequence"] for r in rows] == list(range(20))
    assert [p.rsplit("/", 1)[1] for p in recovery.retained(spark, config, int(time.time() * 1000))] == ["shard-0.1.0.log", "shard-0.2.0.log"]
    assert sorted(p.name for p in archive.glob("shard*")) == ["shard-0.3.0.log", "shard-0.99.1.log.gz"]


def test_small_rules(spark):
    assert [recovery.aligned(n, 4096) for n in (0, 1, 4096, 4097)] == [0, 4096, 4096, 8192] and recovery.aligned(5, 0) == 5
    assert agent.sink_kind("s3") == "object_store" and agent.sink_kind("") == "none"
    row = spark.range(1).select(sequence_of(F.lit("ts=x\tseq=12\tpayload=seq=9")).alias("a"), sequence_of(F.lit("payload=x")).alias("b"), level_name(F.lit(1)).alias("c"), level_name(F.lit(7)).alias("d"))
    assert tuple(row.first()) == (12, None, "WARN", "UNKNOWN")
