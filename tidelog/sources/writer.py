"""Segment writing: route, number, encode and write records as one active segment per shard, or archives."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.config import EngineConfig
from tidelog.functions.codec import encoded
from tidelog.functions.running import totals_before
from tidelog.sources.maintenance import paths_of


#: Rows of the order column's range that are ranked together.
RANK_STEP = 1 << 16


def sequenced(rows: DataFrame, order: str, base: Column | None = None, step: int = RANK_STEP) -> DataFrame:
    """Per-shard sequence numbers in the order of a whole-number column, from ``base`` (0).

    Rows are ranked within ranges of ``step`` of that column and shifted by the counts of the ranges
    before, so no shard is sorted by one task.
    """
    ranged = rows.withColumn("_range", F.floor(F.col(order) / step))
    counts = ranged.groupBy("shard", "_range").agg(F.count("*").alias("_n"))
    before = W.partitionBy("shard").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = F.row_number().over(W.partitionBy("shard", "_range").orderBy(order)) - 1
    out = ranged.withColumn("_local", local).join(counts, ["shard", "_range"])
    first = F.lit(0) if base is None else base
    return out.withColumn("sequence", (F.col("_base") + F.col("_local") + first).cast("long")).drop("_range", "_local", "_base")


def encoded_lines(rows: DataFrame, config: EngineConfig) -> DataFrame:
    """shard, sequence and line of numbered rows (timestamp, shard, sequence, level, payload)."""
    line = encoded(config.format, F.col("timestamp"), F.col("shard"), F.col("sequence"), F.col("level"), F.col("payload"))
    return rows.select("shard", "sequence", line.alias("line"))


def rotation(lines: DataFrame, rotate_bytes: int) -> DataFrame:
    """``lines`` with rotation_index: a new file of the shard begins each time ``rotate_bytes`` have been written before."""
    lines = totals_before(lines, "shard", "sequence", "_written", F.octet_length("line") + 1)
    return lines.withColumn("rotation_index", F.floor(F.col("_written") / rotate_bytes).cast("long")).drop("_written")


def aligned(size: Column, alignment: Column) -> Column:
    """``size`` up to the next multiple of ``alignment``; as it is where that is 0."""
    return F.when(alignment == 0, size).otherwise(size + F.pmod(-size, F.nullif(alignment, F.lit(0))))


def write_active(lines: DataFrame, log_dir: str, prefix: str) -> None:
    """Write each shard's lines, in order of sequence, as its active segment ``<prefix>-<shard>.log``."""
    _write(lines, log_dir, lambda shard, k: f"{prefix}-{shard}.log" if k == 0 else f"{prefix}-{shard}.0.{k}.log", False)


def write_archive(lines: DataFrame, archive_dir: str, prefix: str, timestamp_ms: int, compress: bool = False) -> None:
    """Write each shard's lines as archived segments of ``timestamp_ms``; the same names are written over."""
    end = ".log.gz" if compress else ".log"
    _write(lines, archive_dir, lambda shard, k: f"{prefix}-{shard}.{timestamp_ms}.{k}{end}", compress)


def write_named(lines: DataFrame, folder: str, place: Callable[[str], str] = str) -> None:
    """Write lines (name, sequence, line) as files of those names, in order of sequence; names that end in .gz are compressed.

    Every file is written by one task, files side by side. ``place`` gives a name's path in the folder.
    """
    for compress in (False, True):
        mine = lines.where(F.col("name").endswith(".gz") == F.lit(compress)).withColumn("shard", F.col("name"))
        _write(mine, folder, lambda name, _: place(name), compress)


#: Renames that are under way at a time.
MOVERS = 8


def _write(lines: DataFrame, folder: str, name: Callable[[str, int], str], compress: bool) -> None:
    spark = lines.sparkSession
    folder = folder.rstrip("/")
    stage = f"{folder}/_writing"
    ordered = lines.repartition("shard").sortWithinPartitions("shard", "sequence").select("shard", "line")
    # Tasks move their files into the stage themselves (version 2), not the driver one by one; nobody reads it before the job has ended.
    out = ordered.write.mode("overwrite").partitionBy("shard").option("lineSep", "\n").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    (out.option("compression", "gzip") if compress else out).text(stage)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(stage).getFileSystem(conf)
    shards = jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(fs.listStatus(path(stage)))
    parts: dict[str, list[str]] = {}
    for part in sorted(paths_of(spark, fs.listStatus(shards))):
        shard, file = part.split("/")[-2:]
        if shard.startswith("shard=") and file.startswith("part-"):
            parts.setdefault(shard[6:], []).append(part)
    moves = [(part, f"{folder}/{name(shard, k)}") for shard, found in parts.items() for k, part in enumerate(found)]
    there = set()
    for parent in {goal.rsplit("/", 1)[0] for _, goal in moves}:
        fs.mkdirs(path(parent))
        there |= {f"{parent}/{p.rsplit('/', 1)[1]}" for p in paths_of(spark, fs.listStatus(path(parent)))}

    def move(pair: tuple[str, str]) -> None:
        part, goal = pair
        if goal in there:
            fs.delete(path(goal), False)
        if not fs.rename(path(part), path(goal)):
            raise OSError(f"{part} could not be renamed to {goal}")

    # One rename for each shard's file; the data stay where the tasks wrote them.
    with ThreadPoolExecutor(MOVERS) as pool:
        list(pool.map(move, moves))
    fs.delete(path(stage), True)


def expired(segments: DataFrame, now_ms: Column, retention_seconds: int, most: int) -> DataFrame:
    """Archived segments to delete: older than the retention, or beyond the ``most`` newest of their shard (0: no limit)."""
    rows = segments.where("archived")
    newest = F.row_number().over(W.partitionBy("shard_id").orderBy(F.desc("timestamp_ms"), F.desc("rotation_index"), "path"))
    old = (now_ms - F.col("modified_ms") > retention_seconds * 1000) if retention_seconds else F.lit(False)
    kept = rows.where(~old)
    beyond = kept.withColumn("_n", newest).where(F.col("_n") > most).drop("_n") if most else kept.limit(0)
    return rows.where(old).unionByName(beyond)
