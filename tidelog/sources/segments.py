"""Segment files: names, listing, ordered line reads, and the records in them.

An active segment is ``<prefix>-<shard>.log`` in the log folder, an archived one
``<prefix>-<shard>.<ts_ms>.<rotation>.log[.gz]`` in the archive folder. Folders are any URI that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions.codec import decoded
from tidelog.sources.maintenance import fewer_listers, gzip_errors, paths_of


def described(files: DataFrame, prefix: str, path: str = "path") -> DataFrame:
    """Rows of ``files`` whose name is a segment's, with shard_id, archived, compressed, timestamp_ms, rotation_index."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    form = f"^{_quoted(prefix)}-([0-9]{{1,9}})(?:\\.([0-9]{{1,18}})\\.([0-9]{{1,18}}))?\\.log(\\.gz)?$"
    part = lambda k: F.regexp_extract(name, form, k)
    number = lambda k: F.coalesce(F.nullif(part(k), F.lit("")).cast("long"), F.lit(0))
    rows = files.where(name.rlike(form)).withColumns({
        "shard_id": part(1).cast("int"),
        "archived": part(2) != "",
        "compressed": part(4) != "",
        "timestamp_ms": number(2),
        "rotation_index": number(3),
    })
    return rows.where("archived or not compressed")


def _quoted(text: str) -> str:
    import re

    return re.escape(text)


def without_twins(segments: DataFrame) -> DataFrame:
    """One file of each archived segment: the plain one if a compressed copy stands beside it."""
    key = ["shard_id", "archived", "timestamp_ms", "rotation_index"]
    first = F.row_number().over(W.partitionBy(*key).orderBy("compressed", "path"))
    return segments.withColumn("_n", first).where("_n = 1").drop("_n")


def segment_order() -> list:
    """Shard, archived before active, time, rotation, path."""
    return [F.asc("shard_id"), F.desc("archived"), F.asc("timestamp_ms"), F.asc("rotation_index"), F.asc("path")]


def ranked(segments: DataFrame) -> DataFrame:
    """``segments`` with rank, their place from 1 in segment_order(): within their shard, after all files of the shards before."""
    sizes = segments.groupBy("shard_id").agg(F.count("*").alias("_n"))
    before = W.orderBy("shard_id").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("shard_id", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = F.row_number().over(W.partitionBy("shard_id").orderBy(*segment_order()))
    return segments.withColumn("_local", local).join(sizes, "shard_id").withColumn("rank", F.col("_base") + F.col("_local")).drop("_base", "_local")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path and size of the files directly in a folder, from the file system's own listing; a missing folder is empty."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(conf)
    rows = []
    if fs.exists(where):
        found = fs.listStatus(where)
        rows = [(path, s.getLen(), s.getModificationTime()) for path, s in zip(paths_of(spark, found), found) if s.isFile()]
    return spark.createDataFrame(rows, "path string, size long, modified_ms long")


def segments(spark: SparkSession, log_dir: str, archive_dir: str | None, prefix: str, shard: int | None = None) -> DataFrame:
    """Segments of both folders, each once, pruned to a shard before any file is opened."""
    active = described(listing(spark, log_dir), prefix).where("not archived")
    found = active
    if archive_dir is not None:
        found = active.unionByName(without_twins(described(listing(spark, archive_dir), prefix).where("archived")))
    return found if shard is None else found.where(F.col("shard_id") == shard)


_LINES = "seg_path string, line_no struct<part:bigint,nth:bigint>, line string"


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """seg_path, line_no and line of text files, split at line feeds only.

    line_no orders the lines of a file: where Spark's split of the file begins, and the line's place in
    the task, which rises within a split. So long files are split, and no shuffle numbers their lines.
    Unreadable ends of compressed files are left out, what came before stays; vanished files are skipped.
    """
    if not paths:
        return spark.createDataFrame([], _LINES)
    read = spark.read.option("lineSep", "\n").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    with fewer_listers(spark):
        files = read.text(paths)
    rows = files.select(
        F.col("_metadata.file_path").alias("seg_path"),
        F.struct(F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("nth")).alias("line_no"),
        F.col("value").alias("line"),
    )
    # Space that a writer has set aside at a live file's end is no line.
    return rows.where("line = '' or rtrim(char(0), line) <> ''")


def before_damage(rows: DataFrame) -> DataFrame:
    """The rows of each segment before its first invalid line.

    Rows are read once and dealt by segment, whose size rotation bounds; nothing is sorted.
    """
    first = F.min(F.when(~F.col("valid"), F.col("line_no"))).over(W.partitionBy("seg_path"))
    return rows.withColumn("_bad", first).where("_bad is null or line_no < _bad").drop("_bad")


def records(spark: SparkSession, found: DataFrame, test: Column | None = None) -> DataFrame:
    """Records of the segments ``found`` up to each one's first damage that meet ``test``, with the segment's columns for ordering.

    What the test drops is dropped before anything moves; invalid lines stay until each segment's first is known.
    """
    # The catalog of segments is the scan list, as in any file scan; it is small beside the files.
    paths = [r["path"] for r in found.select("path").collect()]
    rows = decoded(lines(spark, paths))
    if test is not None:
        rows = rows.where(~F.col("valid") | test)
    catalog = found.select(F.col("path").alias("seg_path"), "shard_id", "archived", "timestamp_ms", "rotation_index")
    return before_damage(rows).join(catalog, "seg_path").withColumnRenamed("seg_path", "path")


def read_statistics(spark: SparkSession, found: DataFrame) -> DataFrame:
    """One row of counters: segments read by kind, records before damage, damaged segments and lines, unreadable compressed files."""
    files = found.select("path", "archived", "compressed").collect()
    rows = decoded(lines(spark, [r["path"] for r in files])).select("seg_path", "line_no", "valid")
    bad = F.min(F.when(~F.col("valid"), F.col("line_no"))).over(W.partitionBy("seg_path"))
    rows = rows.withColumn("bad", bad)
    sums = rows.agg(
        F.count_if(F.col("bad").isNull() | (F.col("line_no") < F.col("bad"))).alias("records_returned"),
        F.count_if(F.col("line_no") == F.col("bad")).alias("corrupted_lines"),
    )
    broken = gzip_errors(spark, [r["path"] for r in files if r["compressed"]]).where("not intact").count()
    kinds = {True: sum(r["archived"] for r in files), False: sum(not r["archived"] for r in files)}
    return sums.select(
        F.lit(len(files)).cast("long").alias("segments_read"), F.lit(kinds[True]).cast("long").alias("archive_segments_read"),
        F.lit(kinds[False]).cast("long").alias("active_segments_read"), "records_returned",
        (F.col("corrupted_lines") + broken).alias("corrupted_segments"), "corrupted_lines", F.lit(broken).cast("long").alias("gzip_read_errors"),
    )


def verified_prefix(rows: DataFrame) -> DataFrame:
    """seg_path, valid_records, next_sequence, valid_size of each segment's intact beginning; empty lines do not count.

    next_sequence is one more than the last record's, or the number of records where they have none.
    """
    # Of the lines only their sizes are dealt by segment.
    slim = rows.select("seg_path", "line_no", "valid", "has_sequence", "sequence", F.octet_length("line").alias("_size"))
    kept = before_damage(slim).where("_size > 0")
    found = kept.groupBy("seg_path").agg(
        F.count("*").alias("valid_records"),
        F.max_by(F.when(F.col("has_sequence"), F.col("sequence")), F.col("line_no")).alias("_last"),
        F.sum(F.col("_size") + 1).cast("long").alias("valid_size"),
    )
    return found.select("seg_path", "valid_records", F.coalesce(F.col("_last") + 1, "valid_records").alias("next_sequence"), "valid_size")
