"""Upkeep of segment folders: sizes, leftovers of interrupted writes, and damaged compressed files."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Name endings of files that an interrupted writer leaves behind.
LEFTOVERS = (".checkpoint.tmp", ".gz.tmp")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share (spark.checkpoint.dir), deleted when the application ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.gettempdir()
    folder = f"{shared.rstrip('/')}/tidelog-{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def paths_of(spark: SparkSession, statuses) -> list[str]:
    """The paths in an array of the file system's entries, in its order, by one call instead of several for each."""
    jvm = spark.sparkContext._jvm
    joined = jvm.scala.collection.mutable.ArraySeq.make(jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(statuses)).mkString("\0")
    return joined.split("\0") if joined else []


@contextmanager
def fewer_listers(spark: SparkSession) -> Iterator[None]:
    """Within, Spark looks up many files by a few tasks a core; else it starts one for each file, up to 10,000."""
    key, tasks = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 4 * spark.sparkContext.defaultParallelism
    was = spark.conf.get(key, None)
    if was is None or int(was) > tasks:
        spark.conf.set(key, str(tasks))
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)


def directory_size(spark: SparkSession, folder: str) -> int:
    """Bytes of all files under a folder, 0 if it is missing."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(conf)
    return fs.getContentSummary(path).getLength() if fs.exists(path) else 0


def remove_leftovers(spark: SparkSession, folder: str) -> list[str]:
    """Delete a folder's leftovers and name them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(conf)
    found = [f.getPath() for f in fs.listStatus(path) if f.getPath().getName().endswith(LEFTOVERS)] if fs.exists(path) else []
    for f in found:
        fs.delete(f, False)
    return sorted(f.getName() for f in found)


def gzip_errors(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, intact of compressed segments: whether each decompresses to its end. One file is one row of a task."""
    if not paths:
        return spark.createDataFrame([], "path string, intact boolean")

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "intact": frame["content"].map(_intact)})

    with fewer_listers(spark):
        files = spark.read.format("binaryFile").load(paths)
    return files.select("path", "content").mapInPandas(check, "path string, intact boolean")


def _intact(data: bytes) -> bool:
    while data:
        stream = zlib.decompressobj(31)
        try:
            stream.decompress(data)
        except zlib.error:
            return False
        if not stream.eof:
            return False
        data = stream.unused_data
    return True


def sizes(files: DataFrame) -> DataFrame:
    """folder, files, bytes of a listing (path, size)."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return files.groupBy(folder.alias("folder")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
