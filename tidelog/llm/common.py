"""Helpers shared by the training-data operators: shared-folder tables, sizes and Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in tests on one machine.
_LOCAL_DIR: list[str] = []
_MADE: set[str] = set()
#: Rows and bytes that move between the JVM and Python at once, at most; texts are long.
ARROW_ROWS = 1000
ARROW_BYTES = 4 << 20
#: Groups give memory back when they have held so much since they did last.
_LEAN_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a local one if all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append("file://" + tempfile.mkdtemp(prefix="tidelog-"))
    return _LOCAL_DIR[0]


def _own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one, deleted when the application ends."""
    folder = f"{shared_dir(spark)}/tidelog-{spark.sparkContext.applicationId}"
    if folder not in _MADE:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _MADE.add(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete what this application has stored in the shared folder; its results must have been written elsewhere."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _MADE.discard(_own_dir(spark))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost executor costs one task."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Total bytes of a column, counted exactly: sizes blocks, buckets and files."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"]


def parts(total_bytes: int, each: int, least: int = 1) -> int:
    return max(least, -(-int(total_bytes) // each))


def strings(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """A string column as one array with 64-bit offsets, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return pc.fill_null(column.cast(pa.large_string()), "")


def ascii_lower(column: pa.Array) -> pa.Array:
    """Lower-case A-Z only, leaving every other character alone."""
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8).copy()
    data[(data >= 65) & (data <= 90)] += 32
    return pa.LargeStringArray.from_buffers(len(column), column.buffers()[1], pa.py_buffer(data), offset=column.offset)


def batches(stream: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.Table]:
    """Regroup record batches into tables of about ``most_bytes``; a single longer row makes its own table."""
    held, size = [], 0
    for batch in stream:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * most_bytes / max(1, batch.nbytes)))
        for i in range(0, batch.num_rows, step):
            piece = batch.slice(i, step)
            if held and size + piece.nbytes > most_bytes:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
            held.append(piece)
            size += piece.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def bounds(array: pa.ListArray) -> np.ndarray:
    """Offsets of a list array's rows in its flattened values."""
    offsets = np.asarray(array.offsets, np.int64)
    return offsets - offsets[0]


def give_back() -> None:
    """Return free memory to the system: Python workers outlive their tasks, beside the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _bounded(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session than Spark's own of 10,000 rows of any size."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or (now.isdigit() and int(now) > most):
            spark.conf.set(key, str(most))


def mapped(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow in small batches; the worker gives its memory back when the task ends."""
    _bounded(df.sparkSession)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(stream)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


_held = [0]


def lean(work: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """For applyInArrow: ``work`` whose worker gives its memory back after every few large groups."""

    def run(*groups: pa.Table) -> pa.Table:
        out = work(*groups)
        _held[0] += sum(g.nbytes for g in groups if isinstance(g, pa.Table))
        if _held[0] > _LEAN_BYTES:
            _held[0] = 0
            give_back()
        return out

    if work.__code__.co_argcount == 2:
        return lambda left, right: run(left, right)
    return lambda group: run(group)
