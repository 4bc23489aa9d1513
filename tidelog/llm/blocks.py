"""Join a corpus with a table of its own distinct keys, block by block.

Documents are cut into blocks of bounded size. A block names each of its keys (words, n-grams)
once, in arrays dealt to hash buckets; a bucket sees every block's keys of its share of the key
space, works out one value per distinct key, and answers each block in the order it asked. Texts
move once, compressed, and keys once per block however often they occur, so a frequent key costs
no more than a rare one. A block or bucket is all that one task holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidelog.llm import common

_BLOCK = "block long, digest long, docs binary"
_ASKED = "bucket int, block long, digest long, asked binary"
_ANSWER = "block long, digest long, bucket int, answer binary"


def bucket_count(total_bytes: int) -> int:
    """Buckets of keys for a corpus: fine-grained while there are few, then one for each 256 MB of text."""
    return max(min(1024, common.parts(total_bytes, 4 << 20)), common.parts(total_bytes, 256 << 20))


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))
    with pa.ipc.new_stream(sink, table.schema, options=options) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def _cut(stream: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, int, pa.Table]]:
    """Blocks of a partition: number, digest of the first column (the ids), rows."""
    part = TaskContext.get().partitionId()
    for k, docs in enumerate(common.batches(stream, block_bytes)):
        ids = np.asarray(docs.column(0).combine_chunks().fill_null(-1))
        yield (part << 24) + k, crc32(np.ascontiguousarray(ids, "<i8")) + (docs.num_rows << 32), docs


def _row(schema: str, *values) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[k]) for v, (_, k) in zip(values, fields, strict=True)], [n for n, _ in fields])


def answered(
    docs: DataFrame,
    keys: Callable[[pa.Table], tuple[pa.Array, np.ndarray]],
    values: Callable[[pa.Array, np.ndarray, int], pa.Array],
    result: Callable[[pa.Table, pa.Array], pa.Table],
    schema: str,
    block_bytes: int,
    buckets: int,
) -> DataFrame:
    """Rows of ``result`` for every block of ``docs``, whose first column is an integer id.

    keys: a block's distinct keys and the bucket of each, the same whenever asked.
    values: one value for each of a bucket's distinct keys, given the sum of what blocks said of
        each (their ``weights`` field if keys are structs, else the number of blocks) and their number.
    result: a block's output from its rows and the values in the order of ``keys``.

    ``docs`` is read twice and must be cut alike both times: a scan of files or a stored table is. A
    digest of the ids guards that; if it fails the job stops.
    """

    def ask(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, digest, table in _cut(stream, block_bytes):
            found, bucket = keys(table)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            found = found.take(pa.array(order))
            for b in np.flatnonzero(np.diff(ends)).tolist():
                part = pa.table({"k": found.slice(ends[b], ends[b + 1] - ends[b])})
                yield _row(_ASKED, b, block, digest, packed(part))
            yield _row(_ASKED, block % buckets, block, digest, b"")

    def answer(group: pa.Table) -> pa.Table:
        rows = [(x, unpacked(a)["k"].combine_chunks()) for x, a in enumerate(group["asked"].to_pylist()) if a]
        out = [b""] * group.num_rows
        if rows:
            arrays = [k for _, k in rows]
            weights = None
            if pa.types.is_struct(arrays[0].type):
                weights = np.concatenate([np.asarray(a.field("weight")) for a in arrays])
                arrays = [a.field("key") for a in arrays]
            coded = pa.concat_arrays(arrays).dictionary_encode()
            codes = np.asarray(coded.indices, np.int64)
            sums = np.bincount(codes, weights, len(coded.dictionary)).astype(np.int64)
            found = values(coded.dictionary, sums, len(rows))
            start = 0
            for x, k in rows:
                out[x] = packed(pa.table({"v": found.take(pa.array(codes[start : start + len(k)]))}))
                start += len(k)
        return pa.table({"block": group["block"], "digest": group["digest"], "bucket": group["bucket"], "answer": pa.array(out, pa.binary())})

    def pack(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, digest, table in _cut(stream, block_bytes):
            yield _row(_BLOCK, block, digest, packed(table))

    def put_back(left: pa.Table, right: pa.Table) -> pa.Table:
        same = left.num_rows == 1 and right.num_rows and set(right["digest"].to_pylist()) == set(left["digest"].to_pylist())
        if not same:
            raise RuntimeError("the documents were cut into other blocks at the second reading: give a stored table")
        table = unpacked(left["docs"][0].as_py())
        found, bucket = keys(table)
        order = np.argsort(bucket, kind="stable")
        by_bucket = {b: a for b, a in zip(right["bucket"].to_pylist(), right["answer"].to_pylist()) if a}
        got = [unpacked(by_bucket[b])["v"].combine_chunks() for b in sorted(by_bucket)]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        if sum(map(len, got)) != len(order):
            raise RuntimeError("a block's keys and their values differ in number")
        return result(table, pa.concat_arrays(got).take(pa.array(back)) if got else None)

    answers = common.mapped(docs, ask, _ASKED).groupBy("bucket").applyInArrow(common.lean(answer), _ANSWER)
    blocks = common.mapped(docs, pack, _BLOCK)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(common.lean(put_back), schema)
