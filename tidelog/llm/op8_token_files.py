"""Token-id files: ids of whole documents, packed at the fewest bits that hold the vocabulary.

A file is, in this order and little-endian:
    magic b"TOKBITS1", uint32 bits per id, uint32 documents, uint64 ids, uint32 ids per block, uint32 blocks
    int64 doc_id of each document, uint64 first id of each document in the file (and the end)
    uint64 byte offset of each block (and the end), counted from the first block
    the blocks: ids of up to ``ids per block``, packed from the lowest bit up
A block begins at a byte, so ids i..j need only the blocks that hold them. Files hold consecutive
doc_ids and follow one another in that order.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm import bpe, common

END_ID = 0
FILE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
BLOCK_IDS = 4096
#: Ranges of doc_id at most, as their bounds are one row of the driver; a task writes as many files of FILE_BYTES as its range needs.
MOST_RANGES = 4096
#: In the files, the doc_id that stands for a null one; no other document may have it.
NULL_ID = -(2**63)

_HEAD = struct.Struct("<8sIIQII")
_MAGIC = b"TOKBITS1"


def bits_for(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after another at ``bits`` each, from the lowest bit up."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each.reshape(-1), bitorder="little").tobytes()


def unpack_bits(data: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(n)


def file_bytes(doc_ids: np.ndarray, ids: np.ndarray, offsets: np.ndarray, bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    blocks = [pack_bits(ids[i : i + block_ids], bits) for i in range(0, len(ids), block_ids)]
    at = np.concatenate([[0], np.cumsum([len(b) for b in blocks])])
    head = _HEAD.pack(_MAGIC, bits, len(doc_ids), len(ids), block_ids, len(blocks))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), offsets.astype("<u8").tobytes(), at.astype("<u8").tobytes(), *blocks])


class TokenFile:
    """Reads a file's bytes; ``ids(i, j)`` unpacks only the blocks that hold ids i to j."""

    def __init__(self, data: bytes) -> None:
        magic, self.bits, docs, self.n_ids, self.block_ids, blocks = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a token-id file")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.offsets = np.frombuffer(data, "<u8", docs + 1, at + 8 * docs).astype(np.int64)
        self._blocks = np.frombuffer(data, "<u8", blocks + 1, at + 8 * (2 * docs + 1)).astype(np.int64)
        self._data = memoryview(data)[at + 8 * (2 * docs + 1) + 8 * (blocks + 1) :]

    def ids(self, start: int, end: int) -> np.ndarray:
        if start >= end:
            return np.empty(0, np.uint32)
        first, last = start // self.block_ids, (end - 1) // self.block_ids
        got = [
            unpack_bits(self._data[self._blocks[b] : self._blocks[b + 1]], self.bits, min(self.block_ids, self.n_ids - b * self.block_ids))
            for b in range(first, last + 1)
        ]
        return np.concatenate(got)[start - first * self.block_ids : end - first * self.block_ids]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.offsets[k]), int(self.offsets[k + 1]))


def write(docs: DataFrame, vocabulary: str, folder: str, end_id: int = END_ID, file_bytes_of_text: int = FILE_BYTES) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) to files under ``folder``, a URI that executors share.

    Returns the manifest, stored beside the files: file, part, number, docs, ids. Only files that
    the manifest names count, so a task that runs twice does no harm. Null and empty texts are
    their end id alone; equal doc_ids stand in any order; documents of null doc_id come first, under
    NULL_ID in the file, and are null again when read; an empty table gives an empty manifest and no
    file. Other columns are not read. Beyond MOST_RANGES ranges a task writes several files in turn.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    n = min(MOST_RANGES, common.parts(rows.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"], file_bytes_of_text))
    # Ranges of doc_id of about the same number of documents, one task each: bounds come from the ids alone.
    cuts = rows.agg(F.percentile_approx("doc_id", [(i + 1) / n for i in range(n - 1)], max(10_000, 20 * n)).alias("c")).first()["c"] if n > 1 else []
    cuts = sorted(set(cuts or []))
    part = _range_of(F.col("doc_id"), cuts)
    dealt = rows.withColumn("part", part).repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "doc_id")

    def put(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.codec(vocabulary)
        bits = bits_for(max(codec.size, end_id + 1))
        files, base = pyarrow.fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        number = 0
        for table in _by_part(stream, file_bytes_of_text):
            held = []
            for x in common.batches(iter(table.to_batches()), BATCH_BYTES):
                ids, offsets = bpe.encode_block(codec, common.strings(x["text"]))
                held.append((np.insert(ids, offsets[1:], end_id).astype(np.uint16 if bits <= 16 else np.uint32), np.diff(offsets) + 1))
            ids = np.concatenate([a for a, _ in held])
            offsets = np.concatenate([[0], np.cumsum(np.concatenate([b for _, b in held]))])
            name = f"{uuid.uuid4().hex}.tok"
            with files.open_output_stream(f"{base}/{name}") as out:
                out.write(file_bytes(np.asarray(table["doc_id"]), ids, offsets, bits))
            yield pa.RecordBatch.from_pylist(
                [{"file": name, "part": table["part"][0].as_py(), "number": number, "docs": table.num_rows, "ids": len(ids)}],
                pa.schema([("file", pa.string()), ("part", pa.int32()), ("number", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64())]),
            )
            number += 1

    return common.stored(common.mapped(dealt, put, "file string, part int, number int, docs long, ids long"), "manifest")


def _range_of(doc_id, cuts: list[int]):
    """Number of the range that an id falls in: the cuts below it, counted in two steps of up to 64."""
    if not cuts:
        return F.lit(0)
    groups = [cuts[i : i + 64] for i in range(0, len(cuts), 64)]
    below = lambda values: F.size(F.filter(values, lambda c: c < doc_id))
    array = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    if len(groups) == 1:
        return below(array(cuts))
    coarse = below(array([g[-1] for g in groups]))
    return coarse * 64 + F.coalesce(below(F.get(F.array(*map(array, groups)), coarse)), F.lit(0))


def _by_part(stream: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.Table]:
    """Tables of one part each, cut where they reach ``most_bytes``; parts follow each other in the stream."""
    held, size = [], 0
    for batch in stream:
        part = np.asarray(batch.column("part"))
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            piece = batch.slice(a, b - a)
            for table in common.batches(iter([piece]), most_bytes):
                if held and (size + table.nbytes > most_bytes or held[0]["part"][0] != table["part"][0]):
                    yield pa.concat_tables(held).combine_chunks()
                    held, size = [], 0
                held.append(table)
                size += table.nbytes
    if held:
        yield pa.concat_tables(held).combine_chunks()


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Every document of the files that ``manifest`` names: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it, over all files in order.
    """
    ordered = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    by_part = manifest.groupBy("part").agg(F.sum("ids").alias("ids"))
    by_part = by_part.select("part", F.coalesce(F.sum("ids").over(ordered), F.lit(0)).alias("part_base"))
    within = W.partitionBy("part").orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    based = manifest.withColumn("in_part", F.coalesce(F.sum("ids").over(within), F.lit(0))).join(by_part, "part")
    based = based.select("file", (F.col("in_part") + F.col("part_base")).alias("base"))
    # Before the first file there is no folder.
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    found = found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def documents(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for name, data in zip(batch.column("file").to_pylist(), batch.column("content")):
                held = TokenFile(data.as_buffer())
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * len(held.doc_ids), pa.string()),
                    pa.array(held.doc_ids, pa.int64()),
                    pa.array(held.offsets[:-1], pa.int64()),
                    pa.array(np.diff(held.offsets), pa.int64()),
                    pa.array(bpe.crcs(held.ids(0, held.n_ids), held.offsets), pa.int64()),
                ], ["file", "doc_id", "start", "n_tokens", "ids_crc32"])

    rows = common.mapped(found, documents, "file string, doc_id long, start long, n_tokens long, ids_crc32 long")
    doc_id = F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id")
    return rows.join(based, "file").select(doc_id, (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = common.new_path(spark, "token-files")
    manifest = write(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read(spark, folder, manifest)
