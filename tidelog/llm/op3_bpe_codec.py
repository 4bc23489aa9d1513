"""BPE encoding and decoding through a table of distinct words.

Texts are split into words, every distinct word of the corpus is encoded once, and its ids are
joined back at each position; ids are decoded through the id-to-piece table. Null and empty texts
have no ids and decode to the empty text; a text's length is unlimited, as words are what is
encoded. Rows are independent, so repeated rows and doc_ids give repeated results and an empty
table an empty one; columns other than the id and the text are not read.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, common
from tidelog.llm.blocks import answered, bucket_count

BLOCK_BYTES = 12 << 20


def encode_decode(
    docs: DataFrame,
    vocabulary: str,
    result: str = "digests",
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Encode and decode every text of ``docs`` with the byte-level BPE file ``vocabulary``.

    result "tokens": (id, ids array<int>, decoded string). result "digests": (id, n_tokens,
    ids_sha256, decoded_sha256), the same reduced within the task that made it.
    block_bytes bounds the text that one task holds; buckets of words follow the size of all texts.
    """
    whole = result == "tokens"

    def ids_of(rows: pa.Table, lists: pa.Array | None) -> tuple[np.ndarray, np.ndarray]:
        _, codes, first = bpe.words_of(common.strings(rows.column(1)))
        if lists is None:
            return np.empty(0, np.uint32), np.zeros(rows.num_rows + 1, np.int64)
        return bpe.at_positions(np.asarray(lists.flatten(), np.uint32), common.bounds(lists), codes, first)

    def keys(rows: pa.Table) -> tuple[pa.Array, np.ndarray]:
        words = bpe.words_of(common.strings(rows.column(1)))[0]
        return words, bpe.bucket_of(words, buckets)

    def values(words: pa.Array, _sums: np.ndarray, _blocks: int) -> pa.Array:
        ids, offsets = bpe.codec(vocabulary).encode_words(words.cast(pa.large_string()))
        small = bpe.codec(vocabulary).size <= 1 << 16
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.uint16 if small else np.uint32)))

    def put(rows: pa.Table, lists: pa.Array | None) -> pa.Table:
        codec = bpe.codec(vocabulary)
        ids, offsets = ids_of(rows, lists)
        pieces, at = codec.decoded(ids)
        ends = at[offsets].tolist()
        spans = [pieces[a:b] for a, b in zip(ends, ends[1:])]
        decoded = [bytes(x).decode("utf-8", "replace") for x in spans]
        if whole:
            column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            return pa.table({id_col: rows.column(0), "ids": column, "decoded": pa.array(decoded, pa.string())})
        digits, at = bpe.taken(codec.digits, ids)
        ends = at[offsets].tolist()
        said = [sha256(digits[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends, ends[1:])]
        return pa.table({
            id_col: rows.column(0),
            "n_tokens": pa.array(np.diff(offsets), pa.int64()),
            "ids_sha256": pa.array(said, pa.string()),
            "decoded_sha256": pa.array([sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
        })

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    buckets = bucket_count(common.text_bytes(rows, text_col))
    out = "ids array<int>, decoded string" if whole else "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return answered(rows, keys, values, put, f"{id_col} long, {out}", block_bytes, buckets)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
