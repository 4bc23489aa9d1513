"""Best-fit packing of documents into training sequences by exact-complement hashing.

Only the number of pieces of each length matters for a packing, and there are at most ``capacity``
lengths. So the corpus is reduced to that histogram, the packing is worked out on the histogram as
a list of patterns with multiplicities, and pieces are then dealt to the patterns' slots by their
rank among pieces of the same length. Every step but the histogram's is distributed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm import bpe, common

CAPACITY = 1024
END_ID = 2
BATCH_BYTES = 4 << 20

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


class _Stock:
    """How many pieces of each length are left, with indexes of the sums of one, two and three lengths.

    The index of a sum holds the first combination that may still be in stock, in a fixed order. Stock
    only falls, so what is passed over is never back, and all indexes together move capacity squared
    steps at most.
    """

    def __init__(self, counts: np.ndarray) -> None:
        self.left = counts.tolist()
        #: By sum: the least length of a pair, and the greatest of three, from which on combinations may exist.
        self._pair_from = [1] * len(counts)
        self._triple_from = list(range(-2, len(counts) - 2))

    def _has(self, *lengths: int) -> bool:
        return all(self.left[x] >= lengths.count(x) for x in lengths)

    def take(self, lengths: tuple[int, ...] | list[int], times: int = 1) -> None:
        for x in lengths:
            self.left[x] -= times

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths in stock that add up to exactly ``gap``, the larger ones first."""
        if gap < 1:
            return None
        if self.left[gap]:
            return (gap,)
        return self._pair(gap) or self._triple(gap)

    def _pair(self, total: int) -> tuple[int, int] | None:
        low = self._pair_from[total]
        while 2 * low <= total and not self._has(low, total - low):
            low += 1
        self._pair_from[total] = low
        return (total - low, low) if 2 * low <= total else None

    def _triple(self, total: int) -> tuple[int, int, int] | None:
        high = self._triple_from[total]
        while 3 * high >= total and high > 0:
            if self.left[high] and (pair := self._pair(total - high)):
                if self._has(high, *pair):
                    self._triple_from[total] = high
                    return (high, *pair)
                # The pair needs the one piece of this length itself: another pair of the sum may do.
                for low in range(pair[1] + 1, (total - high) // 2 + 1):
                    if self._has(high, low, total - high - low):
                        self._triple_from[total] = high
                        return (high, total - high - low, low)
            high -= 1
        self._triple_from[total] = high
        return None

    def best_fit(self, gap: int) -> int:
        """The largest length in stock that still fits, 0 if none."""
        return next((x for x in range(gap, 0, -1) if self.left[x]), 0)


def patterns(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """(multiplicity, lengths) of sequences that use every piece, ``counts[n]`` pieces being n long.

    Longest first: an exact complement fills the sequence if the stock has one, otherwise the
    longest piece that fits narrows the gap and the search goes on. What was found once is used as
    often as the stock allows, so the work follows the number of lengths, not of pieces.
    """
    stock = _Stock(counts)
    out = []
    for top in range(capacity, 0, -1):
        while stock.left[top]:
            chosen, gap = [top], capacity - top
            stock.take(chosen)
            while gap:
                exact = stock.complement(gap)
                more = exact or ((x,) if (x := stock.best_fit(gap)) else ())
                if not more:
                    break
                stock.take(more)
                chosen += more
                gap -= sum(more)
            again = min(stock.left[x] // chosen.count(x) for x in set(chosen))
            stock.take(chosen, again)
            out.append((1 + again, chosen))
    return out


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document: its ids and end_id, cut from the end so that only the first may be short."""

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part = bpe.codec(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for rows in common.batches(stream, BATCH_BYTES):
            ids, offsets = bpe.encode_block(codec, common.strings(rows.column(1)))
            n = len(offsets) - 1
            ids = np.insert(ids, offsets[1:], end_id)
            offsets = offsets + np.arange(n + 1)
            total = np.diff(offsets)
            count = -(-total // capacity)
            head = total - (count - 1) * capacity
            doc = np.repeat(np.arange(n), count)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            length = np.where(number == 0, head[doc], capacity)
            start = np.where(number == 0, 0, head[doc] + (number - 1) * capacity)
            begin = offsets[:-1][doc] + start
            by_length = np.argsort(length, kind="stable")
            sizes, first, many = np.unique(length[by_length], return_index=True, return_counts=True)
            nth = np.empty(len(doc), np.int64)
            nth[by_length] = np.arange(len(doc)) - np.repeat(first, many)
            nth += seen[length]
            seen[sizes] += many
            yield pa.RecordBatch.from_arrays([
                rows.column(0).combine_chunks().take(pa.array(doc)),
                pa.array(number, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(bpe.crcs(ids, np.append(begin, len(ids))), pa.int64()),
                pa.array(np.full(len(doc), part), pa.int32()),
                pa.array(nth, pa.int64()),
            ], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.mapped(rows, cut, _PIECES)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack every document of ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece. A null or
    empty text is its end id alone; a long text is cut into pieces of ``capacity`` with a shorter
    first one; repeated rows and doc_ids are packed as rows of their own; an empty table gives no
    rows. Other columns are not read.
    """
    spark = docs.sparkSession
    cut = common.stored(pieces(docs, vocabulary, capacity, end_id), "pieces")
    tally = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    tally = tally.select("length", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # Bounded by the capacity: one row for each length.
    counts = np.zeros(capacity + 1, np.int64)
    for row in tally.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    slots = []
    used, sequence = np.zeros(capacity + 1, np.int64), 0
    for times, lengths in patterns(counts, capacity):
        uses = {x: lengths.count(x) for x in lengths}
        nth, at = dict.fromkeys(uses, 0), 0
        for x in lengths:
            # Of each ``uses[x]`` pieces in a row this slot takes the one numbered nth[x].
            slots.append((x, int(used[x]), int(used[x]) + uses[x] * times, uses[x], nth[x], at, sequence))
            nth[x] += 1
            at += x
        for x, k in uses.items():
            used[x] += k * times
        sequence += times
    # Bounded by the number of lengths and of their patterns, never by documents, so it may be broadcast.
    plan = spark.createDataFrame(
        [(x, a, b, k, [(n, at, s)]) for x, a, b, k, n, at, s in slots],
        "length long, low long, high long, uses long, slot array<struct<nth:long,offset:long,sequence:long>>",
    )
    by_rank = plan.groupBy("length", "low", "high", "uses").agg(F.sort_array(F.flatten(F.collect_list("slot"))).alias("slots"))
    # All ranges of a length in one row, in order, so that a piece finds its own by position.
    ranges = by_rank.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("high", "low", "uses", "slots"))).alias("ranges"))
    ranked = cut.join(tally.drop("n"), ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    found = ranked.join(F.broadcast(ranges), "length").withColumn("r", F.filter("ranges", lambda r: r["high"] > F.col("rank"))[0])
    step = F.col("rank") - F.col("r.low")
    slot = F.get(F.col("r.slots"), F.pmod(step, F.col("r.uses")).cast("int"))
    return found.withColumn("slot", slot).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("slot.sequence") + F.floor(step / F.col("r.uses"))).alias("sequence_id"),
        F.col("slot.offset").alias("offset"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
