"""N-gram Jaccard join: documents whose shingle sets overlap enough, by T-occurrence search.

1. Every text becomes its set of word shingles, as 64-bit hashes. Documents of equal sets are one
   class, named by its least doc_id.
2. A pair that links shares some of the rarest shingles of both sets (the prefix filter); pairs that
   do are put into one candidate cluster. Frequent shingles come last, by their number of documents,
   which is counted over the whole corpus in slots that shingles share by hash, so a group that no batch
   shows is known too. It changes only what is tried, never what is found; but the list is bounded, and
   the more shingles of more than PAIRED documents it lacks, the larger the clusters.
3. Clusters are solved apart: inverted lists of the cluster's sets, the short ones merged (by counting
   places instead of a heap, as a list's entries are array elements), the long ones probed by binary
   search (DivideSkip), documents kept that reach the required overlap. A cluster too large for a task
   is cut into chunks.
4. links() gives every link between classes and each document's class, so every pair of chunks is
   solved. near_duplicates() gives the connected components only: every chunk is solved with the first
   one, and only what is then outside its cluster's main component meets the other chunks. So a group
   of near copies costs no square of its size.

Null and empty texts have empty sets and link with nothing; equal rows are fine, and so are
equal doc_ids, whatever their texts; a null doc_id is left out, but stays in one_of_each(); texts are
read whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm import common
from tidelog.llm.components import components

BATCH_BYTES = 4 << 20
#: Slots at most that count as frequent, about, those of the highest counts: their order is sent to tasks.
MOST_FREQUENT = 1 << 22
FREQUENT = 8
#: Shingles are counted by their first bits, in ranges of so many slots.
SLOT_BITS = 29
RANGE_BITS = 20
#: One more shared shingle is asked of two prefixes for every so many of the smaller set.
SUPPORT = 20
#: Documents up to which a shingle names every pair of its documents; beyond, a star.
PAIRED = 32
#: Sets and shingles of a chunk at most, about.
CHUNK_SETS = 2048
CHUNK_SHINGLES = 1_000_000
#: Words of 64 bits, at most, of the filter that spares rows a join: it is sent to tasks.
FILTER_WORDS = 1 << 19
#: A binary probe costs about this many steps of a merge.
_PROBE_COST = 32

_K = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Measure:
    """Shingles of ``size`` words that link at ``percent`` of the union; ``lower``: A-Z count as a-z."""

    size: int = 4
    percent: int = 85
    lower: bool = True

    def least_overlap(self, n: int | np.ndarray):
        """Shared shingles at least of a set of n with any partner."""
        return -(-self.percent * n // 100)

    def support(self, n):
        """How many shared shingles of two prefixes are asked for, by the smaller set's n."""
        return n // SUPPORT + 1

    def prefix(self, n):
        """Shingles of a prefix: two linked sets share at least ``support`` of the smaller within their prefixes."""
        return n - self.least_overlap(n) + self.support(n)

    def overlap(self, n: int, m: int | np.ndarray):
        """Shared shingles at least of sets of n and m that link: percent * union <= 100 * shared."""
        return -(-self.percent * (n + m) // (100 + self.percent))


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + np.uint64(salt * int(_K) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.LargeStringArray, measure: Measure) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and their offsets."""
    k = measure.size
    split = pc.ascii_split_whitespace(common.ascii_lower(texts) if measure.lower else texts)
    ends = common.bounds(split)
    coded = split.flatten().dictionary_encode()
    codes = np.asarray(coded.indices, np.int64)
    names = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))
    word = np.array([w != "" for w in names], bool)
    is_word = word[codes] if len(codes) else np.empty(0, bool)
    ends = np.concatenate([[0], np.cumsum(is_word)])[ends]
    w = hashes[codes[is_word]] if len(codes) else np.empty(0, np.uint64)
    n = np.diff(ends)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    begin = np.repeat(ends[:-1], count) + np.arange(first[-1]) - np.repeat(first[:-1], count)
    length = np.repeat(np.minimum(n, k), count)
    out = length.astype(np.uint64)
    for j in range(k):
        out = np.where(j < length, out * _K + w[np.minimum(begin + j, max(0, len(w) - 1))], out) if len(w) else out
    out = mixed(out)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        out[a:b].sort()
    if not len(out):
        return out, first
    doc = np.repeat(np.arange(len(n)), count)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[keep], np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(n)))])


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return (total[ends[1:]] - total[ends[:-1]]).view(np.int64)


def _overlapping(sets: list[np.ndarray], measure: Measure, label: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(x, places before x that link with it, shared shingles) over sets in order of size, each pair once.

    With ``label``, which the caller keeps up, pairs of one label are not tried.
    """
    n = np.array([len(s) for s in sets], np.int64)
    if not len(sets) or not n.sum():
        return
    owner = np.repeat(np.arange(len(sets)), n)
    _, codes, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df[codes] > 1
    owner, codes = owner[shared], codes[shared]
    # Inverted lists: sets by token in order of size, all in one sorted array, so one search probes many lists.
    m = len(sets)
    entries = np.sort(codes * m + owner)
    mine = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=m))])
    able = (n > 0) & (np.diff(mine) >= measure.least_overlap(n))
    for x in np.flatnonzero(able).tolist():
        low = int(np.searchsorted(n, measure.least_overlap(int(n[x]))))
        if low >= x:
            continue
        need = int(measure.overlap(int(n[x]), int(n[low])))
        own = codes[mine[x] : mine[x + 1]]
        begin, end = np.searchsorted(entries, own * m + low), np.searchsorted(entries, own * m + x)
        length = end - begin
        by_length = np.argsort(length, kind="stable")
        own, begin, length = own[by_length], begin[by_length], length[by_length]
        # DivideSkip: up to need - 1 of the longest lists may be probed; merging them all is the
        # cheaper way where the short lists already name many sets.
        long = min(need - 1, len(own))
        if int(length[: len(own) - long].sum()) * long * _PROBE_COST > int(length.sum()):
            long = 0
        short, probed = slice(0, len(own) - long), own[len(own) - long :]
        index = np.repeat(begin[short] - (np.cumsum(length[short]) - length[short]), length[short])
        merged = entries[index + np.arange(len(index))] % m
        counts = np.bincount(merged - low, minlength=x - low)
        wanted = measure.overlap(int(n[x]), n[low:x])
        found = np.flatnonzero((counts > 0) & (counts >= wanted - long) & able[low:x])
        found = found[np.argsort(-counts[found], kind="stable")]
        while True:
            if label is not None:
                found = found[label[found + low] != label[x]]
            if not len(found):
                break
            some, found = found[:64], found[64:]
            total = counts[some]
            if long:
                keys = probed[None, :] * m + (some + low)[:, None]
                place = np.minimum(np.searchsorted(entries, keys), len(entries) - 1)
                total = total + (entries[place] == keys).sum(axis=1)
            reached = total >= wanted[some]
            if reached.any():
                yield x, some[reached] + low, total[reached]


def link(sets: list[np.ndarray], measure: Measure, known: np.ndarray | None = None) -> np.ndarray:
    """The least index that every set is connected to by links between sets of the list; ``known``: equal where sets are connected already."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    label = np.arange(len(sets))
    if known is not None and len(sets):
        _, first, code = np.unique(known[order], return_index=True, return_inverse=True)
        label = first[code]
    for x, near, _ in _overlapping([sets[i] for i in order], measure, label):
        for y in near.tolist():
            a, b = sorted((label[x], label[y]))
            label[label == b] = a
    # Back to the given order, each component named by its least index.
    given = np.empty(len(sets), np.int64)
    given[order] = label
    least = np.full(len(sets), len(sets))
    np.minimum.at(least, given, np.arange(len(sets)))
    return least[given]


def pairs(sets: list[np.ndarray], measure: Measure) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every link of the list: its lower index, its higher one, and their shared shingles."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    found = [(np.full(len(near), order[x]), order[near], shared) for x, near, shared in _overlapping([sets[i] for i in order], measure)]
    a, b, shared = (np.concatenate([np.empty(0, np.int64), *c]) for c in zip(*found)) if found else (np.empty(0, np.int64),) * 3
    return np.minimum(a, b), np.maximum(a, b), shared


def _slots(flat: np.ndarray) -> np.ndarray:
    return (flat >> np.uint64(64 - SLOT_BITS)).astype(np.uint32)


def _packed(slots: np.ndarray, docs: np.ndarray) -> bytes:
    """Ascending slots and their documents, compressed: steps from slot to slot, like bytes together."""
    both = np.concatenate([np.diff(slots, prepend=slots[:1] * 0), docs]).astype("<u4")
    return pa.Codec("zstd", compression_level=1).compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)


def _unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(pa.Codec("zstd").decompress(data, 8 * n, asbytes=True), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
    return np.cumsum(both[:n], dtype=np.uint32), both[n:]


def classes(docs: DataFrame, measure: Measure) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, f1, f2) of every document, equal where the sets are; (slot, docs) of slots that FREQUENT documents or more have."""

    def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "f1", "f2", "part", "slots", "counts"]
        for rows in common.batches(stream, BATCH_BYTES):
            flat, ends = shingle_sets(common.strings(rows["text"]), measure)
            f1, f2 = _sums(mixed(flat, 1), ends), _sums(mixed(flat, 2), ends)
            none = [pa.nulls(rows.num_rows, t) for t in (pa.int32(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([rows["doc_id"].combine_chunks(), pa.array(np.diff(ends)), pa.array(f1), pa.array(f2), *none], names)
            slot, docs_of = np.unique(_slots(flat), return_counts=True)
            part, first = np.unique(slot >> RANGE_BITS, return_index=True)
            after = np.append(first[1:], len(slot))
            counts = [_packed(slot[a:b] & ((1 << RANGE_BITS) - 1), docs_of[a:b]) for a, b in zip(first.tolist(), after.tolist())]
            none = [pa.nulls(len(part), pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*none, pa.array(part, pa.int32()), pa.array(after - first, pa.int32()), pa.array(counts, pa.binary())], names)

    def count(group: pa.Table) -> pa.Table:
        total = np.zeros(1 << RANGE_BITS, np.int64)
        for n, data in zip(group["slots"].to_pylist(), group["counts"]):
            slot, docs_of = _unpacked(data.as_py(), n)
            total[slot] += docs_of
        often = np.flatnonzero(total >= FREQUENT)
        return pa.table({"slot": pa.array(often + (group["part"][0].as_py() << RANGE_BITS), pa.int32()), "docs": pa.array(total[often])})

    shape = "doc_id long, n long, f1 long, f2 long, part int, slots int, counts binary"
    both = common.stored(common.mapped(docs, scan, shape), "classes")
    counted = both.where("part is not null").select("part", "slots", "counts").groupBy("part").applyInArrow(common.lean(count), "slot int, docs long")
    return both.where("doc_id is not null").select("doc_id", "n", "f1", "f2"), common.stored(counted, "counted")


def frequent_slots(counted: DataFrame) -> tuple[bytes, int]:
    """The slots of the most documents, with their documents, as _packed() makes them, and their number."""
    found = counted.groupBy("docs").count().toArrow()
    docs, slots = np.asarray(found["docs"], np.int64), np.asarray(found["count"], np.int64)
    order = np.argsort(-docs)
    docs, upto = docs[order], np.cumsum(slots[order])
    whole = int(np.searchsorted(upto, MOST_FREQUENT, "right"))
    least = int(docs[whole - 1]) if whole else 2**62
    chosen = F.col("docs") >= least
    if whole < len(docs):
        # Of the first number of documents that doesn't fit whole, a share: slots are hashes.
        had = int(upto[whole - 1]) if whole else 0
        share = (MOST_FREQUENT - had) / (int(upto[whole]) - had)
        chosen |= (F.col("docs") == int(docs[whole])) & (F.col("slot") < int(share * (1 << SLOT_BITS)))
    top = counted.where(chosen).select("slot", F.least("docs", F.lit(2**31 - 1)).cast("int").alias("docs")).toArrow()
    slot, docs = np.asarray(top["slot"], np.int64), np.asarray(top["docs"], np.int64)
    order = np.argsort(slot)
    return _packed(slot[order], docs[order]), len(slot)


def _lateness(flat: np.ndarray, slots: np.ndarray, level: np.ndarray) -> np.ndarray:
    """How late each shingle comes in the order of rarity: 0 to 255, 0 for those that aren't frequent."""
    if not len(slots):
        return np.zeros(len(flat), np.int64)
    own = _slots(flat)
    at = np.minimum(np.searchsorted(slots, own), len(slots) - 1)
    return np.where(slots[at] == own, level[at], 0)


def _fingerprinted(rows: DataFrame, keep: str, measure: Measure) -> DataFrame:
    """doc_id, the column ``keep``, n, f1 and f2 of rows with a text."""

    def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.batches(stream, BATCH_BYTES):
            flat, ends = shingle_sets(common.strings(part["text"]), measure)
            out = part.select(["doc_id", keep])
            for name, x in (("n", np.diff(ends)), ("f1", _sums(mixed(flat, 1), ends)), ("f2", _sums(mixed(flat, 2), ends))):
                out = out.append_column(name, pa.array(x, pa.int64()))
            yield from out.to_batches()

    fields = [rows.schema["doc_id"], rows.schema[keep], *[T.StructField(c, T.LongType()) for c in ("n", "f1", "f2")]]
    return common.mapped(rows, scan, T.StructType(fields))


def _shingled(docs: DataFrame, frequent: tuple[bytes, int], measure: Measure) -> DataFrame:
    """tok, node (class hash f1), n, low of the prefixes of the documents.

    Where more than PAIRED documents of a batch have a shingle in their prefixes, only the least of
    them stands for it beyond the batch (hot); the others give it as their ``low`` and have no tok.
    """

    def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, docs_of = _unpacked(*frequent)
        level = np.minimum(255, 8 * np.log2(np.maximum(docs_of, 2))).astype(np.int64)
        for rows in common.batches(stream, BATCH_BYTES):
            flat, ends = shingle_sets(common.strings(rows["text"]), measure)
            if not len(flat):
                continue
            f1 = _sums(mixed(flat, 1), ends)
            n = np.diff(ends)
            doc = np.repeat(np.arange(len(n)), n)
            # Sets are sorted, so the stable order by (document, lateness) keeps each part sorted.
            flat = flat[np.argsort(doc * 256 + _lateness(flat, slots, level), kind="stable")]
            nth = np.arange(len(flat)) - np.repeat(ends[:-1], n)
            keep = nth < np.repeat(measure.prefix(n), n)
            flat, doc = flat[keep], doc[keep]
            # Copies within the batch fold before they are dealt out; the rows come in order of tok and node.
            tok, node = flat.view(np.int64), f1[doc]
            order = np.lexsort((node, tok))
            tok, node, size = tok[order], node[order], n[doc[order]]
            once = np.ones(len(tok), bool)
            once[1:] = (tok[1:] != tok[:-1]) | (node[1:] != node[:-1])
            tok, node, size = tok[once], node[once], size[once]
            first = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
            many = np.diff(np.append(first, len(tok)))
            hot = np.repeat(many, many) > PAIRED
            rest = hot.copy()
            rest[first] = False
            yield pa.RecordBatch.from_arrays(
                [pa.array(tok, mask=rest), pa.array(node), pa.array(size), pa.array(np.repeat(node[first], many), mask=~rest), pa.array(hot)],
                ["tok", "node", "n", "low", "hot"],
            )

    return common.mapped(docs, scan, "tok long, node long, n long, low long, hot boolean")


def _met(rows: DataFrame) -> DataFrame:
    """Rows of shingles that several documents have in their prefixes: node and n, with ``low``, the least document, and near, null for those of more than PAIRED.

    near: the next documents in order that have the shingle too. A stored table.
    """
    by_tok = W.partitionBy("tok")
    met = rows.where("tok is not null").withColumn("docs", F.count("*").over(by_tok) + PAIRED * F.max(F.col("hot").cast("int")).over(by_tok))
    after = by_tok.orderBy("node").rowsBetween(1, PAIRED - 1)
    met = met.where("docs > 1").withColumns({
        "low": F.min("node").over(by_tok),
        "near": F.when(F.col("docs") <= PAIRED, F.collect_list(F.struct("node", "n")).over(after)),
    })
    met = met.where("near is null and node <> low or size(near) > 0").select("node", "n", "low", "near")
    folded = rows.where("tok is null").select("node", "n", "low", F.lit(None).cast("array<struct<node:bigint,n:bigint>>").alias("near"))
    return common.stored(met.unionByName(folded), "prefixes")


def _edges(met: DataFrame, measure: Measure) -> DataFrame:
    """(a, b): classes that share ``support`` shingles of up to PAIRED documents in their prefixes, or one of more."""
    stars = met.where("near is null and node <> low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    pairs = met.where("near is not null").select(F.col("node").alias("a"), F.col("n").alias("na"), F.explode("near").alias("o"))
    small, large = F.least("na", "o.n"), F.greatest("na", "o.n")
    pairs = pairs.where((F.col("a") != F.col("o.node")) & (small * 100 >= large * measure.percent))
    pairs = pairs.groupBy("a", F.col("o.node").alias("b")).agg(F.count("*").alias("shared"), F.min(small).alias("small"))
    pairs = pairs.where(F.col("shared") >= F.floor(F.col("small") / SUPPORT) + 1).select("a", "b")
    return stars.unionByName(pairs)


def candidate_edges(docs: DataFrame, frequent: tuple[bytes, int], measure: Measure) -> DataFrame:
    """(a, b): class hashes f1 of sets that may link.

    If two sets overlap by t, their first n - t + s shingles in any common order share s or more. So
    a pair that shares fewer is no candidate. Shingles of up to PAIRED documents count the pairs of
    these; one of more documents joins them all by a star, whatever they share besides, so that no
    group's pairs are listed. ``frequent``, of frequent_slots(): these come last in the order of rarity.
    """
    return _edges(_met(_shingled(docs, frequent, measure)), measure)


def _placed(docs: DataFrame, measure: Measure) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Every document's class; the classes by their least doc_id; those in clusters, with their chunk c of ``chunks``; the documents' texts."""
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every, counted = classes(rows, measure)
    clusters = components(candidate_edges(rows, frequent_slots(counted), measure))
    reps = every.where("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"))
    reps = common.stored(reps, "reps")
    members = reps.join(clusters.select(F.col("node").alias("f1"), F.col("label").alias("cluster")), "f1").select("f1", "f2", "rep", "n", "cluster")
    members = common.stored(members, "members")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")).where("sets > 1")
    sizes = common.stored(sizes.select("cluster", _chunks("sets", "shingles").alias("chunks")), "sizes")
    place = F.pmod(F.xxhash64("f1", "f2"), "chunks").cast("int").alias("c")
    placed = members.join(sizes, "cluster").select("f1", "f2", F.col("rep").alias("doc_id"), "n", "cluster", "chunks", place)
    return every, reps, common.stored(placed, "placed"), rows


def _chunks(sets: str, shingles: str):
    return F.greatest(F.ceil(F.col(sets) / CHUNK_SETS), F.ceil(F.col(shingles) / CHUNK_SHINGLES)).cast("int")


def _perhaps(rows: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The ``rows`` whose doc_id may be one of ``ids``, all that are and few others; with left_anti the others, none of which is.

    A Bloom filter of four bits in one word for each id, so that rows are told apart where they are read and their texts not dealt out.
    """
    key = lambda c: c.cast("long")
    word = lambda c: F.pmod(F.xxhash64(key(c)), F.lit(FILTER_WORDS))

    def bits(c):
        h, one = F.xxhash64(key(c), F.lit(1)), F.lit(1).cast("long")
        each = [F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(4)]
        return each[0].bitwiseOR(each[1]).bitwiseOR(each[2]).bitwiseOR(each[3])

    own = F.col("doc_id")
    words = F.broadcast(ids.groupBy(word(own).alias("word")).agg(F.bit_or(bits(own)).alias("bits")))
    mine = rows["doc_id"]
    return rows.join(words, (word(mine) == words["word"]) & (words["bits"].bitwiseAND(bits(mine)) == bits(mine)), how)


def _texts(rows: DataFrame, placed: DataFrame, measure: Measure) -> DataFrame:
    """``placed`` with the text of each class."""
    # A doc_id may have several texts: of its rows, each class takes one whose set is its own. The join leaves out what the filter let pass.
    named = _perhaps(rows, placed.select("doc_id"))
    return _fingerprinted(named, "text", measure).dropDuplicates(["doc_id", "f1", "f2"]).drop("n").join(placed, ["doc_id", "f1", "f2"])


def _sets(group: pa.Table, measure: Measure) -> tuple[pa.Table, list[np.ndarray]]:
    """A cell in order of doc_id and f1, and the shingle sets."""
    group = group.take(pa.array(np.lexsort((np.asarray(group["f1"], np.int64), np.asarray(group["doc_id"], np.int64)))))
    flat, ends = shingle_sets(common.strings(group["text"]), measure)
    return group, [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def links(docs: DataFrame, measure: Measure = Measure()) -> tuple[DataFrame, DataFrame]:
    """(a, b, class_a, class_b, shared) of all links between classes, and (doc_id, n_shingles, rep, class) of every row.

    A class is known by its hash and shown by its least doc_id, which two classes share if that
    doc_id has two texts; a and b, a at most b, show two classes that link, and ``shared`` counts the
    shingles they share. Two rows link if their classes are equal, and their sets not empty, or are a
    pair. No link is left out for being implied by others, so a group of g classes that all link
    gives g (g - 1) / 2 rows; near_duplicates() is for those who need the groups only.
    """
    every, reps, placed, rows = _placed(docs, measure)
    # A cell holds two chunks, or the only one; each two chunks meet in one cell, which solves all pairs in it.
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    cells = _texts(rows, placed, measure).withColumn("d", other).where((F.col("chunks") == 1) | (F.col("c") != F.col("d")))
    cells = cells.select("cluster", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"), "c", "doc_id", "f1", "text")

    def solve(group: pa.Table) -> pa.Table:
        group, sets = _sets(group, measure)
        i, j, c = group["i"][0].as_py(), group["j"][0].as_py(), np.asarray(group["c"], np.int64)
        a, b, shared = pairs(sets, measure)
        # A chunk meets several others; its own pairs are given in the first of these cells.
        keep = (c[a] != c[b]) | ((i == 0) & np.where(c[a] == 0, j <= 1, c[a] == j))
        ids, f1 = np.asarray(group["doc_id"], np.int64), np.asarray(group["f1"], np.int64)
        out = {"a": ids[a[keep]], "b": ids[b[keep]], "class_a": f1[a[keep]], "class_b": f1[b[keep]], "shared": shared[keep].astype(np.int64)}
        return pa.table({k: pa.array(v) for k, v in out.items()})

    found = cells.groupBy("cluster", "i", "j").applyInArrow(common.lean(solve), "a long, b long, class_a long, class_b long, shared long")
    own = ["doc_id", F.col("n").alias("n_shingles")]
    members = every.where("n > 0").join(reps.select("f1", "f2", "rep"), ["f1", "f2"]).select(*own, "rep", F.col("f1").alias("class"))
    return found, members.unionByName(every.where("n = 0").select(*own, F.col("doc_id").alias("rep"), F.col("f1").alias("class")))


def _beyond(rows: DataFrame, large: DataFrame, edges: DataFrame, measure: Measure) -> DataFrame:
    """Cells of what ``edges`` leave open in clusters of several chunks: sets outside the main component with the chunks other than the first."""
    known = large.join(components(edges).select(F.col("node").alias("f1"), "label"), "f1", "left").withColumn("label", F.coalesce("label", "f1"))
    known = common.stored(known, "known")
    size = known.groupBy("cluster", "label").agg(F.count("*").alias("sets"))
    main = size.groupBy("cluster").agg(F.max_by("label", F.struct("sets", "label")).alias("main"))
    outside = known.join(main, "cluster").where("label <> main").drop("main", "chunks")
    groups = outside.groupBy("cluster").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")).select("cluster", _chunks("sets", "shingles").alias("groups"))
    groups = common.stored(groups, "groups")
    texts = common.stored(_texts(rows, known.join(groups, "cluster"), measure), "texts")
    own = texts.where("c > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).withColumn("j", F.col("c"))
    apart = texts.join(outside.select("f1", "f2"), ["f1", "f2"], "left_semi")
    apart = apart.withColumn("i", F.pmod(F.xxhash64("f2", "f1"), "groups").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(1), F.col("chunks") - 1)))
    shown = ["cluster", "i", "j", "doc_id", "f1", "label", "text"]
    return own.select(*shown).unionByName(apart.where("c <> j").select(*shown))


def _named(docs: DataFrame, measure: Measure) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, f1, f2) of every document; (f1, f2, component_id, first) of the classes, first: of its component's classes the one to keep."""
    every, reps, placed, rows = _placed(docs, measure)

    def solve(group: pa.Table) -> pa.Table:
        group, sets = _sets(group, measure)
        f1 = np.asarray(group["f1"], np.int64)
        root = link(sets, measure, np.asarray(group["label"], np.int64))
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": pa.array(f1[root[moved]]), "b": pa.array(f1[moved])})

    solved = lambda cells: cells.groupBy("cluster", "i", "j").applyInArrow(common.lean(solve), "a long, b long")
    # Every chunk meets the first one; the first one meets them all.
    with_first = F.when(F.col("c") > 0, F.array("c")).when(F.col("chunks") > 1, F.sequence(F.lit(1), F.col("chunks") - 1)).otherwise(F.array(F.lit(0)))
    cells = _texts(rows, placed, measure).select("cluster", F.lit(0).alias("i"), F.explode(with_first).alias("j"), "doc_id", "f1", F.col("f1").alias("label"), "text")
    edges = common.stored(solved(cells), "solved")
    large = common.stored(placed.where("chunks > 2"), "large")
    if not large.isEmpty():
        edges = edges.unionByName(solved(_beyond(rows, large, edges, measure)))
    linked = components(edges)
    linked = common.stored(linked.select(F.col("node").alias("f1"), "label"), "linked")
    own = F.struct("rep", "f1", "f2")
    least = reps.join(linked, "f1").groupBy("label").agg(F.min(own).alias("least"))
    named = reps.join(linked, "f1", "left").join(least, "label", "left").withColumn("least", F.coalesce("least", own))
    first = (F.col("least.f1") == F.col("f1")) & (F.col("least.f2") == F.col("f2"))
    return every, common.stored(named.select("f1", "f2", F.col("least.rep").alias("component_id"), first.alias("first")), "named")


def near_duplicates(docs: DataFrame, measure: Measure = Measure()) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links) of every row of ``docs`` (doc_id, text).

    The rows of a doc_id with several texts are several documents; their components share a name if
    this doc_id is the least of both.
    """
    every, named = _named(docs, measure)
    full = every.where("n > 0").join(named, ["f1", "f2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(every.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, measure: Measure) -> DataFrame:
    """One row of ``docs`` of each component, of its least doc_id, with its own columns.

    Rows without a shingle or a doc_id duplicate nothing and stay.
    """
    every, named = _named(docs, measure)
    first = named.where("first").select(F.col("component_id").alias("doc_id"), "f1", "f2")
    # Where a doc_id is one row's, it tells the row; the rows of the others are told by their sets.
    several = common.stored(every.groupBy("doc_id").count().where("count > 1").select("doc_id"), "several")
    kept = first.select("doc_id").unionByName(every.where("n = 0").select("doc_id")).join(several, "doc_id", "left_anti")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    shared = _perhaps(docs, several).join(several, "doc_id", "left_semi").select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("row"), F.col("text").cast("string").alias("text"))
    shared = _fingerprinted(shared, "row", measure)
    nth = F.row_number().over(W.partitionBy("doc_id", "f1", "f2").orderBy("row.text"))
    chosen = shared.where("n > 0").join(first, ["doc_id", "f1", "f2"], "left_semi").withColumn("nth", nth).where("nth = 1")
    chosen = chosen.select("row.*").union(shared.where("n = 0").select("row.*"))
    told = every.select("doc_id").distinct().join(kept.distinct().withColumn("kept", F.lit(True)), "doc_id", "left").select("doc_id", F.col("kept").isNotNull().alias("kept"))
    told = common.stored(told, "told")
    # Only rows that may have a doc_id of the smaller part, kept or gone, are dealt out to meet it.
    stays = told.where("kept").select("doc_id")
    goes = told.where("not kept").select("doc_id")
    with_id = docs.where("doc_id is not null")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if stays.count() < goes.count():
        left = _perhaps(with_id, stays).join(stays, "doc_id", "left_semi").select(*columns)
    else:
        left = _perhaps(with_id, goes, "left_anti").union(_perhaps(with_id, goes).join(goes, "doc_id", "left_anti").select(*columns))
    return docs.where("doc_id is null").union(left).union(chosen)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), Measure(size=4, percent=85, lower=True))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE doc_id IS NOT NULL),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(seen) AS component_id
FROM d JOIN r ON r.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY ALL
"""
