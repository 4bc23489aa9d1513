"""LM scoring: stupid-backoff bigram scores of every document against the rest of the corpus.

S(w | v) = c(v w) / c(v) where the rest of the corpus has v w, else BACKOFF c(w) / N, and BACKOFF^2 / N
for a word that it lacks. Counts are those of all documents less the document's own, so a document
never vouches for itself; N is the number of words less its own. A text begins after a start mark.
lm_score is the mean log10 S of its words. Words are runs without ASCII white space, A-Z lower-cased.

n-grams are 64-bit hashes. Blocks of documents ask for the counts of their distinct n-grams; the
count tables are partitioned by the hash; counts come back to the block and are summed by document.
Null and empty texts have no words and a null score; repeated rows and doc_ids are documents each;
texts are scored whole; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import common
from tidelog.llm.blocks import answered, bucket_count
from tidelog.llm.op7_ngram_join import mixed

BACKOFF = 0.4
BLOCK_BYTES = 8 << 20
_START = np.uint64(0x5851F42D4C957F2D)
_K = np.uint64(0x9E3779B97F4A7C15)


def _grams(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every word: its hash, its context's hash, the hash of both; and the offsets of texts."""
    split = pc.ascii_split_whitespace(common.ascii_lower(texts))
    coded = split.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, 10) for w in names), np.uint64, len(names))
    codes = np.asarray(coded.indices, np.int64)
    real = np.array([w != "" for w in names], bool)[codes] if len(codes) else np.empty(0, bool)
    ends = np.concatenate([[0], np.cumsum(real)])[common.bounds(split)]
    word = mixed(hashes)[codes[real]] if len(codes) else np.empty(0, np.uint64)
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[ends[:-1][np.diff(ends) > 0]] = _START
    return word, before, mixed(before * _K + word, 2), ends


def _own(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often each key occurs in its document."""
    _, code, count = np.unique(mixed(keys, 5) + mixed(doc.astype(np.uint64), 6), return_inverse=True, return_counts=True)
    return count[code]


def _distinct(word: np.ndarray, pair: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a block, sorted, and how often each occurs; the start mark once a text that has words."""
    keys, count = np.unique(np.concatenate([word, pair]), return_counts=True)
    return np.append(keys, _START), np.append(count, texts)


def lm_scores(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_backoff (words scored by their own count), lm_score of every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = F.size(F.array_remove(F.split("text", "[ \\t-\\r]+"), ""))
    facts = rows.agg(F.coalesce(F.sum(F.when(F.col("text").isNotNull(), words)), F.lit(0)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    total, buckets = facts["n"], bucket_count(facts["b"])

    def keys(table: pa.Table) -> tuple[pa.Array, np.ndarray]:
        word, _, pair, ends = _grams(common.strings(table.column(1)))
        found, count = _distinct(word, pair, int((np.diff(ends) > 0).sum()))
        asked = pa.StructArray.from_arrays([pa.array(found), pa.array(count, pa.int32())], ["key", "weight"])
        return asked, (found % np.uint64(buckets)).astype(np.int64)

    def values(_keys: pa.Array, sums: np.ndarray, _blocks: int) -> pa.Array:
        return pa.array(sums)

    def score(table: pa.Table, counts: pa.Array) -> pa.Table:
        word, before, pair, ends = _grams(common.strings(table.column(1)))
        n = np.diff(ends)
        found, _ = _distinct(word, pair, 0)
        counts = np.asarray(counts, np.int64)
        starts, found, counts = counts[-1], found[:-1], counts[:-1]
        doc = np.repeat(np.arange(len(n)), n)
        at = lambda k: counts[np.searchsorted(found, k)]
        own_word, own_pair = _own(word, doc), _own(pair, doc)
        first = before == _START
        c_word, c_pair = at(word) - own_word, at(pair) - own_pair
        c_before = np.empty(len(word), np.int64)
        c_before[1:] = c_word[:-1]
        c_before[first] = starts - 1
        # A context counts as often as it is one: its occurrences in other documents.
        rest = np.maximum(1, total - n)[doc]
        with np.errstate(divide="ignore", invalid="ignore"):
            s = np.where(c_pair > 0, c_pair / np.maximum(c_before, 1), np.where(c_word > 0, BACKOFF * c_word / rest, BACKOFF**2 / rest))
        log = np.log10(s) if len(s) else s
        sums = np.array([log[a:b].sum() for a, b in zip(ends[:-1], ends[1:])])
        backed = np.bincount(doc[c_pair <= 0], minlength=len(n)) if len(doc) else np.zeros(len(n), np.int64)
        mean = np.round(sums / np.maximum(n, 1), 6)
        return pa.table({
            "doc_id": table.column(0),
            "n_words": pa.array(n, pa.int64()),
            "n_backoff": pa.array(backed, pa.int64()),
            "lm_score": pa.array(mean, pa.float64(), mask=n == 0),
        })

    return answered(rows, keys, values, score, "doc_id long, n_words long, n_backoff long, lm_score double", block_bytes, buckets)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(common.table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
p AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM d),
b AS (SELECT doc_id, i, w, coalesce(lag(w) OVER (PARTITION BY doc_id ORDER BY i), ' ') AS v FROM p),
u AS (SELECT w, count(*) AS c FROM b GROUP BY w UNION ALL SELECT ' ', count(*) FROM b WHERE i = 1),
uo AS (SELECT doc_id, w, count(*) AS c FROM b GROUP BY doc_id, w UNION ALL SELECT doc_id, ' ', 1 FROM b WHERE i = 1),
g AS (SELECT v, w, count(*) AS c FROM b GROUP BY v, w),
go AS (SELECT doc_id, v, w, count(*) AS c FROM b GROUP BY doc_id, v, w),
n AS (SELECT count(*) AS c FROM b),
no AS (SELECT doc_id, count(*) AS c FROM b GROUP BY doc_id),
x AS (
  SELECT b.doc_id, g.c - go.c AS pair, uv.c - uov.c AS context, uw.c - uow.c AS word, greatest(1, n.c - no.c) AS rest
  FROM b JOIN g USING (v, w) JOIN go ON go.doc_id = b.doc_id AND go.v = b.v AND go.w = b.w
  JOIN u uv ON uv.w = b.v JOIN uo uov ON uov.doc_id = b.doc_id AND uov.w = b.v
  JOIN u uw ON uw.w = b.w JOIN uo uow ON uow.doc_id = b.doc_id AND uow.w = b.w
  JOIN no ON no.doc_id = b.doc_id CROSS JOIN n),
s AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (pair <= 0) AS n_backoff,
         avg(log10(CASE WHEN pair > 0 THEN pair / greatest(context, 1) WHEN word > 0 THEN 0.4::DOUBLE * word / rest ELSE 0.4::DOUBLE * 0.4::DOUBLE / rest END)) AS m
  FROM x GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_backoff, 0) AS n_backoff, round(m, 6) AS lm_score FROM d LEFT JOIN s USING (doc_id)
"""
