"""Language ID: nearest of several centroids per language by cosine of TF-IDF character n-grams.

A text is lower-cased, everything but letters becomes one space, and its byte n-grams of 1 to 3 bytes
are hashed to DIMENSIONS counts; counts are damped, weighted by inverse document frequency and
normalised. Centroids come from spherical k-means within each language, every one of the column, over
a bounded sample of its labelled texts; a language is solved in one task, and the driver and the tasks
hold its centroids only. A text whose best cosine is under its language's floor is rejected.

A null text and one without a letter are ``und`` with score 0. Texts are read whole, a long one in
the same bounded steps as many short ones. Rows are judged alone, so repeated rows agree and ties go
to the first centroid in order of language; an empty table gives no rows. Only the text is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm import common

DIMENSIONS = 4096
#: Labelled texts of each language at most that centroids are made from, the lowest hashes of doc_id.
MOST_OF_LANGUAGE = 400
CENTROIDS = 4
#: A text is rejected below this share of the cosine that 99 % of its language's training texts reach.
RADIUS = 0.5
BATCH_BYTES = 2 << 20
ROWS = 256

UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    floor: np.ndarray
    idf: np.ndarray


def counts(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram counts of each text, and whether it has a letter."""
    lower = pc.utf8_lower(texts)
    lettered = np.asarray(pc.match_substring_regex(lower, r"\p{L}")).astype(bool)
    plain = pc.replace_substring_regex(lower, r"[^\p{L}]+", " ").cast(pa.large_string())
    ends = np.frombuffer(plain.buffers()[1], np.int64, len(plain) + 1, 8 * plain.offset)
    data = np.frombuffer(plain.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(np.uint32)
    ends = ends - ends[0]
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    step = 1 << 20
    text_of = np.repeat(np.arange(len(texts)), np.diff(ends))
    for a in range(0, len(data), step):
        b = min(len(data), a + step)
        seen = data[a : min(len(data), b + 2)]
        owner = text_of[a : min(len(data), b + 2)]
        for n in (1, 2, 3):
            code = seen[: len(seen) - n + 1].copy() + np.uint32(n << 8)
            for k in range(1, n):
                code = code * np.uint32(0x01000193) + seen[k : len(seen) - n + 1 + k]
            code = (code * np.uint32(0x9E3779B1)) >> np.uint32(20)
            start = owner[: len(code)]
            keep = (start == owner[n - 1 : n - 1 + len(code)]) & (np.arange(len(code)) < b - a)
            lo = start[0] if len(start) else 0
            hi = start[-1] + 1 if len(start) else 0
            flat = (start[keep] - lo) * DIMENSIONS + code[keep]
            out[lo:hi] += np.bincount(flat, minlength=(hi - lo) * DIMENSIONS).reshape(hi - lo, DIMENSIONS)
    return out, lettered


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(found) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from seeds far apart; the same data give the same centroids."""
    seeds = [0]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin((x @ x[seeds].T).max(axis=1))))
    centre = x[seeds]
    for _ in range(12):
        near = np.argmax(x @ centre.T, axis=1)
        sums = np.stack([x[near == j].sum(axis=0) if (near == j).any() else centre[j] for j in range(len(centre))])
        centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centre


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def fit(docs: DataFrame, most: int = MOST_OF_LANGUAGE, centroids: int = CENTROIDS) -> Model:
    """Learn from text and lang of the rows whose crc32(doc_id) modulo 5 is not 0, ``most`` of every language."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    rows = rows.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    # The lowest hashes of each language, found without its texts: top rows per task, then overall. As
    # a stored table its size is known, so that where it is small the texts are not dealt out.
    nth = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = rows.select("lang", "doc_id").withColumn("n", nth).where(F.col("n") <= most).select("lang", "doc_id").distinct()
    taken = rows.join(common.stored(chosen, "chosen"), ["doc_id", "lang"]).select("doc_id", "lang", "text")

    def features(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.batches(stream, BATCH_BYTES):
            texts = common.strings(rows["text"])
            for a in range(0, len(texts), ROWS):
                found, lettered = counts(texts.slice(a, ROWS))
                part = rows.slice(a, ROWS)
                for k in np.flatnonzero(lettered).tolist():
                    at = np.flatnonzero(found[k])
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([part["doc_id"][k].as_py()], pa.int64()),
                        "lang": pa.array([part["lang"][k].as_py()], pa.string()),
                        "at": pa.array([at.astype("<u2").tobytes()], pa.binary()),
                        "n": pa.array([found[k][at].astype("<f4").tobytes()], pa.binary()),
                    })

    found = common.stored(common.mapped(taken, features, "doc_id long, lang string, at binary, n binary"), "features")

    def spread(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(DIMENSIONS, np.int64)
        for rows in stream:
            n += rows.num_rows
            for at in rows["at"]:
                df[np.frombuffer(at.as_py(), "<u2")] += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "df": pa.array([df.tobytes()], pa.binary())})

    sums = common.mapped(found.select("at"), spread, "n long, df binary").collect()
    n = sum(r["n"] for r in sums)
    df = sum((np.frombuffer(r["df"], np.int64) for r in sums), np.zeros(DIMENSIONS, np.int64))
    if not n:
        return Model([], np.empty(0, int), np.empty((0, DIMENSIONS), np.float32), np.empty(0), np.ones(DIMENSIONS))
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 1

    def solve(group: pa.Table) -> pa.Table:
        group = group.take(pa.array(np.argsort(np.asarray(group["doc_id"], np.int64), kind="stable")))
        x = np.zeros((len(group), DIMENSIONS), np.float32)
        for k, (at, of) in enumerate(zip(group["at"].to_pylist(), group["n"].to_pylist())):
            x[k, np.frombuffer(at, "<u2")] = np.frombuffer(of, "<f4")
        x = vectors(x, idf)
        c = _clusters(x, centroids)
        # One floor for a language: a centroid of near copies must not turn away everything else.
        floor = RADIUS * float(np.quantile((x @ c.T).max(axis=1), 0.01))
        return pa.table({"lang": pa.array([group["lang"][0].as_py()], pa.string()), "centroids": pa.array([c.astype("<f4").tobytes()], pa.binary()), "floor": [floor]})

    got = found.groupBy("lang").applyInArrow(common.lean(solve), "lang string, centroids binary, floor double").collect()
    got.sort(key=lambda r: r["lang"])
    centres = [np.frombuffer(r["centroids"], "<f4").reshape(-1, DIMENSIONS) for r in got]
    each = [len(c) for c in centres]
    return Model([r["lang"] for r in got], np.repeat(np.arange(len(got)), each), np.concatenate(centres), np.repeat([r["floor"] for r in got], each), idf)


def predicted(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """_row (the columns ``keep`` of ``docs``, all by default), lang_pred, score and rejected.

    rejected: the text is too far from every centroid or has no letter.
    """

    def predict(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in common.batches(stream, BATCH_BYTES):
            texts = common.strings(rows["_text"])
            known, best, low = [], [], []
            for a in range(0, len(texts), ROWS):
                found, lettered = counts(texts.slice(a, ROWS))
                if not model.languages:
                    lettered[:] = False
                near = vectors(found, model.idf) @ model.centroids.T if model.languages else np.zeros((len(found), 1))
                top = np.argmax(near, axis=1)
                score = np.clip(near[np.arange(len(near)), top], 0, 1)
                known += [model.languages[model.owner[t]] if ok else UNKNOWN for t, ok in zip(top, lettered)]
                best.append(np.where(lettered, score, 0.0))
                low.append(~lettered | (score < (model.floor[top] if model.languages else 1)))
            out = rows.drop_columns(["_text"])
            out = out.append_column("lang_pred", pa.array(known, pa.string()))
            out = out.append_column("score", pa.array(np.concatenate(best), pa.float64()))
            out = out.append_column("rejected", pa.array(np.concatenate(low), pa.bool_()))
            yield from out.to_batches()

    # The input's columns travel as one struct, so no name of theirs can clash.
    own = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)])
    packed = docs.select(own.alias("_row"), F.col("text").cast("string").alias("_text"))
    schema = T.StructType([
        packed.schema["_row"],
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ])
    return common.mapped(packed, predict, schema)


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is known, with their own columns.

    A text with a letter also stays if it is labelled with a language of which no text could be learned from.
    """
    model = fit(docs)
    own = F.col("_row.lang").cast("string")
    new = own.isNotNull() & ~own.isin(model.languages) & F.col("_row.text").cast("string").rlike(r"\p{L}")
    return predicted(docs, model).where(~F.col("rejected") | new).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang"))
    docs = docs.withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    found = predicted(docs, model, ["doc_id", "held_out"])
    return found.select("_row.doc_id", "_row.held_out", "lang_pred", "score", "rejected")
