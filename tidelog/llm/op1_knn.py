"""Exact top-k search by a Voronoi join: queries and data grouped by pivots, data replicated by bounds.

Vectors are floor(1024 x) and the score is their integer inner product. Pivots are means of a bounded
sample. Every data vector belongs to the cell of its nearest pivot; a cell's summary holds its number
of vectors, its radius and the vectors nearest to its pivot. A query group is the queries nearest to
one pivot P; its summary holds the radius r of its queries about P. As P.x - r|x| <= q.x <= P.x + r|x|,
the cells' summaries give a lower bound t of the k-th score of every query of a group, raised by the
k-th scores of its queries over the sample, whose vectors are data too. A cell whose radius keeps all
its P.x + r|x| under t is left out of the group as a whole, any other vector by vector; the rest is
replicated to it. Groups are solved locally, their queries in blocks and their data in shards, so no
task holds a whole group; the shards' k best merge.

Vectors that are null, or hold a null or non-finite component, take no part, nor do null ids. Shorter
vectors count as ending in zeros. Equal scores go to the smaller vec_id; rows of the query's own
vec_id are never its candidates; repeated rows are candidates each, but one query: a vec_id with
several vectors asks once for each of them. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm import common

#: Vectors at most that pivots and lower bounds come from: the lowest hashes of vec_id.
SAMPLE = 2048
MOST_PIVOTS = 64
QUERIES_PER_PIVOT = 64
#: Queries and data vectors that meet in one task at most, and queries scored at once.
QUERY_BLOCK = 8192
SHARD = 32768
TILE = 64
BATCH_BYTES = 4 << 20

_RESULT = "query_id long, rank int, vec_id long, score long"


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column as one array, zeros beyond a row's end."""
    ends = common.bounds(lists)
    flat = np.asarray(lists.flatten(), np.int64)
    if len(lists) and (np.diff(ends) == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lists), width), np.int64)
    n = np.diff(ends)
    row = np.repeat(np.arange(len(lists)), n)
    out[row, np.arange(len(flat)) - np.repeat(ends[:-1], n)] = flat
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows; in doubles where these hold every sum exactly."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def best(found: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k highest scores among ids other than ``own``, ties to the smaller id."""
    place = np.flatnonzero(ids != own)
    if len(place) > k:
        least = np.partition(found[place], len(place) - k)[len(place) - k]
        place = place[found[place] >= least]
    return place[np.lexsort((ids[place], -found[place]))][:k]


def _pivots(x: np.ndarray, k: int) -> np.ndarray:
    centre = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].astype(float)
    for _ in range(8):
        near = nearest(x, centre)
        centre = np.stack([x[near == j].mean(axis=0) if (near == j).any() else centre[j] for j in range(len(centre))])
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.argmin((centre**2).sum(axis=1) - 2 * (x @ centre.T), axis=1)


def knn(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows of ``vectors`` (vec_id, embedding) for every query.

    is_query: a boolean column over vec_id.
    """
    spark = vectors.sparkSession
    x = F.col("embedding")
    finite = lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf"))
    rows = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, finite)).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(x, lambda v: F.floor(v.cast("double") * 1024).cast("long")).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("q"),
    )
    facts = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width"), F.count_if("q").alias("queries")).first()
    if not facts["queries"]:
        return spark.createDataFrame([], _RESULT)
    width, shards = max(1, facts["width"]), common.parts(facts["n"], SHARD)
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    sample_ids = np.array([r["vec_id"] for r in some], np.int64)
    sample = _matrix(pa.array([r["v"] for r in some], pa.list_(pa.int64())), width)
    pivots = _pivots(sample, min(MOST_PIVOTS, common.parts(facts["queries"], QUERIES_PER_PIVOT)))

    def group(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.batches(stream, BATCH_BYTES):
            ids, v = np.asarray(t["vec_id"]), _matrix(t["v"].combine_chunks(), width)
            g = nearest(v, pivots)
            found = scores(v, sample)
            floor = [s[p[-1]] if len(p := best(s, sample_ids, i, k)) == k else -np.inf for s, i in zip(found, ids.tolist())]
            away = np.linalg.norm(v - pivots[g], axis=1)
            yield pa.RecordBatch.from_arrays(
                [t["vec_id"].combine_chunks(), t["v"].combine_chunks(), pa.array(g, pa.int32()), pa.array(away), pa.array(floor, pa.float64())],
                ["vec_id", "v", "g", "away", "floor"],
            )

    def cells(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a task's vectors: cell, number, radius, and each of the vectors nearest to the pivot, the cell's first row carrying the numbers."""
        count, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
        near: list[list[tuple[float, int, list[int]]]] = [[] for _ in pivots]
        for t in common.batches(stream, BATCH_BYTES):
            ids, v = np.asarray(t["vec_id"]), _matrix(t["v"].combine_chunks(), width)
            c = nearest(v, pivots)
            away = np.linalg.norm(v - pivots[c], axis=1)
            count += np.bincount(c, minlength=len(pivots))
            np.maximum.at(radius, c, away)
            for j in np.unique(c).tolist():
                mine = np.flatnonzero(c == j)
                mine = mine[np.argsort(away[mine], kind="stable")[: k + 1]]
                near[j] = sorted(near[j] + [(float(away[i]), int(ids[i]), v[i].tolist()) for i in mine])[: k + 1]
        for j, some in enumerate(near):
            if some:
                n = len(some)
                yield pa.RecordBatch.from_arrays([
                    pa.array([j] * n, pa.int32()), pa.array([int(count[j])] + [0] * (n - 1), pa.int64()), pa.array([float(radius[j])] * n), pa.array([x[0] for x in some]),
                    pa.array([x[1] for x in some], pa.int64()), pa.array([x[2] for x in some], pa.list_(pa.int64())),
                ], ["c", "n", "r", "away", "vec_id", "v"])

    asked = rows.where("q").drop("q").dropDuplicates(["vec_id", "v"])
    queries = common.stored(common.mapped(asked, group, "vec_id long, v array<long>, g int, away double, floor double"), "queries")
    blocks = lambda n: F.ceil(n / QUERY_BLOCK)
    # Summaries: one row for each of at most MOST_PIVOTS groups, and k + 1 for each of as many cells.
    summary = queries.groupBy("g").agg(F.max("away").alias("r"), F.min("floor").alias("t"), blocks(F.count("*")).alias("blocks")).orderBy("g").collect()
    partial = common.stored(common.mapped(rows.drop("q"), cells, "c int, n long, r double, away double, vec_id long, v array<long>"), "cells")
    cell = {r["c"]: r["r"] for r in partial.groupBy("c").agg(F.max("r").alias("r"), F.sum("n").alias("n")).collect()}
    nth = F.row_number().over(W.partitionBy("c").orderBy("away", "vec_id"))
    known = partial.withColumn("nth", nth).where(F.col("nth") <= k + 1).select("vec_id", "v").collect()
    near = _matrix(pa.array([r["v"] for r in known], pa.list_(pa.int64())), width)
    centre = pivots[[s["g"] for s in summary]]
    radius = np.array([s["r"] for s in summary])
    # The k + 1 best lower bounds, as one of the vectors may be the query's own. Repeated rows of its id might be more, so each id counts once.
    ids = np.array([r["vec_id"] for r in known], np.int64)
    first = np.unique(ids, return_index=True)[1]
    low = np.sort(near[first] @ centre.T - np.linalg.norm(near[first], axis=1)[:, None] * radius, axis=0)
    least = np.array([s["t"] for s in summary], float)
    if len(first) > k:
        least = np.maximum(least, low[-(k + 1)] - 1e-6 * (1 + np.abs(low[-(k + 1)])))
    block_count = np.array([s["blocks"] for s in summary], np.int64)
    names = np.array([s["g"] for s in summary], np.int32)
    # Cells that no vector of can be among the best of any query of the group.
    far = np.array([cell.get(j, 0.0) for j in range(len(pivots))])
    most = pivots @ centre.T + far[:, None] * np.linalg.norm(centre, axis=1) + (np.linalg.norm(pivots, axis=1) + far)[:, None] * radius
    open_cell = most * (1 + 1e-9 * np.sign(most)) + 1e-6 >= least

    def replicate(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.batches(stream, BATCH_BYTES):
            v = _matrix(t["v"].combine_chunks(), width)
            c = nearest(v, pivots)
            bound = v @ centre.T + np.linalg.norm(v, axis=1)[:, None] * radius
            # A hair of slack covers the rounding of the bound, which is in doubles.
            needed = open_cell[c] & (bound * (1 + 1e-9 * np.sign(bound)) + 1e-6 >= least)
            for j in range(len(names)):
                need = np.flatnonzero(needed[:, j])
                part = t.select(["vec_id", "v"]).take(pa.array(need)).combine_chunks()
                for b in range(block_count[j]):
                    n = len(need)
                    yield from part.append_column("g", pa.array(np.full(n, names[j]))).append_column("b", pa.array(np.full(n, b, np.int32))).to_batches()

    data = common.mapped(rows, replicate, "vec_id long, v array<long>, g int, b int")
    data = data.withColumn("s", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    per_group = F.create_map(*[F.lit(int(z)) for s in summary for z in (s["g"], s["blocks"])])
    asked = queries.withColumn("b", F.pmod(F.xxhash64("vec_id"), per_group[F.col("g")]).cast("int"))
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), F.xxhash64("v").alias("qh"), "g", "b", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = pa.schema([("query_id", pa.int64()), ("qh", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return kind.empty_table()
        q_ids, ids = np.asarray(left["query_id"]), np.asarray(right["vec_id"])
        asked, vectors = _matrix(left["qv"].combine_chunks(), width), _matrix(right["v"].combine_chunks(), width)
        which, chosen, found = [], [], []
        for a in range(0, len(q_ids), TILE):
            for i, s in enumerate(scores(asked[a : a + TILE], vectors), a):
                top = best(s, ids, int(q_ids[i]), k)
                which.append(np.full(len(top), i))
                chosen.append(ids[top])
                found.append(s[top])
        at = np.concatenate(which)
        return pa.table([q_ids[at], np.asarray(left["qh"])[at], np.concatenate(chosen), np.concatenate(found)], schema=kind)

    key = ["g", "b", "s"]
    partial = asked.groupBy(*key).cogroup(data.groupBy(*key)).applyInArrow(common.lean(solve), "query_id long, qh long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id", "qh").orderBy(F.desc("score"), "vec_id"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)),
q AS (SELECT * FROM v WHERE vec_id % 100 = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, v.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q JOIN v ON q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
