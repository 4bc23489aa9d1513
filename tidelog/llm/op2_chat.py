"""Chat formatting: logged snapshots that a longer conversation begins with are dropped, the rest rendered.

A log that is written after every turn holds each conversation once per turn. Rolling hashes of the
turn prefixes find them: conversation A is a snapshot of B if A's hash of all turns is B's hash of
its first turns. Equal conversations leave the one of lowest conv_id. Two running sums of 64-bit
hashes, each salted by the position, stand for a prefix, so a prefix costs one row however long it is.

Turns are ordered by turn, ties by role, then text, nulls first; a null turn sorts first, null role
and text are empty, rows without conv_id are left out, repeated rows are turns of their own. An empty
table gives no rows. A conversation is rendered in parts of at most PART_TURNS turns, so a huge one
is never one row of one task; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm import common

PART_TURNS = 256


def _wrapped(total: Column) -> Column:
    """A sum of hashes modulo 2^63 - 25, small enough to be summed again."""
    return F.pmod(total, F.lit(2**63 - 25).cast("decimal(38,0)")).cast("long")


def positions(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), role, text and the turn's two hashes; a hot conversation is ranked in chunks of turns.

    Turns are dealt by conv_id and a chunk of the turn number, ranked within their chunk, and
    shifted by the sizes of the chunks before, so that no key holds a whole hot conversation.
    """
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id",
        F.coalesce(F.col("turn").cast("long"), F.lit(-(2**62))).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("chunk", F.floor(F.col("turn") / PART_TURNS))
    within = W.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text")
    rows = rows.withColumn("nth", F.row_number().over(within) - 1)
    sizes = rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"))
    before = W.partitionBy("conv_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("conv_id", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(sizes, ["conv_id", "chunk"]).select("conv_id", "chunk", (F.col("base") + F.col("nth")).alias("pos"), "role", "text")


def prefixes(placed: DataFrame) -> DataFrame:
    """conv_id, chunk, size, h1, h2: the hashes of every conversation's first ``size`` turns, for every size."""
    part = lambda salt: F.xxhash64(F.lit(salt), F.col("pos"), F.col("role"), F.col("text")).cast("decimal(20,0)")
    rows = placed.select("conv_id", "chunk", "pos", part(1).alias("a"), part(2).alias("b"))
    totals = rows.groupBy("conv_id", "chunk").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    before = W.partitionBy("conv_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,0)")
    totals = totals.select("conv_id", "chunk", *[F.coalesce(F.sum(c).over(before), zero).alias(c) for c in ("ta", "tb")])
    upto = W.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select("conv_id", "chunk", "pos", F.sum("a").over(upto).alias("a"), F.sum("b").over(upto).alias("b"))
    return rows.join(totals, ["conv_id", "chunk"]).select(
        "conv_id",
        (F.col("pos") + 1).alias("size"),
        _wrapped(F.col("a") + F.col("ta")).alias("h1"),
        _wrapped(F.col("b") + F.col("tb")).alias("h2"),
    )


def maximal(placed: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations that no longer one begins with, one of each equal set."""
    every = common.stored(prefixes(placed), "prefixes")
    sizes = every.groupBy("conv_id").agg(F.max("size").alias("n_turns"))
    marked = every.join(sizes, "conv_id")
    key = ["size", "h1", "h2"]
    whole = marked.where(F.col("size") == F.col("n_turns")).groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    inner = marked.where(F.col("size") < F.col("n_turns")).select(*key).distinct()
    return whole.join(inner, key, "left_anti").select("conv_id", F.col("size").alias("n_turns"))


def rendered(turns: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """conv_id, n_turns, part, chat_text: the maximal conversations of ``turns`` as chat text, part by part."""
    placed = positions(turns)
    kept = placed.join(maximal(placed), "conv_id")
    line = F.concat(F.lit(start), F.col("role"), F.lit("\n"), F.col("text"), F.lit(f"{end}\n"))
    kept = kept.withColumn("part", F.floor(F.col("pos") / PART_TURNS).cast("long"))
    parts = kept.groupBy("conv_id", "n_turns", "part").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
    return parts.select("conv_id", "n_turns", "part", F.concat_ws("", "lines.line").alias("chat_text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(common.table(spark, sf_dir, "conversations"))


ORACLE_SQL = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
         '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS line
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, max(pos) + 1 AS n_turns FROM turns GROUP BY conv_id),
prefixes AS (
  SELECT conv_id, pos + 1 AS size,
         string_agg(length(line) || ':' || line, '' ORDER BY pos) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS body
  FROM turns),
marked AS (SELECT p.*, s.n_turns FROM prefixes p JOIN sizes s USING (conv_id)),
whole AS (SELECT min(conv_id) AS conv_id, size AS n_turns, body FROM marked WHERE size = n_turns GROUP BY size, body),
kept AS (
  SELECT conv_id, n_turns FROM whole w
  WHERE NOT EXISTS (SELECT 1 FROM marked m WHERE m.size < m.n_turns AND m.size = w.n_turns AND m.body = w.body))
SELECT t.conv_id, k.n_turns, CAST(t.pos // 256 AS BIGINT) AS part, string_agg(t.line, '' ORDER BY t.pos) AS chat_text
FROM turns t JOIN kept k USING (conv_id) GROUP BY t.conv_id, k.n_turns, t.pos // 256
"""
