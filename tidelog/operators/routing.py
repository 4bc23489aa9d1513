"""Routing of records to shards: hash modulo, consistent hashing on a ring, and policies for empty keys."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.hashing import FNV_BASIS, fnv1a64, unsigned, unsigned_mod

_PRIME = 2**40 + 435


def fnv_bytes(data: bytes) -> int:
    h = FNV_BASIS
    for b in data:
        h = (h ^ b) * _PRIME % 2**64
    return h


def ring(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """Sorted (token, shard) of every virtual node; a token hashes shard and node, each ended by byte 255."""
    return sorted((fnv_bytes(b"%d\xff%d\xff" % (s, v)), s) for s in range(shards) for v in range(virtual_nodes))


def hashed_keys(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with hash, the BIGINT bits of the key's FNV-1a 64; each distinct key is hashed once.

    The join back is left to Spark, which broadcasts the keys only where they are few.
    """
    distinct = rows.select(key).distinct().withColumn("_row", F.monotonically_increasing_id())
    # Filters that Spark derives from joins on the hash name this column, so they stay above; pushed below, they would hash every row's key.
    distinct = distinct.select(key, F.when(F.col("_row") >= 0, fnv1a64(F.col(key))).alias("hash"))
    return rows.join(distinct, key)


def modulo_shard(hash_bits: Column, shards: int) -> Column:
    return unsigned_mod(hash_bits, shards).cast("int")


def ring_point(hash_bits: Column, points: list[tuple[int, int]]) -> Column:
    """struct(token, shard) of the first ring point at or after the hash, the first of all beyond the last.

    An as-of join without a join: the ring has shards x nodes points, far fewer than rows, and is
    searched by halves. Bits are compared as unsigned by flipping the sign.
    """
    flipped = hash_bits.bitwiseXOR(F.lit(-(2**63)))
    tokens = F.array(*[F.lit(t - 2**63) for t, _ in points])
    owners = F.array(*[F.lit(s) for _, s in points])
    n = len(points)
    halves = F.aggregate(
        F.sequence(F.lit(1), F.lit(max(1, n.bit_length()))),
        F.struct(F.lit(0).alias("low"), F.lit(n).alias("high")),
        lambda a, _: F.when(
            a["low"] < a["high"],
            F.when(
                F.get(tokens, F.floor((a["low"] + a["high"]) / 2).cast("int")) < flipped,
                F.struct((F.floor((a["low"] + a["high"]) / 2) + 1).cast("int").alias("low"), a["high"].alias("high")),
            ).otherwise(F.struct(a["low"].alias("low"), F.floor((a["low"] + a["high"]) / 2).cast("int").alias("high"))),
        ).otherwise(a),
    )
    place = F.pmod(halves["low"], F.lit(n))
    return F.struct(F.get(tokens, place).bitwiseXOR(F.lit(-(2**63))).alias("token"), F.get(owners, place).alias("shard"))


def route(key: str, shards: int, points: list[tuple[int, int]] | None = None, local_shard: int = 0, index: int | None = None) -> dict:
    """One key's decision: shard, hash, token, used_local_fallback. index: of the round-robin policy for empty keys."""
    if not shards:
        return {"shard": 0, "hash": 0, "token": 0, "used_local_fallback": True}
    if not key:
        shard = local_shard % shards if index is None else index % shards
        return {"shard": shard, "hash": 0, "token": 0, "used_local_fallback": index is None}
    h = fnv_bytes(key.encode())
    if points is None:
        return {"shard": h % shards, "hash": h, "token": h, "used_local_fallback": False}
    token, shard = points[bisect_left(points, (h, -1)) % len(points)]
    return {"shard": shard, "hash": h, "token": token, "used_local_fallback": False}


def routed(rows: DataFrame, key: str, shards: int, points: list[tuple[int, int]] | None = None, local_shard: int = 0, index: str | None = None) -> DataFrame:
    """``rows`` with shard, hash and token (DECIMAL(20,0)) and used_local_fallback.

    points: a ring for consistent hashing, modulo if none. index: a column whose value modulo the
    shards places empty keys in turn; without it they stay on ``local_shard``.
    """
    zero = F.lit(0).cast("decimal(20,0)")
    if not shards:
        return rows.withColumns({"shard": F.lit(0), "hash": zero, "token": zero, "used_local_fallback": F.lit(True)})
    empty = F.coalesce(F.col(key), F.lit("")) == ""
    out = hashed_keys(rows.withColumn(key, F.coalesce(F.col(key), F.lit(""))), key).withColumnRenamed("hash", "_bits")
    if points is None:
        shard, token = modulo_shard(F.col("_bits"), shards), F.col("_bits")
    else:
        out = out.withColumn("_point", ring_point(F.col("_bits"), points))
        shard, token = F.col("_point.shard"), F.col("_point.token")
    spare = F.lit(local_shard % shards) if index is None else F.pmod(F.col(index), F.lit(shards)).cast("int")
    return out.withColumns({
        "shard": F.when(empty, spare).otherwise(shard).cast("int"),
        "hash": F.when(empty, zero).otherwise(unsigned(F.col("_bits"))),
        "token": F.when(empty, zero).otherwise(unsigned(token)),
        "used_local_fallback": empty & F.lit(index is None),
    }).drop("_bits", "_point")
