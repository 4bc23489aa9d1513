"""Running totals by key, worked out in ranges of the order, so that no key is sorted by one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Width of the order column's ranges that one task sorts.
STEP = 1 << 16


def carried(rows: DataFrame, bases: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``bases`` of the same keys, null keys too."""
    own = bases.withColumnsRenamed({k: f"_base_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_base_{k}")) for k in keys])
    return rows.join(own, same).drop(*[f"_base_{k}" for k in keys])


def totals_before(rows: DataFrame, key: str, order: str, name: str, value: Column, step: int = STEP) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the key's rows before this one in order of a whole-number column.

    A null counts as 0; rows without a key are one key, rows without an order come first. A range holds at most
    ``step`` rows unless the order repeats.
    """
    ranged = rows.withColumns({"_range": F.floor(F.col(order) / step), "_value": F.coalesce(value, F.lit(0)).cast("long")})
    before = W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy(key, "_range").agg(F.sum("_value").alias("_sum"))
    bases = sums.select(key, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    local = F.sum("_value").over(W.partitionBy(key, "_range").orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    out = carried(ranged.withColumn("_local", F.coalesce(local, F.lit(0))), bases, [key, "_range"])
    return out.withColumn(name, F.col("_base") + F.col("_local")).drop("_range", "_value", "_local", "_base")
