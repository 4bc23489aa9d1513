"""Health, backpressure and alert rules: sliding windows over counters and ordered conditions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Minutes of a recent window; thresholds of the health rules in their order.
RECENT_MINUTES = 5
UNHEALTHY = (
    ("checkpoint_failures", 0),
    ("gzip_archive_failures", 0),
    ("recovery_fallbacks", 3),
    ("gzip_read_errors", 3),
    ("corrupted_segments", 10),
    ("corrupted_lines", 10),
)
# Pressures in order of priority.
PRESSURES = ("disk_quota", "pending_bytes", "sink_backlog", "sink_failures", "sink_latency", "sink_latency_average")
DEGRADED = ("recovery_fallbacks", "gzip_read_errors", "corrupted_segments", "corrupted_lines")


def recent_sums(counts: DataFrame, key: str, minute: str, value: str) -> DataFrame:
    """key, minute, n, recent, lifetime: sums per minute, of the last five minutes, and so far.

    Rows are one per key and minute after partial aggregation, so the window sorts few of them.
    """
    per_minute = counts.groupBy(key, minute).agg(F.sum(value).alias("n"))
    by_time = W.partitionBy(key).orderBy(minute)
    return per_minute.withColumns({
        "recent": F.sum("n").over(by_time.rangeBetween(-(RECENT_MINUTES - 1), 0)),
        "lifetime": F.sum("n").over(by_time.rowsBetween(W.unboundedPreceding, 0)),
    })


def health_status() -> Column:
    """unhealthy, degraded or ok from the recent counters."""
    bad, worse = F.lit(False), F.lit(False)
    for name, most in UNHEALTHY:
        bad = bad | (F.col(name) > most)
    for name in DEGRADED:
        worse = worse | (F.col(name) > 0)
    return F.when(bad, "unhealthy").when(worse, "degraded").otherwise("ok")


def health_reason() -> Column:
    """The first counter over its unhealthy threshold, else the first above zero, else none."""
    out = F.lit("none")
    for name in reversed(DEGRADED):
        out = F.when(F.col(name) > 0, name).otherwise(out)
    for name, most in reversed(UNHEALTHY):
        out = F.when(F.col(name) > most, name).otherwise(out)
    return out


def health_basis() -> Column:
    """What the health reason rests on: the recent window, or none."""
    return F.when(health_reason() == "none", "none").otherwise("recent_window")


def backpressure(limits: dict[str, int]) -> Column:
    """The first pressure at or over its limit, in order of priority; none if all are below. A limit of 0 is off."""
    out = F.lit("none")
    for name in reversed(PRESSURES):
        most = limits.get(name, 0)
        if most:
            out = F.when(F.col(name) >= most, name).otherwise(out)
    return out


def ewma(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, average of a key's whole numbers in order: (7 old + new) div 8, beginning with the first, and anew after 0.

    Each step rounds, so a key's rows are folded one after another; its task reads them in order as
    chunks of Arrow's batch size and carries the average from chunk to chunk. A null makes it null.
    """
    kind = rows.schema[key].dataType

    def fold(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The schema is told by the first chunk; a task without rows gives none.
        at, average, begun, of = None, None, False, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], of), pa.array([average], pa.int64())], ["key", "average"])

        for chunk in stream:
            of = chunk.schema.field(0).type
            for k, x in zip(chunk.column(0).to_pylist(), chunk.column(1).to_pylist()):
                if not begun or k != at:
                    if begun:
                        yield out()
                    at, average, begun = k, 0, True
                if average is not None:
                    average = x if average == 0 else None if x is None else (average * 7 + x) // 8
        if begun:
            yield out()

    ordered = rows.repartition(key).sortWithinPartitions(key, order, value).select(F.col(key).alias("key"), F.col(value).cast("long").alias("x"))
    schema = T.StructType([T.StructField("key", kind), T.StructField("average", T.LongType())])
    return ordered.mapInArrow(fold, schema).withColumnRenamed("key", key)


def nearest_rank(values: Column, ratio: float) -> Column:
    """The element of the sorted array at floor(ratio * (n - 1))."""
    return F.get(F.array_sort(values), F.floor(F.lit(ratio) * (F.size(values) - 1)).cast("int"))


def rank_percentiles(rows: DataFrame, keys: list[str], value: str, ratios: dict[str, float]) -> DataFrame:
    """keys and one column for each ratio: the value at rank floor(ratio * (n - 1)) of the key's values.

    Values are counted before they are ranked, so a key's window holds its distinct values only.
    """
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    ranked = counted.withColumns({"_upto": upto, "_n": F.sum("_c").over(W.partitionBy(*keys))})
    at = lambda r: F.floor(F.lit(r) * (F.col("_n") - 1))
    return ranked.groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") > at(r), F.col(value))).alias(name) for name, r in ratios.items()])


def rates(samples: DataFrame, key: str, seconds: str, value: str) -> DataFrame:
    """key, seconds, value, rate: increase per second since the sample before; a fall is a restart from 0."""
    by_time = W.partitionBy(key).orderBy(seconds)
    last, then = F.lag(value).over(by_time), F.lag(seconds).over(by_time)
    grown = F.when(F.col(value) >= last, F.col(value) - last).otherwise(F.col(value))
    return samples.withColumn("rate", grown / (F.col(seconds) - then))


def held_for(samples: DataFrame, key: str, seconds: str, condition: Column, span: int) -> Column:
    """Whether a condition held at every sample of the last ``span`` seconds, this one included."""
    window = W.partitionBy(key).orderBy(seconds).rangeBetween(-span, 0)
    return F.min(condition.cast("int")).over(window) == 1


def reason_durations(states: DataFrame, key: str, ts: str, reason: str) -> DataFrame:
    """key, reason, seconds: how long each reason was in force, from a state's sample to the next change."""
    by_time = W.partitionBy(key).orderBy(ts)
    changed = states.withColumn("_was", F.lag(reason).over(by_time)).where(f"_was is null or _was <> {reason}")
    upto = F.lead(ts).over(by_time)
    spans = changed.withColumn("_s", upto - F.col(ts)).where("_s is not null")
    return spans.groupBy(key, reason).agg(F.sum("_s").alias("seconds"))


# Alert rules over recent counters (name, counter, threshold, severity).
ALERTS = (
    ("checkpoint_write_failing", "checkpoint_failures", 0, "critical"),
    ("archive_compression_failing", "gzip_archive_failures", 0, "warning"),
    ("recovery_fallback_seen", "recovery_fallbacks", 0, "warning"),
    ("compressed_read_failing", "gzip_read_errors", 0, "warning"),
    ("corrupted_segments_seen", "corrupted_segments", 0, "warning"),
    ("many_problems", None, 10, "critical"),
)


def alerts(counters: DataFrame, key: str) -> DataFrame:
    """key, alert, severity of every rule that fires; the rule without a counter looks at all of them."""
    every = [name for name, _ in UNHEALTHY]
    fires = lambda name, most: F.col(name) > most if name else F.greatest(*every) > most
    found = F.array(*[F.when(fires(name, most), F.struct(F.lit(alert).alias("alert"), F.lit(severity).alias("severity"))) for alert, name, most, severity in ALERTS])
    return counters.select(key, F.explode(F.filter(found, lambda a: a.isNotNull())).alias("a")).select(key, "a.alert", "a.severity")


def quota_exceeded(used: Column, quota: Column) -> Column:
    """Whether a directory's bytes reach its quota; a quota of 0 is off."""
    return (quota > 0) & (used >= quota)


def can_resume(used: Column, quota: Column, resume: Column) -> Column:
    """Whether writing may go on after a pause: no quota, or use at or below ``resume`` (the quota if 0)."""
    return (quota == 0) | (used <= F.when(resume == 0, quota).otherwise(resume))


def over_watermark(pending: Column, high: Column, low: Column, waiting: Column) -> Column:
    """Whether a writer must wait: over the high mark, or already waiting and over the low one (half the high if 0)."""
    floor = F.when(low == 0, F.floor(high / 2)).otherwise(low)
    return (high > 0) & F.when(waiting, pending > floor).otherwise(pending > high)
