"""Reports over measured runs: rates, profiles by group, soak runs, scaling, and peaks of queues and scanners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.running import STEP, totals_before


def throughput(messages: Column, elapsed: Column, per_second: int = 1_000_000) -> Column:
    """Messages a second; 0 where no time went by."""
    return F.when(elapsed == 0, 0.0).otherwise(messages * float(per_second) / elapsed)


def profile(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of each group and the means of their throughput, submit_us, p95_us and p99_us, as exactly as they are printed."""
    return runs.groupBy(*keys).agg(
        F.count("*").alias("runs"), F.round(F.avg("throughput"), 2).alias("throughput"), F.round(F.avg("submit_us"), 4).alias("submit_us"),
        F.round(F.avg("p95_us"), 4).alias("p95_us"), F.round(F.avg("p99_us"), 4).alias("p99_us"),
    )


def soak(runs: DataFrame) -> DataFrame:
    """One row over all runs: means, the least and most throughput, the worst p99; zeros without a run."""
    found = runs.agg(
        F.count("*").alias("runs"), F.round(F.avg("throughput"), 2).alias("throughput"), F.round(F.min("throughput"), 2).alias("least_throughput"),
        F.round(F.max("throughput"), 2).alias("most_throughput"), F.round(F.avg("submit_us"), 4).alias("submit_us"), F.round(F.avg("p95_us"), 4).alias("p95_us"),
        F.round(F.avg("p99_us"), 4).alias("p99_us"), F.round(F.max("p99_us"), 4).alias("worst_p99_us"),
    )
    return found.fillna(0.0)


def efficiency(runs: DataFrame) -> DataFrame:
    """scenario, shards, efficiency: mean throughput of so many shards over that of one shard times their number."""
    by = runs.groupBy("scenario", "shards").agg(F.avg("throughput").alias("t"))
    one = by.where("shards = 1").select("scenario", F.col("t").alias("t1"))
    return by.join(one, "scenario").select("scenario", "shards", F.round(F.col("t") / (F.col("shards") * F.col("t1")), 9).alias("efficiency"))


def scanner(snapshots: DataFrame) -> DataFrame:
    """Of each run: when it had committed and sent its messages, its rate, and the peaks of backlog, queue and workers until then.

    snapshots: run, messages, started_ms, at_ms, committed, sent, backlog, queue_batches, active_workers. A run that
    never gets there is a timeout, measured at its last snapshot.
    """
    there = (F.col("committed") >= F.col("messages")) & (F.col("sent") >= F.col("messages"))
    ends = snapshots.groupBy("run").agg(F.min(F.when(there, F.col("at_ms"))).alias("_done"), F.max("at_ms").alias("_last"))
    until = snapshots.join(ends, "run").where(F.col("at_ms") <= F.coalesce("_done", "_last"))
    peak = lambda c: F.greatest(F.max(c), F.lit(0)).cast("long")
    out = until.groupBy("run").agg(
        F.max("messages").alias("messages"), (F.max(F.coalesce("_done", "_last")) - F.min("started_ms")).alias("elapsed_ms"),
        peak("backlog").alias("peak_backlog"), peak("queue_batches").alias("peak_queue_batches"), peak("active_workers").alias("peak_active_workers"),
        F.when(F.max("_done").isNull(), "timeout").otherwise("completed").alias("status"),
    )
    return out.withColumn("throughput", F.round(throughput(F.col("messages"), F.col("elapsed_ms"), 1000), 2)).drop("messages")


def queue_peaks(changes: DataFrame, queue: str, order: str, change: str, step: int = STEP) -> DataFrame:
    """queue, most: the greatest depth of each queue after any of its changes (1 put in, -1 taken out), 0 at least."""
    rows = totals_before(changes, queue, order, "_before", F.col(change), step)
    return rows.groupBy(queue).agg(F.greatest(F.max(F.col("_before") + F.col(change)), F.lit(0)).cast("long").alias("most"))
