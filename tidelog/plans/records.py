"""The records query: which segments, which records, in which order, how many."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources import segments as seg


@dataclass(frozen=True)
class ReadQuery:
    """All conditions hold together; None leaves one out. Times are compared as text; limit 0 gives no rows."""

    shard: int | None = None
    seq_from: int | None = None
    seq_to: int | None = None
    time_from: str | None = None
    time_to: str | None = None
    source_id: str | None = None
    agent_id: str | None = None
    include_archive: bool = True
    limit: int | None = 100

    @classmethod
    def from_params(cls, given: dict[str, str], zero_means_default: bool = False) -> ReadQuery:
        """From text parameters: a bad number is an error, but a bad limit is the default of 100."""
        number = lambda k: None if given.get(k) in (None, "") else _whole(k, given[k])
        try:
            limit = _whole("limit", given["limit"]) if given.get("limit") else 100
        except ValueError:
            limit = 100
        if zero_means_default and limit == 0:
            limit = 100
        return cls(
            shard=number("shard"), seq_from=number("seq_from"), seq_to=number("seq_to"),
            time_from=given.get("time_from"), time_to=given.get("time_to"),
            source_id=given.get("source_id"), agent_id=given.get("agent_id"),
            include_archive=given.get("include_archive", "true").lower() in ("1", "true", "yes", "on"),
            limit=limit,
        )


def _whole(name: str, text: str) -> int:
    if not text.isascii() or not text.isdigit():
        raise ValueError(f"{name} must be a whole number")
    return int(text)


def condition(q: ReadQuery) -> Column:
    """The query's conditions on records."""
    tests = []
    if q.seq_from is not None:
        tests.append(F.col("has_sequence") & (F.col("sequence") >= q.seq_from))
    if q.seq_to is not None:
        tests.append(F.col("has_sequence") & (F.col("sequence") <= q.seq_to))
    if q.time_from is not None:
        tests.append((F.col("timestamp") != "") & (F.col("timestamp") >= q.time_from))
    if q.time_to is not None:
        tests.append((F.col("timestamp") != "") & (F.col("timestamp") <= q.time_to))
    if q.source_id is not None:
        tests.append(F.col("source_id") == q.source_id)
    if q.agent_id is not None:
        tests.append(F.col("agent_id") == q.agent_id)
    return reduce(Column.__and__, tests, F.lit(True))


def matching(rows: DataFrame, q: ReadQuery) -> DataFrame:
    """Records that meet the query's conditions on records."""
    return rows.where(condition(q))


def read_records(spark: SparkSession, log_dir: str, archive_dir: str | None, prefix: str, q: ReadQuery) -> DataFrame:
    """Records of the segments in file order. Shards and archives that the query excludes are never listed or opened."""
    found = seg.segments(spark, log_dir, archive_dir if q.include_archive else None, prefix, q.shard)
    rows = seg.records(spark, found, condition(q)).orderBy(*seg.segment_order(), "line_no")
    return rows if q.limit is None else rows.limit(q.limit)
