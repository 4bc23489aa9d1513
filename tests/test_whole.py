"""Queries cover all rows: compared with plain Python on tables where a cut would show."""

import json

from duck import SF

from tidelog.operators import rules
from tidelog.plans import queries

LARGER = "/root/testdata/sf0.01"


def averages(rows):
    out = {}
    for _, key, x in sorted(rows):
        a = out.get(key, 0)
        out[key] = x if a == 0 else (a * 7 + x) // 8
    return out


def test_every_batch_is_rendered(spark):
    shards = {}
    for r in queries.records(spark, SF).select("shard", "sequence", "payload").collect():
        shards.setdefault(r["shard"], {})[r["sequence"]] = r["payload"]
    want = {}
    for shard, rows in shards.items():
        for first in range(0, len(rows), 20):
            end = min(first + 20, len(rows))
            items = [{"sequence": n, "message": rows[n]} for n in range(first, end)]
            want[shard, first // 20] = {"agent_id": "agent-1", "shard": shard, "first_sequence": first, "next_sequence": end, "records": items}
    assert max(n for _, n in want) > 3
    got = lambda f: {(r["shard"], r["batch_no"]): json.loads(r["body"]) for r in f(spark, SF).collect()}
    assert got(queries.sink_batch_json) == want
    assert {k: v["value"] for k, v in got(queries.kafka_envelope).items()} == want
    assert {k: v["body"] for k, v in got(queries.object_manifest).items()} == want


def test_every_segment_is_ranked(spark):
    rows = queries.seg.without_twins(queries.seg.described(queries._files(spark, SF), "shard")).collect()
    rows.sort(key=lambda r: (r["shard_id"], not r["archived"], r["timestamp_ms"], r["rotation_index"], r["path"]))
    assert len(rows) > 60
    got = {r["rank"]: r["path"] for r in queries.segment_sort(spark, SF).collect()}
    assert got == {n + 1: r["path"] for n, r in enumerate(rows)}


def test_ewma_folds_every_event(spark):
    rows = [(r["event_id"], r["event_type"], int(r["value"] * 100 // 1)) for r in queries.table(spark, LARGER, "events").collect()]
    want = averages(rows)
    assert want != averages([r for r in rows if r[0] < 2000])
    assert {r["event_type"]: r["average"] for r in queries.ewma_latency(spark, LARGER).collect()} == want


def test_ewma_carries_over_chunks(spark):
    rows = [(i * 37 % 500, "abc"[i % 3], i * 7919 % 1000 * (i % 11 > 0)) for i in range(500)]
    frame = spark.createDataFrame(rows, "n long, kind string, x long")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["kind"]: r["average"] for r in rules.ewma(frame, "kind", "n", "x").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert got == averages(rows)
    assert rules.ewma(frame.limit(0), "kind", "n", "x").count() == 0
