import json
import socket
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tidelog.agent import Agent
from tidelog.config import EngineConfig
from tidelog.log import Writer
from tidelog.operators import delivery, ingest, rules
from tidelog.plans.records import ReadQuery, read_records
from tidelog.streaming import pipelines, sources


def test_tail(tmp_path):
    f = tmp_path / "a.log"
    f.write_text("first\nsecond\npartial")
    lines, inode, at, _ = sources.tail_once(str(f), 0, 0, 100)
    assert [x for x, _ in lines] == ["first", "second"]
    with f.open("a") as o:
        o.write("-done\nthird\n")
    lines, inode, at, replaced = sources.tail_once(str(f), inode, at, 100)
    assert [x for x, _ in lines] == ["partial-done", "third"] and not replaced
    f.write_text("new\n")
    lines, _, _, replaced = sources.tail_once(str(f), inode, at, 100)
    assert [x for x, _ in lines] == ["new"] and replaced
    assert sources.expanded([str(tmp_path / "*.log"), str(f), "/none"]) == ["/none", str(f)]


def test_listener(tmp_path):
    udp = sources.Listener("udp", "127.0.0.1:0")
    s = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    s.sendto(b"datagram", ("127.0.0.1", int(udp.name.split(":")[1])))
    unix = sources.Listener("unix", str(tmp_path / "s"))
    time.sleep(0.2)
    u = socket.socket(socket.AF_UNIX, socket.SOCK_STREAM)
    u.connect(str(tmp_path / "s"))
    u.sendall(b"one\r\ntwo\n")
    u.close()
    for x, n in ((udp, 1), (unix, 2)):
        for _ in range(50):
            if x.end >= n:
                break
            time.sleep(0.1)
    assert [r[2] for r in udp.between(0, 1)] == ["datagram"] and [r[2] for r in unix.between(0, 2)] == ["one", "two"]
    unix.commit(1)
    assert [r[2] for r in unix.between(1, 2)] == ["two"]


def test_tail_stream(spark, tmp_path):
    sources.register(spark)
    (tmp_path / "in.log").write_text("a\nb\n")
    q = (
        spark.readStream.format("tail").option("path", str(tmp_path / "*.log")).load()
        .writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    q.processAllAvailable()
    with (tmp_path / "in.log").open("a") as f:
        f.write("c\n")
    for _ in range(60):
        q.processAllAvailable()
        if spark.table("tailed").count() == 3:
            break
        time.sleep(0.2)
    q.stop()
    assert sorted((r["source_offset"], r["line"]) for r in spark.table("tailed").collect()) == [(0, "a"), (2, "b"), (4, "c")]


def test_append_goes_on_from_batch_to_batch(spark, tmp_path):
    config = EngineConfig(log_dir=str(tmp_path / "logs"), archive_dir=str(tmp_path / "archive"), shards=2)
    add = pipelines.appender(config)
    rows = lambda a, b: spark.range(a, b).select(F.col("id").alias("n"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("route_key"), F.lit("INFO").alias("level"), F.col("id").cast("string").alias("payload"))
    add(rows(0, 50), 0)
    add(rows(50, 80), 1)
    add(rows(50, 80), 1)
    got = read_records(spark, config.log_dir, config.archive_dir, "shard", ReadQuery(limit=None)).collect()
    assert sorted(int(r["payload"]) for r in got) == list(range(80))
    for shard in (0, 1):
        own = [r for r in got if r["shard"] == shard]
        assert [r["sequence"] for r in own] == list(range(len(own))) and [int(r["payload"]) for r in own] == sorted(int(r["payload"]) for r in own)


class _Sink(BaseHTTPRequestHandler):
    seen, fail = [], 1

    def do_POST(self):  # noqa: N802
        body = self.rfile.read(int(self.headers["Content-Length"]))
        if _Sink.fail:
            _Sink.fail -= 1
            self.send_response(503)
        else:
            _Sink.seen.append(json.loads(body))
            self.send_response(200)
        self.end_headers()

    def log_message(self, *_):
        pass


def test_delivery_over_http(spark):
    web = HTTPServer(("127.0.0.1", 0), _Sink)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    rows = spark.createDataFrame([(0, i, f"m{i}") for i in range(5)] + [(1, 0, "x")], "shard int, sequence long, payload string")
    offsets = spark.createDataFrame([(0, 1)], "shard int, next_sequence long")
    after = pipelines.deliver(rows, offsets, "a", 3, pipelines.http_sink(f"http://127.0.0.1:{web.server_port}/", pause=0.01))
    assert {tuple(r) for r in after.collect()} == {(0, 5), (1, 1)}
    web.shutdown()
    assert sorted((b["shard"], b["first_sequence"], len(b["records"])) for b in _Sink.seen) == [(0, 1, 2), (0, 3, 2), (1, 0, 1)]


def test_multiline_carries_over(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"source_id": "s", "source_offset": i, "line": x}) for i, x in enumerate(["START a", "b", "START c"])))
    stream = spark.readStream.schema("source_id string, source_offset long, line string").json(str(tmp_path / "in"))
    q = pipelines.multiline(stream, "source_id", "START", 10).writeStream.format("memory").queryName("merged").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    (tmp_path / "in" / "2.json").write_text("\n".join(json.dumps({"source_id": "s", "source_offset": i, "line": x}) for i, x in enumerate(["d", "START e"], 3)))
    q.processAllAvailable()
    q.stop()
    assert [r["record"] for r in spark.table("merged").collect()] == ["START a\nb", "START c\nd"]


def test_batch_rules(spark):
    minutes = spark.createDataFrame([("k", 100, 3), ("k", 101, 2), ("k", 105, 0), ("k", 106, 0)], "k string, m long, n long")
    got = {r["m"]: (r["recent"], r["lifetime"]) for r in rules.recent_sums(minutes, "k", "m", "n").collect()}
    assert got[101] == (5, 5) and got[105] == (2, 5) and got[106] == (0, 5)
    zero = dict.fromkeys(["disk_quota", "pending_bytes", "sink_backlog", "sink_failures", "sink_latency", "sink_latency_average"], 0)
    for reason, value, most in (("sink_backlog", 10, 10), ("sink_failures", 3, 3), ("sink_latency", 5000, 1000), ("pending_bytes", 64, 64), ("disk_quota", 32, 32)):
        row = spark.createDataFrame([zero | {reason: value}]).select(rules.backpressure({reason: most}).alias("r")).first()
        assert row["r"] == reason
    lines = spark.createDataFrame([("b", i, x) for i, x in enumerate(["START 1", "more", "START 2", "more"])], "b string, o long, t string")
    assert [r["record"] for r in ingest.multiline(lines, "b", "o", "t", "START", 100).orderBy("first").collect()] == ["START 1\nmore", "START 2\nmore"]
    bodies = spark.createDataFrame([('{"records":[{"message":"a","level":"warning","service":"svc-a","host":"h","trace_id":"t","attributes":{"env":"e"}},{"payload":"b","level":"err","route_key":"route-b"}]}',), ("text",), ('{"records":[1]}',)], "body string")
    got = ingest.normalised(ingest.bodies(bodies)).collect()
    assert sorted((r["payload"], r["level"], r["route_key"]) for r in got) == [("a", "WARN", "svc-a"), ("b", "ERROR", "route-b"), ("text", "INFO", ""), ('{"records":[1]}', "INFO", "")]
    assert next(r["attributes"] for r in got if r["payload"] == "a") == {"env": "e", "service": "svc-a", "host": "h", "trace_id": "t"}
    offsets = delivery.merged_offsets(
        spark.createDataFrame([(0, 7), (1, 19), (2, 42)], "shard int, next_sequence long"), spark.createDataFrame([(0, 11), (3, 51), (4, 63)], "shard int, next_sequence long")
    )
    assert {tuple(r) for r in offsets.collect()} == {(0, 11), (1, 19), (2, 42), (3, 51), (4, 63)}


def test_streaming_plans(spark, tmp_path):
    stream = spark.readStream.format("rate").load().withColumn("key", F.lit("a"))
    assert pipelines.recent_counts(stream, "timestamp", "key").isStreaming
    sent = stream.select("timestamp", F.lit("a").alias("agent_id"), F.lit(0).alias("shard"), F.col("value").alias("first_sequence"), F.col("value").alias("next_sequence"))
    assert pipelines.deduplicated(sent, "timestamp").isStreaming
    pytest.importorskip("pandas")


def _wait(done, seconds=60):
    until = time.time() + seconds
    while not done() and time.time() < until:
        time.sleep(0.2)
    assert done()


def test_quiet_record_is_given_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps({"source_id": "s", "source_offset": 0, "line": "START only"}))
    stream = spark.readStream.schema("source_id string, source_offset long, line string").json(str(tmp_path / "in"))
    merged = pipelines.multiline(stream, "source_id", "START", 10, quiet_ms=1000)
    q = merged.writeStream.format("memory").queryName("quiet").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="2 seconds").start()
    try:
        _wait(lambda: [r["record"] for r in spark.table("quiet").collect()] == ["START only"])
    finally:
        q.stop()


def test_writers_of_one_folder_lose_nothing(spark, tmp_path):
    config = EngineConfig(log_dir=str(tmp_path / "l"), archive_dir=str(tmp_path / "a"), shards=1)
    for text in ("one", "two"):
        writer = Writer(spark, config)
        writer.info(text)
        writer.flush()
    read = lambda: [(r["sequence"], r["payload"]) for r in read_records(spark, config.log_dir, config.archive_dir, "shard", ReadQuery(limit=None)).collect()]
    assert read() == [(0, "one"), (1, "two")]
    append, writer._append = writer._append, lambda *_: 1 / 0
    writer.info("three")
    with pytest.raises(ZeroDivisionError):
        writer.flush()
    assert writer.metrics["flush_errors"] == 1 and writer.metrics["pending_entries"] == 1
    writer._append = append
    writer.info("four")
    writer.flush()
    writer.flush()
    assert read() == [(0, "one"), (1, "two"), (2, "three"), (3, "four")]
    for checkpoint in ("c1", "c2"):
        (tmp_path / f"in-{checkpoint}").mkdir()
        (tmp_path / f"in-{checkpoint}" / "x.txt").write_text(f"from {checkpoint}\n")
        rows = spark.readStream.text(str(tmp_path / f"in-{checkpoint}")).selectExpr("'' as route_key", "'INFO' as level", "value as payload", "0L as n")
        q = rows.writeStream.foreachBatch(pipelines.appender(config)).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert read()[4:] == [(4, "from c1"), (5, "from c2")]


def test_agent_from_source_to_sink(spark, tmp_path):
    config = EngineConfig(log_dir=str(tmp_path / "l"), archive_dir=str(tmp_path / "a"), shards=2, sink_batch_size=3, compress_archives=True)
    (tmp_path / "l").mkdir()
    landing = tmp_path / "landing"
    landing.mkdir()
    (tmp_path / "app.log").write_text("line 1\nline 2\n")
    sent, fail = [], [2]

    def send(body):
        if fail[0]:
            fail[0] -= 1
            raise OSError("away")
        sent.append(json.loads(body))

    agent = Agent(spark, config, send, "a1", pause=0.05)
    (landing / "1.txt").write_text('{"records":[{"message":"m1","route_key":"k"},{"message":"m2"}]}')
    agent.start(str(landing), [str(tmp_path / "app.log")])
    try:
        _wait(lambda: agent.stats["source_committed"] >= 4)
        (landing / "2.txt").write_text("plain text")
        _wait(lambda: agent.stats["source_committed"] >= 5)
        until = time.time() + 90
        agent.deliver(lambda: len({m["message"] for b in sent for m in b["records"]}) >= 5 or time.time() > until)
    finally:
        agent.stop()
    got = sorted(m["message"] for b in sent for m in b["records"])
    assert got == ["line 1", "line 2", "m1", "m2", "plain text"]
    assert agent.stats["sink_failed"] == 2 and agent.stats["sink_sent"] == 5 and agent.stats["sink_dispatch_active_workers"] == 0
    from tidelog.sources import state

    after = state.read_offsets(agent.state)
    assert sum(after.values()) == 5 and all(state.read_pending(agent.state, s) is None for s in (0, 1))
    # A batch that was stored but perhaps not sent goes out first.
    again = Agent(spark, config, send, "a1")
    again.state.write("pending", state.PendingBatch(0, 0, 1, ("again",)).text())
    again.round()
    assert sent[-1]["records"] == [{"sequence": 0, "message": "again"}] and again.state.read("pending") is None
    again.limits = {"sink_failures": 1}
    again._failures[0] = 1
    assert again.pressure() == "sink_failures"
    again.wait(0.3)
    assert again.status()["backpressure_reason"] == "sink_failures" and again.stats["backpressure_pause_duration_ms"] >= 200
