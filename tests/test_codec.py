import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from tidelog.functions.codec import CRC_CLASSES, RecordFormat, decoded, encoded, sanitised
from tidelog.functions.hashing import fnv1a64, unsigned, unsigned_mod, xxh64_hex
from tidelog.functions.text import http_endpoint, json_escaped, key_values, metrics, status_codes
from tidelog.operators.routing import fnv_bytes, ring, route, routed


def one(spark, fmt, payload="payload", level="WARN"):
    row = spark.createDataFrame([("2026-01-01 00:00:00.000001", 1, 42, level, payload)], "t string, s int, q long, l string, p string")
    return row.select(encoded(fmt, F.col("t"), F.col("s"), F.col("q"), F.col("l"), F.col("p")).alias("line"))


@pytest.mark.parametrize("crc", CRC_CLASSES)
def test_roundtrip_and_damage(spark, crc):
    lines = one(spark, RecordFormat(crc=crc), "a\tb\nc\rd é")
    got = decoded(lines).first()
    assert got["valid"] and got["payload"] == "a b c d é" and got["sequence"] == 42 and got["shard"] == 1
    assert got["level"] == "WARN" and got["timestamp"] == "2026-01-01 00:00:00.000001"
    bad = decoded(lines.withColumn("line", F.regexp_replace("line", "é$", "e"))).first()
    assert bad["valid"] == (crc in ("none", "header"))


def test_known_line(spark):
    body = "ts=2026-01-01 00:00:00.000001\tshard=1\tseq=42\tlevel=WARN\tpayload=payload"
    assert one(spark, RecordFormat()).first()["line"] == f"crc={zlib.crc32(body.encode()):08x}\t{body}"
    meta = body.split("\tpayload=")[0]
    digest = xxhash.xxh64_hexdigest(b"payload")
    assert one(spark, RecordFormat(crc="payload_hash")).first()["line"] == f"crc=x:{zlib.crc32((meta + digest).encode()):08x}:{digest}\t{body}"


def test_bare_and_odd_lines(spark):
    lines = ["plain", "", "level=DEBUG", "seq=12", "seq=+5", "seq=99999999999999999999999", "shard=4294967296", "crc=00000000\tpayload=x", "crc=zz\tx", "level=ERROR\tpayload="]
    rows = {r["line"]: r for r in decoded(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    assert [rows[x]["valid"] for x in lines] == [True, True, False, True, False, False, False, False, False, True]
    assert rows["plain"]["payload"] == "plain" and not rows["plain"]["has_sequence"] and rows["plain"]["timestamp"] == ""
    assert rows["seq=12"]["has_sequence"] and rows["level=ERROR\tpayload="]["payload"] == ""


def test_envelope(spark):
    lines = ['{"message":"m","agent_id":"a","source_id":"s","source_offset":42,"ingest_timestamp":"t","attributes":{"host":"h"}}', '{"message":5}', '{"agent_id":"a"}', "{bad", '{"k": 1}']
    rows = {r["line"]: r for r in decoded(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    first = rows[lines[0]]
    assert (first["payload"], first["agent_id"], first["source_offset"], first["attributes"]) == ("m", "a", 42, {"host": "h"})
    assert all(rows[x]["payload"] == x for x in lines[1:])
    assert rows[lines[2]]["agent_id"] == "a" and rows[lines[1]]["source_offset"] is None


def test_sanitised(spark):
    assert spark.range(1).select(sanitised(F.lit("row-1\nrow-2\trow-3\rrow-4")).alias("x")).first()["x"] == "row-1 row-2 row-3 row-4"


def test_fnv(spark):
    keys = ["route-a", "é", "", "x" * 200, "日本\n"]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", unsigned(fnv1a64(F.col("k"))).alias("h"), unsigned_mod(fnv1a64(F.col("k")), 7).alias("m"), xxh64_hex("k").alias("x")).collect()
    for r in rows:
        assert int(r["h"]) == fnv_bytes(r["k"].encode()) and r["m"] == fnv_bytes(r["k"].encode()) % 7
        assert r["x"] == xxhash.xxh64_hexdigest(r["k"].encode())
    assert fnv_bytes(b"route-a") == 7034495724473851416


def test_routing(spark):
    points = ring(4, 64)
    assert len(points) == 256
    keys = [f"key-{i}" for i in range(300)] + [""]
    frame = spark.createDataFrame(list(enumerate(keys)), "n long, k string")
    for p in (None, points):
        for r in routed(frame, "k", 4, p, local_shard=3).collect():
            want = route(r["k"], 4, p, local_shard=3)
            assert (r["shard"], int(r["hash"]), int(r["token"]), r["used_local_fallback"]) == tuple(want.values())
    assert route("", 4, local_shard=3)["shard"] == 3
    assert [route("", 4, index=i)["shard"] for i in (0, 1, 5)] == [0, 1, 1]
    assert route("a", 0)["used_local_fallback"]


def test_text(spark):
    row = spark.range(1).select(
        http_endpoint(F.lit("http://localhost:18081/v1/logs")).alias("a"), http_endpoint(F.lit("https://x/")).alias("b"), http_endpoint(F.lit("http://h")).alias("c"),
        status_codes(F.lit("503, 429,503,abc,99")).alias("s"), json_escaped(F.lit('a"\\\n\t\r')).alias("j"),
        key_values(F.lit("a=1\nb=2=3\nno\na=4")).alias("kv"), metrics(F.lit("messages=5 rate=1.5 x")).alias("m"),
    ).first()
    assert tuple(row["a"]) == ("localhost", 18081, "/v1/logs") and row["b"] is None and tuple(row["c"]) == ("h", 80, "/")
    assert row["s"] == [429, 503] and row["j"] == 'a\\"\\\\\\n\\t\\r' and row["kv"] == {"a": "4", "b": "2=3"} and row["m"] == {"messages": 5.0, "rate": 1.5}
