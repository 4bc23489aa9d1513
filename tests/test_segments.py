import gzip
import json
import re
import threading
import urllib.error
import urllib.request
from itertools import takewhile

import pytest
from duck import SF
from pyspark.sql import functions as F

from tidelog import config as options
from tidelog.cli import main, server
from tidelog.functions.codec import decoded
from tidelog.plans import queries
from tidelog.plans.records import ReadQuery, read_records
from tidelog.plans.status import export_batch
from tidelog.sources import segments as seg
from tidelog.sources import state, writer
from tidelog.sources.generator import generated


@pytest.fixture
def folders(tmp_path):
    (tmp_path / "logs" / "archive").mkdir(parents=True)
    return tmp_path / "logs", tmp_path / "logs" / "archive"


def payloads(spark, folders, q=None):
    return [r["payload"] for r in read_records(spark, str(folders[0]), str(folders[1]), "shard", q or ReadQuery(limit=None)).collect()]


def stats(spark, folders):
    return seg.read_statistics(spark, seg.segments(spark, str(folders[0]), str(folders[1]), "shard")).first()


def test_plain_twin_wins(spark, folders):
    logs, archive = folders
    (archive / "shard-0.123456789.7.log").write_text("payload=plain-archive-record\n")
    with gzip.open(archive / "shard-0.123456789.7.log.gz", "wt") as f:
        f.write("payload=other\n")
    (logs / "shard-0.log").write_text("payload=active-record\n")
    (logs / "other.txt").write_text("x\n")
    assert payloads(spark, folders) == ["plain-archive-record", "active-record"]
    got = stats(spark, folders)
    assert (got["segments_read"], got["archive_segments_read"], got["active_segments_read"]) == (2, 1, 1)
    assert payloads(spark, folders, ReadQuery(include_archive=False)) == ["active-record"]


def test_damage_ends_its_segment(spark, folders):
    logs, archive = folders
    (archive / "shard-0.1.0.log").write_text("payload=good\ncrc=00000000\tpayload=corrupted\npayload=later\n")
    (logs / "shard-0.log").write_text("payload=active\n")
    assert payloads(spark, folders) == ["good", "active"]
    got = stats(spark, folders)
    assert (got["corrupted_segments"], got["corrupted_lines"], got["records_returned"]) == (1, 1, 2)


def test_short_gzip_keeps_its_beginning(spark, folders):
    logs, archive = folders
    data = gzip.compress("".join(f"payload=row {i * 7919 % 10007}\n" for i in range(5000)).encode())
    (archive / "shard-0.1.0.log.gz").write_bytes(data[: len(data) // 2])
    (logs / "shard-0.log").write_text("payload=active\n")
    got = payloads(spark, folders)
    assert 100 < len(got) < 5000 and got[0] == "row 0" and got[1] == "row 7919" and got[-1] == "active"


def test_vanished_and_empty(spark, folders):
    logs, _ = folders
    assert payloads(spark, folders) == []
    (logs / "shard-0.log").write_text("payload=a\n\npayload=b")
    (logs / "shard-1.log").write_text("payload=gone\n")
    found = seg.segments(spark, str(logs), None, "shard").persist()
    found.count()
    rows = seg.records(spark, found)
    (logs / "shard-1.log").unlink()
    assert sorted(r["payload"] for r in rows.collect()) == ["", "a", "b"]
    assert payloads(spark, ("/no/such", "/no/such/a")) == []


def test_verified_prefix(spark, folders):
    logs, _ = folders
    (logs / "shard-0.log").write_text("seq=0\tpayload=a\n\nseq=1\tpayload=b\nseq=x\n")
    rows = decoded(seg.lines(spark, [str(logs / "shard-0.log")]))
    got = seg.verified_prefix(rows).first()
    assert (got["valid_records"], got["next_sequence"], got["valid_size"]) == (2, 2, 32)


def test_write_and_read_back(spark, folders):
    logs, archive = folders
    rows = generated(spark, 500, 40, 0).withColumn("shard", (F.col("n") % 3).cast("int"))
    rows = writer.sequenced(rows, "n", step=64).withColumn("timestamp", F.lit("2026-01-01 00:00:00.000000"))
    config = options.EngineConfig()
    writer.write_active(writer.encoded_lines(rows, config), str(logs), "shard")
    writer.write_archive(writer.encoded_lines(rows, config), str(archive), "shard", 5, compress=True)
    assert sorted(p.name for p in logs.glob("*.log")) == ["shard-0.log", "shard-1.log", "shard-2.log"]
    got = read_records(spark, str(logs), str(archive), "shard", ReadQuery(shard=1, seq_from=10, seq_to=12)).collect()
    assert [r["sequence"] for r in got] == [10, 11, 12] * 2 and [r["archived"] for r in got] == [True] * 3 + [False] * 3
    assert got[0]["payload"].startswith("bench-log-31 ") and len(got[0]["payload"]) == 40
    assert payloads(spark, folders, ReadQuery(limit=0)) == []
    body = json.loads(export_batch(read_records(spark, str(logs), None, "shard", ReadQuery(shard=0, limit=2)), None).first()["body"])
    assert body["agent_id"] == "query-export" and [r["sequence"] for r in body["records"]] == [0, 1]


def test_command_line_and_server(spark, folders, capsys, tmp_path):
    logs, archive = folders
    (logs / "shard-0.log").write_text('seq=0\tpayload={"message":"m","agent_id":"a","source_offset":4,"attributes":{"b":"2","a":"1"}}\nseq=1\tpayload=x\n')
    args = ["--log-dir", str(logs), "--archive-dir", str(archive)]
    assert main(["read", *args, "--seq-from", "1"]) == 0
    assert capsys.readouterr().out == "seq=1\tpayload=x\n"
    main(["verify", *args])
    assert "valid_records=2 next_sequence=2" in capsys.readouterr().out
    main(["route", "--key", "route-a"])
    assert json.loads(capsys.readouterr().out)["hash"] == 7034495724473851416
    offsets = tmp_path / "offsets"
    offsets.write_text(state.offsets_text({0: 1}))
    main(["replay", *args, "--offsets", str(offsets)])
    assert json.loads(capsys.readouterr().out)["records"] == [{"sequence": 1, "message": "x"}]
    landing = tmp_path / "landing"
    landing.mkdir()
    web = server(spark, options.EngineConfig(log_dir=str(logs), archive_dir=str(archive)), str(landing), most_bytes=100)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{web.server_port}/v1/"
    get = lambda p: json.load(urllib.request.urlopen(url + p))
    first = get("records?agent_id=a")["records"]
    assert len(first) == 1 and first[0]["payload"] == "m" and first[0]["source_offset"] == 4 and list(first[0]["attributes"]) == ["a", "b"]
    assert get("status")["segments_read"] == 1 and get("route?key=")["used_local_fallback"]
    post = lambda b: json.load(urllib.request.urlopen(url + "logs", b.encode()))
    assert post('{"records":[{"message":"a"},{"message":"b"}]}') == {"accepted": 2} and post("text") == {"accepted": 1}
    for bad, code in ((lambda: get("records?shard=x"), 400), (lambda: post("y" * 200), 413), (lambda: post(" "), 400), (lambda: get("no"), 404)):
        with pytest.raises(urllib.error.HTTPError) as e:
            bad()
        assert e.value.code == code
    web.shutdown()
    assert len(list(landing.glob("*.txt"))) == 2


def test_state_files(spark, tmp_path):
    c = state.Checkpoint(100, 7, 2)
    assert state.Checkpoint.parsed(c.text()) == c and state.Checkpoint.parsed("sequence=999999\n") is None
    assert state.Checkpoint.parsed(c.text().replace("sequence=7", "sequence=8")) is None
    assert state.recovery_mode(c, 200) == ("from_checkpoint", 100, 7)
    assert state.recovery_mode(c, 50)[0] == "full_scan_stale_checkpoint" and state.recovery_mode(None, 50)[0] == "full_scan_incomplete_checkpoint"
    assert state.parsed_offsets(state.offsets_text({2: 42, 0: 7})) == {0: 7, 2: 42} and state.parsed_offsets("shard=3\nnext_sequence=9\n") == {3: 9}
    with pytest.raises(ValueError):
        state.parsed_offsets("shard=3\nnext_sequence=9\n", 4)
    p = state.PendingBatch(4, 10, 13, ("plain", "line\nbreak", 'quote"slash\\'))
    assert state.PendingBatch.parsed(p.text()) == p and state.PendingBatch.parsed("x=1") is None
    s = state.SourceOffset("/a", 5, 6)
    assert state.SourceOffset.parsed(s.text()) == s
    path = tmp_path / "o"
    path.write_text(state.offsets_text({0: 7, 3: 51}))
    assert {tuple(r) for r in state.offset_table(spark, str(path)).collect()} == {(0, 7), (3, 51)}


def test_config(tmp_path):
    path = tmp_path / "c"
    path.write_text("shards=8 # eight\ncrc-class=header\n\nrecord-level=no\nunknown=1\n")
    got = options.load(str(path), shards=2)
    assert (got.shards, got.crc_class, got.record_level) == (2, "header", False)
    for bad in ({"routing": "x"}, {"crc_class": "x"}, {"shards": -1}, {"empty_route_key": "x"}):
        with pytest.raises(ValueError):
            options.EngineConfig(**bad)
    assert ReadQuery.from_params({"limit": "x", "shard": "2"}).limit == 100 and ReadQuery.from_params({"limit": "0"}, True).limit == 100


@pytest.fixture
def written(spark, monkeypatch):
    """What segments' queries hand to the writer, and the settings that hold then: nothing small enough to be broadcast unasked."""
    seen = []
    whole = writer.write_named
    monkeypatch.setattr(queries.writer, "write_named", lambda lines, *rest: seen.append(lines) or whole(lines, *rest))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield seen
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_no_task_holds_a_shard(spark, written):
    """Records are not dealt by shard alone on their way into segment files."""
    queries._segment_files(spark, SF)
    for lines in written:
        joins = re.findall(r"SortMergeJoin \[(.*?)\]", lines._jdf.queryExecution().executedPlan().toString())
        assert joins and not [keys for keys in joins if re.fullmatch(r"shard#\d+", keys)]


def test_each_key_is_hashed_once(spark):
    """No filter hashes the keys of all records before they are distinct."""
    lines = queries.records(spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    for k, x in enumerate(lines):
        if "Aggregate [route_key" in x:
            below = takewhile(lambda y: depth(y) > depth(x), lines[k + 1 :])
            assert not [y for y in below if "lambdafunction" in y]


def test_lines_stay_where_prefixes_are_verified(spark, folders):
    """Sizes of lines are dealt by segment, not the lines."""
    (folders[0] / "shard-0.log").write_text("seq=0\tpayload=a\n")
    node = seg.verified_prefix(decoded(seg.lines(spark, [str(folders[0] / "shard-0.log")])))._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Window":
        node = node.children().head()
    dealt = node.children().head().output().mkString(" ")
    assert "_size#" in dealt and "line#" not in dealt


def test_many_files_are_looked_up_by_few_tasks(spark, folders):
    logs, _ = folders
    for k in range(80):
        (logs / f"shard-{k}.log").write_text(f"seq=0\tpayload={k}\n")
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    was, tasks = spark.conf.get(key, None), spark.sparkContext.defaultParallelism * 4
    spark.sparkContext.setJobGroup("many", "many")
    try:
        rows = seg.lines(spark, [str(p) for p in logs.glob("*.log")])
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("many") for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages) <= tasks < 80
    assert spark.conf.get(key, None) == was and rows.count() == 80


def test_files_are_written_over(spark, tmp_path):
    """Names land in their places, over files that are there; a folder of a segment's name is no segment."""
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.1.log").write_text("old\n")
    rows = spark.createDataFrame([("x.1.log", 1, "two"), ("x.1.log", 0, "one"), ("y.log.gz", 0, "three")], "name string, sequence long, line string")
    writer.write_named(rows, str(tmp_path), lambda name: f"{'b' if name[0] == 'x' else 'c'}/{name}")
    assert (tmp_path / "b" / "x.1.log").read_text() == "one\ntwo\n"
    assert gzip.decompress((tmp_path / "c" / "y.log.gz").read_bytes()) == b"three\n"
    (tmp_path / "b" / "z.log").mkdir()
    assert [(r["path"].rsplit("/", 1)[1], r["size"]) for r in seg.listing(spark, str(tmp_path / "b")).collect()] == [("x.1.log", 8)]
