import gzip
import logging

from pyspark.sql import functions as F

from tidelog.config import EngineConfig
from tidelog.functions.text import headers
from tidelog.log import Handler, Writer
from tidelog.plans.records import ReadQuery, read_records
from tidelog.sources import maintenance


def test_folders(spark, tmp_path):
    (tmp_path / "a.checkpoint.tmp").write_text("x")
    (tmp_path / "a.log").write_text("xyz")
    (tmp_path / "b.gz.tmp").write_text("x")
    assert maintenance.directory_size(spark, str(tmp_path)) == 5 and maintenance.directory_size(spark, str(tmp_path / "no")) == 0
    assert maintenance.remove_leftovers(spark, str(tmp_path)) == ["a.checkpoint.tmp", "b.gz.tmp"] and (tmp_path / "a.log").exists()


def test_gzip_errors(spark, tmp_path):
    data = gzip.compress(b"payload=x\n" * 100)
    (tmp_path / "good.log.gz").write_bytes(data + data)
    (tmp_path / "bad.log.gz").write_bytes(data[:-8])
    got = {r["path"].rsplit("/", 1)[1]: r["intact"] for r in maintenance.gzip_errors(spark, [str(tmp_path / "good.log.gz"), str(tmp_path / "bad.log.gz")]).collect()}
    assert got == {"good.log.gz": True, "bad.log.gz": False}
    assert maintenance.gzip_errors(spark, []).count() == 0


def test_writer_and_handler(spark, tmp_path):
    config = EngineConfig(log_dir=str(tmp_path / "l"), archive_dir=str(tmp_path / "a"), shards=1)
    writer = Writer(spark, config)
    writer.info("one", "k")
    writer.flush()
    log = logging.getLogger("tidelog-test")
    log.propagate = False
    log.addHandler(handler := Handler(writer))
    log.warning("two")
    log.error("three")
    handler.flush()
    got = read_records(spark, config.log_dir, config.archive_dir, "shard", ReadQuery(limit=None)).collect()
    assert [r["sequence"] for r in got] == [0, 1, 2] and [r["level"] for r in got] == ["INFO", "WARN", "ERROR"]
    assert got[1]["payload"].startswith("[test_upkeep.py:") and got[1]["payload"].endswith("] two")
    lost = []
    Handler(None, lost.append).emit(logging.LogRecord("x", logging.INFO, "f.py", 3, "m", None, None))
    assert lost == ["[f.py:3] m\n"]


def test_headers(spark):
    text = "X-A: 1\nHost: no\nbad name: x\nx-a: 2\nB:y"
    assert spark.range(1).select(headers(F.lit(text)).alias("h")).first()["h"] == {"x-a": "2", "b": "y"}
