import random

from pyspark.sql import functions as F

from tidelog.functions.running import totals_before
from tidelog.operators import ingest, reports


def test_totals_before_with_null_keys_orders_and_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), n, rng.choice([None, 1, 5, -3])) for n in rng.sample(range(400), 120)]
    got = totals_before(spark.createDataFrame(rows, "k string, n long, v int"), "k", "n", "upto", F.col("v"), step=16)
    want = {n: sum(v or 0 for k2, n2, v in rows if k2 == k and n2 < n) for k, n, _ in rows}
    assert {r["n"]: r["upto"] for r in got.collect()} == want
    assert got.columns == ["k", "n", "v", "upto"]
    assert totals_before(spark.createDataFrame([], "k string, n long, v int"), "k", "n", "upto", F.col("v")).count() == 0


def _merged(lines, starts, most):
    out, held, first = [], [], None
    for n, t in lines:
        if held and (t.startswith(starts) or len(held) == most):
            out.append((first, "\n".join(held)))
            held = []
        if not held:
            first = n
        held.append(t)
    return out + ([(first, "\n".join(held))] if held else [])


def test_multiline_across_ranges(spark):
    rng = random.Random(5)
    lines = [(n, rng.choice(["START x", "more", "more", "", " at y"])) for n in sorted(rng.sample(range(300), 90))]
    frame = spark.createDataFrame([(None, n, t) for n, t in lines], "b string, n long, t string")
    for step in (7, 64, 1 << 16):
        got = ingest.multiline(frame, "b", "n", "t", "START", 4, step).orderBy("first").collect()
        assert [(r["first"], r["record"]) for r in got] == _merged(lines, "START", 4)


def test_queue_peaks_and_empty_reports(spark):
    changes = spark.createDataFrame([("q", n, c) for n, c in enumerate([1, 1, -1, 1, 1, -1, -1, -1, 1])] + [("r", 0, -1)], "q string, n long, c int")
    assert {r["q"]: r["most"] for r in reports.queue_peaks(changes, "q", "n", "c", step=2).collect()} == {"q": 3, "r": 0}
    none = spark.createDataFrame([], "throughput double, submit_us double, p95_us double, p99_us double")
    assert set(reports.soak(none).first()) == {0}


def test_scanner_stops_at_completion(spark):
    rows = [(1, 10, 100, 100, 0, 0, 5, 1, 1), (1, 10, 100, 150, 10, 9, 7, 2, 2), (1, 10, 100, 200, 10, 10, 3, 3, 0), (1, 10, 100, 250, 10, 10, 99, 99, 99), (2, 10, 0, 40, 3, 3, -1, 0, 0)]
    names = "run int, messages long, started_ms long, at_ms long, committed long, sent long, backlog long, queue_batches long, active_workers long"
    got = {r["run"]: r for r in reports.scanner(spark.createDataFrame(rows, names)).collect()}
    assert (got[1]["elapsed_ms"], got[1]["peak_backlog"], got[1]["peak_queue_batches"], got[1]["peak_active_workers"], got[1]["status"], got[1]["throughput"]) == (100, 7, 3, 2, "completed", 100.0)
    assert (got[2]["elapsed_ms"], got[2]["peak_backlog"], got[2]["status"]) == (40, 0, "timeout")
