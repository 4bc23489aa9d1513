import math

import corpus_pipeline
import numpy as np
import pytest
from duck import SF

from tidelog.llm import op1_knn, op2_chat


def brute_knn(rows, asked, k=10):
    clean = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in clean:
        if asked(q):
            scored = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in clean if i != q))[:k]
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)}
    return out


@pytest.mark.parametrize("shard", [8192, 16])
def test_knn(spark, monkeypatch, shard):
    from pyspark.sql import functions as F

    monkeypatch.setattr(op1_knn, "SHARD", shard)
    monkeypatch.setattr(op1_knn, "QUERIES_PER_PIVOT", 8)
    monkeypatch.setattr(op1_knn, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).round(2).tolist()) for i in range(120)]
    rows += [(200 + i, [1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(30)]
    rows += [(300, None), (310, [1.0, None, 0.0]), (320, [math.nan, 0.0]), (330, [math.inf, 0.0]), (None, [1.0] * 5), (340, [0.5, 0.5]), (350, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score")
    got = {tuple(r) for r in op1_knn.knn(frame, F.col("vec_id") % 10 == 0).collect()}
    assert got == brute_knn(rows, lambda q: q % 10 == 0)
    few = frame.where("vec_id < 4")
    assert {tuple(r) for r in op1_knn.knn(few, F.col("vec_id") % 10 == 0).collect()} == brute_knn(rows[:4], lambda q: q % 10 == 0)
    assert op1_knn.knn(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_chat(spark):
    turn = lambda c, t, x, r="user": (c, t, r, x, "extra")
    rows = [turn(1, 0, "a"), turn(1, 1, "b"), turn(2, 0, "a"), turn(2, 1, "b"), turn(2, 2, "c"), turn(3, 0, "a"), turn(3, 1, "x")]
    rows += [turn(4, 0, "a"), turn(4, 1, "x"), turn(5, None, None, None), turn(None, 0, "a"), turn(6, 0, "ab"), turn(7, 0, "b"), turn(7, 0, "b")]
    rows += [turn(8, i, f"t{i}") for i in range(600)] + [turn(9, i, f"t{i}") for i in range(300)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")
    got = {}
    for r in op2_chat.rendered(frame).orderBy("conv_id", "part").collect():
        got.setdefault(r["conv_id"], []).append(r)
    assert set(got) == {2, 3, 5, 6, 7, 8} and [r["part"] for r in got[8]] == [0, 1, 2] and got[8][0]["n_turns"] == 600
    assert got[2][0]["chat_text"] == "".join(f"<|im_start|>user\n{x}<|im_end|>\n" for x in "abc")
    assert got[5][0]["chat_text"] == "<|im_start|>\n<|im_end|>\n" and got[7][0]["n_turns"] == 2
    assert "".join(r["chat_text"] for r in got[8]).count("<|im_start|>") == 600
    assert op2_chat.rendered(frame.limit(0)).count() == 0


def test_pipeline(spark):
    import brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "language", "near_duplicates", "packing"]
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = {r["doc_id"]: r["text"] for r in rows.select("doc_id", "text").collect()}
        rows = stage(spark, rows, SF)
        assert rows.columns == docs.columns
        kept = {r["doc_id"] for r in rows.collect()}
        assert kept <= set(before)
        if name == "quality":
            failed = {i for i, t in before.items() if (lambda s: s[0] < 10 or 100 * s[4] > 20 * s[0])(brute.statistics(t))}
            assert not kept & failed and len(kept) > 0.6 * len(before)
        if name == "near_duplicates":
            want, _ = brute.components(before, corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.SIMILAR_PERCENT)
            assert kept == {i for i, c in want.items() if i == c}
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == kept


def test_pipeline_on_odd_rows(spark, docs, tmp_path):
    own = docs.select("doc_id", "text", "lang", "source", "n_chars", "n")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (own, own.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, str(tmp_path))
        assert rows.count() >= 0
