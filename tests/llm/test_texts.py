import brute
import numpy as np
import pyarrow as pa
import pytest
from duck import SF, same, views
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import op5_language, op6_licenses, op7_ngram_join, op9_quality_rules, op10_lm_score, registry
from tidelog.llm.components import components


def test_language(spark, docs, texts):
    model = op5_language.fit(docs)
    got = {r["_row"]["doc_id"]: r for r in op5_language.predicted(docs, model).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        lettered = any(c.isalpha() for c in t or "")
        assert (got[i]["lang_pred"] == "und") == (not lettered) and 0 <= got[i]["score"] <= 1
        assert got[i]["rejected"] or lettered
    assert op5_language.filtered(docs).columns == docs.columns
    assert op5_language.predicted(docs, op5_language.fit(docs.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert op5_language.predicted(docs.limit(0), model).count() == 0


def test_language_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = op5_language.query(spark, "/root/testdata/sf0.01").join(table, "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97 and np.mean([r["rejected"] for r in got]) < 0.02


def test_licenses(spark, docs, texts):
    got = {r["doc_id"]: r for r in op6_licenses.scan(docs).collect()}
    for i, t in texts.items():
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute.licenses(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert op6_licenses.scan(docs.limit(0)).count() == 0 and len(op6_licenses.signatures()) > 200


def test_license_rules():
    found = lambda t: [(s.label, s.name) for _, _, s in op6_licenses.detections(op6_licenses.joined(t.lower()))]
    assert found("SPDX-License-Identifier: Apache-2.0") == [("apache-2", "spdx")]
    assert found("This work is licensed under the terms of the GNU GPL v3 license.") == [("gpl-3.0", "grant")]
    assert found("licensed under CC BY-NC-SA 4.0") == [("cc-by-nc-sa", "grant")]
    assert found("nothing of the kind") == []


@given(st.lists(st.sampled_from(["cc", "by", "nc", "CC", "-", "é", "mit", "under the MIT license", ".", " "]), max_size=30))
@settings(max_examples=100, deadline=None)
def test_base_phrases(parts):
    text = " ".join(parts)
    words = op6_licenses.joined(brute.lower(text))
    at = sorted(words.count(" ", 0, p) for phrase, _ in op6_licenses.BASE for p in op6_licenses.places(words, phrase))
    n = brute.licenses(text)
    assert (len(at), at[0] if at else None, at[-1] if at else None) == n[1:4]


def test_near_duplicates(spark, docs, texts):
    for measure in (op7_ngram_join.Measure(), op7_ngram_join.Measure(5, 80)):
        want, sizes = brute.components(texts, measure.size, measure.percent)
        got = {r["doc_id"]: r for r in op7_ngram_join.near_duplicates(docs, measure).collect()}
        assert {i: r["component_id"] for i, r in got.items()} == want and {i: r["n_shingles"] for i, r in got.items()} == sizes
    kept = op7_ngram_join.one_of_each(docs, op7_ngram_join.Measure())
    assert kept.columns == docs.columns
    assert op7_ngram_join.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_of_the_table(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    want, _ = brute.components(rows, 4, 85)
    assert {r["doc_id"]: r["component_id"] for r in op7_ngram_join.query(spark, SF).collect()} == want


def test_chunked_clusters(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(80)]
    rows = {}
    for i in range(60):
        own = list(base)
        for k in rng.integers(0, 80, rng.integers(0, 6)):
            own[k] = f"v{rng.integers(0, 40)}"
        rows[i] = " ".join(own)
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    want, _ = brute.components(rows, 4, 85)
    for sets, paired in ((2048, 32), (7, 32), (7, 4)):
        monkeypatch.setattr(op7_ngram_join, "CHUNK_SETS", sets)
        monkeypatch.setattr(op7_ngram_join, "PAIRED", paired)
        assert {r["doc_id"]: r["component_id"] for r in op7_ngram_join.near_duplicates(frame).collect()} == want


@given(st.lists(st.sets(st.integers(0, 30), max_size=14), max_size=25))
@settings(max_examples=150, deadline=None)
def test_overlap_search(sets):
    measure = op7_ngram_join.Measure()
    got = op7_ngram_join.link([np.array(sorted(s), np.uint64) for s in sets], measure)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert got.tolist() == [find(i) for i in range(len(sets))]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (20, 1), (None, 3)] + [(100, i) for i in range(101, 140)] + [(i, i + 1) for i in range(200, 260)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in (1, 2, 3, 4, 20)) and all(got[i] == 7 for i in (7, 8, 9))
    assert all(got[i] == 100 for i in range(100, 140)) and all(got[i] == 200 for i in range(200, 261)) and got[5] == 5


def test_quality_statistics(spark, docs, texts):
    clash = docs.drop("n").withColumnRenamed("score", "n_words")
    got = {r["doc_id"]: r for r in op9_quality_rules.statistics(docs).collect()}
    for i, t in texts.items():
        r = got[i]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute.statistics(t)
    labels = spark.createDataFrame([(i, int(i % 2)) for i in texts] + [(None, 1), (0, None)], "doc_id long, quality int")
    kept = op9_quality_rules.filtered(clash, labels)
    assert kept.columns == clash.columns and kept.count() > 0
    assert op9_quality_rules.filtered(docs.limit(0), labels).count() == 0
    assert op9_quality_rules.fit(docs, labels.limit(0)) == []


def test_quality_rules_learn_what_labels_say():
    rng = np.random.default_rng(0)
    x = rng.random((900, 2))
    bad = (x[:, 0] > 0.8) | ((x[:, 1] > 0.9) & (x[:, 0] > 0.3))
    rules = op9_quality_rules.learn(x, bad, ["a", "b"])
    out = np.zeros(len(x), bool)
    for r in rules:
        out |= np.all([x[:, "ab".index(n)] >= v if least else x[:, "ab".index(n)] <= v for n, least, v in r.conditions], axis=0)
    assert (out & ~bad).sum() <= 5 and (out & bad).sum() > 0.9 * bad.sum()
    assert op9_quality_rules.learn(x, rng.random(900) > 0.5, ["a", "b"]) == []


def test_lm_scores(spark, docs, texts):
    a = {r["doc_id"]: r for r in op10_lm_score.lm_scores(docs).collect()}
    b = {r["doc_id"]: r for r in op10_lm_score.lm_scores(docs, block_bytes=1 << 10).collect()}
    assert a == b and set(a) == set(texts)
    assert all((r["lm_score"] is None) == (r["n_words"] == 0) for r in a.values())
    assert op10_lm_score.lm_scores(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    same(registry.queries()[name](spark, SF), views(SF), registry.oracle_sql()[name])


def test_shingles_of_blank_texts():
    flat, ends = op7_ngram_join.shingle_sets(pa.array(["", " ", "\n"], pa.large_string()), op7_ngram_join.Measure())
    assert len(flat) == 0 and ends.tolist() == [0, 0, 0, 0]
