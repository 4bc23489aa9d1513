"""Operators find all that their method asks for: compared with the same search without its short cuts."""

import dataclasses
import itertools
import re
import zlib

import brute
import numpy as np
from pyspark.sql import functions as F

from tidelog.llm import op5_language, op6_licenses, op7_ngram_join


def spelled(pattern):
    """Every text that a pattern of literals, alternatives, options and digits matches; a digit as 4."""
    choices = []
    for op, x in pattern:
        match str(op):
            case "LITERAL":
                choices.append([chr(x)])
            case "IN":
                choices.append(["4"])
            case "BRANCH":
                choices.append([t for one in x[1] for t in spelled(one)])
            case "SUBPATTERN":
                choices.append(list(spelled(x[3])))
            case "MAX_REPEAT":
                assert x[:2] == (0, 1)
                choices.append(["", *spelled(x[2])])
            case _:
                raise ValueError(op)
    return ["".join(t) for t in itertools.product(*choices)]


def test_license_gate_covers_every_alternative(spark, monkeypatch):
    titles = [t for _, _, title in op6_licenses.LICENSES for t in spelled(re._parser.parse(title))]
    texts = [f"Licensed under {t}!" for t in titles] + [t for _, _, p, _, _ in op6_licenses.TEXTS for t in spelled(re._parser.parse(p))]
    texts += ["SPDX-License-Identifier: 0BSD", "Distributed under the FreeBSD license", "Licensed under Creative Commons BY-SA 4.0", "Released under the Python Software Foundation License"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in op6_licenses.scan(frame).collect()}
    ungated = tuple(dataclasses.replace(s, keywords=("",)) for s in op6_licenses.signatures())
    shown = lambda t: [(a, b, s.label, s.name) for a, b, s in op6_licenses.detections(op6_licenses.joined(t.lower()))]
    gated = [shown(t) for t in texts]
    monkeypatch.setattr(op6_licenses, "signatures", lambda: ungated)
    for k, t in enumerate(texts):
        want = shown(t)
        assert want and gated[k] == want, t
        assert got[k] == ",".join(sorted({label for _, _, label, _ in want} | set(filter(None, got[k].split(","))) & {label for _, label in op6_licenses.BASE})), t
    assert [got[len(texts) - 4 + k] for k in range(4)] == ["0bsd", "bsd-2-clause", "cc-by-sa", "python-2.0"]


def test_links_are_all_given(spark, docs, texts, monkeypatch):
    rng = np.random.default_rng(3)
    rows = {i: " ".join(f"v{rng.integers(0, 9)}" if rng.random() < 0.01 else f"w{k}" for k in range(80)) for i in range(60)}
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    for given, table, chunk in ((docs, texts, 2048), (frame, rows, 2048), (frame, rows, 7)):
        monkeypatch.setattr(op7_ngram_join, "CHUNK_SETS", chunk)
        sets = {i: brute.shingles(t, 4) for i, t in table.items()}
        reps = {}
        for i in sorted(sets):
            reps.setdefault(sets[i] or i, i)
        want = {
            (a, b, len(sets[a] & sets[b]))
            for a, b in itertools.combinations(sorted(reps.values()), 2)
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
        }
        assert table is texts or len(want) > len(rows)
        pairs, members = op7_ngram_join.links(given)
        assert sorted(tuple(r) for r in pairs.select("a", "b", "shared").collect()) == sorted(want)
        got = {r["doc_id"]: (r["rep"], r["n_shingles"]) for r in members.collect()}
        assert got == {i: (reps[s or i], len(s)) for i, s in sets.items()}


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(230):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzäöüéèçñ"), 6)) for _ in range(6)]
        # The last thirty languages have fewer texts than the others.
        rows += [(len(rows) + i, " ".join(rng.choice(words, 40)), f"l{k:03}") for i in range(8 if k < 200 else 5)]
    # All texts of this one are held out, so it can't be learned and nothing of it may be turned away for that.
    first = next(i for i in range(10_000, 10_100) if zlib.crc32(str(i).encode()) % 5 == 0)
    rows.append((first, "жило было слово " * 9, "unlearned"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = op5_language.fit(docs)
    assert model.languages == [f"l{k:03}" for k in range(230)]
    got = {r["_row"]["doc_id"]: r for r in op5_language.predicted(docs, model).collect()}
    assert all(got[i]["lang_pred"] == lang and not got[i]["rejected"] for i, _, lang in rows[:-1])
    assert {r["doc_id"] for r in op5_language.filtered(docs).collect()} == {i for i, _, _ in rows}


def test_rows_that_share_a_doc_id(spark):
    text = lambda c, *changed: " ".join("changed" if k in changed else f"{c}{k}" for k in range(60))
    rows = [
        (1, text("a")), (1, text("b")), (2, text("a", 59)), (3, text("b", 59)), (1, text("a")), (None, text("a")), (4, text("c")), (4, ""), (4, ""),
        (5, text("d")), (6, text("d")), (6, text("e")), (7, text("e", 0)), (8, None), (9, text("f")),
    ]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k int")
    got = sorted((r["doc_id"], r["component_id"]) for r in op7_ngram_join.near_duplicates(docs).collect())
    assert got == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (4, 4), (5, 5), (6, 5), (6, 6), (7, 6), (8, 8), (9, 9)]
    kept = op7_ngram_join.one_of_each(docs, op7_ngram_join.Measure())
    assert kept.columns == docs.columns
    left = sorted(r["k"] for r in kept.collect())
    assert [k for k in left if k not in (0, 4)] == [1, 5, 6, 7, 8, 9, 11, 13, 14] and len({0, 4} & set(left)) == 1
    pairs, _ = op7_ngram_join.links(docs)
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == [(1, 2), (1, 3), (6, 7)]


def test_common_shingles_make_no_links(spark, monkeypatch):
    """Passages that many documents share make no links, though the list of frequent shingles lacks them."""
    rng = np.random.default_rng(8)
    passages = [[f"p{k}w{i}" for i in range(25)] for k in range(12)]
    rows = {}
    for i in range(240):
        own = [f"d{i}v{k}" for k in range(60)]
        at = int(rng.integers(0, 60))
        rows[i] = " ".join(own[:at] + passages[i % 12] + passages[(i // 12) % 12] + own[at:])
    for i in range(240, 280):
        words = rows[i % 7].split(" ")
        words[int(rng.integers(0, len(words)))] = f"x{i}"
        rows[i] = " ".join(words)
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    want, _ = brute.components(rows, 4, 85)
    monkeypatch.setattr(op7_ngram_join, "PAIRED", 8)
    monkeypatch.setattr(op7_ngram_join, "MOST_FREQUENT", 1)
    assert {r["doc_id"]: r["component_id"] for r in op7_ngram_join.near_duplicates(frame).collect()} == want


def common_passages(spark):
    """Documents, one in a batch, that share passages with many others; the last three are near copies of the first three."""
    passages = [[f"p{k}w{i}" for i in range(30)] for k in range(4)]
    rows = [(i, " ".join([f"d{i}v{k}" for k in range(90)] + passages[i % 4] + passages[(i + 1) % 4])) for i in range(80)]
    rows += [(80 + i, rows[i][1].replace(f"d{i}v50", "changed")) for i in range(3)]
    return rows, spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string")


def cluster_sizes(frame, measure):
    _, _, placed, _ = op7_ngram_join._placed(frame, measure)
    return sorted(r["count"] for r in placed.groupBy("cluster").count().collect())


def test_shingles_common_to_the_corpus_only_make_no_cluster(spark):
    """Shingles of many documents are known to be frequent though no batch shows it."""
    rows, frame = common_passages(spark)
    measure = op7_ngram_join.Measure()
    assert cluster_sizes(frame, measure) == [2, 2, 2]
    want, _ = brute.components(dict(rows), 4, 85)
    assert {r["doc_id"]: r["component_id"] for r in op7_ngram_join.near_duplicates(frame, measure).collect()} == want


def test_pipeline_stage_on_common_passages(spark):
    import corpus_pipeline

    _, frame = common_passages(spark)
    assert cluster_sizes(frame, op7_ngram_join.Measure(corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.SIMILAR_PERCENT)) == [2, 2, 2]
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame, "").collect()) == list(range(80))


def test_pipeline_stage_deals_out_few_texts(spark, monkeypatch):
    """Texts that nothing resembles stay where they are read; only those that may be copies move."""
    import corpus_pipeline

    rng = np.random.default_rng(11)
    rows = [(i, " ".join(rng.bytes(256).hex() for _ in range(60)), i) for i in range(500)]
    rows += [(500 + i, rows[i][1].replace(" ", " a ", 1), i) for i in range(10)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "doc_id long, text string, word long")
    inside = spark.sparkContext._jsc.sc()

    def written():
        inside.listenerBus().waitUntilEmpty(10_000)
        return sum(inside.statusStore().executorList(True).apply(k).totalShuffleWrite() for k in range(inside.statusStore().executorList(True).size()))

    # Tables of ids count as too large to be sent to every task, as those of a large corpus are.
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        began = written()
        left = corpus_pipeline.near_duplicates(spark, docs, "")
        assert left.columns == docs.columns
        assert sorted(tuple(r) for r in left.collect()) == rows[:500]
        assert written() - began < sum(len(t) for _, t, _ in rows)
        # A filter so full that it tells nothing apart changes no row, whether few documents go or few stay.
        monkeypatch.setattr(op7_ngram_join, "FILTER_WORDS", 1)
        few = docs.where("doc_id < 10 or doc_id >= 500")
        for some, want in ((few, 10), (few.withColumn("doc_id", F.col("doc_id").cast("int")), 10), (few.unionByName(few.withColumn("doc_id", F.col("doc_id") + 5000)), 10)):
            got = corpus_pipeline.near_duplicates(spark, some, "")
            assert got.schema == some.schema and sorted(tuple(r) for r in got.collect()) == rows[:want]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_repeated_queries_and_cells(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tidelog.llm import op1_knn

    monkeypatch.setattr(op1_knn, "QUERIES_PER_PIVOT", 2)
    monkeypatch.setattr(op1_knn, "TILE", 3)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 6)) * 4
    rows = [(i, [float(x) for x in (centres[i % 4] + rng.normal(size=6) / 20).round(3)]) for i in range(160)]
    rows += [(0, rows[0][1]), (0, rows[0][1]), (40, rows[3][1]), (7, rows[7][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v in rows]
    want = []
    for q, v in {(i, tuple(v)) for i, v in whole if i % 20 == 0}:
        scored = sorted((-int(np.dot(v, w)), i) for i, w in whole if i != q)[:3]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    assert sorted(tuple(r) for r in op1_knn.knn(frame, F.col("vec_id") % 20 == 0, 3).collect()) == sorted(want)


def test_token_files_of_null_ids_and_no_rows(spark, vocabulary, tmp_path):
    from tidelog.llm import op8_token_files

    frame = spark.createDataFrame([(None, "a b"), (-1, "c"), (5, None), (None, "d")], "doc_id long, text string")
    for docs, want in ((frame, [None, None, -1, 5]), (frame.limit(0), [])):
        folder = f"file://{tmp_path}/{len(want)}"
        got = op8_token_files.read(spark, folder, op8_token_files.write(docs, vocabulary, folder)).orderBy("start").collect()
        assert [r["doc_id"] for r in got] == want
        assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(len(got))]
