"""The registered queries over their whole tables, against plain versions."""

import zlib
from hashlib import sha256

import brute
import numpy as np
import pytest
from duck import SF

from tidelog.llm import common, op5_language, op9_quality_rules, registry


@pytest.fixture(scope="module")
def table(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def ids(table, vocabulary):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return {i: tokenizer.encode(r["text"] or "", add_special_tokens=False).ids for i, r in table.items()}, tokenizer


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def test_codec_query(spark, table, ids):
    encoded, tokenizer = ids
    got = {r["doc_id"]: r for r in registry.queries()["op3_bpe_codec"](spark, SF).collect()}
    assert set(got) == set(table)
    for i, x in encoded.items():
        said = sha256(",".join(map(str, x)).encode()).hexdigest()
        back = sha256(tokenizer.decode(x, skip_special_tokens=False).encode()).hexdigest()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(x), said, back)


def test_packing_query(spark, table, ids):
    rows = registry.queries()["op4_packing"](spark, SF).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(table)
    for i, x in ids[0].items():
        whole, at = [*x, 2], 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, crc(whole[at : at + r["length"]]))
            assert 0 < r["length"] <= 1024 and (k == 0 or r["length"] == 1024)
            at += r["length"]
        assert at == len(whole) and len(pieces[i]) == -(-len(whole) // 1024)
    for spans in sequences.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(sequences) <= 1.02 * sum(len(x) + 1 for x in ids[0].values()) / 1024


def test_license_query(spark, table):
    got = {r["doc_id"]: r for r in registry.queries()["op6_license_scan"](spark, SF).collect()}
    assert set(got) == set(table)
    for i, r in table.items():
        g = got[i]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == brute.licenses(r["text"])
        assert set(filter(None, g["base_labels"].split(","))) <= set(g["labels"].split(","))


def test_token_file_query(spark, table, ids):
    got = {r["doc_id"]: r for r in registry.queries()["op8_token_files"](spark, SF).collect()}
    start = 0
    for i in sorted(table):
        x = [*ids[0][i], 0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(x), crc(x))
        start += len(x)


def plain_language(text, model):
    """Language and score of a text, n-gram by n-gram."""
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    if not letters.strip():
        return "und", 0.0
    while "  " in letters:
        letters = letters.replace("  ", " ")
    b, found = letters.encode(), np.zeros(op5_language.DIMENSIONS)
    for n in (1, 2, 3):
        for i in range(len(b) - n + 1):
            code = b[i] + (n << 8)
            for k in range(1, n):
                code = (code * 0x01000193 + b[i + k]) % 2**32
            found[(code * 0x9E3779B1) % 2**32 >> 20] += 1
    x = np.log1p(found) * model.idf
    near = model.centroids @ (x / np.linalg.norm(x))
    return model.languages[model.owner[int(np.argmax(near))]], float(near.max())


def test_language_query(spark, table):
    model = op5_language.fit(common.table(spark, SF, "documents").select("doc_id", "text", "lang"))
    got = {r["doc_id"]: r for r in registry.queries()["op5_language_id"](spark, SF).collect()}
    assert set(got) == set(table) and set(model.languages) <= {r["lang"] for r in table.values()}
    for i, r in table.items():
        lang, score = plain_language(r["text"], model)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert abs(got[i]["score"] - score) < 1e-3 and (got[i]["lang_pred"] == lang or score < 0.5)


def test_quality_query(spark, table):
    rules = op9_quality_rules.fit(common.table(spark, SF, "documents").select("doc_id", "text"), common.table(spark, SF, "labels"))
    got = {r["doc_id"]: r for r in registry.queries()["op9_quality_rules"](spark, SF).collect()}
    assert set(got) == set(table)
    for i, r in table.items():
        text = r["text"] or ""
        words, chars, symbols, dup_lines, repeats = brute.statistics(text)
        lines = sum(1 for x in text.split("\n") if brute.WORD.search(x))
        features = {
            "symbols_per_word": symbols / max(words, 1), "marks_per_word": text.count("!") / max(words, 1),
            "upper_share": sum("A" <= c <= "Z" for c in text) / max(chars, 1), "dup_line_share": dup_lines / max(lines, 1), "repeat_share": repeats / max(words, 1),
        }
        failed = words < 10 or 100 * repeats > 20 * words
        held = [all(features[n] >= v if least else features[n] <= v for n, least, v in rule.conditions) for rule in rules]
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_symbols"], got[i]["n_dup_lines"], got[i]["n_repeat_words"]) == (words, chars, symbols, dup_lines, repeats)
        assert (got[i]["base_failed"], got[i]["kept"]) == (failed, not failed and not any(held))
