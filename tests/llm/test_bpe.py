import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import bpe, common, op3_bpe_codec, op4_packing, op8_token_files


@pytest.fixture(scope="session")
def ids(texts, vocabulary):
    t = bpe.codec(vocabulary).tokenizer
    return {i: t.encode(x or "", add_special_tokens=False).ids for i, x in texts.items()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t ab'lsé1!日  <|endoftext|>x\x85᠎"), max_size=24), max_size=12))
def test_blocks_encode_as_the_library(texts):
    import public_tokenizers

    codec = bpe.codec(public_tokenizers.path("byte_bpe_50k.json"))
    ids, ends = bpe.encode_block(codec, pa.array([*texts, "a<|endoftext|> b"], pa.large_string()))
    for k, t in enumerate([*texts, "a<|endoftext|> b"]):
        own = ids[ends[k] : ends[k + 1]]
        assert own.tolist() == codec.tokenizer.encode(t, add_special_tokens=False).ids
        pieces, at = codec.decoded(own)
        assert bytes(pieces[: at[-1]]).decode() == codec.tokenizer.decode(own.tolist(), skip_special_tokens=False)


@pytest.mark.parametrize("block_bytes", [1 << 10, 16 << 20])
def test_codec(spark, docs, texts, ids, vocabulary, block_bytes):
    got = {r["doc_id"]: r for r in op3_bpe_codec.encode_decode(docs, vocabulary, block_bytes=block_bytes).collect()}
    assert set(got) == set(texts)
    for i, x in texts.items():
        assert got[i]["n_tokens"] == len(ids[i])
        assert got[i]["ids_sha256"] == sha256(",".join(map(str, ids[i])).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == sha256((x or "").encode()).hexdigest()
    tokens = {r["doc_id"]: r for r in op3_bpe_codec.encode_decode(docs, vocabulary, "tokens").collect()}
    assert all(tokens[i]["ids"] == ids[i] and tokens[i]["decoded"] == (x or "") for i, x in texts.items())
    assert op3_bpe_codec.encode_decode(docs.limit(0), vocabulary).count() == 0


def check_packing(rows, ids):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        own.sort(key=lambda r: r["piece"])
        whole = [*ids[i], 2]
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(whole)
        assert all(r["length"] == 1024 for r in own[1:]) and len(own) == -(-len(whole) // 1024)
        for r in own:
            part = whole[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in own])
        assert [r["offset"] for r in own] == [0, *ends[:-1].tolist()] and ends[-1] <= 1024
    return len(by_sequence)


def test_packing(spark, docs, ids, vocabulary):
    rows = op4_packing.pack(docs, vocabulary).collect()
    n = check_packing(rows, ids)
    assert n <= 1 + -(-sum(r["length"] for r in rows) // 1024)
    assert op4_packing.pack(docs.limit(0), vocabulary).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_patterns_use_every_piece(lengths):
    counts = np.bincount(lengths, minlength=65) if lengths else np.zeros(65, int)
    made = op4_packing.patterns(counts, 64)
    used = np.zeros(65, int)
    for times, parts in made:
        assert times > 0 and sum(parts) <= 64
        np.add.at(used, parts, times)
    assert (used == counts).all()
    # First fit decreasing, as a bar to stay near.
    bins = []
    for x in sorted(lengths, reverse=True):
        for k, room in enumerate(bins):
            if room >= x:
                bins[k] -= x
                break
        else:
            bins.append(64 - x)
    assert sum(t for t, _ in made) <= len(bins) + 2


def test_token_files(spark, docs, texts, ids, vocabulary):
    folder = common.new_path(spark, "files")
    manifest = op8_token_files.write(docs, vocabulary, folder, file_bytes_of_text=20_000)
    assert manifest.count() > 3
    got = sorted(op8_token_files.read(spark, folder, manifest).collect(), key=lambda r: r["doc_id"])
    start = 0
    assert [r["doc_id"] for r in got] == sorted(texts)
    for r in got:
        whole = [*ids[r["doc_id"]], 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(whole), zlib.crc32(np.array(whole, "<u4").tobytes()))
        start += len(whole)
    empty = common.new_path(spark, "none")
    assert op8_token_files.write(docs.limit(0), vocabulary, empty).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_bits(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 2**bits, 1000, dtype=np.uint64).astype(np.uint32)
    data = op8_token_files.pack_bits(ids, bits)
    assert len(data) == -(-1000 * bits // 8) and (op8_token_files.unpack_bits(data, bits, 1000) == ids).all()
    f = op8_token_files.TokenFile(op8_token_files.file_bytes(np.array([5, 9]), ids, np.array([0, 300, 1000]), bits, 64))
    assert (f.document(1) == ids[300:]).all() and (f.ids(63, 65) == ids[63:65]).all() and f.ids(4, 4).size == 0
    assert op8_token_files.bits_for(50257) == 16 and op8_token_files.bits_for(1) == 1
