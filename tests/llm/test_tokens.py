"""Operators 4, 6 and 9 against the library and against plain Python."""

import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from emberline.llm import sharding, tokenfile, treebpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = [None, "", " \n\t ", "Hello, World! don't I'M 42", "<|endoftext|> a<|endoftext|>b <|x", "İstanbul ΑΣ Σ ǅ é é ﬁ \x1c x\x1dy z µª ÷×ß", "漢字 😀👍🏽 ́a", "Ab" * 3000, "x" * 1500 + " " + "é" * 900 + "1" * 700, "same", "same"]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens long")


def wanted(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("huge", [20_000, 600])
def test_tree_encoding_equals_library(spark, huge):
    rows = {r.doc_id: r for r in treebpe.encode_documents(frame(spark), PATH, outputs=True, huge=huge).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        ids = wanted(text)
        assert rows[i].ids == ids and rows[i].n_tokens == len(ids)
        assert rows[i].decoded == LIBRARY.decode(ids, skip_special_tokens=False)
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(rows[i].decoded.encode()).hexdigest()
    assert treebpe.encode_documents(frame(spark, []), PATH).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abehintors", min_size=1, max_size=120) | st.text(alphabet="aé", min_size=1, max_size=60))
def test_tree_of_tiny_leaves_is_exact(word):
    encoder = treebpe.tree_encoder(PATH)
    before, encoder.leaf = encoder.leaf, 4
    try:
        (piece, _), = encoder.parts(word)
        assert [encoder.vocab[t] for t in encoder.word(piece)] == wanted(word)
    finally:
        encoder.leaf = before


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_chunks_stand_for_the_text(text):
    assert treebpe.tree_encoder(PATH).both(text)[0] == " ".join(map(str, wanted(text)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=" \t\r\n\x1c\u3000aB'1.é<|漢\u0301", max_size=12) | st.sampled_from([t or "" for t in TEXTS]), min_size=1, max_size=8), st.integers(1, 40))
def test_texts_taken_together_equal_library(texts, together):
    before, treebpe.TOGETHER = treebpe.TOGETHER, together
    try:
        out = treebpe._digest({"text": texts}, PATH, True)
    finally:
        treebpe.TOGETHER = before
    assert out["ids"] == [wanted(t) for t in texts] and out["n_tokens"] == [len(wanted(t)) for t in texts]
    assert out["decoded"] == [LIBRARY.decode(wanted(t), skip_special_tokens=False) for t in texts]
    assert out["decoded_sha256"] == [hashlib.sha256(t.encode()).hexdigest() for t in out["decoded"]]


def test_a_chunk_is_encoded_once_for_texts_taken_together(monkeypatch):
    asked, value = [], treebpe.TreeEncoder.value
    monkeypatch.setattr(treebpe.TreeEncoder, "value", lambda self, chunk: asked.append(chunk) or value(self, chunk))
    encoder = treebpe.TreeEncoder(PATH)
    encoder.held = 10  # fewer than there are different chunks
    monkeypatch.setattr(treebpe, "tree_encoder", lambda path: encoder)
    texts = [" ".join(f"word{i}x" for i in range(50))] * 20
    assert treebpe._digest({"text": texts}, PATH, False)["n_tokens"] == [len(wanted(t)) for t in texts]
    assert len(asked) == 50


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 600), max_size=700), max_size=6))
def test_file_round_trip_and_random_access(docs):
    arrays = [np.array(d, np.uint32) for d in docs]
    lengths = np.array([len(d) for d in docs], np.int64)
    reader = tokenfile.Reader(tokenfile.pack(np.concatenate([*arrays, np.array([], np.uint32)]), np.cumsum(lengths) - lengths, np.arange(len(docs))))
    for k, d in enumerate(docs):
        assert reader.document(k).tolist() == d
    flat = [x for d in docs for x in d]
    for at in range(0, len(flat), 97):
        assert reader[at] == flat[at]


def test_token_files(spark, tmp_path):
    folder = str(tmp_path / "dac")
    tokenfile.write_tokens(frame(spark), PATH, folder, file_ids=500)
    rows = tokenfile.read_tokens(spark, folder, outputs=True).orderBy("doc_id").collect()
    start = 0
    for i, (row, text) in enumerate(zip(rows, TEXTS, strict=True)):
        ids = [*wanted(text), 1]
        assert (row.doc_id, row.start, row.n_tokens, row.ids) == (i, start, len(ids), ids)
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    tokenfile.write_tokens(frame(spark, []), PATH, folder)
    assert tokenfile.read_tokens(spark, folder).count() == 0


def score(key, shard, weight, seed=7):
    h = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42) if key is not None else 42
    for n in (shard, seed):
        h = xxhash.xxh64_intdigest(n.to_bytes(4, "little"), h)
    return -weight / math.log(((h >> 11) + 0.5) / 2.0**53)


def test_sharding_against_plain_python(spark):
    texts = [None, "", "ab", "ü"] * 50
    rows = sharding.shard_documents(spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string"), shards=5, rows_per_group=3).collect()
    by_shard: dict = {}
    for r in rows:
        text = texts[r.doc_id or 0]
        assert (r.size, r.text_crc32) == (len((text or "").encode()) + 16, zlib.crc32((text or "").encode()))
        assert r.shard == max(range(5), key=lambda s: score(r.doc_id, s, 1.0))
        assert r.grown_shard == max(range(6), key=lambda s: score(r.doc_id, s, 1.0))
        assert r.grown_shard in (r.shard, 5) and r.law == "key"
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_heavier_shards_get_more(spark):
    got = spark.range(20_000).select(sharding.rendezvous(__import__("pyspark").sql.functions.col("id"), {0: 1.0, 1: 3.0}).alias("s")).groupBy("s").count().collect()
    assert abs({r.s: r["count"] for r in got}[1] / 20_000 - 0.75) < 0.02
