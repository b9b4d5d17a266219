"""Backtracking against the library's own encoding and decoding."""

import hashlib
import random

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from joulewright.llm import piece_codec as C

MODEL = P.path("piece_bpe_32k.model")
RNG = random.Random(5)
BITS = ["a", "b", "th", "the", "ing", " ", "  ", "▁", "é", "­", "日本", "😀", "\n", "\t", "<0x41>", "<s>", "</s>", "<unk>", "=", "====", "0", "\x00", "ﬁ", "x" * 50]


def by_library(text):
    ids = C.load(MODEL).model.encode(text)
    return ids, C.load(MODEL).model.decode(ids)


def ours(text):
    c = C.load(MODEL)
    ids = c.encode(text)
    assert c.decode(ids) == c.both(text)[1]
    return ids, c.both(text)[1]


def test_mixed_texts_and_rows_of_pieces():
    c = C.load(MODEL)
    for k in range(6000):
        n = RNG.randint(0, 30)
        text = "".join(RNG.choice(BITS) for _ in range(n)) if k % 2 else "".join(c.pieces[RNG.randrange(259, 32000)].replace("▁", " ") for _ in range(n // 2))
        assert ours(text) == by_library(text), repr(text)


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(text):
    assert ours(text) == by_library(text)


@pytest.mark.parametrize("text", [" " * 5000, "a" * 30000, "the" * 9000, "=" * 9999, "日本語" * 5000, "ab c" * 9000, "\U0001f600" * 3000, "the" * 20 + "\n" * 70 + "x"])
def test_long_units(text):
    assert ours(text) == by_library(text)


def test_every_word_of_the_tables(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    assert all(ours(t) == by_library(t) for t in texts)


def test_search_gives_tokens_back():
    """Where the longest pieces are not the encoding, the search itself (without the shortcut) finds it."""
    c, given_back = C.load(MODEL), 0
    for t in ["▁" + "".join(RNG.choice("aeinrst") for _ in range(RNG.randint(3, 40))) for _ in range(3000)]:
        best = [-1] * len(t)
        for stop, token in c.automaton.iter(t):
            best[stop + 1 - c.length[token]] = token
        given_back += c.longest(t) is None
        assert c.search(best, 0, len(t)) == c.model.encode(t[1:])
    assert given_back > 100


def test_decoding_of_any_ids():
    c = C.load(MODEL)
    for _ in range(4000):
        ids = [RNG.randrange(600) if RNG.random() < 0.7 else RNG.randrange(32000) for _ in range(RNG.randint(0, 8))]
        assert c.decode(ids) == c.model.decode(ids), ids


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(C, "KEPT", 5)
    monkeypatch.setattr(C, "PAIRS", 3)
    c = C.Codec(MODEL)
    for _ in range(50):
        text = " ".join(RNG.choice(BITS) for _ in range(40))
        assert c.encode(text) == c.model.encode(text) and len(c.units) <= 5 and len(c.pairs) <= 3


def test_operator(spark):
    texts = [None, "", "a", "a", "x y  z", "▁a", "é\n😀", "word " * 3000]
    df = spark.createDataFrame([(i, t, [1], "b") for i, t in enumerate(texts)] + [(None, "a", [2], "c"), (2, "a", [1], "b")], "doc_id long, text string, ids array<int>, decoded string")
    rows = C.encode_and_decode(df, MODEL).collect()
    assert len(rows) == len(texts) + 2 and sum(r.doc_id == 2 for r in rows) == 2
    for r in rows:
        assert (r.ids, r.decoded) == by_library((texts[r.doc_id] if r.doc_id is not None else "a") or "")
    for r in C.digests(C.encode_and_decode(df, MODEL)).collect():
        ids, text = by_library((texts[r.doc_id] if r.doc_id is not None else "a") or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert C.encode_and_decode(df.limit(0), MODEL).count() == 0


def test_results_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(C, "HANDED", 10)
    df = spark.createDataFrame([(i, "some words " * (i % 3)) for i in range(50)], "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.ids for r in C.encode_and_decode(df, MODEL).collect()} == {i: by_library("some words " * (i % 3))[0] for i in range(50)}
