"""Packing: exact round trip of ids, gapless sequences, little padding; both tokenizer paths agree."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from joulewright.llm import packing as K

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", "short", "<|endoftext|> inside <|endoftext|>", "日本語 text ﬁ 　x", "tabs\tand\n\nlines  ", "word " * 5000, "é" * 3000, "can't we'll 12345 !!", "\x1c\x1f\x85​ z"]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(JSON)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def verify(rows, texts, plain, capacity=2048):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc_id, text in texts.items():
        ids, at = plain(text), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        total += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / total


def test_round_trip(spark, plain):
    rng = random.Random(2)
    texts = dict(enumerate(TEXTS + [" ".join(rng.choice(["alpha", "Beta", "gamma,", "x1"]) for _ in range(rng.randint(0, 1500))) for _ in range(200)]))
    df = spark.createDataFrame([(i, t, 7) for i, t in texts.items()], "doc_id long, text string, offset int").repartition(3)
    assert verify(K.pack(df, JSON, RANKS).collect(), texts, plain) < 0.01


def test_testdata(spark, plain):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert verify(K.pack(docs, JSON, RANKS).collect(), texts, plain) < 0.005


def test_both_paths_agree_on_usual_characters(plain):
    import base64

    encode = K.load(JSON, RANKS)
    rng = random.Random(3)
    usual = [chr(c) for c in range(0x250) if not K.UNUSUAL.search(chr(c))] + list("‐–—‘’“”…€")
    for _ in range(300):
        text = "".join(rng.choice(usual) for _ in range(rng.randint(1, 60)))
        assert encode(text).tolist() == plain(text)
    # every token of the vocabulary as a text of its own: merges reach what the ranks look up
    texts = []
    for line in open(RANKS, "rb"):
        t = base64.b64decode(line.split()[0]).decode(errors="ignore")
        if t and not K.UNUSUAL.search(t):
            texts.append(t)
    slow = Tokenizer.from_file(JSON)
    for t, e in zip(texts, slow.encode_batch(texts, add_special_tokens=False)):
        assert encode(t).tolist()[:-1] == e.ids, t


def test_classes():
    assert K.cuts(2048 * 2 + 1024 + 64 + 3, 2048, 64) == [2048, 2048, 1024, 64, 3]
    assert K.cuts(1, 2048, 64) == [1]


def test_full_bins_hold_the_class_number_of_pieces():
    bins = K.Bins(64, 0)
    for i in range(10):
        bins.add(i, 0, np.zeros(9, "<u4"), 9)  # class 7
    assert len(bins.rows) == 7 and {r[5] for r in bins.rows} == {0}
    bins.finish()
    assert sum(r[2] for r in bins.rows) == 90


def test_empty_nulls_and_repeats(spark):
    schema = "doc_id long, text string"
    assert K.pack(spark.createDataFrame([], schema), JSON, RANKS).count() == 0
    rows = K.pack(spark.createDataFrame([(None, None), (None, "a"), (1, "a"), (1, "a")], schema), JSON, RANKS).collect()
    assert sum(r.length for r in rows) == 7 and sum(r.doc_id is None for r in rows) >= 2
