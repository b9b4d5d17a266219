"""Exact dedup: the perfect hash, and groups against a plain version."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from joulewright.llm import exact_dedup as E

TEXTS = [None, "", " \n", "a b", "ab", "a\tb ", "a b", "A b", "x" * 100_000, "x" * 100_000 + "\r", "é", "é", "é"]


def plain(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id))
    out = {}
    for key, members in groups.items():
        keep = min(members)[1]
        for _, doc_id in members:
            out[doc_id] = (keep, len(members), doc_id == keep, hashlib.sha256(key.encode()).hexdigest())
    return out


def test_perfect_hash():
    digests = np.frombuffer(b"".join(hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(5000)), np.uint8).reshape(-1, 32)
    h = E.PerfectHash.unpack(E.PerfectHash.build(digests[:4000]).pack())
    assert sorted(h.slots(digests[:4000]).tolist()) == list(range(4000))
    assert (h.slots(digests[4000:]) < 4000).all()
    assert len(E.PerfectHash.build(digests[:0]).slots(digests[:0])) == 0


@pytest.mark.parametrize("history", ["true", "false", None, "doc_id < 7", "doc_id > 100"])
def test_any_history_gives_the_same_groups(spark, history):
    rows = list(enumerate(TEXTS * 2))
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, digest string")
    got = E.dedup(df, None if history is None else F.expr(history), per_shard=3).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == plain(rows)
    if history == "true":
        assert all(r.member for r in got)


def test_digests_that_fold_alike_are_folded_another_way(monkeypatch):
    plain = E.PerfectHash.words
    alike = staticmethod(lambda d, fold=0: plain(d, fold) * np.uint64(fold > 1))
    monkeypatch.setattr(E.PerfectHash, "words", alike)
    digests = np.frombuffer(b"".join(hashlib.sha256(bytes([i])).digest() for i in range(50)), np.uint8).reshape(-1, 32)
    h = E.PerfectHash.unpack(E.PerfectHash.build(digests).pack())
    assert h.fold == 2 and sorted(h.slots(digests).tolist()) == list(range(50))


def test_shards_grow_with_the_batch_too(spark):
    assert [E.shards_of(h, b, 50, 4) for h, b in ((0, 0), (1000, 10), (10, 1000), (0, 10**6))] == [4, 20, 20, 20_000]
    df = spark.range(5000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'same  text', concat('t', id)) AS text")
    got = E.dedup(df, F.lit(False), per_shard=50).collect()
    assert len(got) == 5000 and sum(r.kept for r in got) == 3334 and {r.group_size for r in got} == {1, 1667}


def test_testdata(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in E.dedup(docs, per_shard=50).collect()} == plain(rows)


def test_null_ids_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (2, "b"), (2, "b"), (3, "a")], "doc_id long, text string")
    got = E.dedup(df).collect()
    assert sum(r.kept for r in got) == 2
    assert {r.keep_id for r in got if r.text_sha256 == hashlib.sha256(b"a").hexdigest()} == {3}
    assert E.dedup(df.limit(0)).count() == 0
