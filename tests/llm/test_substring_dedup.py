"""Repeated passages against a plain count of all windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from joulewright.llm import substring_dedup as S


def plain(texts, length):
    raw = [(t or "").encode() for t in texts]
    counts = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        covered = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(t)) if covered[i] and not (i and covered[i - 1]))
        out.append((len(t), sum(covered), runs, hashlib.sha256(bytes(b for b, c in zip(t, covered) if not c)).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdeé fgh") for _ in range(n))
    passages = [text(rng.randint(60, 200)) for _ in range(5)]
    docs = [text(rng.randint(0, 80)) + rng.choice(passages)[rng.randint(0, 30) :] + text(rng.randint(0, 80)) + rng.choice(passages) for _ in range(60)]
    docs += ["a" * 300, "ab" * 200, "abcde" * 100, None, "", text(63), text(64), text(65)]
    return docs + [docs[0], docs[-1], docs[3][5:], docs[4][:-7]]


@pytest.mark.parametrize("hot,seed", [(500, 1), (2, 2), (2, 3)])
def test_small_windows(spark, monkeypatch, hot, seed):
    monkeypatch.setattr(S, "HOT", hot)
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    got = {r.doc_id: tuple(r)[1:] for r in S.drop_repeats(df, length=64, k=16).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts, 64)


def test_a_document_longer_than_a_batch(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_200_000))
    texts = [long + long[500_000:500_100], "x" + long[1_100_000:1_100_090], "y" * 63 + "z" * 64, "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in S.drop_repeats(df, length=64, k=16).collect()}
    assert [got[i] for i in range(4)] == plain(texts, 64)


def test_hashes_tell_alternating_texts_apart():
    t, u = b"a", b"b"
    for _ in range(10):  # strings that differ in all places, and agree modulo a power of two in any odd base
        t, u = t + u, u + t
    base = 3**38 + 2
    h = S.Hashes([t, u], base)
    n = len(t)
    plain_hash = [sum((c + 1) * pow(base, i, S.PRIME) for i, c in enumerate(x)) % S.PRIME for x in (t, u)]
    got = h.of(np.array([0, n]), np.array([n, 2 * n]))
    assert got.tolist() == S.mixed(np.array(plain_hash, np.uint64)).tolist() and got[0] != got[1]
    x = np.array([0, 1, S.PRIME - 1, 2**60 + 12345, 2**32], np.uint64)
    assert [[int(v) for v in S.times(x, np.uint64(y))] for y in x] == [[int(a) * int(y) % S.PRIME for a in x] for y in x]


def test_testdata(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in S.drop_repeats(docs).collect()}
    assert [got[r.doc_id] for r in rows] == plain([r.text for r in rows], 400)


def test_nulls_repeats_and_empty(spark):
    schema = "doc_id long, text string"
    df = spark.createDataFrame([(None, "q" * 401), (None, "z"), (1, "same " * 90), (1, "same " * 90), (None, None)], schema)
    got = sorted((r.doc_id is None, r.n_bytes, r.n_removed) for r in S.drop_repeats(df).collect())
    assert got == [(False, 450, 450), (False, 450, 450), (True, 0, 0), (True, 1, 0), (True, 401, 401)]
    assert S.drop_repeats(df.limit(0)).count() == 0
    kept = S.drop_repeats(df, with_text=True).where("n_bytes = 1").first()
    assert kept.kept_text == "z"


def test_rows_alike_are_fetched_once(spark, monkeypatch):
    """Thousands of rows alike in id and text, null ids too: what is fetched is no more than there are stretches."""
    text = "".join(random.Random(9).choice("abcdefgh") for _ in range(300))
    variant = text[:150] + "X" + text[151:]
    rows = [(None, text)] * 1500 + [(7, text)] * 1500 + [(8, variant)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fetched = []
    real = S.materialize

    def spy(frame, label):
        out = real(frame, label)
        if label in ("contexts", "asked"):
            fetched.append((label, out.count()))
        return out

    monkeypatch.setattr(S, "materialize", spy)
    got = {(r.doc_id, r.n_removed, r.n_spans) for r in S.drop_repeats(df, length=64, k=16).collect()}
    want = plain([text, text, variant], 64)
    assert got == {(None, *want[0][1:3]), (7, *want[0][1:3]), (8, *want[2][1:3])}
    assert dict(fetched)["contexts"] == dict(fetched)["asked"] > 0


def plain_shared(texts, words):
    """For each text, the places where a string of so many words begins that another text has too."""
    split = [[w for w in re.split(r"[ \t-\r]+", t or "") if w] for t in texts]
    held = [[" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] for w in split]
    rows = Counter(x for h in held for x in set(h))
    return [sum(rows[x] > 1 for x in h) for h in held]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages_of_words_that_other_documents_have(spark, seed):
    rng = random.Random(seed)
    prose = lambda n: " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 3))) for _ in range(n))
    passages = [prose(rng.randint(10, 30)) for _ in range(6)]
    texts = [prose(rng.randint(0, 20)) + rng.choice(" \n\t") + rng.choice(passages) + " " + prose(rng.randint(0, 20)) + " " + rng.choice(passages) for _ in range(50)]
    texts += ["the " * 40, "the " * 25 + "end", "to be " * 15, "to be " * 3 + prose(12), None, "", " ", prose(11), prose(12)]
    texts += [texts[0], texts[1].replace(" ", "\r\n"), texts[2][7:], texts[3][:-9]]
    own = prose(12)
    texts += [own + " x " + own]  # repeated in its own document only
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in S.drop_repeats(df, length=64, k=16, words=12).collect()}
    want = [(*a, b) for a, b in zip(plain(texts, 64), plain_shared(texts, 12))]
    assert [got[i] for i in range(len(texts))] == want
    assert 0 < sum(x[-1] > 0 for x in want) < len(want) and want[-1][-1] == 0


def test_a_passage_of_over_50_words_and_under_400_bytes_is_told(spark, tmp_path):
    """n_removed cannot tell it, as no 400 bytes repeat."""
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage = prose(51)
    rows = [(i, prose(40) + " " + passage + " " + prose(40)) for i in range(3)] + [(9, prose(200)), (None, passage), (None, passage), (7, passage[6:])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id or 0, r.n_removed, r.n_shared) for r in S.query(spark, str(tmp_path)).collect())
    assert got == [(0, 0, 1), (0, 0, 1), (0, 0, 1), (1, 0, 1), (2, 0, 1), (7, 0, 0), (9, 0, 0)]
    assert S.drop_repeats(df.limit(0), words=51).count() == 0
