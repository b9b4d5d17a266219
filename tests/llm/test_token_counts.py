"""Token counts in overlapping chunks against one call on the whole text."""

import random

import public_tokenizers as P
import pytest

from joulewright.llm import token_counts as T

MODEL = P.path("piece_bpe_32k.model")
RNG = random.Random(4)
WORDS = ["the", "of", "Größe", "naïve", "x", "1234", "end.", "a,b", "日本", "<s>", "▁"]
TEXTS = [None, "", " ", "  two  spaces ", "x" * 4000, " " * 3000, "a b" * 2000, "é ü " * 1500, "tab\tand\nline " * 400, "no stable place é " * 10 + "é é " * 900]
TEXTS += [" ".join(RNG.choice(WORDS) for _ in range(RNG.randint(1, 2500))) for _ in range(40)]


@pytest.mark.parametrize("chunk,overlap", [(200, 8), (777, 64), (3000, 512)])
def test_chunks_count_like_whole_texts(chunk, overlap):
    model = T.load(MODEL)
    for t in TEXTS:
        assert T.count_tokens(model, t or "", chunk, overlap) == len(model.encode(t or "")), (t or "")[:50]


def test_operator(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)] + [(None, "a", 0)], "doc_id long, text string, n_bytes int")
    model = T.load(MODEL)
    got = {r.doc_id: r for r in T.token_counts(df, MODEL, limit=100, chunk=500).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        n = len(model.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 100)
    assert T.token_counts(df.limit(0), MODEL).count() == 0


def test_given_tables_and_repeated_rows(spark):
    model = T.load(MODEL)
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = sorted((r.doc_id, len(model.encode(r.text or ""))) for r in df.collect())
    # chunks so short that most texts are spliced
    got = sorted((r.doc_id, r.n_tokens) for r in T.token_counts(df.unionAll(df), MODEL, chunk=700).collect())
    assert got == sorted(want + want)
