"""Variants against comparing all pairs of words."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from joulewright.llm import spelling_variants as S

RNG = random.Random(6)


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(words):
    out = {}
    for w, n in words.items():
        close = [v for v in words if near(w, v)]
        best = min(close, key=lambda v: (-words[v], v), default=None)
        out[w] = [n, len(close), best if best and words[best] >= 2 * n else None]
    for w, v in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        v += [words.get(v[2]), root]
    return {w: tuple(v) for w, v in out.items()}


def counted(docs):
    words = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 5 and n >= 3}


def rows(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def vocabulary(letters, sizes, count):
    words = {"".join(RNG.choice(letters) for _ in range(RNG.choice(sizes))): RNG.choice((3, 5, 7, 20, 90, 400)) for _ in range(count)}
    for w in list(words)[: count // 2]:
        k = RNG.randrange(len(w))
        v = RNG.choice((w[:k] + w[k + 1 :], w[:k] + RNG.choice(letters) + w[k:], w[:k] + RNG.choice(letters) + w[k + 1 :]))
        if len(v) >= 5:
            words[v] = RNG.choice((3, 5, 7, 20, 90))
    return words


@pytest.mark.parametrize("letters,sizes,count,most", [("ab", (5, 6, 7), 120, 60), ("abcdeéÉ", (5, 6), 700, 200), ("ab", (40, 41, 300), 200, 500_000), ("aaab", (9, 10, 11), 300, 40)])
def test_random_words(spark, letters, sizes, count, most):
    words = vocabulary(letters, sizes, count)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows(S.spelling_variants(df, most_chars=most)) == plain(words)


def test_windows_are_halved_until_they_fit(spark):
    """Words that agree in all but one place are a group at every width; it ends at one position."""
    words = {f"beginning{a}ending": 3 + k for k, a in enumerate("abcdefghijkl")}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    groups = S.windows(df, 20).groupBy("first", "beyond", "key").count().collect()
    assert min(r.beyond - r.first for r in groups) == 1
    assert rows(S.spelling_variants(df, most_chars=20)) == plain(words)


def test_chains_of_forms(spark):
    words = {"a" * (5 + k): 3 * 2**k for k in range(20)}
    got = rows(S.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == plain(words) and {v[4] for v in got.values()} == {"a" * 24}


def test_wavelet_tree_reports_rectangles():
    for n in (1, 2, 3, 17, 64):
        values = np.random.default_rng(n).permutation(n)
        lo, hi = np.random.default_rng(n + 1).integers(0, n + 1, (2, 200))
        a, b = np.random.default_rng(n + 2).integers(0, n + 1, (2, 200))
        which, value = S.WaveletTree(values).report(lo, np.maximum(lo, hi), a, np.maximum(a, b))
        want = sorted((k, v) for k in range(200) for v in values[lo[k] : hi[k]] if a[k] <= v < b[k])
        assert sorted(zip(which.tolist(), value.tolist())) == want


def test_corpus(spark, monkeypatch):
    monkeypatch.setattr(S, "SLICE", 50)
    monkeypatch.setattr(S, "HELD", 30)
    vocab = list(vocabulary("abcdeEé×", (2, 4, 5, 6, 7), 150))
    docs = [(i, " ".join(RNG.choice(vocab) + RNG.choice(("", ".", "-x", "1")) for _ in range(RNG.randint(0, 60)))) for i in range(300)]
    docs += [(None, "hello " * 5), (301, None), (302, ""), (303, "x" * 500), (303, "x" * 500), (303, "x" * 500), (304, "Hello hellO hełlo " * 3)]
    df = spark.createDataFrame([(i, t, 7, "q") for i, t in docs], "doc_id long, text string, n int, word string")
    got = rows(S.corpus_variants(df))
    assert got == plain(counted(docs)) and "x" * 500 in got and len(got) > 100
    assert S.corpus_variants(df.limit(0)).count() == 0 and S.corpus_variants(df.limit(0)).columns == ["word", "n", "n_near", "form", "form_n", "root"]


def test_the_smallest_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = counted([(r.doc_id, r.text) for r in df.collect()])
    got = rows(S.corpus_variants(df))
    # all pairs of words that share a deletion or are a deletion of the other
    by = {}
    for w in want:
        for v in {w} | {w[:k] + w[k + 1 :] for k in range(len(w))}:
            by.setdefault(v, set()).add(w)
    close = {w: set() for w in want}
    for group in by.values():
        for a in group:
            close[a] |= {b for b in group if near(a, b)}
    assert {w: (v[0], v[1]) for w, v in got.items()} == {w: (n, len(close[w])) for w, n in want.items()}
    for w, (n, _, form, form_n, _) in got.items():
        best = min(close[w], key=lambda v: (-want[v], v), default=None)
        assert (form, form_n) == ((best, want[best]) if best and want[best] >= 2 * n else (None, None))


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = con.sql(S.ORACLE)
    at = [want.columns.index(c) for c in ("word", "n", "n_near", "form", "form_n", "root")]
    assert rows(S.query(spark, d)) == {r[at[0]]: tuple(r[i] for i in at[1:]) for r in want.fetchall()}
