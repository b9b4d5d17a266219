"""The trie against plain prefixes."""

import hashlib
import random
import zlib

import duckdb
import pytest

from joulewright.llm import conversation_trie as C

RNG = random.Random(7)
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    turns = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            turns.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    own = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + v[h:]
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        kids = [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p] if len(members) < 400 else None
        out[p] = [min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), kids]
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved, rows_ = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        kids = children.get(p, [])
        leaves[p] = sum(leaves[q] for q in kids) or 1
        saved[p] = sum(saved[q] for q in kids) + ((len(members[p]) - 1) * len(p[-1][1].encode().split()) if p else 0)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(built[c]) == len(p))))
        rows_.append((*out[p][:4], len(kids), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows_, key=lambda r: r[:2])


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=lambda r: r[:2])


def conversations(count, words, longest):
    rows = []
    for c in RNG.sample(range(count * 2), count):
        for t in range(RNG.choice((1, 2, 3, longest))):
            rows.append((c, t, RNG.choice(("user", "assistant")) if RNG.random() < 0.2 else "user", " ".join(RNG.choice(words) for _ in range(RNG.choice((0, 1, 1, 2))))))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"width": 3, "local": 2, "shard": 5}, {"width": 2, "local": 1}, {"width": 64, "local": 3}])
def test_random_conversations(spark, sizes):
    rows = conversations(120, ["a", "b"], 9)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(C.conversation_trie(df, **sizes)) == plain(rows)


def test_copies_ties_nulls_and_clashing_columns(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(40, 60) for t in range(5)]
    rows += [(7, None, "a", "first"), (7, None, None, None), (7, 1, "a", "x"), (7, 1, "a", "x"), (7, 1, "b", "x"), (None, 0, "a", "no conversation"), (-3, 0, "a", "below zero"), (100000, 5, "x", ""), (100001, 5, "x", "q")]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "conv_id long, turn long, role string, text string, depth int, n string")
    assert got(C.conversation_trie(df)) == plain(rows)
    assert got(C.conversation_trie(df, width=1, local=1)) == plain(rows)


def test_turnless_and_empty(spark):
    rows = [(c, 0, "u", "x") for c in range(20, 40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(C.conversation_trie(df)) == plain(rows)
    alone = [(c, 0, "u", "x") for c in range(1, 20)]  # no family's first one: some lose all they have
    df = spark.createDataFrame(alone, "conv_id long, turn long, role string, text string")
    want = plain(alone)
    assert got(C.conversation_trie(df)) == want and want[0][7] != C.NOTHING
    assert got(C.conversation_trie(df.limit(0))) == []


def test_blocks_of_ids(spark, monkeypatch):
    monkeypatch.setattr(C, "ID_BITS", 2)
    monkeypatch.setattr(C, "TURNS", 2)
    rows = [(c, t, "u", f"{t}") for c in range(0, 200, 20) for t in range(6)] + [(c, 0, "u", "q") for c in range(200, 230)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(C.conversation_trie(df, width=4)) == plain(rows)


def test_long_conversations(spark):
    rows = [(c, t, "u", f"{t if t < 500 else t * (c + 1)}") for c in (0, 20, 40) for t in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(C.conversation_trie(df)) == plain(rows)


def test_quicksort_emits_parents_first():
    windows = sorted({tuple(RNG.choice((1, 2)) for _ in range(RNG.randint(0, 6))) for _ in range(60)})
    RNG.shuffle(windows)
    nodes, ends = C.quicksort([list(w) for w in windows], [[1] * len(w) for w in windows], [1] * len(windows), list(range(len(windows))), 0)
    assert len(nodes) == len({w[:k] for w in windows for k in range(1, len(w) + 1)})
    assert all(parent < k and (parent < 0 or nodes[parent][1] + 1 == nodes[k][1]) for k, (parent, *_) in enumerate(nodes))
    assert all((nodes[e][1] if e >= 0 else 0) == len(w) for w, e in zip(windows, ends))


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    want = con.sql(C.ORACLE)
    at = [want.columns.index(c) for c in COLUMNS]
    mine = got(C.query(spark, d))
    assert mine == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=lambda r: r[:2])
    assert mine == plain([tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
