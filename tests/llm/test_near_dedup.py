"""SimHash: fingerprints and components against plain versions."""

import random

import numpy as np
import pandas as pd
import pytest
import xxhash

from joulewright.llm import components as components_module
from joulewright.llm import near_dedup as N
from joulewright.llm.components import connected_components


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    n = max(1, len(w) - 3) if w else 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n) if n else 0


def components(fps, ids, radius=4):
    fps, parent = np.array(fps, np.uint64), list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius) + i + 1:
            parent[find(int(j))] = find(i)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


TEXTS = [None, "", " \t\n", "One", "one TWO three", "a b c d", "a b c d", "A b\x0bc\x0cd", "É é ß b c", "x " * 500, "x y z w v", "a\x1cb c d e"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, fp string, least_id int")


def test_fingerprints(spark):
    got = {r.doc_id: r.fingerprint for r in N.near_duplicates(frame(spark, TEXTS)).collect()}
    assert got == {i: f"{plain_fingerprint(t):016x}" for i, t in enumerate(TEXTS)}


@pytest.mark.parametrize("shard,leaf", [(4096, 512), (40, 8), (8, 2)])
def test_links_connect_what_brute_force_connects(spark, shard, leaf):
    rng = random.Random(shard)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(300):  # chains and dense groups
        f = rng.choice(fps)
        for _ in range(rng.randint(1, 4)):
            f ^= 1 << rng.randrange(64)
        fps.append(f)
    fps = sorted(set(fps) | {0, 2**64 - 1, 2**63})
    signed = [int(x) for x in np.array(fps, np.uint64).view(np.int64)]
    edges = N.links(spark.createDataFrame([(x,) for x in signed], "fp long"), len(fps), shard=shard, leaf=leaf)
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 4 for a, b in edges.collect())
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    names = [roots.get(x, x) for x in signed]
    want = components(fps, range(len(fps)))
    assert len(set(zip(names, want))) == len(set(names)) == len(set(want))


def test_dense_group_is_linked_without_all_pairs():
    rng = random.Random(1)
    fps = {0}
    while len(fps) < 3000:
        fps.add(sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    x = np.array(sorted(fps), np.uint64)
    links = np.concatenate(N.link(x, x, 4))
    assert len(links) < 4 * len(x)


def test_testdata(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r for r in N.near_duplicates(docs, shard=200, leaf=32).collect()}
    fps = [plain_fingerprint(r.text) for r in rows]
    assert [got[r.doc_id].fingerprint for r in rows] == [f"{f:016x}" for f in fps]
    assert [got[r.doc_id].component_id for r in rows] == components(fps, [r.doc_id for r in rows])


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (None, None), (5, "a b c d e"), (5, "a b c d e"), (3, "")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in N.near_duplicates(df).collect())
    assert got == [(False, 3, 3), (False, 5, 5), (False, 5, 5), (True, 0, 3), (True, 0, 5)]
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1001 + i) for i in range(50)] + [(7000, 7000)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    first, second = {got[i] for i in range(61)}, {got[1000 + i] for i in range(51)}
    assert len(first) == len(second) == 1 and first != second and 7000 not in got


def test_rounds_grow_with_the_logarithm_of_a_chain(spark, monkeypatch):
    rounds = []
    plain = components_module.contract
    monkeypatch.setattr(components_module, "contract", lambda *a: rounds.append(a[2]) or plain(*a))
    chain = spark.range(10_000).selectExpr("id AS a", "id + 1 AS b")
    got = connected_components(chain)
    assert got.count() == 10_001 and got.select("root").distinct().count() == 1
    assert len(rounds) <= 20


def test_shards_keep_their_size_as_the_input_grows():
    assert [N.sample_size(n, 4096, 20_000, 2_000_000) for n in (100, 10**7, 10**8, 10**12)] == [20_000, 20_000, 195_312, 2_000_000]


def test_a_hot_fingerprint_is_joined_without_a_shuffle_of_its_rows(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "IF(id % 3 = 0, NULL, concat('w', id, ' x y z ', id * 7)) AS text")
    got = N.near_duplicates(df).collect()
    assert sum(r.component_id == 0 for r in got if r.doc_id % 3 == 0) == 2000 and len(got) == 6000


def test_a_batch_is_dealt_in_a_frame_a_tree():
    """However many leaves the trees have, a task hands on few frames; each fingerprint is at home once a tree."""
    fps = np.unique(np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 5000))
    tops = [N.Tree(fps.view(np.uint64), m, 1, 64) for m in N.masks(3)]
    frames = list(N.deal(iter([pd.DataFrame({"fp": fps})]), tops, 1))
    dealt = pd.concat(frames)
    assert len(frames) <= len(dealt) // N.DEALT + 3 and dealt.groupby("tree")["shard"].nunique().min() > 50
    assert (dealt[dealt["home"]].groupby(["tree", "fp"]).size() == 1).all() and dealt["home"].sum() == 3 * len(fps)
