"""Hits and items against a plain search."""

import hashlib
import re

from joulewright.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(docs, items, n=10):
    out = {}
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            for k in range(max(1, len(v) - n + 1) if v else 0):
                window = v[k : k + n]
                for i in range(len(w) - len(window) + 1):
                    if w[i : i + len(window)] == window:
                        hit.update(range(i, i + len(window)))
                        found.add(str(item))
        out[doc_id] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short item"), (10, "short ITEM!"), (3, None), (4, "..."), (5, "été à la mer"), (2, "Short item")]
DOCS = [
    (0, None), (1, ""), (2, "x ONE two, three-four five six seven eight nine ten y"), (3, "two three four five six seven eight nine ten eleven twelve short item short"),
    (4, "short"), (5, "item"), (6, "ÉTÉ été à la mer"), (7, "one two three four five six seven eight nine"), (8, "a short item " * 3000),
]


def frames(spark):
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in DOCS], "doc_id long, text string, term int, shard string").coalesce(1)
    return docs, spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id long, text string, doc_id int")


def test_hits(spark):
    docs, items = frames(spark)
    for block in (1000, 2):
        got = {r.doc_id: tuple(r)[1:] for r in D.decontaminate(docs, items, items_per_block=block).collect()}
        assert got == plain(DOCS, ITEMS)


def test_small_shards(spark, monkeypatch):
    monkeypatch.setattr(D, "SHARD_WORDS", 12)
    docs, items = frames(spark)
    assert {r.doc_id: tuple(r)[1:] for r in D.decontaminate(docs, items).collect()} == plain(DOCS, ITEMS)


def test_testdata(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert {r.doc_id: tuple(r)[1:] for r in D.decontaminate(docs, items).collect()} == want


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x x green blue"), (2, "blue x x x x x x red green"), (3, "green red"), (4, "blue"), (5, "Blue; green, red!")], "doc_id long, text string").coalesce(1)
    got = D.proximity_matches(D.build_index(docs), {"i": ("red", "green", "blue", "red")}, 5).collect()
    assert sorted(r.doc_id for r in got) == [1, 5]


def test_nulls_repeats_and_empty(spark):
    docs, items = frames(spark)
    assert D.decontaminate(docs.limit(0), items).count() == 0
    assert not any(r.contaminated for r in D.decontaminate(docs, items.limit(0)).collect())
    twice = spark.createDataFrame([(None, "short item"), (None, "short item"), (7, "short item"), (7, "short item")], "doc_id long, text string")
    got = D.decontaminate(twice, items).collect()
    assert len(got) == 4 and all(r.contaminated and r.n_items == 2 for r in got)


def test_a_benchmark_of_many_blocks_is_a_plan_of_constant_size(spark):
    docs, items = frames(spark)
    plans = []
    for block in (1000, 1):
        out = D.decontaminate(docs, items, items_per_block=block)
        assert {r.doc_id: tuple(r)[1:] for r in out.collect()} == plain(DOCS, ITEMS)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString().count("\n"))
    assert plans[0] == plans[1]
