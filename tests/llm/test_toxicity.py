"""Instances from labels of bags: held-out accuracy, places, and odd inputs."""

import math
import random
import re
import zlib
from collections import namedtuple

import numpy as np

from joulewright.llm import toxicity as T

RNG = random.Random(5)
GOOD = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
BAD = ["nasty", "vile", "rotten"]


def document(toxic):
    sentences = [" ".join(RNG.choice(GOOD) for _ in range(RNG.randint(3, 12))) for _ in range(RNG.randint(1, 20))]
    if toxic:
        k = RNG.randrange(len(sentences))
        sentences[k] += " " + RNG.choice(BAD) + " " + RNG.choice(GOOD)
    return ". ".join(sentences) + "."


def corpus(spark, n=900):
    rows = [(i, document(i % 8 == 0), "x", 1.0) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string, score double")
    return docs, spark.createDataFrame([(i, int(i % 8 == 0), i % 2) for i in range(n)], "doc_id long, toxic int, quality int")


def test_held_out_and_places(spark):
    docs, labels = corpus(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = T.toxicity(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == (r.doc_id % 8 == 0) for r in held) / len(held) > 0.97
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        for place in filter(None, r.offending.split(",")):
            a, b = map(int, place.split(":"))
            assert any(w in texts[r.doc_id][a:b] for w in BAD)
    told = [r for r in got if r.doc_id % 8 == 0]
    assert sum(bool(r.offending) for r in told) / len(told) > 0.9


def test_without_toxic_keeps_columns(spark):
    docs, labels = corpus(spark)
    kept = T.without_toxic(docs, T.fit(docs.select("doc_id", "text"), labels))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len([i for i in range(900) if i % 8 and i in ids]) > 770 and len([i for i in range(0, 900, 8) if i in ids]) < 6


def sigmoid(z):
    return 1 / (1 + math.exp(-z))


def test_scores_are_the_noisy_or_of_the_sentences(spark):
    weights = {"vile": 4.0, "vil-": 1.5, "word-": -0.5, "nasty": 7.0, "wordaa": 0.25}
    model = T.Model(weights, -5.0)
    docs, _ = corpus(spark, 200)
    odd = docs.select("doc_id", "text").union(spark.createDataFrame([(None, "Vile! vile, x. VILlain"), (-1, ""), (-2, "..."), (-3, "no-vile nasty_nasty 1vile")], "doc_id long, text string"))

    def plain(text):
        none = 1.0
        for sentence in re.split("[.!?\n|]", text):
            if sentence.strip():
                words = re.findall(r"[^\W\d_]+", sentence.lower())
                has = {f for f in weights for w in words if w == f or f[-1] == "-" and w.startswith(f[:-1])}
                none *= 1 - sigmoid(-5.0 + sum(weights[f] for f in has))
        return 1 - none

    texts = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in odd.collect())
    got = sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in T.score(odd, model).collect())
    assert len(got) == 204 and all(abs(g[2] - plain(t[2])) < 1e-9 for g, t in zip(got, texts))


def test_stems_that_several_words_of_a_text_have():
    assert T.features_of("vile") == ["vile", "vil-"] and T.features_of("vil") == ["vil"]
    assert T.features_in({"vile", "vilest", "vil", "word"}) == {"vile", "vilest", "vil", "word", "vil-", "vil-+", "vile-", "viles-", "wor-"}
    model = T.Model({"vil-": 1.0, "vil-+": 6.0, "wor-+": 9.0}, -4.0)

    def want(*odds):
        return 1 - math.prod(1 - sigmoid(z) for z in odds)

    for text, odds in [
        ("a vile b. c", [-3.0, -4.0]),
        ("Vile, vile. VILE", [-3.0] * 2),  # one word, repeated
        ("vil vile. x", [-3.0, -4.0]),  # a stem alone is no word that has it
        ("vile. villain! x. word", [3.0, 3.0, -4.0, -4.0]),
        ("word words", [5.0]),  # known by its plural alone
        ("word vile", [-3.0]),
    ]:
        score, bad = T.judged(T.Finder(model.weights), model, text)
        assert abs(score - want(*odds)) < 1e-9, text
        assert len(bad.split(",")) == sum(z >= 0 for z in odds) or not bad and max(odds) < 0


def test_training_follows_the_gradient_of_the_noisy_or():
    rng, Row = random.Random(7), namedtuple("Row", "toxic plain sentences")
    rows = [Row(rng.randint(0, 1), rng.randint(0, 3), [rng.sample(range(5), rng.randint(1, 3)) for _ in range(rng.randint(0, 4))]) for _ in range(40)]
    rows = [r for r in rows if r.plain or r.sentences]

    def plain(w):
        total = 0.0
        for r in rows:
            none = (1 - sigmoid(w[5])) ** r.plain
            for s in r.sentences:
                none *= 1 - sigmoid(w[5] + sum(w[f] for f in s))
            total -= math.log(1 - none if r.toxic else none)
        return total / len(rows)

    w = np.array([rng.gauss(0, 1) for _ in range(6)])
    loss, g = T.Bags(rows).loss(w)
    assert abs(loss - plain(w)) < 1e-9
    for i in range(6):
        step = np.eye(6)[i] * 1e-5
        assert abs(g[i] - (plain(w + step) - plain(w - step)) / 2e-5) < 1e-6


def test_labels_of_copies_and_repeated_rows_are_one_observation(spark):
    docs, labels = corpus(spark, 300)
    twice, more = docs.union(docs), labels.union(labels.selectExpr("doc_id", "0 AS toxic", "quality"))
    model, again = (T.fit(d.select("doc_id", "text"), l) for d, l in ((docs, labels), (twice, more)))
    assert model.weights.keys() == again.weights.keys() and abs(model.bias - again.bias) < 1e-6


def test_odd_inputs(spark):
    docs, labels = corpus(spark, 300)
    odd = docs.select("doc_id", "text").union(spark.createDataFrame([(None, None), (None, "nasty"), (5000, ""), (5001, "x " * 60000)], "doc_id long, text string"))
    got = T.toxicity(odd, labels).collect()
    assert len(got) == 304 and all(not r.held_out for r in got if r.doc_id is None)
    assert [r.score for r in got if r.doc_id == 5000] == [0.0]
    none = T.toxicity(odd, labels.where("toxic = 0")).collect()
    assert {r.score for r in none} == {0.0} and {r.predicted for r in none} == {0}
    assert {r.score for r in T.toxicity(odd, labels.limit(0)).collect()} == {0.0}
    assert T.toxicity(odd.limit(0), labels).count() == 0
