"""Toxicity by multiple-instance learning: labels of documents, scores of sentences.

A document is a bag of sentences. A sentence's score is logistic in the words and word
stems it has, and a document's is the noisy-or of its sentences: one bad sentence is
enough. Only documents are labelled; maximising the likelihood of their labels decides
which sentences must have been meant, and those are reported with their places.

The model is fitted on a bounded sample (`sample` labelled documents, the first in order
of a hash of their ids); the sample is small enough to be broadcast, so no text is
shuffled. Features are words and stems (the first 3 to 8 letters of longer words) that stand
in positive documents clearly more often than in others, counted over the whole sample on the
workers. A stem that several words of a text have is a feature of its own beside the stem:
one such word may be chance where two are none.
How many there are follows from the sample alone. The driver sees them, and for each sampled
document those that each sentence has.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joulewright.llm.common import collected, drop_tables, materialize, read, text_of

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n|]*[^\s.!?|][^.!?\n|]*")
STEMS = range(3, 9)


def features_of(word: str) -> list[str]:
    """The word itself, and its stems, marked by a hyphen; more letters follow a stem, so a whole word is none."""
    return [word, *(word[:k] + "-" for k in STEMS if k < len(word))]


def features_in(words: set[str]) -> set[str]:
    """The features of a text's words; those that two or more of the words have stand there with a plus sign too."""
    n = Counter(f for w in words for f in features_of(w))
    return n.keys() | {f + "+" for f, k in n.items() if k > 1}


@dataclass(frozen=True)
class Model:
    """Of a sentence: the log-odds are bias plus the weights of its features."""

    weights: dict[str, float]
    bias: float

    def sentence(self, found: set[str]) -> float:
        return 1 / (1 + np.exp(-(self.bias + sum(self.weights[f] for f in found))))


class Finder:
    """The known features of words; what was looked up is remembered, up to a bound.

    A text in which no word starts with a known word or stem has no feature; one pass of
    an automaton over the text tells that, and only other texts are cut into words.
    """

    def __init__(self, known: dict[str, object], most: int = 500_000):
        import ahocorasick

        self.known, self.most, self.memo = known, most, {}
        self.single = {f.removesuffix("+") for f in known}
        self.automaton = ahocorasick.Automaton()
        for f in self.single:
            self.automaton.add_word(f.removesuffix("-"), len(f.removesuffix("-")))
        self.automaton.make_automaton()

    def of(self, word: str) -> tuple[str, ...]:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) >= self.most:
                self.memo.clear()
            got = self.memo[word] = tuple(f for f in features_of(word) if f in self.single)
        return got

    def any_in(self, text: str) -> bool:
        text = text.lower()
        return bool(self.known) and any(self.starts(text, end + 1 - n) for end, n in self.automaton.iter(text)) and any(map(self.of, WORD.findall(text)))

    @staticmethod
    def starts(text: str, at: int) -> bool:
        """Whether a word can start there: what is before it is no character of a word."""
        return at == 0 or not text[at - 1].isalnum() or text[at - 1].isdecimal()

    def sentences(self, text: str) -> Iterator[tuple[int, int, set[str]]]:
        n = Counter(f for w in set(WORD.findall(text.lower())) for f in self.of(w))
        also = {f: [f + "+"] for f, k in n.items() if k > 1}
        for m in SENTENCE.finditer(text):
            found = {f for w in WORD.findall(m[0].lower()) for f in self.of(w)}
            yield m.start(), m.end(), {g for f in found for g in (f, *also.get(f, ())) if g in self.known}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, text, toxic of at most `sample` labelled documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.join(F.broadcast(known), "doc_id")


def counted(sample: DataFrame, among: set[str] | None) -> DataFrame:
    """feature, pos, neg: in how many documents of each label a feature stands; of positive ones only, or of those given."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = (Counter(), Counter())
        for b in batches:
            for text, y in zip(b["text"], b["toxic"]):
                if among is not None or y:
                    f = features_in(set(WORD.findall(text.lower())))
                    found[y].update(f if among is None else f & among)
        names = list(found[0].keys() | found[1].keys())
        for k in range(0, len(names), 50_000):
            part = names[k : k + 50_000]
            yield pd.DataFrame({"feature": part, "pos": [found[1][f] for f in part], "neg": [found[0][f] for f in part]})

    each = sample.select("text", "toxic").mapInPandas(count, "feature string, pos long, neg long")
    return each.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def choose(sample: DataFrame, n_pos: int, n_neg: int, least: int, z_least: float, lift: float) -> list[str]:
    """All features that tell: in `least` positive documents, z of their share of positive ones, at least `lift` times the usual share."""
    among = {r.feature for r in counted(sample, None).where(F.col("pos") >= least).collect()}
    share = n_pos / max(1, n_pos + n_neg)
    n = F.col("pos") + F.col("neg")
    z = (F.col("pos") - n * share) / F.sqrt(n * share * (1 - share))
    told = counted(sample, among).where((z >= z_least) & (F.col("pos") >= lift * share * n))
    return [r.feature for r in told.orderBy(F.desc(z), "feature").collect()]


def bags(sample: DataFrame, chosen: list[str]) -> DataFrame:
    """toxic, plain (sentences without a chosen feature), sentences (numbers of the features of the others)."""
    number = {f: i for i, f in enumerate(chosen)}

    def bag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(number)
        for b in batches:
            each = [[f for _, _, f in finder.sentences(t)] for t in b["text"]]
            yield pd.DataFrame({
                "doc_id": b["doc_id"],
                "toxic": b["toxic"],
                "plain": [sum(not f for f in e) for e in each],
                "sentences": [[sorted(number[x] for x in f) for f in e if f] for e in each],
            })

    return sample.mapInPandas(bag, "doc_id long, toxic int, plain long, sentences array<array<int>>")


class Bags:
    """The sampled documents as arrays: labels, plain sentences, and the features of the other sentences."""

    def __init__(self, rows: list):
        self.y = np.array([r.toxic for r in rows], float)
        self.plain = np.array([r.plain for r in rows], float)
        self.bag = np.array([k for k, r in enumerate(rows) for _ in r.sentences], np.int64)
        flat = [s for r in rows for s in r.sentences]
        self.of = np.repeat(np.arange(len(flat)), np.array([len(s) for s in flat], np.int64))
        self.x = np.array([f for s in flat for f in s], np.int64)
        self.sentences = len(flat)

    def loss(self, w: np.ndarray, positive: float = 1.0) -> tuple[float, np.ndarray]:
        """The mean negative log-likelihood of the labels under the noisy-or of weights w (the bias last), and its gradient.

        positive: how many times a positive document counts.
        """
        n = len(w) - 1
        z = w[n] + np.bincount(self.of, w[self.x], self.sentences)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-w[n]))
        log_none = np.bincount(self.bag, -np.logaddexp(0, z), len(self.y)) - self.plain * np.logaddexp(0, w[n])
        log_none = np.minimum(log_none, -1e-12)
        loss = -np.mean(positive * self.y * np.log(-np.expm1(log_none)) + (1 - self.y) * log_none)
        pull = positive * self.y / np.expm1(-log_none) - (1 - self.y)  # of the negative log-likelihood, by log_none
        by_z = -pull[self.bag] * p
        return loss, np.append(np.bincount(self.x, by_z[self.of], n), by_z.sum() - (pull * self.plain).sum() * p0) / len(self.y)


def train(rows: list, chosen: list[str], rounds: int = 600, rate: float = 0.1, shrink: float = 5e-6, weak: float = 0.5, positive: float = 2.0) -> Model:
    """Full-batch Adam on the noisy-or likelihood; the document of a sentence is known, its label is not.

    Positive documents are few, and each of them counts `positive` times. Weights under
    `weak` say next to nothing and are left out.
    """
    data, n = Bags(rows), len(chosen)
    w = np.zeros(n + 1)
    w[n] = -6.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        _, g = data.loss(w, positive)
        g[:n] += shrink * w[:n]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Model({f: float(w[i]) for i, f in enumerate(chosen) if abs(w[i]) >= weak}, float(w[n]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12_000, least: int = 3, z_least: float = 4.0, lift: float = 2.0) -> Model | None:
    """The model, or None where the sample has no document of one of the labels, or nothing tells them apart.

    The size of the model is bounded by that of the sample of labelled documents, whatever
    the corpus; of their features all that tell are taken.
    """
    with collected() as tables:
        # copies of one text are one observation, toxic if any label says so
        once = sampled(docs, labels, sample).groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
        rows = materialize(once, "labelled")
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    model = None
    if len(n) == 2 and (chosen := choose(rows, n[1], n[0], least, z_least, lift)):
        model = train(sorted(bags(rows, chosen).collect(), key=lambda r: r.doc_id), chosen)
    drop_tables(docs.sparkSession, tables)
    return model


def judged(finder: Finder, model: Model | None, text: str) -> tuple[float, str]:
    """The noisy-or of the sentences of a text, and the places of those of 0.5 or more."""
    log_none, bad = 0.0, []
    if model and finder.any_in(text):
        for start, end, found in finder.sentences(text):
            p = model.sentence(found)
            log_none += np.log1p(-min(p, 1 - 1e-12))
            if p >= 0.5:
                bad.append(f"{start}:{end}")
    elif model:
        log_none = np.log1p(-model.sentence(set())) * sum(1 for _ in SENTENCE.finditer(text))
    return float(-np.expm1(log_none)), ",".join(bad)


def score(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, offending (start:end of sentences of 0.5 or more, in code points)."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(model.weights if model else {})
        for b in batches:
            each = [judged(finder, model, t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": [s for s, _ in each], "offending": [o for _, o in each]})

    scored = docs.mapInPandas(judge, "doc_id long, score double, offending string")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "offending")


def without_toxic(docs: DataFrame, model: Model | None, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text scores under the threshold."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(model.weights if model else {})
        for b in batches:
            texts = b.column(b.schema.names.index(text_col)).to_pylist()
            yield b.filter(pa.array([judged(finder, model, t or "")[0] < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **fitting) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= threshold), offending.

    Fitted on labels whose crc32(doc_id as text) mod 3 is not 1; rows without a label of 0
    or 1 are not used; a text with several labels, its copies' too, is toxic if one of them
    says so. Null and empty texts have no sentences and the score 0; a text of any length is
    one string, and its sentences are judged one after the other; a null id is not held out.
    Without a model (no labels, or one kind only) every score is 0. Repeated rows give
    repeated results; other columns are not read; an empty table gives no rows.
    """
    t = text_of(docs, id_col, text_col)
    return score(t, fit(t, labels, **fitting), threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
