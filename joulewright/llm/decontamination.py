r"""Benchmark decontamination over a stored, distributed positional inverted index.

The index is dealt by documents: each batch of an input partition is a shard that holds
the postings of every term of its documents (term -> positions in the shard, ascending),
and one directory row (the documents and where each one starts). Between documents one
position is left free, so that neighbouring positions always belong to one document.
Building it needs no shuffle, and a passage that many documents share is spread as the
documents are.

A search reads the index once: it selects the postings of all search terms and brings each
shard's together in one row. Then it intersects offset-adjusted position lists, beginning
with the rarest term of the phrase. Benchmarks of any size are searched in blocks of a
bounded number of items and characters against those rows, so what the driver holds and the
workers get is bounded by a block; where there is more than one block, the rows are written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joulewright.llm.common import lower_ascii, materialize, materialize_parts, read, rows_in_blocks, text_of, tidy

#: term null: the directory row, ids with the documents and at with their starts and the end.
INDEX = "shard long, term string, ids array<long>, at array<int>"
#: A byte of a word, lower-cased, or a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Words of a shard at most, unless one document alone has more.
SHARD_WORDS = 2_000_000


def words_of(text: bytes) -> list[bytes]:
    """The words of UTF-8 text: runs of digits, letters a-z and all that is not ASCII."""
    return text.translate(WORD_BYTES).split()


def shard_rows(shard: int, ids: list, docs: list[list[bytes]]) -> pa.RecordBatch:
    sizes = np.array([len(d) for d in docs], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    flat = np.array([w for d in docs for w in d], object)
    at = np.arange(len(flat)) + np.repeat(np.arange(len(docs)), sizes)
    codes, terms = pd.factorize(flat)
    order = np.argsort(codes, kind="stable")
    ends = np.concatenate(([0], np.cumsum(np.bincount(codes, minlength=len(terms)))))
    n = len(terms) + 1
    positions = pa.ListArray.from_arrays(pa.array(np.append(ends, ends[-1] + len(starts)), pa.int32()), pa.array(np.concatenate((at[order], starts)), pa.int32()))
    id_lists = pa.ListArray.from_arrays(pa.array([0] * n + [len(ids)], pa.int32()), pa.array(ids, pa.int64()))
    names = pa.array([*terms, None], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, shard), pa.int64()), names, id_lists, positions], names=["shard", "term", "ids", "at"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The postings of all terms of all whole texts, and a directory row for each shard."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for b in batches:
            ids, held, n = [], [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
                words = words_of(text.as_py())
                if held and n + len(words) > SHARD_WORDS:
                    yield shard_rows(shard, ids, held)
                    shard, ids, held, n = shard + 1, [], [], 0
                ids.append(doc_id)
                held.append(words)
                n += len(words)
            if held:
                yield shard_rows(shard, ids, held)
                shard += 1

    return text_of(docs, id_col, text_col).mapInArrow(build, INDEX)


def windows_of(text: str | None, n: int) -> list[tuple[str, ...]]:
    """n consecutive words each; a text of fewer words, but not none, is one window."""
    w = [x.decode() for x in words_of((text or "").encode())]
    return list(dict.fromkeys(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))) if w else []


def occurs(postings: dict[str, np.ndarray], phrase: tuple[str, ...]) -> np.ndarray:
    """Where the phrase starts: the rarest term's positions, then each next rarest list intersected."""
    lists = [(postings.get(t), k) for k, t in enumerate(phrase)]
    if any(p is None for p, _ in lists):
        return np.zeros(0, np.int64)
    lists.sort(key=lambda x: len(x[0]))
    starts = lists[0][0] - lists[0][1]
    for p, k in lists[1:]:
        at = np.searchsorted(p, starts + k)
        starts = starts[(at < len(p)) & (p[np.minimum(at, len(p) - 1)] == starts + k)]
        if not len(starts):
            break
    return starts


def near(postings: dict[str, np.ndarray], terms: tuple[str, ...], within: int, doc_of) -> np.ndarray:
    """Where a stretch of at most `within` words of one document starts that has all the terms."""
    lists = [postings.get(t) for t in dict.fromkeys(terms)]
    if not lists or any(p is None for p in lists):
        return np.zeros(0, np.int64)
    lefts = np.unique(np.concatenate(lists))
    last = lefts.copy()
    for p in lists:
        at = np.searchsorted(p, lefts)
        inside = at < len(p)
        lefts, last, at = lefts[inside], last[inside], at[inside]
        last = np.maximum(last, p[at])
    close = last - lefts < within
    lefts, last = lefts[close], last[close]
    return lefts[doc_of(lefts) == doc_of(last)]


#: Search terms that may be broadcast (some 10 MB); more of them are joined by a shuffle of the index.
MOST_BROADCAST = 500_000
SHARDS = "shard long, ids array<long>, starts array<int>, postings array<struct<term:string,at:array<int>>>"


def terms_of(items: DataFrame) -> DataFrame:
    """term: the distinct words of the texts of items."""
    cut = F.split(lower_ascii(F.col("text")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return items.where("text IS NOT NULL").select(F.explode(cut).alias("term")).where("term != ''").distinct()


def select(index: DataFrame, terms: DataFrame) -> DataFrame:
    """SHARDS: one row per shard, with the postings of those terms that it has; the index is read once."""
    terms = materialize(terms, "terms")
    wanted = F.broadcast(terms) if terms.count() <= MOST_BROADCAST else terms
    found = index.where("term IS NOT NULL").join(wanted, "term", "left_semi").unionByName(index.where("term IS NULL"))
    head = F.col("term").isNull()
    return found.groupBy("shard").agg(
        F.first(F.when(head, F.col("ids")), ignorenulls=True).alias("ids"),
        F.first(F.when(head, F.col("at")), ignorenulls=True).alias("starts"),
        F.collect_list(F.when(~head, F.struct("term", "at"))).alias("postings"),
    )


def opened(shards: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, np.ndarray, dict[str, np.ndarray]]]:
    """The number, the ids, the starts and the postings of each shard."""
    for b in shards:
        for k in range(b.num_rows):
            shard, ids, starts, postings = (b.column(i)[k] for i in range(4))
            terms, lists = postings.values.flatten() if len(postings) else ((), ())
            at = {t.as_py(): np.asarray(p.values, np.int64) for t, p in zip(terms, lists)}
            yield shard.as_py(), ids.as_py(), np.asarray(starts.values, np.int64), at


def phrase_matches(shards: DataFrame, phrases: dict[tuple[str, ...], list[str]]) -> DataFrame:
    """shard, doc (its place in the shard), doc_id, n_words, spans (start, end, ... of hit words), items.

    phrases: the items that each phrase stands for.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, ids, starts, postings in opened(batches):
            spans: dict[int, list] = {}
            items: dict[int, set] = {}
            for phrase, owners in phrases.items():
                found = occurs(postings, phrase)
                for d, at in zip(np.searchsorted(starts, found, "right") - 1, found):
                    spans.setdefault(d, []).extend((int(at - starts[d]), int(at - starts[d]) + len(phrase)))
                    items.setdefault(d, set()).update(owners)
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, shard), pa.int64()),
                    pa.array(np.arange(n), pa.int64()),
                    pa.array(ids, pa.int64()),
                    pa.array(np.diff(starts) - 1, pa.int64()),
                    pa.array([spans.get(d, []) for d in range(n)], pa.list_(pa.int64())),
                    pa.array([sorted(items.get(d, ())) for d in range(n)], pa.list_(pa.string())),
                ],
                names=["shard", "doc", "doc_id", "n_words", "spans", "items"],
            )

    return shards.mapInArrow(search, "shard long, doc long, doc_id long, n_words long, spans array<long>, items array<string>")


def proximity_matches(index: DataFrame, items: dict[str, tuple[str, ...]], within: int) -> DataFrame:
    """doc_id, item_id, n_matches: documents with all terms of an item in a stretch of `within` words.

    A word stands for itself however often an item has it. Items are a bounded block.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, starts, postings in opened(batches):
            rows = []
            doc_of = lambda at: np.searchsorted(starts, at, "right") - 1
            for item, terms in items.items():
                for d, n in zip(*np.unique(doc_of(near(postings, terms, within, doc_of)), return_counts=True)):
                    rows.append((ids[d], item, int(n)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), (pa.int64(), pa.string(), pa.int64()))], names=["doc_id", "item_id", "n_matches"])

    terms = index.sparkSession.createDataFrame([(t,) for t in sorted({t for p in items.values() for t in p})], "term string")
    return select(index, terms).mapInArrow(search, "doc_id long, item_id string, n_matches long")


@tidy
def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, items_per_block: int = 1000, chars_per_block: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A document word inside any occurrence of a window of an item is hit; windows never
    cross documents. Null and empty texts have no words, and an item without words hits
    nothing; an item without an id is called 'null'. A very long text is a shard of its own,
    and an item of any length a block of its own. Null document ids stay null; repeated
    documents give repeated rows, repeated items count once; other columns are not read.
    An empty benchmark leaves every document clean; no documents, no rows.
    """
    index = materialize(build_index(docs, id_col, text_col), "postings")
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("string").alias("text"))
    shards = select(index, terms_of(bench))
    size = bench.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    if size.items > items_per_block or size.chars > chars_per_block:
        shards = materialize(shards, "shards")

    def blocks() -> Iterator[DataFrame]:
        """The matches of each block of items; the first has every document, the others those that they hit."""
        number = -1
        for number, block in enumerate(rows_in_blocks(bench, "item_id", items_per_block, "text", chars_per_block)):
            phrases: dict[tuple[str, ...], list[str]] = {}
            for item, text in block:
                for w in windows_of(text, window):
                    phrases.setdefault(w, []).append(item)
            part = phrase_matches(shards, phrases)
            yield part.where(F.size("spans") > 0) if number else part
        if number < 0:
            yield phrase_matches(shards, {})

    found = materialize_parts(blocks(), "matches")

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n_hit = [sum(e - s for s, e in merged(x)) for x in b["spans"]]
            items = [sorted(set(x)) for x in b["items"]]
            yield pd.DataFrame({
                "doc_id": b["doc_id"].astype("Int64"),
                "n_words": b["n_words"],
                "n_hit": n_hit,
                "n_items": [len(x) for x in items],
                "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items],
                "contaminated": [x > 0 for x in n_hit],
            })

    by_doc = found.groupBy("shard", "doc").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items")
    )
    return by_doc.mapInPandas(total, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def merged(flat) -> list[list[int]]:
    """Spans (start, end, start, end, ...) as maximal runs."""
    out: list[list[int]] = []
    for s, e in sorted(zip(flat[::2], flat[1::2])):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def oracle(window: int = 10) -> str:
    """The same in SQL: every window of words by lead(), and every length that an item's window has."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    grams = ["w AS g1", *(f"g{n - 1} || ' ' || lead(w, {n - 1}) OVER s AS g{n}" for n in range(2, window + 1))]
    steps = lambda t, key: ", ".join(
        [f"{t}1 AS (SELECT {key}, i, w, w AS g1 FROM {t}0)"]
        + [f"{t}{n} AS (SELECT *, {grams[n - 1]} FROM {t}{n - 1} WINDOW s AS (PARTITION BY {key} ORDER BY i))" for n in range(2, window + 1)]
    )
    every = lambda t, key: " UNION ALL ".join(f"SELECT {key}, i, {n} AS n, g{n} AS g FROM {t}{window} WHERE g{n} IS NOT NULL" for n in range(1, window + 1))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
b AS (SELECT row_number() OVER () AS r, item_id::VARCHAR AS item_id, text FROM benchmark),
x0 AS (SELECT r, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS i FROM (SELECT r, {words} AS l FROM d)),
y0 AS (SELECT r, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS i FROM (SELECT r, {words} AS l FROM b)),
{steps("x", "r")}, {steps("y", "r")},
z AS (SELECT r, max(i) AS n FROM y0 GROUP BY 1),
p AS (SELECT DISTINCT item_id, v.n, v.g FROM ({every("y", "r")}) v JOIN z ON v.r = z.r AND v.n = least(z.n, {window}) JOIN b ON b.r = v.r),
h AS (SELECT v.r, v.i, v.n, p.item_id FROM ({every("x", "r")}) v JOIN p ON v.n = p.n AND v.g = p.g),
c AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM h) GROUP BY 1),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY 1),
n AS (SELECT r, count(*) AS n_words FROM x0 GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""


ORACLE = oracle()
