"""Spelling variants of a corpus's words by two-dimensional range reporting.

A word is a point: its place in the order of all words, and its place in the order of all
words read backwards. The words that differ from a word only at one edit position are those
in the rectangle of what begins like it before that position and what ends like it behind
it. So for each word and each edit position the interval of the prefix in forward order is
intersected with the interval of the suffix in reverse order, and a wavelet tree over the
reverse places, in forward order, reports what both hold: time goes with what is found.

For replacements a word looks among the words of its own length; for deletions it looks, as
a visitor, among those one shorter (insertions are the same pairs from the other side). Of a
run of equal letters only the last is deleted, so each pair of words is found at one place.

The work is dealt out by windows of edit positions: words of a length that agree before and
behind a window of positions can only be near each other within it. First a window is half of
a word; a group of more than `most_chars` is split again by halving its window, down to one
position, where at most an alphabet of words is left. No group is cut short, and no pair of
words meets twice.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joulewright.llm.common import materialize, read, text_of, tidy

#: The least code points of a word, and the number of which one divides the hash of a run that loses a code point.
LEAST, LOST = 5, 97
RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST},}}")
#: Words that a task counts before it hands them on; characters of a text that are looked at at once.
HELD, SLICE = 200_000, 1 << 20
#: What is no letter of a run, where a long text may be cut.
APART = re.compile("[^A-Za-zÀ-ÿ]")


def slices(text: str) -> Iterator[str]:
    """A text in parts that are cut where no run goes on."""
    at = 0
    while len(text) - at > SLICE:
        cut = APART.search(text, at + SLICE)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def words_of(doc_id: int | None, text: str) -> Counter:
    """How often each word is in a text, after the runs that lose a code point have lost it."""
    runs: Counter = Counter()
    for part in slices(text):
        runs.update(RUN.findall(part.encode().lower().decode()))  # of bytes, lower() is for A-Z alone
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for w, n in runs.items():
        h = zlib.crc32(w.encode(), start)
        if h % LOST == 0:
            k = h % len(w)
            w = w[:k] + w[k + 1 :]
            if len(w) < LEAST:
                continue
        out[w] += n
    return out


def count_words(docs: DataFrame, least_n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of all words that occur least_n times or more; counted within tasks before they are shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for b in batches:
            ids = b["doc_id"].astype("Int64")
            for k, (null, text) in enumerate(zip(ids.isna(), b["text"])):
                held.update(words_of(None if null else int(ids.iloc[k]), text))
                if len(held) > HELD:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held.clear()
        yield pd.DataFrame({"word": pd.Series(list(held), dtype=object), "n": pd.Series(list(held.values()), dtype="int64")})

    parts = text_of(docs, id_col, text_col).mapInPandas(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


class WaveletTree:
    """Distinct values 0..n-1 in some order, level by level by their bits; reports those of a range that lie in another."""

    def __init__(self, values: np.ndarray):
        self.depth = max(1, int(len(values) - 1).bit_length()) if len(values) else 1
        self.before: list[np.ndarray] = []  # of each level, the zeros before each place
        for bit in reversed(range(self.depth)):
            zero = (values >> bit & 1) == 0
            self.before.append(np.concatenate(([0], np.cumsum(zero))))
            values = np.concatenate((values[zero], values[~zero]))

    def report(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, beyond: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value) of each value at places [lo, hi) that lies in [least, beyond)."""
        at, base = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for level, before in enumerate(self.before):
            width = 1 << (self.depth - level - 1)
            zeros = before[-1]
            lo0, hi0 = before[lo], before[hi]
            parts = []
            for a, b, c in ((lo0, hi0, base), (zeros + lo - lo0, zeros + hi - hi0, base + width)):
                some = (a < b) & (c < beyond[at]) & (c + width > least[at])
                parts.append((a[some], b[some], c[some], at[some]))
            lo, hi, base, at = (np.concatenate(x) for x in zip(*parts))
        return at, base


class Order:
    """The order of some words of which neighbours' common beginnings are known."""

    def __init__(self, words: np.ndarray, resident: np.ndarray):
        n, width = len(words), words.dtype.itemsize
        order = np.argsort(words, kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[order] = np.arange(n)
        letters = words[order].view(np.uint8).reshape(n, width)
        common = np.full(n + 1, -1, np.int32)  # with the one before
        for k in range(1, n, step := max(1, (1 << 24) // width)):
            to = min(n, k + step)
            differ = letters[k:to] != letters[k - 1 : to - 1]
            common[k:to] = np.where(differ.any(1), differ.argmax(1), width)
        #: the least of each 2 ** k neighbours
        self.least = [common]
        while 2 << (len(self.least) - 1) <= n:
            half, last = 1 << (len(self.least) - 1), self.least[-1]
            self.least.append(np.concatenate((np.minimum(last[:-half], last[half:]), np.full(half, -1, np.int32))))
        self.most = np.maximum(common[:-1], common[1:])[self.place]
        self.residents = np.concatenate(([0], np.cumsum(resident[order])))
        self.own = order[resident[order]]  # the residents in this order

    def interval(self, word: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The residents, by their places among the residents, that begin like each word for so many letters."""
        n = len(self.place)
        lo = self.place[word]
        hi = lo + 1
        for k in reversed(range(len(self.least))):
            size, least = 1 << k, self.least[k]
            hi = np.where((hi + size <= n) & (least[np.minimum(hi, n)] >= length), hi + size, hi)
            start = lo - size + 1
            lo = np.where((start >= 1) & (least[np.maximum(start, 0)] >= length), lo - size, lo)
        return self.residents[lo], self.residents[hi]


def backwards(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The words read from their ends."""
    n, width = len(words), words.dtype.itemsize
    letters = words.view(np.uint8).reshape(n, width)
    at = lengths[:, None] - 1 - np.arange(width)[None, :]
    return np.where(at >= 0, np.take_along_axis(letters, np.maximum(at, 0), 1), 0).astype(np.uint8).view(f"S{width}").ravel()


def near_pairs(size: int, words: list[bytes], visits: np.ndarray, first: np.ndarray, beyond: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, near word) by their places in `words`, each pair once in each direction.

    Residents have `size` letters, visitors one more; each looks at its edit positions in [first, beyond).
    A word may be given several times, for windows of its own: the first of them stands for all.
    """
    text, index, of = np.unique(np.array(words, f"S{size + 1}"), return_index=True, return_inverse=True)
    visitor = visits[index]
    length = size + visitor.astype(np.int64)
    forward, reverse = Order(text, ~visitor), Order(backwards(text, length), ~visitor)
    # only positions up to which some other word begins alike and behind which some other one ends alike
    low = np.maximum(first, length[of] - 1 - reverse.most[of])
    count = np.maximum(np.minimum(np.minimum(beyond, length[of]), forward.most[of] + 1) - low, 0)
    word = np.repeat(of, count)
    edit = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    letters = text.view(np.uint8).reshape(len(text), size + 1)
    last_of_run = (edit == length[word] - 1) | (letters[word, edit] != letters[word, np.minimum(edit + 1, size)])
    some = ~visitor[word] | last_of_run
    word, edit = word[some], edit[some]
    lo, hi = forward.interval(word, edit)
    least, most = reverse.interval(word, length[word] - 1 - edit)
    alone = np.where(visitor[word], 0, 1)  # a resident is in its own rectangle
    some = (hi - lo > alone) & (most - least > alone)
    word, lo, hi, least, most = word[some], lo[some], hi[some], least[some], most[some]
    places = np.empty(len(text), np.int64)
    places[reverse.own] = np.arange(len(reverse.own))
    which, value = WaveletTree(places[forward.own]).report(lo, hi, least, most)
    a, b = word[which], reverse.own[value]
    a, b = a[a != b], b[a != b]
    other = visitor[a]
    return index[np.concatenate((a, b[other]))], index[np.concatenate((b, a[other]))]


def solve(g: pd.DataFrame) -> pd.DataFrame:
    """word, n_near, best_n, best of the words of a shard, as far as the shard knows."""
    parts = []
    for size, rows in g.groupby("size", sort=True):
        words, n = rows["word"].tolist(), rows["n"].to_numpy()
        a, b = near_pairs(int(size), words, rows["visitor"].to_numpy(bool), rows["first"].to_numpy(np.int64), rows["beyond"].to_numpy(np.int64))
        if not len(a):
            continue
        _, order = np.unique(np.array(words, f"S{size + 1}"), return_inverse=True)
        by = np.lexsort((order[b], -n[b], a))
        a, b = a[by], b[by]
        starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        parts.append(pd.DataFrame({
            "word": [words[k].decode("latin-1") for k in a[starts]],
            "n_near": np.diff(np.append(starts, len(a))),
            "best_n": n[b[starts]],
            "best": [words[k].decode("latin-1") for k in b[starts]],
        }))
    return pd.concat(parts) if parts else pd.DataFrame({"word": [], "n_near": [], "best_n": [], "best": []}).astype({"word": object, "n_near": "int64", "best_n": "int64", "best": object})


def key() -> Column:
    """What words must agree in to be near within a window: size, window, what is before it and behind it."""
    behind = F.greatest(F.col("size") - F.col("beyond"), F.lit(0))
    return F.xxhash64("size", "first", "beyond", F.expr("left(word, first)"), F.when(behind > 0, F.right("word", behind)).otherwise("")).alias("key")


def halves(rows: DataFrame) -> DataFrame:
    """Each row twice, with the two halves of its window."""
    middle = F.expr("(first + beyond) div 2").cast("int")
    ends = F.array(F.struct(F.col("first").alias("first"), middle.alias("beyond")), F.struct(middle.alias("first"), F.col("beyond").alias("beyond")))
    return rows.select("word", "n", "size", "visitor", F.explode(ends).alias("w")).select("word", "n", "size", "visitor", "w.first", "w.beyond")


def windows(words: DataFrame, most_chars: int) -> DataFrame:
    """word, n, size, visitor, first, beyond, key: the rows of all windows, whose groups have at most most_chars, or one position."""
    length = F.length("word")
    among = F.array(F.struct(length.alias("size"), F.lit(False).alias("visitor")), F.struct((length - 1).alias("size"), F.lit(True).alias("visitor")))
    rows = words.select("word", "n", F.explode(among).alias("x")).where(F.col("x.size") >= LEAST)
    # of `size` letters plus one that a visitor has, any may be the edit position
    whole = rows.select("word", "n", "x.size", "x.visitor", F.lit(0).alias("first"), (F.col("x.size") + 1).alias("beyond"))
    todo, done = materialize(halves(whole).withColumn("key", key()), "windows"), None
    while True:
        large = materialize(todo.groupBy("key", (F.col("beyond") - F.col("first")).alias("width")).agg(F.sum(F.length("word")).alias("chars")).where((F.col("chars") > most_chars) & (F.col("width") > 1)).select("key"), "large")
        if large.isEmpty():
            return todo if done is None else done.unionByName(todo)
        fits = todo.join(large, "key", "left_anti")
        done = fits if done is None else done.unionByName(fits)
        todo = materialize(halves(todo.join(large, "key", "left_semi")).withColumn("key", key()), "windows")


def last_forms(links: DataFrame) -> DataFrame:
    """word, root: from each word with a form, the form that has none, by doubling: links are followed to where they lead."""
    todo, done = links.select("word", F.col("form").alias("root")), None
    while True:
        step = todo.alias("a").join(todo.alias("b"), F.col("a.root") == F.col("b.word"), "left").select("a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved"))
        step = materialize(step, "roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        todo = step.select("word", "root")


@tidy
def spelling_variants(words: DataFrame, most_chars: int = 500_000) -> DataFrame:
    """word, n, n_near, form, form_n, root of each word of words (word of Latin-1 letters and LEAST code points or more, n).

    Two words are near if one inserted, deleted or replaced code point makes one of the other.
    form: the near word of the largest n, then the least in code-point order, if its n is
    twice the word's or more, else null; root: the last of the forms of forms (n grows along
    them, so they end), or the word. most_chars bounds a task's group, not what is found.
    Words are distinct; an empty table gives no rows.
    """
    spark = words.sparkSession
    rows = windows(words, most_chars)
    total = rows.agg(F.sum(F.length("word"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // most_chars))
    dealt = rows.select(F.encode("word", "ISO-8859-1").alias("word"), "n", "size", "visitor", "first", "beyond", F.pmod("key", F.lit(shards)).alias("shard"))
    found = dealt.repartition(shards, "shard").groupBy("shard").applyInPandas(lambda g: solve(g), "word string, n_near long, best_n long, best string")
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("a"), F.col("best").alias("b"))).alias("first"))
    fits = -F.col("first.a") >= 2 * F.col("n")
    formed = materialize(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("first.b")).alias("form"), F.when(fits, -F.col("first.a")).alias("form_n")), "forms")
    roots = last_forms(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


@tidy
def corpus_variants(docs: DataFrame, least_n: int = 3, id_col: str = "doc_id", text_col: str = "text", **search) -> DataFrame:
    """spelling_variants() of the words of whole texts: runs of Latin letters in lower A-Z.

    A run of which LOST divides the CRC-32 of `<id>:<run>` loses one code point (a null id is
    written as nothing). Words are the results of LEAST code points or more that occur least_n
    times or more. Null and empty texts have none; a long text is read in slices; repeated
    rows count again; other columns are not read; an empty table gives no rows.
    """
    return spelling_variants(materialize(count_words(docs, least_n, id_col, text_col), "words"), **search)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_variants(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE k AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc),
r AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' AS id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents),
d AS (SELECT id, run, count(*) AS n FROM r WHERE length(run) >= 5 GROUP BY ALL),
h AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(id || run, ''),
      lambda s: CASE WHEN unicode(s) < 128 THEN [unicode(s)::BIGINT] ELSE [195, unicode(s)::BIGINT - 64] END))),
    lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]))) AS h
  FROM d, k),
l AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM l WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
x AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
p AS (
  SELECT a.word, b.word AS near, b.n FROM x AS a JOIN x AS b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT x.word, w.word, w.n FROM x JOIN w ON x.less = w.word
  UNION SELECT w.word, x.word, x.n FROM x JOIN w ON x.less = w.word),
b AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS near_n FROM p GROUP BY word),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form,
    CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
  FROM w LEFT JOIN b ON w.word = b.word),
c AS (
  SELECT word, word AS root, 0 AS steps FROM f
  UNION ALL SELECT c.word, f.form, steps + 1 FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.*, z.root FROM f JOIN (SELECT word, arg_max(root, steps) AS root FROM c GROUP BY word) AS z ON f.word = z.word
"""
