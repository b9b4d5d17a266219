"""Removal of repeated passages by a depth-limited radix sort of suffixes.

Only the first `length` bytes of a suffix matter, so sorting stops there, and the groups
that are still equal are exactly the repeated windows. The first digit of the sort is
content-defined: a window's anchor is the k-gram with the least hash in it (the first of
equal ones), which equal windows have at the same offset. Windows of one anchor stand next
to each other in a document, so they travel as one row (an anchor and the stretch of its
windows) instead of one each; on average there are length - k of them.

1. Anchors are counted by k-gram and stretch (the hash of all bytes of the windows), with
   partial aggregation. A stretch that occurs again repeats all its windows, and a k-gram
   with one stretch needs no more sorting.
2. For k-grams with several stretches the bytes of one occurrence of each are fetched, and
   their windows are sorted by offset and then by one block of bytes after the other, most
   significant first; what is alone in its group leaves. A k-gram with many stretches (a
   common passage in many surroundings) is no task's group: its next digit is taken as rows
   of a table, one for each band of neighbouring offsets: the bytes that all windows of the
   band share. Only bands that agree in it with another are cut into their windows, which
   are counted by offset and hash; both counts are aggregated before the shuffle.
3. The repeated windows go back to every occurrence of their stretch, documents merge them,
   and the other bytes are kept.

A passage of 51 words can be under 400 bytes, and a string may repeat in its own document only.
shared_passages() therefore goes the same way over words: windows of so many words, anchored at
the least gram of PASSAGE_GRAM words, counted by k-gram and stretch over documents; only where
stretches of a k-gram differ are windows cut out, and counted by their hashes.

A digit is the hash of its bytes, a polynomial modulo the prime 2 ** 61 - 1 in a base that
is drawn anew for each run, and windows are taken as equal when all digits agree: texts
cannot be made to collide, and two different strings of n bytes do with a chance under
n / 2 ** 60.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joulewright.llm.common import hot_keys, join_facts, materialize, read, release, text_of, tidy

#: Bytes of text hashed at once, unless one document has more.
BATCH = 1 << 20
#: Stretches of a k-gram that one task sorts; of more, bands of so many offsets are rows.
HOT, BAND = 200, 32
DIGIT = 80
#: Words of the grams that anchor a passage.
PASSAGE_GRAM = 8
#: times is 0 of a stretch of bytes; of words: how often it occurs in its row, least the number of its windows, most of its bytes.
ANCHORS = "doc_id long, th long, pos long, kg long, stretch long, least int, most int, times int"

ODD = np.uint64(0x9E3779B97F4A7C15)
PRIME = 2**61 - 1


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return x - np.uint64(PRIME) * (x >= np.uint64(PRIME))


def times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """The product modulo PRIME, by halves of 31 bits."""
    low, half = np.uint64(2**31 - 1), np.uint64(31)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    mid = a0 * b1 + a1 * b0
    return reduced(np.uint64(2) * a1 * b1 + (mid >> np.uint64(30)) + ((mid & np.uint64(2**30 - 1)) << half) + a0 * b0)


def times_byte(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product modulo PRIME where b is under 2 ** 29."""
    mid = (a >> np.uint64(31)) * b
    return reduced((mid >> np.uint64(30)) + ((mid & np.uint64(2**30 - 1)) << np.uint64(31)) + (a & np.uint64(2**31 - 1)) * b)


def less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The difference modulo PRIME."""
    return reduced(a + (np.uint64(PRIME) - b))


def running(x: np.ndarray) -> np.ndarray:
    """Running sums modulo PRIME, from 0 on."""
    out = np.zeros(len(x) + 1, np.uint64)
    high = np.cumsum(x >> np.uint64(32), dtype=np.uint64)
    # times 2 ** 32 is a rotation of 61 bits
    high = ((high & np.uint64(2**29 - 1)) << np.uint64(32)) + (high >> np.uint64(29))
    out[1:] = reduced(high + reduced(np.cumsum(x & np.uint64(2**32 - 1), dtype=np.uint64)))
    return out


POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo PRIME; those of a few bases are remembered."""
    held = POWERS.get(base)
    if held is None or len(held) < n:
        held = np.ones(1, np.uint64)
        while len(held) < max(n, BATCH + 2):
            held = np.concatenate((held, times(held, np.uint64(pow(base, len(held), PRIME)))))
        if len(POWERS) >= 4:
            POWERS.clear()
        if len(held) <= 4 * BATCH:
            POWERS[base] = held
    return held[:n]


class Hashes:
    """Hashes of any stretches of pieces of bytes, from the running sums of a polynomial in `base` modulo PRIME.

    Pieces are summed in blocks of about BATCH bytes, so that the powers are a table of that
    size; a stretch lies within a piece. What is held is 8 bytes for each byte.
    """

    def __init__(self, pieces: list[bytes], base: int):
        sums, first, starts, at = [], [], [], 0
        for _, block in batches_of(pieces):
            buf = np.frombuffer(b"".join(block), np.uint8)
            part = running(times_byte(powers(base, len(buf)), buf.astype(np.uint64) + np.uint64(1)))
            first.append(sum(map(len, sums)))
            sums.append(part)
            starts.append(at)
            at += len(buf)
        self.sums = np.concatenate(sums) if sums else np.zeros(1, np.uint64)
        self.first, self.starts = np.array(first or [0], np.int64), np.array(starts or [0], np.int64)
        self.inverse = powers(pow(base, -1, PRIME), max(map(len, sums), default=1))

    @classmethod
    def over(cls, values: np.ndarray, base: int) -> Hashes:
        """Of stretches of numbers instead of bytes, which are below PRIME."""
        h = cls([], base)
        h.sums = running(times(powers(base, len(values)), values))
        h.inverse = powers(pow(base, -1, PRIME), len(h.sums))
        return h

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the bytes from start to end, counted over all pieces."""
        block = np.searchsorted(self.starts, start, "right") - 1
        local, move = start - self.starts[block], self.first[block] - self.starts[block]
        return mixed(times(less(self.sums[end + move], self.sums[start + move]), self.inverse[local]))

    def sliding(self, n: int) -> np.ndarray:
        """Of every n neighbouring bytes of a single block."""
        return mixed(times(less(self.sums[n:], self.sums[:-n]), self.inverse[: len(self.sums) - n]))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w neighbours."""
    n = len(x) - w + 1
    rows = -(-len(x) // w)
    grid = np.full(rows * w, np.iinfo(x.dtype).max, x.dtype)
    grid[: len(x)] = x
    grid = grid.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def joined(texts: list[bytes], base: int) -> tuple[np.ndarray, np.ndarray, Hashes]:
    """Where each text begins, all bytes, and their hashes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    buf = b"".join(texts)
    return np.cumsum(sizes) - sizes, np.frombuffer(buf, np.uint8), Hashes([buf], base)


def runs_of_anchors(h: Hashes, j: np.ndarray, own: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Of the windows that begin at j, in texts own: first and last window of each run with one anchor, its place, k-gram and stretch."""
    grams = h.sliding(k)
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    a = (sliding_min(key, length - k + 1)[j] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (own[1:] != own[:-1])]) if len(j) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(j)] - 1 if len(j) else first
    p = a[first]
    stretch = h.of(j[first], j[last] + length)
    with np.errstate(over="ignore"):
        stretch = mixed(stretch + ((p - j[first]) * 65536 + p - j[last]).astype(np.uint64) * ODD)
    return first, last, p, grams[p], stretch


NONE = np.zeros(0, np.int64)


def anchors_of(starts: np.ndarray, buf: np.ndarray, h: Hashes, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Of all windows of joined texts, by anchor: text, place of the anchor, k-gram, stretch, least and most offset of it in a window."""
    if len(buf) < length:
        return (NONE,) * 6
    windows = np.maximum(np.diff(np.r_[starts, len(buf)]) - length + 1, 0)  # that begin and end in one text
    own = np.repeat(np.arange(len(starts)), windows)
    j = np.arange(len(own)) + np.repeat(starts - np.cumsum(windows) + windows, windows)
    first, last, p, kg, stretch = runs_of_anchors(h, j, own, length, k)
    text = own[first]
    return text, p - starts[text], kg, stretch, p - j[last], p - j[first]


def words_of(starts: np.ndarray, buf: np.ndarray, h: Hashes, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Hashes]:
    """Of all words (runs without ASCII white space) of joined texts: text, begin, end, and hashes over words."""
    solid = (buf != 32) & ((buf < 9) | (buf > 13))
    border = np.zeros(len(buf) + 1, bool)
    border[starts] = True
    border[-1:] = True
    begin = np.flatnonzero(solid & (border[:-1] | ~np.r_[False, solid[:-1]]))
    end = np.flatnonzero(solid & (border[1:] | ~np.r_[solid[1:], False])) + 1
    own = np.searchsorted(starts, begin, "right") - 1
    return own, begin, end, Hashes.over(reduced(h.of(begin, end)), base)


def passages_of(starts: np.ndarray, buf: np.ndarray, h: Hashes, words: int, k: int, base: int) -> tuple[np.ndarray, ...]:
    """Of all windows of so many words of joined texts, by anchor and stretch, once a text: text, byte where the stretch comes
    first, k-gram, stretch, windows and bytes of it, and how often it occurs in the text."""
    own, begin, end, h = words_of(starts, buf, h, base)
    if len(own) < words:
        return (NONE,) * 7
    j = np.flatnonzero(own[: len(own) - words + 1] == own[words - 1 :])
    if not len(j):
        return (NONE,) * 7
    first, last, _, kg, stretch = runs_of_anchors(h, j, own[j], words, k)
    text = own[j[first]]
    order = np.lexsort((stretch, text))  # stable, so the first place of a stretch stays first
    new = np.flatnonzero(np.r_[True, (np.diff(text[order]) != 0) | (stretch[order][1:] != stretch[order][:-1])])
    one, times_ = order[new], np.diff(np.r_[new, len(order)])
    at, to, text = begin[j[first[one]]], end[j[last[one]] + words - 1], text[one]
    return text, at - starts[text], kg[one], stretch[one], (last - first + 1)[one], to - at, times_


def batches_of(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in lists of about BATCH bytes, with the number of the first."""
    start, n = 0, 0
    for i, t in enumerate(texts):
        if i > start and n + len(t) > BATCH:
            yield start, texts[start:i]
            start, n = i, 0
        n += len(t)
    if start < len(texts):
        yield start, texts[start:]


def find_anchors(docs: DataFrame, length: int, k: int, base: int, words: int | None) -> DataFrame:
    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in frames:
            ids, th = b["doc_id"].astype("Int64"), b["th"].to_numpy()
            for start, texts in batches_of([t.encode() for t in b["text"]]):
                whole = joined(texts, base)
                bytes_ = anchors_of(*whole, length, k)
                passages = passages_of(*whole, words, min(PASSAGE_GRAM, words), base) if words else (NONE,) * 7
                text, pos, kg, stretch, least, most = (np.concatenate(x) for x in zip(bytes_, passages))
                own = text + start
                yield pd.DataFrame({
                    "doc_id": ids.take(own).reset_index(drop=True),
                    "th": th[own],
                    "pos": pos,
                    "kg": kg.view(np.int64),
                    "stretch": stretch.view(np.int64),
                    "least": least.astype(np.int32),
                    "most": most.astype(np.int32),
                    "times": np.r_[np.zeros(len(bytes_[0]), np.int32), passages[6]].astype(np.int32),
                })

    return docs.mapInPandas(find, ANCHORS)


@tidy
def shared_passages(found: DataFrame, once: DataFrame, words: int, base: int) -> DataFrame:
    """doc_id, th, n_shared: at how many places a string of so many words begins that another row has too, if at any.

    found: the stretches of words of ANCHORS; once: one of the rows alike in id and text. White space between words does not matter.
    """
    at = [F.first(c).alias(c) for c in ("doc_id", "th", "pos", "most")]  # all of one row
    each = materialize(found.groupBy("kg", "stretch").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("width"), *at), "wordings")
    several = each.groupBy("kg").agg(F.count(F.lit(1)).alias("stretches")).where("stretches > 1").select("kg")
    asked = each.join(several, "kg", "left_semi").drop("width")
    wanted = asked.groupBy(F.col("doc_id").alias("wd"), F.col("th").alias("wt")).agg(F.collect_list(F.struct("kg", "stretch", "n", "pos", "most")).alias("wanted"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in frames:
            asked_, parts = [], []
            for text, row, wanted in zip(b["text"], b["row"], b["wanted"]):
                raw = text.encode()
                for w in wanted:
                    asked_.append((w["kg"], w["stretch"], w["n"], row))
                    parts.append(raw[w["pos"] : w["pos"] + w["most"]])
            for first, block in batches_of(parts):
                own, _, _, h = words_of(*joined(block, base), base)
                windows, size = h.sliding(words).view(np.int64), np.bincount(own, minlength=len(block))
                at = np.cumsum(size) - size
                out = [(*a, windows[i : i + n - words + 1]) for a, i, n in zip(asked_[first:], at, size)]
                yield pd.DataFrame(out, columns=["kg", "stretch", "n", "row", "hashes"])

    with_text = once.join(wanted, F.col("doc_id").eqNullSafe(F.col("wd")) & (F.col("th") == F.col("wt"))).select("text", F.xxhash64("doc_id", "th").alias("row"), "wanted")
    windows = materialize(with_text.mapInPandas(cut, "kg long, stretch long, n long, row long, hashes array<long>"), "windows").withColumn("hash", F.explode("hashes")).drop("hashes")
    common = windows.groupBy("kg", "hash").agg(F.min("row").alias("low"), F.max("row").alias("high"), F.max("n").alias("n")).where("low <> high OR n > 1").select("kg", "hash")
    # a stretch of several rows is shared with all its windows, one of a single row with those that others have
    single = windows.where("n = 1").join(common, ["kg", "hash"], "left_semi").groupBy("kg", "stretch").agg(F.count(F.lit(1)).alias("windows"))
    facts = materialize(single.unionByName(each.where("n > 1").select("kg", "stretch", F.col("width").cast("long").alias("windows"))), "sharings")
    hot = hot_keys(each, ["kg", "stretch"], F.col("n"), found.count())
    met = join_facts(found, facts, ["kg", "stretch"], hot).select("doc_id", "th", F.struct("kg", "stretch", (F.col("windows") * F.col("times")).alias("places")).alias("met"))
    # a set, as rows alike in id and text have the same
    places = F.aggregate(F.collect_set("met"), F.lit(0).cast("long"), lambda n, x: n + x["places"])
    out = materialize(met.groupBy("doc_id", "th").agg(places.alias("n_shared")), "shared")
    release(found.sparkSession)
    return out


def repeated_windows(g: pd.DataFrame, length: int, base: int) -> pd.DataFrame:
    """kg, stretch, start, end: runs of bytes, from the anchor, that windows of several stretches of a k-gram cover.

    g: kg, stretch, least and most (the offsets of the anchor in the windows), bytes.
    """
    low, most = (g[c].to_numpy().astype(np.int64) for c in ("least", "most"))
    sizes = np.array([len(x) for x in g["bytes"]], np.int64)
    starts = np.cumsum(sizes) - sizes
    h = Hashes(list(g["bytes"]), base)
    n = most - low + 1
    row = np.repeat(np.arange(len(g)), n)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]
    at = starts[row] + most[row] - offset
    kg = g["kg"].to_numpy().view(np.uint64)
    with np.errstate(over="ignore"):
        key = mixed(kg[row] + offset.astype(np.uint64) * ODD)
    alive = np.arange(len(row))
    for t in range(-1, -(-length // DIGIT)):
        if t >= 0:
            begin = at[alive] + t * DIGIT
            digit = h.of(begin, np.minimum(begin + DIGIT, at[alive] + length))
            with np.errstate(over="ignore"):
                key = mixed(key * ODD + digit)
        order = np.argsort(key)
        s = key[order]
        same = s[1:] == s[:-1]
        keep = np.zeros(len(s), bool)
        keep[order[1:][same]] = True
        keep[order[:-1][same]] = True
        alive, key = alive[keep], key[keep]
        if not len(alive):
            break
    # neighbouring windows of a row are one run
    new = np.r_[True, (row[alive][1:] != row[alive][:-1]) | (np.diff(offset[alive]) != 1)] if len(alive) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(alive)] - 1 if len(first) else first
    of, hi, lo = row[alive[first]], offset[alive[last]], offset[alive[first]]
    return pd.DataFrame({"kg": g["kg"].to_numpy()[of], "stretch": g["stretch"].to_numpy()[of], "start": (-hi).astype(np.int32), "end": (length - lo).astype(np.int32)})


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def once_of(docs: DataFrame) -> DataFrame:
    """The rows, but of those alike in id and text one, so that what is fetched is as much as there are stretches."""
    again = materialize(docs.groupBy(F.col("doc_id").alias("ad"), F.col("th").alias("at")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "alike")
    alike = F.col("doc_id").eqNullSafe(F.col("ad")) & (F.col("th") == F.col("at"))
    one_each = docs.join(again, alike, "left_semi").groupBy("doc_id", "th").agg(F.first("text").alias("text"))
    return docs.join(again, alike, "left_anti").unionByName(one_each.select(docs.columns))


def sort_windows(docs: DataFrame, once: DataFrame, anchors: DataFrame, length: int, base: int, megabytes: int = 8) -> tuple[DataFrame, DataFrame]:
    """kg, stretch, start, end: what is repeated around each occurrence of a stretch; and kg, stretch, n: how often each occurs."""
    spark = docs.sparkSession
    by_stretch = anchors.groupBy("kg", "stretch").agg(
        F.count(F.lit(1)).alias("n"), F.min("least").alias("least"), F.min("most").alias("most"), *[F.first(c).alias(c) for c in ("doc_id", "th", "pos")]
    )
    by_stretch = materialize(by_stretch, "stretches")
    several = by_stretch.groupBy("kg").agg(F.count(F.lit(1)).alias("stretches")).where("stretches > 1")
    asked = materialize(by_stretch.join(several, "kg").select("kg", "stretch", "least", "most", "stretches", "doc_id", "th", "pos"), "asked")
    release(spark)

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in frames:
            out = []
            for text, wanted in zip(b["text"], b["wanted"]):
                raw = text.encode()
                for w in wanted:
                    part = raw[w["pos"] - w["most"] : w["pos"] - w["least"] + length]
                    hot = w["stretches"] > HOT
                    out.append((w["kg"], w["stretch"], w["least"], w["most"], None if hot else part, bands_of(part, w["least"], w["most"], length, base) if hot else None))
            yield pd.DataFrame(out, columns=["kg", "stretch", "least", "most", "bytes", "bands"])

    wanted = asked.groupBy("doc_id", "th").agg(F.collect_list(F.struct("kg", "stretch", "least", "most", "stretches", "pos")).alias("wanted"))
    with_text = once.join(wanted.withColumnRenamed("doc_id", "wd").withColumnRenamed("th", "wt"), F.col("doc_id").eqNullSafe(F.col("wd")) & (F.col("th") == F.col("wt")))
    contexts = materialize(with_text.select("text", "wanted").mapInPandas(fetch, f"kg long, stretch long, least int, most int, bytes binary, bands array<struct<{BANDS}>>"), "contexts")
    release(spark)

    def sort(g: pd.DataFrame) -> pd.DataFrame:
        return repeated_windows(g, length, base)

    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), asked.count() * 600 // (megabytes << 20))
    cold = contexts.where("bytes IS NOT NULL").drop("bands").withColumn("task", F.pmod(F.xxhash64("kg"), F.lit(tasks)))
    across = cold.groupBy("task").applyInPandas(sort, "kg long, stretch long, start int, end int")
    again = by_stretch.where("n > 1").select("kg", "stretch", (-F.col("most")).cast("int").alias("start"), (F.lit(length) - F.col("least")).cast("int").alias("end"))
    hot = count_windows(contexts.where("bands IS NOT NULL").select("kg", "stretch", "bands"), length)
    return materialize(across.unionByName(again).unionByName(hot), "repeated"), by_stretch.select("kg", "stretch", "n")


BANDS = "band int, low int, high int, core long, full long, hashes array<long>"


def bands_of(part: bytes, least: int, most: int, length: int, base: int) -> list[tuple]:
    """BANDS of the windows of a stretch, by their offsets: low to high of them, the hash of what all windows
    that a band can have share, the hash of all bytes of those it has, and the hashes of its windows."""
    width = max(1, min(BAND, length // 4))
    band = np.arange(least // width, most // width + 1)
    low, high = np.maximum(band * width, least), np.minimum(band * width + width - 1, most)
    h = Hashes([part], base)
    core = h.of(most - band * width, most + length - (band * width + width - 1)).view(np.int64)
    full = h.of(most - high, most - low + length).view(np.int64)
    start = most - np.arange(least, most + 1)
    each = h.of(start, start + length).view(np.int64)
    return [(int(b), int(lo), int(hi), int(c), int(f), each[lo - least : hi - least + 1].tolist()) for b, lo, hi, c, f in zip(band, low, high, core, full)]


def count_windows(hot: DataFrame, length: int) -> DataFrame:
    """What repeated_windows() gives, of any number of stretches of a k-gram, by counting bands and windows natively."""
    each = hot.select("kg", "stretch", F.inline("bands"))
    key = ["kg", "band", "low", "high", "full"]
    # bands alike in all are one row, and repeat all their windows if they are several
    distinct = materialize(each.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.first("core").alias("core"), F.first("hashes").alias("hashes")), "bands")
    shared = distinct.groupBy("kg", "band", "core").agg(F.count(F.lit(1)).alias("alike")).where("alike > 1").drop("alike")
    cut = distinct.join(shared, ["kg", "band", "core"], "left_semi").select(*key, F.posexplode("hashes").alias("i", "hash")).select(*key, (F.col("low") + F.col("i")).alias("offset"), "hash")
    several = cut.groupBy("kg", "offset", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = cut.join(several, ["kg", "offset", "hash"], "left_semi").select(*key, F.col("offset").alias("first"), F.col("offset").alias("last"))
    whole = distinct.where("n > 1").select(*key, F.col("low").alias("first"), F.col("high").alias("last"))
    by_band = in_runs(met.unionByName(whole), key)
    runs = in_runs(each.select("kg", "stretch", *key[1:]).join(by_band, key).select("kg", "stretch", "first", "last"), ["kg", "stretch"])
    return runs.select("kg", "stretch", (-F.col("last")).cast("int").alias("start"), (F.lit(length) - F.col("first")).cast("int").alias("end"))


def in_runs(offsets: DataFrame, by: list[str]) -> DataFrame:
    """by, first, last: the offsets of a key, of which there are under a window's length, in maximal runs."""
    none = F.array().cast("array<struct<first:int,last:int>>")

    def step(runs, x):
        before = F.get(runs, F.size(runs) - 1)
        grown = F.concat(F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0))), F.array(F.struct(before["first"].alias("first"), F.greatest(before["last"], x["last"]).alias("last"))))
        return F.when((F.size(runs) > 0) & (before["last"] + 1 >= x["first"]), grown).otherwise(F.concat(runs, F.array(x)))

    sorted_ = F.sort_array(F.collect_set(F.struct(F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"))))
    return offsets.groupBy(*by).agg(sorted_.alias("all")).select(*by, F.inline(F.aggregate("all", none, step)))


@tidy
def drop_repeats(docs: DataFrame, length: int = 400, k: int = 64, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, words: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and n_shared and kept_text, on request).

    Every byte is removed that a string of `length` bytes covers which starts anywhere else
    too, in the same document or another; overlaps count, and all is judged on the input.
    Null and empty texts have no bytes; texts shorter than `length` keep all. Rows alike in
    id and text repeat each other. A very long text is one string in its task, with some 40
    bytes of hashes for each of its bytes. With `words`, n_shared counts the places where a string
    of so many words begins (whatever ASCII white space is between them) that another row has too,
    however few bytes it has; it removes nothing. Null ids stay null; other columns are not read; an
    empty table gives no rows. kept_text replaces bytes that no longer make up characters.
    """
    spark = docs.sparkSession
    base = secrets.randbelow(PRIME - 2**32) + 2**32
    rows = text_of(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    once = once_of(rows)
    found = materialize(find_anchors(rows.select("doc_id", "th", "text"), length, k, base, words), "anchors")
    anchors = found.where("times = 0").drop("times")
    shared = shared_passages(found.where("times > 0"), once, words, base) if words else None
    repeated, sizes = sort_windows(rows, once, anchors, length, base)
    release(spark)
    hot = hot_keys(sizes, ["kg", "stretch"], F.col("n"), anchors.count())
    hits = join_facts(anchors, repeated, ["kg", "stretch"], hot).select("doc_id", "th", (F.col("pos") + F.col("start")).alias("s"), (F.col("pos") + F.col("end")).alias("e"))
    spans = hits.groupBy(F.col("doc_id").alias("sd"), F.col("th").alias("st")).agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("spans"))
    if words:
        spans = spans.join(shared, F.col("sd").eqNullSafe(F.col("doc_id")) & (F.col("st") == F.col("th")), "full_outer")
        spans = spans.select(F.when(F.col("st").isNull(), F.col("doc_id")).otherwise(F.col("sd")).alias("sd"), F.coalesce("st", "th").alias("st"), "spans", "n_shared")
    spans = materialize(spans, "spans")
    release(spark)

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in frames:
            out = []
            passages = b["n_shared"].fillna(0).astype("int64") if words else [None] * len(b)
            for doc_id, text, found, n_shared in zip(b["doc_id"].astype("Int64"), b["text"], b["spans"], passages):
                raw, at, kept = text.encode(), 0, []
                runs = merged([(x["s"], x["e"]) for x in found]) if found is not None else []
                for s, e in runs:
                    kept.append(raw[at:s])
                    at = e
                left = b"".join([*kept, raw[at:]])
                out.append((doc_id, len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest(), *([n_shared] if words else []), *([left.decode(errors="replace")] if with_text else [])))
            columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["n_shared"] if words else []), *(["kept_text"] if with_text else [])]
            yield pd.DataFrame(out, columns=columns).astype({"doc_id": "Int64"})

    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("sd")) & (F.col("th") == F.col("st")), "left").select("doc_id", "text", "spans", *(["n_shared"] if words else []))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", n_shared long" if words else "") + (", kept_text string" if with_text else "")
    return joined.mapInPandas(keep, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(read(spark, sf_dir, "documents"), words=51)
