"""SimHash near duplicates with vantage-point trees over Hamming distance.

Two fingerprints that differ in at most `radius` of 64 bits differ in at most
radius // blocks bits of one of `blocks` disjoint groups of bits. Hamming distance on such
a group is a pseudometric, so each group has a vantage-point tree of its own, and the
smaller radius within a group leaves few fingerprints near a branch's boundary. The tops
of the trees are built from a sample (its size grows with the number of shards, up to a
bound) and cut the fingerprints into shards: a
fingerprint is at home in one shard of each tree, and visits those that the triangle
bounds do not exclude (|d(v, q) - d(v, p)| <= d(q, p)). A shard splits its residents by a
tree of the same kind, and compares visitors and residents of a leaf on all 64 bits.

Every pair within the radius meets in a leaf. What leaves a shard is not the pairs but
links that connect what they connect: all that lie within the radius of a pivot are linked
to it and not compared with each other, and by the triangle bound only what lies within
twice the radius of it can be near them. A dense group of copies is so linked in about
linear time. Documents with one fingerprint are one row throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joulewright.llm.common import hot_keys, join_facts, materialize, read, release, text_of, tidy
from joulewright.llm.components import connected_components

SEED = 42
BITS = 64
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16
#: Sampled fingerprints for each shard, and fingerprints that a task deals out at once.
SAMPLED, DEALT = 8, 100_000


def fingerprint(text: str, words: int = 4) -> int:
    """The SimHash of the word shingles of text, repeats included; 0 of no words."""
    import xxhash

    w = text.encode().lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    flat = memoryview(b" ".join(w))
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[len(w) - n :] - 1).tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(flat[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, n, BLOCK):
        part = hashes[k : k + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int32)
    return sum(1 << i for i in np.flatnonzero(counts * 2 > n).tolist())


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": fps.view(np.int64)})

    return text_of(docs, id_col, text_col).mapInPandas(take, "doc_id long, fp long")


def masks(blocks: int) -> list[int]:
    """Disjoint groups of neighbouring bits, as even as can be."""
    cut = [BITS * k // blocks for k in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cut, cut[1:])]


def distance(x: np.ndarray, v, mask: int) -> np.ndarray:
    return np.bitwise_count((x ^ np.uint64(v)) & np.uint64(mask))


@dataclass
class Branch:
    """Residents with a distance of at most `limit` from the vantage point go near, others far."""

    vantage: int
    limit: int
    near: Branch | int
    far: Branch | int


class Tree:
    """A vantage-point tree on the bits of a mask, with numbered leaves."""

    def __init__(self, points: np.ndarray, mask: int, radius: int, leaf: float):
        self.mask, self.radius, self.leaves = mask, radius, 0
        self.root = self.grow(points, leaf)

    def leaf(self) -> int:
        self.leaves += 1
        return self.leaves - 1

    def grow(self, points: np.ndarray, leaf: float) -> Branch | int:
        if len(points) <= leaf:
            return self.leaf()
        best = None
        for v in points[:: max(1, len(points) // 4)][:4]:
            d = distance(points, v, self.mask)
            for limit in np.unique(np.quantile(d, (0.35, 0.5, 0.65), method="lower")):
                # the share that must visit both branches, against how even they are
                inside = np.count_nonzero(d <= limit) / len(points)
                if 0 < inside < 1:
                    both = np.count_nonzero((d > int(limit) - self.radius) & (d <= int(limit) + self.radius)) / len(points)
                    even = -np.log2(max(inside, 1 - inside))
                    cost = (np.log2(1 + both) + 0.01) / even
                    if best is None or cost < best[0]:
                        best = (cost, int(v), int(limit), d <= limit)
        if best is None:
            return self.leaf()
        _, v, limit, near = best
        return Branch(v, limit, self.grow(points[near], leaf), self.grow(points[~near], leaf))

    def spread(self, x: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """Each leaf with the places in x of what reaches it within the radius; 0: of what is at home in it."""
        todo: list[tuple[Branch | int, np.ndarray]] = [(self.root, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if isinstance(node, int):
                yield node, at
                continue
            d = distance(x[at], node.vantage, self.mask).astype(np.int64)
            todo.append((node.near, at[d - radius <= node.limit]))
            todo.append((node.far, at[d + radius > node.limit]))


def link(home: np.ndarray, all_: np.ndarray, radius: int) -> list[np.ndarray]:
    """Links (n, 2) that connect what pairs of a resident and any other within the radius connect."""
    out, group, absorbed = [], np.arange(len(all_)), np.zeros(len(all_), bool)
    resident = np.isin(all_, home, assume_unique=True)

    def join(to: int, who: np.ndarray, by: np.ndarray) -> None:
        """who[i] is near by[i], which is in the group of `to`."""
        out.append(np.stack([all_[who], all_[by]], 1))
        group[np.isin(group, group[who])] = group[to]

    for p in np.flatnonzero(resident):
        if absorbed[p]:
            continue
        d = distance(all_, all_[p], 2**64 - 1)
        if np.count_nonzero(d <= 2 * radius) == 1:
            continue
        ball = np.flatnonzero(d <= radius)
        absorbed[ball] = True
        fresh = ball[group[ball] != group[p]]
        if len(fresh):
            join(p, fresh, np.full(len(fresh), p))
        inner = ball[resident[ball]]
        ring = np.flatnonzero((d > radius) & (d <= 2 * radius) & (group != group[p]))
        step = max(1, 4_000_000 // max(1, len(ring)))
        for k in range(0, len(inner), step):
            ring = ring[group[ring] != group[p]]
            if not len(ring):
                break
            part = inner[k : k + step]
            close = np.bitwise_count(all_[ring][:, None] ^ all_[part][None, :]) <= radius
            hit = close.any(1)
            if hit.any():
                join(p, ring[hit], part[close[hit].argmax(1)])
    return out


def sample_size(count: int, shard: int, least: int, most: int) -> int:
    """How many fingerprints the tops of the trees are built from: SAMPLED for each shard, within the bounds."""
    return min(most, max(least, SAMPLED * count // shard))


def in_lists(batches: Iterator[pd.DataFrame], column: str) -> Iterator[np.ndarray]:
    """A column's values in arrays of about DEALT, so that a pass through a large tree is for many of them."""
    held: list[np.ndarray] = []
    for b in batches:
        held.append(b[column].to_numpy())
        if sum(map(len, held)) >= DEALT:
            yield np.concatenate(held)
            held = []
    if held:
        yield np.concatenate(held)


def deal(batches: Iterator[pd.DataFrame], tops: list[Tree], near: int) -> Iterator[pd.DataFrame]:
    """tree, shard, fp, home: each fingerprint at home in a shard of each tree, and in those that it visits."""
    for fps in in_lists(batches, "fp"):
        x = fps.view(np.uint64)
        for t, tree in enumerate(tops):
            home = np.full(len(x), -1)
            for leaf_, at in tree.spread(x, 0):
                home[at] = leaf_
            # one frame a tree, however many leaves are reached
            reached = list(tree.spread(x, near))
            at = np.concatenate([a for _, a in reached])
            leaves = np.repeat([k for k, _ in reached], [len(a) for _, a in reached])
            for k in range(0, len(at), DEALT):
                part, of = at[k : k + DEALT], leaves[k : k + DEALT]
                yield pd.DataFrame({"tree": t, "shard": of, "fp": x[part].view(np.int64), "home": home[part] == of})


def links(distinct: DataFrame, count: int, radius: int = 4, blocks: int = 3, sample: int = 20_000, most: int = 2_000_000, shard: int = 4096, leaf: int = 512) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect all pairs within the radius.

    Shards have about `shard` residents: the driver holds a sample of SAMPLED fingerprints a
    shard for that, at least `sample` and at most `most` of them (as rows of collect() some 100 bytes each), which lasts to
    10^9 distinct fingerprints; beyond that shards grow with the input.
    """
    size = sample_size(count, shard, sample, most)
    some = np.array([r.fp for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(size).collect()], np.int64).view(np.uint64)
    near = radius // blocks
    tops = [Tree(some, m, near, max(float(SAMPLED), shard * len(some) / max(1, count))) for m in masks(blocks)]
    sent = distinct.sparkSession.sparkContext.broadcast(tops)  # once an executor, not once a task

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        x, home, mask = g["fp"].to_numpy().view(np.uint64), g["home"].to_numpy(), masks(blocks)[g["tree"].iloc[0]]
        out = [np.zeros((0, 2), np.uint64)]
        if home.any():
            own = np.sort(x[home])
            tree = Tree(own, mask, near, leaf)
            residents = dict(tree.spread(own, 0))
            for k, at in tree.spread(x, near):
                out += link(own[residents[k]], np.sort(x[at]), radius)
        pairs = np.concatenate(out).view(np.int64)
        return pd.DataFrame({"a": pairs.min(1), "b": pairs.max(1)}).drop_duplicates()

    dealt = distinct.select("fp").mapInPandas(lambda batches: deal(batches, sent.value, near), "tree int, shard int, fp long, home boolean")
    return dealt.groupBy("tree", "shard").applyInPandas(solve, "a long, b long")


@tidy
def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text", **search) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id.

    Fingerprints link at `radius` or fewer differing bits; component_id is the smallest
    doc_id that links reach, itself included (null if all of them are null). Null and
    empty texts have no words and the fingerprint 0, which links like any other; a text of
    any length is one string and BLOCK of its shingles at a time. Documents of one
    fingerprint, however many, are one row of the search. Repeated rows give repeated
    results; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = materialize(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")), "distinct")
    edges = materialize(links(distinct, distinct.count(), radius, **search), "links")
    release(spark)
    roots = connected_components(edges)
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least_id", "n", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    to = materialize(named.join(least, "root").select("fp", "n", "component_id"), "named")
    hot = hot_keys(to, ["fp"], F.col("n"), rows.count())
    return join_facts(rows, to, ["fp"], hot).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
