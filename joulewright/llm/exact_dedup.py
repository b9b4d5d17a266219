"""Exact dedup against a minimal perfect hash of the distinct digests of the history.

The history's distinct digests are dealt to shards by a prefix of the digest. Each shard
builds a minimal perfect hash (levels of bit arrays; a digest's slot is the rank of its
bit) whose slots hold the full digest and the winner's locator, and is one row of an index
table. A batch is reduced to its distinct digests before it is shuffled, looks its digests
up in the shard they belong to, and a hit counts only if all 32 bytes in the slot agree.
Members join the history's group; nonmembers make groups of their own.

Nothing here grows with the size of a group of copies: rows are reduced to one per digest
by partial aggregation before any shuffle by digest, digests that hold a large share of the
rows are joined back by broadcast, and shards are as many as the larger of the history and
the batch needs at `per_shard` digests each, so one shard's memory is bounded.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joulewright.llm.common import ASCII_SPACE, hot_keys, join_facts, materialize, read, tidy

#: A group's winner (most code points, smallest id, first row) and its size.
BEST = "digest binary, n_chars long, keep_id long, keep_row long, group_size long"
SLOT = "<32sqqqqB"
#: Stands for a null id in a slot's locator, with a flag of its own.
NO_ID = 0
ROOM = 1.5  # bits of a level for each digest that is still without a slot


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A hash of 64-bit values for each seed."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Slots 0..n-1 for n distinct digests: a slot is the rank of the bit that is the digest's alone."""

    def __init__(self, levels: list[np.ndarray], fold: int = 0):
        self.levels, self.fold = levels, fold
        self.ranks, base = [], 0
        for bits in levels:
            self.ranks.append(base + np.concatenate(([0], np.cumsum(bits[:-1], dtype=np.int64))) if len(bits) else np.zeros(0, np.int64))
            base += int(bits.sum())

    @staticmethod
    def words(digests: np.ndarray, fold: int = 0) -> np.ndarray:
        """Three quarters of a digest folded to 64 bits, in one way for each number: (n, 32) bytes; the first 8 choose the shard."""
        w = np.ascontiguousarray(digests).view("<u8")
        with np.errstate(over="ignore"):
            odd = np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * fold)
            return w[:, 1] ^ (w[:, 2] * odd) ^ (w[:, 3] * np.uint64(0xC2B2AE3D27D4EB4F))

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        """Of distinct digests. Where two of them fold to one word, they are folded another way."""
        fold = 0
        while len(np.unique(left := cls.words(digests, fold))) != len(left):
            fold += 1
        levels = []
        while len(left):
            size = max(8, int(ROOM * len(left)))
            at = (mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels, fold)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest; -1 where no level has a bit for it (certainly no member)."""
        words = self.words(digests, self.fold)
        out, todo = np.full(len(words), -1, np.int64), np.arange(len(words))
        for k, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = (mix(words[todo], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[todo[hit]] = ranks[at[hit]]
            todo = todo[~hit]
        return out

    def pack(self) -> bytes:
        return struct.pack("<II", len(self.levels), self.fold) + b"".join(struct.pack("<Q", len(b)) + np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def unpack(cls, data: bytes) -> PerfectHash:
        (n, fold), at, levels = struct.unpack_from("<II", data), 8, []
        for _ in range(n):
            (size,) = struct.unpack_from("<Q", data, at)
            nbytes = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, nbytes, at + 8), count=size).astype(bool))
            at += 8 + nbytes
        return cls(levels, fold)


def matrix(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)


def slot_bytes(g: pd.DataFrame) -> list[bytes]:
    null = g["keep_id"].isna()
    ids = g["keep_id"].fillna(NO_ID).astype("int64")
    return [struct.pack(SLOT, *x) for x in zip(g["digest"], g["n_chars"], ids, g["keep_row"], g["group_size"], null)]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, row (a number of its own for each row), digest of the normalised text, code points."""
    row = (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row")
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), row, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    plain = F.translate("text", ASCII_SPACE, "")
    return t.select(
        "doc_id",
        "row",
        F.unhex(F.sha2(plain.cast("binary"), 256)).alias("digest"),
        F.length("text").cast("long").alias("n_chars"),
    )


def rank(n_chars: str, doc_id: str, row: str) -> Column:
    """The order of a group's rows, least first: most code points, smallest id (null last), first row."""
    return F.struct((-F.col(n_chars)).alias("a"), F.col(doc_id).isNull().alias("b"), F.col(doc_id).alias("c"), F.col(row).alias("d"))


def best(df: DataFrame, n_chars: str = "n_chars", doc_id: str = "doc_id", row: str = "row", count: Column | None = None) -> DataFrame:
    """One row per digest, by partial aggregation: its winner and its size."""
    g = df.groupBy("digest").agg(F.min(rank(n_chars, doc_id, row)).alias("w"), (F.count(F.lit(1)) if count is None else F.sum(count)).alias("group_size"))
    return g.select("digest", (-F.col("w.a")).alias("n_chars"), F.col("w.c").alias("keep_id"), F.col("w.d").alias("keep_row"), F.col("group_size").cast("long"))


def shard(shards: int) -> Column:
    return F.pmod(F.xxhash64(F.substring("digest", 1, 8)), F.lit(shards)).cast("int").alias("shard")


def build_index(groups: DataFrame, shards: int) -> DataFrame:
    """shard, hash (levels of bits), slots (each a full digest and its winner's locator) of distinct digests."""

    def build(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        h = PerfectHash.build(matrix(g["digest"]))
        slots = np.empty(len(g), object)
        slots[h.slots(matrix(g["digest"]))] = slot_bytes(g)
        return pd.DataFrame({"shard": [key[0]], "hash": [h.pack()], "slots": [b"".join(slots)]})

    return groups.withColumn("shard", shard(shards)).groupBy("shard").applyInPandas(build, "shard int, hash binary, slots binary")


def look_up(index: DataFrame, groups: DataFrame, shards: int) -> DataFrame:
    """BEST and member of every digest that the index or the batch's groups hold; members are merged."""
    columns = [f.split()[0] for f in BEST.split(", ")]

    def merge(left: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
        if len(left):
            h, slots = PerfectHash.unpack(left["hash"][0]), [*struct.iter_unpack(SLOT, left["slots"][0])]
        else:
            h, slots = PerfectHash([]), []
        at = h.slots(matrix(batch["digest"])) if len(batch) else np.zeros(0, np.int64)
        merged, fresh = dict(enumerate(slots)), []
        batch_ids = batch["keep_id"].fillna(NO_ID).astype("int64")
        for s, *x in zip(at, batch["digest"], batch["n_chars"], batch_ids, batch["keep_row"], batch["group_size"], batch["keep_id"].isna()):
            if s >= 0 and slots[s][0] == x[0]:
                old = slots[s]
                first = min(old, x, key=lambda v: (-v[1], v[5], v[2], v[3]))
                merged[s] = (*first[:4], old[4] + x[4], first[5])
            else:
                fresh.append(x)
        rows = pd.DataFrame([(*v, True) for v in merged.values()] + [(*v, False) for v in fresh], columns=[*columns, "null_id", "member"])
        rows["keep_id"] = rows["keep_id"].astype("Int64").mask(rows.pop("null_id").astype(bool))
        return rows

    return index.groupBy("shard").cogroup(groups.withColumn("shard", shard(shards)).groupBy("shard")).applyInPandas(merge, f"{BEST}, member boolean")


def shards_of(history: int, batch: int, per_shard: int, least: int) -> int:
    """As many as the larger side needs, so that neither side of a shard grows with the input."""
    return max(1, -(-max(history, batch) // per_shard), min(64, least))


@tidy
def dedup(docs: DataFrame, history: Column | None = None, per_shard: int = 50_000, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, row, keep_id, group_size, kept, text_sha256, member.

    `history` says which rows make up the history that the index is built from (a condition
    on doc_id, null: none of them; by default half of the ids, by a hash); the result does
    not depend on it, but `member` (the digest was in the index) does. `row` is the row's
    number, that of `row_col` where it is given (unique, not null). Texts are equal when
    identical without ASCII white space; the row with the most code points, then the
    smallest id, stays. Null and empty texts are equal to each other; a text of any length
    is read as one string and leaves as its digest. Null ids come last and have a null
    keep_id among themselves; of rows alike in all, one stays. Other columns are not read;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = materialize(keyed(docs, id_col, text_col, row_col), "digests")
    history = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0 if history is None else history
    old = F.coalesce(history, F.lit(False))
    groups = materialize(best(rows.where(old)), "history")
    batch = materialize(best(rows.where(~old)), "batch")
    shards = shards_of(groups.count(), batch.count(), per_shard, int(spark.conf.get("spark.sql.shuffle.partitions")))
    index = materialize(build_index(groups, shards), "index")
    winners = materialize(look_up(index, batch, shards).drop("n_chars"), "winners")
    hot = hot_keys(winners, ["digest"], F.col("group_size"), rows.count())
    return join_facts(rows, winners, ["digest"], hot).select(
        "doc_id",
        "row",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "member",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents")).drop("row", "member")


ORACLE = r"""
WITH k AS (
  SELECT doc_id, coalesce(text, '') AS text,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER w = 1 AS kept
  FROM k WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM r
"""
