"""Harmonic packing of whole documents into training sequences.

A document's ids (with the end id) are cut into pieces whose lengths fall into
reciprocal-capacity classes: a piece of length s is in class j = capacity // s, that is
capacity / (j + 1) < s <= capacity / j, and a bin of class j takes exactly j pieces. Cuts
are free, so they are made where a class wastes nothing: full sequences first (class 1),
then the powers of two from capacity / 2 down to `least` (classes 2, 4, 8, ...). What is
left of a document is under `least` tokens; its class j is large, and a full bin of it
wastes under s < `least` tokens.

Every worker fills the bins of its own input partition, so there is no shuffle and no
count that workers share: a sequence id holds the partition's number and the bin's. The
bins that are not full when a partition ends are opened again; their pieces are laid end
to end and cut at capacity, so a partition ends with one short sequence, which is cut into
powers of two, the lengths that need no padding.

Tokens: the fast path uses the rank file of the same vocabulary, and is taken only for
texts whose characters all lie in ranges where both libraries' patterns were tested to
agree; any other text goes to the tokenizer file itself.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from joulewright.llm.common import read, text_of

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Any other character sends the text to the tokenizer file.
UNUSUAL = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ɏ‐-―‘-‟…€]")
SPECIAL = "<|endoftext|>"
#: Bits of a sequence id for the bin's number within its partition.
BIN_BITS = 40


@lru_cache(maxsize=2)
def load(json_path: str, rank_path: str):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    with open(rank_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if SPECIAL in text or UNUSUAL.search(text):
            ids = slow.encode(text, add_special_tokens=False).ids
        else:
            ids = fast.encode_ordinary(text)
        return np.array([*ids, 1], dtype="<u4")

    return encode


def cuts(n: int, capacity: int, least: int) -> list[int]:
    """The lengths of the pieces of a document of n tokens, in order."""
    out = [capacity] * (n // capacity)
    rest, part = n % capacity, capacity // 2
    while part >= least:
        if rest >= part:
            out.append(part)
            rest -= part
        part //= 2
    return out + [rest] * (rest > 0)


class Bins:
    """The open bins of one partition; rows holds the pieces of those that are full."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for p in pieces:
            self.rows.append((*p[:3], zlib.crc32(p[4]), p[3], self.next_id, at))
            at += p[2]
        self.next_id += 1

    def add(self, doc_id, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        j = self.capacity // len(ids)
        piece = (doc_id, start, len(ids), doc_tokens, ids)
        if j == 1:
            self.close([piece])
            return
        held = self.open.setdefault(j, [])
        held.append(piece)
        if len(held) == j:
            self.close(self.open.pop(j))

    def finish(self) -> None:
        """Lay the pieces of the bins that are left end to end; cut the last sequence at powers of two."""
        left = [p for j in sorted(self.open) for p in self.open[j]]
        self.open.clear()
        total = sum(p[2] for p in left)
        sizes = [self.capacity] * (total // self.capacity)
        rest = total % self.capacity
        sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        queue = iter(left)
        piece = next(queue, None)
        for size in sizes:
            bin_, room = [], size
            while room:
                doc_id, start, n, doc_tokens, ids = piece
                take = min(room, n)
                bin_.append((doc_id, start, take, doc_tokens, ids[:take]))
                room -= take
                piece = (doc_id, start + take, n - take, doc_tokens, ids[take:]) if take < n else next(queue, None)
            self.close(bin_)


def pack(docs: DataFrame, json_path: str, rank_path: str, capacity: int = 2048, least: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each id of each document lies in exactly one piece; a sequence's offsets have no gap
    from 0. Null and empty texts are documents of the one end id; null ids stay null;
    repeated rows are packed each; other columns are not read; an empty table gives no
    rows. `capacity` and `least` are powers of two. The layout depends only on how the
    input is split, so a task that runs again gives the same rows; memory is an Arrow
    batch and at most the open bins (under capacity tokens for each class).
    """
    if capacity & (capacity - 1) or least & (least - 1):
        raise ValueError("capacity and least are powers of two")

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load(json_path, rank_path)
        bins = Bins(capacity, TaskContext.get().partitionId() << BIN_BITS)
        columns = [f.split()[0] for f in PIECES.split(", ")]

        def rows() -> pd.DataFrame:
            out, bins.rows = pd.DataFrame(bins.rows, columns=columns), []
            return out.astype({"doc_id": "Int64"})

        for b in batches:
            for doc_id, text in zip(b["doc_id"].astype("Int64"), b["text"]):
                ids, at = encode(text), 0
                for n in cuts(len(ids), capacity, least):
                    bins.add(doc_id, at, ids[at : at + n], len(ids))
                    at += n
            yield rows()
        bins.finish()
        yield rows()

    return text_of(docs, id_col, text_col).mapInPandas(fill, PIECES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path
    return pack(read(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))
