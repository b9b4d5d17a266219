"""Token counts of whole documents by overlap resynchronisation.

A document of more than `chunk` characters is given to the tokenizer in chunks (in longer ones
only where it has no stable place, such as one word of that length). Chunks that overlap are encoded with the offsets of their pieces, and two neighbours are
spliced where both of them start a piece at the same character and that start is stable:
no piece of the vocabulary can span it, whatever stands left or right of it. Merges are
confined between such places, so what a chunk says between two of them is what the whole
text would give. If an overlap holds no such place, it is widened, up to the whole rest.

Why a place is stable: the vocabulary has no piece with the word mark after another
character (checked when the model is loaded), so nothing merges over a place where a
single space follows a non-space and a non-space follows it. That space becomes the word
mark that the model itself puts before a text, so a chunk that starts there starts with
its first non-space character.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from joulewright.llm.common import read, text_of

MARK = "▁"
#: The places where a chunk may start: one plain space between two ordinary characters.
STABLE = re.compile(r"(?<=[A-Za-z0-9.,;:!?]) (?=[A-Za-z0-9])")


@lru_cache(maxsize=4)
def load(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if any(MARK in model.id_to_piece(i).lstrip(MARK) for i in range(model.get_piece_size())):
        raise ValueError("a piece holds the word mark inside: no place between words is stable")
    if model.encode("x y", out_type=str) != model.encode("x", out_type=str) + model.encode("y", out_type=str):
        raise ValueError("the model does not mark the start of a text as the start of a word")
    return model


def piece_starts(model, text: str) -> list[int]:
    """Where each piece of text starts, in UTF-8 bytes."""
    return [p.begin for p in model.encode(text, return_type="proto").pieces]


def size(text: str) -> int:
    return len(text.encode())


def count_tokens(model, text: str, chunk: int = 32768, overlap: int = 512) -> int:
    """The number of tokens of text, exactly as one call on the whole text gives it."""
    if len(text) <= chunk:
        return len(model.encode(text, num_threads=1))
    total, start = 0, 0
    while True:
        # [start, end) and what follows it overlap by `wide` characters on each side of end
        end = start + chunk
        if end >= len(text):
            return total + len(model.encode(text[start:], num_threads=1))
        left = piece_starts(model, text[start:end])
        known, wide, cut = set(left), overlap, None
        while cut is None:
            low = max(start + 1, end - wide)
            if first := STABLE.search(text, low, end):
                # the right-hand chunk starts at a stable place inside the overlap
                base = first.end()
                right = set(piece_starts(model, text[base : end + wide]))
                for place in reversed([m.start() for m in STABLE.finditer(text, base, end)]):
                    at = size(text[start:place])
                    if at in known and size(text[base:place]) in right:
                        cut = place
                        break
            if low == start + 1:
                break
            wide *= 2
        if cut is None:
            # nothing to splice at in the whole chunk: a longer one from the same start
            chunk *= 2
            continue
        total += bisect_left(left, at)
        start = cut + 1


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", chunk: int = 32768) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row, whole texts.

    Null texts count as empty (0 bytes, 0 tokens); null ids stay null; repeated rows give
    repeated results; other columns are not read; an empty table gives no rows. One narrow
    pass: no shuffle, and the memory of a task is an Arrow batch and one chunk.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load(model_path)
        for b in batches:
            n = [count_tokens(model, t, chunk) for t in b["text"]]
            yield pd.DataFrame({
                "doc_id": b["doc_id"],
                "n_bytes": [size(t) for t in b["text"]],
                "n_tokens": n,
                "over_limit": [x > limit for x in n],
            })

    return text_of(docs, id_col, text_col).mapInPandas(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
