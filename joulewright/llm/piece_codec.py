"""Exact SentencePiece (merge type) encoding by backtracking, and decoding.

The library joins the neighbours with the best score, left-most first, until nothing joins.
What it gives has two properties: each token is what its own text gives, and each two
neighbours are what their joined text gives; and a row of tokens with both properties is what
the library gives (the first merge over a boundary of such a row would also be made in the
text of the two tokens beside that boundary alone). So the encoding can be searched for:

- an Aho-Corasick automaton of the pieces that give themselves finds the longest piece at
  every place, and a table the next shorter piece that a piece begins with;
- the longest piece whose end has not failed, and that is compatible with the token before it
  (checked by merging the text of the two again; kept in a table), is taken;
- if there is none, this place is marked in a bitfield of failed positions, and the last token
  is given back for a shorter one. The tokens of a prefix are its encoding, which is unique,
  so a place that fails once fails for ever: the search is linear.

A text is cut where no piece can reach over: before a word mark that follows another character
(checked of the vocabulary when it is loaded) and around characters that the vocabulary lacks,
which become their bytes. The units between such cuts are encoded on their own, and the
recent ones are kept.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joulewright.llm.common import read, text_of

MARK = "▁"
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: The score of two neighbours that make no piece.
NONE = float("-inf")
#: Units in a generation of the cache, the most characters of such a unit, and pairs of tokens that are remembered.
KEPT, KEPT_CHARS, PAIRS = 300_000, 64, 1_000_000
#: Characters of texts after which a task hands on what it has.
HANDED = 1 << 23


class Codec:
    """Encoding and decoding with the vocabulary of one model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.pieces = [model.id_to_piece(i) for i in ids]
        plain = [i for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]
        self.bytes_of = {int(self.pieces[i][3:5], 16): i for i in ids if model.is_byte(i)}
        self.byte_at = {i: b for b, i in self.bytes_of.items()}
        self.hidden = {i for i in ids if model.is_control(i)}
        if len(self.bytes_of) != 256 or any(model.is_unused(i) for i in ids):
            raise ValueError("not a vocabulary with bytes for unknown characters and without unused pieces")
        if any(MARK in self.pieces[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece holds the word mark after another character")
        if model.normalize("x  y ") != f"{MARK}x{MARK}{MARK}y{MARK}":
            raise ValueError("the model marks the start of a text or its spaces in another way")
        self.score = {self.pieces[i]: model.get_score(i) for i in plain}
        self.length = [len(p) for p in self.pieces]
        # pieces that merging cannot reach are no token of any encoding
        own = {self.pieces[i]: i for i in plain if self.merge(self.pieces[i]) == [self.pieces[i]]}
        self.automaton = ahocorasick.Automaton()
        for p, i in own.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        #: the next shorter piece that a piece begins with, or -1
        self.shorter = [-1] * len(self.pieces)
        for p, i in own.items():
            self.shorter[i] = next((own[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in own), -1)
        #: each piece as it is decoded, but for odd ones
        self.shown = [p.replace(MARK, " ") for p in self.pieces]
        self.odd = frozenset(ids) - frozenset(plain)
        self.pairs: dict[int, bool] = {}
        self.units = Recent(self.of_unit)

    def merge(self, text: str) -> list[str]:
        """The symbols of a short text after all merges, best score first and left-most of equal ones."""
        s, score = list(text), self.score.get
        scores = [score(a + b, NONE) for a, b in zip(s, s[1:])]
        while scores and (best := max(scores)) > NONE:
            at = scores.index(best)
            s[at : at + 2] = [s[at] + s[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = score(s[at - 1] + s[at], NONE)
            if at < len(scores):
                scores[at] = score(s[at] + s[at + 1], NONE)
        return s

    def compatible(self, left: int, right: int) -> bool:
        """Whether the texts of two tokens, joined and merged again, are these two tokens. It is remembered."""
        a, b = self.pieces[left], self.pieces[right]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        fit = self.pairs[left * len(self.pieces) + right] = self.merge(a + b) == [a, b]
        return fit

    def search(self, best: list[int] | array, start: int, end: int) -> list[int]:
        """The tokens of [start, end), all of whose characters the vocabulary has; best: the longest piece at each place."""
        length, shorter, pairs, many = self.length, self.shorter, self.pairs, len(self.pieces)
        tokens: list[int] = []
        failed, failures = bytearray((end - start >> 3) + 1), False
        at, token, last = start, best[start], -1
        while True:
            stop = at + length[token]
            k = stop - start
            if stop <= end and not (failures and failed[k >> 3] >> (k & 7) & 1):
                if last < 0 or ((fit := pairs.get(last * many + token)) is None and self.compatible(last, token)) or fit:
                    tokens.append(token)
                    if stop == end:
                        return tokens
                    at, last, token = stop, token, best[stop]
                    continue
            token = shorter[token]
            if token < 0:
                failures, k = True, at - start
                failed[k >> 3] |= 1 << (k & 7)
                token = tokens.pop()
                at -= length[token]
                last = tokens[-1] if tokens else -1

    def longest(self, unit: str) -> list[int] | None:
        """The longest piece at each place where the one before ended, if all neighbours are compatible: then nothing is given back."""
        length, pairs, many, tokens, last, at = self.length, self.pairs, len(self.pieces), [], -1, -1
        for stop, token in self.automaton.iter_long(unit):
            if stop - length[token] != at:
                return None
            if last >= 0 and not (self.compatible(last, token) if (fit := pairs.get(last * many + token)) is None else fit):
                return None
            tokens.append(token)
            last, at = token, stop
        return tokens if at == len(unit) - 1 else None

    def encode_unit(self, unit: str) -> list[int]:
        if (tokens := self.longest(unit)) is not None:
            return tokens
        n, length = len(unit), self.length
        best = [-1] * n if n <= KEPT_CHARS else array("i", [-1]) * n
        for stop, token in self.automaton.iter(unit):
            best[stop + 1 - length[token]] = token  # longer ones come later
        if 0 < n <= KEPT_CHARS and min(best) >= 0:
            return self.search(best, 0, n)
        out: list[int] = []
        start = 0
        while start < n:
            if best[start] < 0:  # a character that no piece is or begins with
                out += [self.bytes_of[b] for b in unit[start].encode()]
                start += 1
                continue
            end = start + 1
            while end < n and best[end] >= 0:
                end += 1
            out += self.search(best, start, end)
            start = end
        return out

    def of_unit(self, unit: str) -> tuple[bytes, str]:
        """A unit's ids as bytes of 32-bit integers, and what they decode to, marks as spaces."""
        ids = self.encode_unit(unit)
        return array("i", ids).tobytes(), "".join([self.shown[i] for i in ids]) if not self.odd.intersection(ids) else self.join(ids)

    def both(self, text: str) -> tuple[bytes, str]:
        """The ids of a whole text as bytes of 32-bit integers, and their decoding."""
        found = [self.units[u] for u in UNIT.findall(self.model.normalize(text))]
        return b"".join([x[0] for x in found]), "".join([x[1] for x in found])[1:]

    def encode(self, text: str) -> list[int]:
        return array("i", self.both(text)[0]).tolist()

    def join(self, ids: list[int]) -> str:
        """The pieces' text with marks as spaces; bytes that are no UTF-8 are one replacement character each."""
        out, held = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_at:
                held.append(self.byte_at[i])
                continue
            if held:
                out.append(utf8(bytes(held)))
                held.clear()
            if i is not None and i not in self.hidden:
                out.append(" ⁇ " if self.model.is_unknown(i) else self.shown[i])
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: the mark that starts a text is left out, control ids say nothing."""
        shown = [i for i in ids if i not in self.hidden]
        text = self.join(shown)
        return text[1:] if shown and self.pieces[shown[0]].startswith(MARK) else text


def utf8(data: bytes) -> str:
    """Decoded as the library does: each byte that starts no whole character is one U+FFFD."""
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            at += 1
    return "".join(out)


class Recent(dict):
    """Values of the units seen last: two generations, the older of which goes when the younger is full."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, unit: str):
        value = self.old.get(unit)
        if value is None:
            value = self.make(unit)
        if len(unit) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.old = dict(self)
                self.clear()
            self[unit] = value
        return value


@lru_cache(maxsize=2)
def load(path: str) -> Codec:
    return Codec(path)


RESULT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def encode_and_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int, as the library encodes the whole text), decoded (the text of these ids).

    Null and empty texts have no ids and decode to the empty text. A literal word mark in a
    text decodes to a space, as in the library. A text is one string of any length, with its
    ids beside it; a unit of it (a word, or a stretch without spaces) is searched in time and
    memory linear in its length. Null ids stay null, repeated rows give repeated results,
    other columns are not read, an empty table gives no rows. One narrow pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(model_path)
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            first, flat, ends, decoded, held = 0, [], [0], [], 0
            for k in range(b.num_rows):
                x, y = codec.both(texts[k].as_py())
                flat.append(x)
                ends.append(ends[-1] + len(x) // 4)
                decoded.append(y)
                held += len(y)
                if held > HANDED or k == b.num_rows - 1:
                    values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(flat))])
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                    yield pa.RecordBatch.from_arrays([ids.slice(first, len(decoded)), lists, pa.array(decoded, pa.string())], schema=RESULT)
                    first, flat, ends, decoded, held = k + 1, [], [0], [], 0

    return text_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, comma-joined), decoded_sha256 of what encode_and_decode() gives."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(encode_and_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))
