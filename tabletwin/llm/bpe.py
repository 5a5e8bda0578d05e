"""Byte-level BPE: whole texts to token ids and back, equal to applying the merges one by one.

A vocabulary is a file of ranks (base64 of a token's bytes, its rank). Its tokens, with bytes mapped to Latin-1
characters, form one Aho-Corasick automaton, so a single pass over a piece of text gives the longest token at every
byte. Encoding walks from the left: it takes the longest token that stands next to the one before it, tries shorter
ones where it does not, and steps back from bytes that nothing leads on from. Two tokens stand side by side if undoing
the merges at their border, latest first, never meets a pair that would have been merged earlier; these answers are
kept. A prefix of a piece has only one encoding whose neighbours all fit, so every byte is reached at most once
and every token at it is tried at most once: the work is linear in the text.

Cases: a null text is empty and an empty text has no tokens; very long texts and pieces are read whole; equal texts
give equal ids (there are no ties: the result is a function of the text); repeated rows, null ids and ids of any type
give one row each; extra columns, whatever their names, are not carried on; an empty table gives an empty result. A
vocabulary without all 256 single bytes, or with a token that is merged from one of higher rank, is an error. Tokens that no merges lead to are used for whole pieces only.
"""

from __future__ import annotations

import base64
import re
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tabletwin.llm.store import map_arrow

#: Remembered pieces, words and token pairs per task process; a full memory is emptied, which changes no result.
MEMORY = 200_000
ROWS = 128
#: A space after another white-space character: only then can a space be inside a piece that began before it.
LOOSE = re.compile(r"\s ")


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.ids = ranks
        self.find = regex.compile(pattern).findall
        n = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * n
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.size = [len(t) for t in self.bytes_of]
        self.pairs: dict[int, int] = {}
        self.fits: dict[int, bool] = {}
        self.left, self.right = list(range(n)), list(range(n))
        # place in time of the merge that makes a token left of a border, and right of it; -1 for what is not merged
        self.made_left, self.made_right = [-1] * n, [-1] * n
        self.shorter = [-1] * n
        self._derive()
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _derive(self):
        usable = set()
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in sorted(self.ids.items(), key=lambda x: x[1]):
            if len(token) > 1:
                for cut in range(len(token) - 1, 0, -1):
                    a, b = self.ids.get(token[:cut], rank), self.ids.get(token[cut:], rank)
                    if a < rank and b < rank and a in usable and b in usable and self._side_by_side(a, b):
                        break
                else:
                    if self._merged(token) == [rank]:
                        raise ValueError(f"token {rank} is merged from a later one: ranks do not follow the merges")
                    continue
                self.pairs[a << 32 | b] = rank
                self.left[rank], self.right[rank] = a, b
                self.made_left[rank], self.made_right[rank] = 3 * rank, 3 * rank + 2
            usable.add(rank)
            automaton.add_word(token.decode("latin-1"), rank)
        for rank in usable:
            token = self.bytes_of[rank]
            for cut in range(len(token) - 1, 0, -1):
                less = self.ids.get(token[:cut], -1)
                if less in usable:
                    self.shorter[rank] = less
                    break
        automaton.make_automaton()
        self.automaton = automaton

    def _merged(self, token: bytes) -> list[int]:
        """A token's bytes after all merges, one by one: lowest rank first, then leftmost."""
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 1:
            found = [(self.ids[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in self.ids]
            if not found:
                break
            i = min(found)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [self.ids[p] for p in parts]

    def _side_by_side(self, a: int, b: int) -> bool:
        """Whether the merges leave tokens a and b beside each other: the merges at the border are undone from the last
        to the first, and a merge across it must at no time come before the one undone last. At equal rank the pair
        further left merges first, so times are 3r on the left, 3r + 1 across and 3r + 2 on the right."""
        limit = 1 << 62
        while True:
            across = self.pairs.get(a << 32 | b)
            if across is not None and 3 * across + 1 < limit:
                return False
            x, y = self.made_left[a], self.made_right[b]
            if x < 0 and y < 0:
                return True
            if x > y:
                limit, a = x, self.right[a]
            else:
                limit, b = y, self.left[b]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece of text."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        n, size, shorter, fits = len(piece), self.size, self.shorter, self.fits
        best = [-1] * n
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            best[end - size[token] + 1] = token  # ends ascend, so the longest stays
        dead = bytearray(n + 1)
        out: list[int] = []
        at = 0
        while at < n:
            token = best[at]
            if token < 0:
                dead[at] = 1
                at -= size[out.pop()]
                continue
            best[at] = shorter[token]
            end = at + size[token]
            if dead[end]:
                continue
            if out:
                key = out[-1] << 32 | token
                ok = fits.get(key)
                if ok is None:
                    if len(fits) >= MEMORY:
                        fits.clear()
                    ok = fits[key] = self._side_by_side(out[-1], token)
                if not ok:
                    continue
            out.append(token)
            at = end
        return out

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            if len(self.pieces) >= MEMORY:
                self.pieces.clear()
            got = self.pieces[piece] = np.array(self.encode_piece(piece.encode()), "<u4").tobytes()
        return got

    def _word(self, word: str) -> bytes:
        """Ids of a space and what follows it up to the next."""
        if len(self.words) >= MEMORY:
            self.words.clear()
        got = self.words[word] = b"".join(map(self._piece, self.find(" " + word)))
        return got

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if LOOSE.search(text):
            return b"".join(map(self._piece, self.find(text)))
        # a piece never crosses a space that follows other text, so the text may be cut before each
        parts = text.split(" ")
        known, word = self.words.get, self._word
        return b"".join(map(self._piece, self.find(parts[0]))) + b"".join([known(p) or word(p) for p in islice(parts, 1, None)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[tuple, Encoder] = {}


def encoder(data: bytes, pattern: str) -> Encoder:
    """The encoder of a rank file's content, made once per task process."""
    key = (data, pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(read_ranks(data), pattern)
    return _encoders[key]


def _file(path: str) -> bytes:
    # a vocabulary is a fixed file of about a megabyte: it travels with the tasks
    with open(path, "rb") as f:
        return f.read()


def _rows(batches, column: str):
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            yield part, part.column(part.schema.get_field_index(column)).to_pylist()


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens long, ids binary) for every row: ids as little-endian unsigned 32-bit integers."""
    data = _file(ranks_path)
    schema = T.StructType([docs.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def work(batches):
        enc = encoder(data, pattern)
        for part, texts in _rows(batches, "_text"):
            ids = [enc.encode(t) if t else b"" for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], [key, "n_tokens", "ids"])

    return map_arrow(docs.select(docs[key].alias("_key"), docs[text].alias("_text")), work, schema)


def decode(tokens: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """The rows of ``tokens`` with the bytes that the ids of column ``ids`` stand for (null ids: no bytes)."""
    data = _file(ranks_path)
    if into in tokens.columns:
        raise ValueError(f"column {into} is there already")
    schema = T.StructType([*tokens.schema.fields, T.StructField(into, T.BinaryType())])

    def work(batches):
        enc = encoder(data, pattern)
        for part, rows in _rows(batches, ids):
            back = pa.array([enc.decode(x) if x else b"" for x in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, back], schema.names)

    return map_arrow(tokens, work, schema)
