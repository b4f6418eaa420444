"""Encoding texts with a public byte-level BPE vocabulary.

Merging pairs in order of rank takes time that grows faster than the text. A
sequence of tokens is what the merges give if and only if each two neighbours
are: that is read off the merge tables without merging anything (the pair
compatibility table). So the encoder goes through a piece of text from left to
right with the longest token at each place, found for all places at once by an
Aho-Corasick automaton, steps back to shorter tokens where neighbours are
incompatible, and never visits a place twice in vain: time is linear.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: How a text is cut into pieces before encoding; belongs to the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where the vocabulary lies if no other path is given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces whose ids a worker remembers.
REMEMBERED = 300_000


class Vocabulary:
    """The tables of a vocabulary: tokens by rank, merges, prefixes, offsets."""

    def __init__(self, content: bytes):
        pairs = (line.split() for line in content.splitlines() if line.strip())
        self.ids = {base64.b64decode(a): int(b) for a, b in pairs}
        size = max(self.ids.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for t, i in self.ids.items():
            self.tokens[i] = t
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.buffer = np.frombuffer(b"".join(self.tokens), np.uint8)
        #: The longest token that is a proper prefix of a token, -1 where there is none.
        self.shorter = [next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), -1) for t in self.tokens]
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(size)]
        for i, t in enumerate(self.tokens):
            left = self.shorter[i] if len(t) > 1 else -1
            while left >= 0:
                right = self.ids.get(t[len(self.tokens[left]) :], -1)
                if left < i and 0 <= right < i and self._follows(left, right):
                    self.merged[left, right] = i
                    self.halves[i] = (left, right)
                    break
                left = self.shorter[left]
        self.compatible: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t.decode("latin-1"), (i, len(t)))
        self.automaton.make_automaton()
        self.seen: dict[str, list[int]] = {}

    def _follows(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart: no merge across their border comes before the merges that made them.

        Both are taken apart at the border, the later merge first; a pair that
        merges earlier than what it was taken from would have pre-empted it.
        """
        ceiling = len(self.tokens) + 1
        while True:
            joint = self.merged.get((left, right))
            if joint is not None and joint < ceiling:
                return False
            # undo the later merge; where a side is down to one byte, the other one's turn
            for turn in (left > right, left <= right):
                if turn:
                    part = self.halves[left][1]
                    if part != left:
                        ceiling, left = left, part
                        break
                else:
                    part = self.halves[right][0]
                    if part != right:
                        ceiling, right = right + 1, part
                        break
            else:
                return True

    def fits(self, left: int, right: int) -> bool:
        """The pair compatibility table, filled as it is needed."""
        known = self.compatible.get((left, right))
        if known is None:
            if len(self.compatible) > 2_000_000:
                self.compatible.clear()
            known = self.compatible[left, right] = self._follows(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of a piece of text, as rank-ordered merging gives them."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        longest = [0] * len(piece)
        for end, (token, n) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - n + 1] = token  # of one start the longer token comes later
        dead = bytearray(len(piece) + 1)  # places from which no compatible rest was found
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(piece):
            end = at + len(self.tokens[token])
            if not dead[end] and (not out or self.fits(out[-1], token)):
                out.append(token)
                at = end
                if at < len(piece):
                    token = longest[at]
                continue
            token = self.shorter[token]
            if token < 0:
                dead[at] = 1
                token = out.pop()
                at -= len(self.tokens[token])
                # the same token again leads to the dead place, so a shorter one is next
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        seen = self.seen
        for piece in _PIECES.findall(text):
            ids = seen.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode("utf-8", "replace"))
                if len(piece) <= 64:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[piece] = ids
            out += ids
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids: each id's slice of the joined tokens, all gathered at once by the offset table."""
        ids = np.asarray(ids, np.int64)
        starts, lengths = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        if not len(ids):
            return b""
        first = np.cumsum(lengths) - lengths
        return self.buffer[np.arange(lengths.sum()) + np.repeat(starts - first, lengths)].tobytes()


_PIECES = regex.compile(PATTERN)
_LOADED: dict[str, Vocabulary] = {}


def load(content: bytes) -> Vocabulary:
    """The vocabulary of a file's content, built once in a process."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(content)
    return _LOADED[key]


def encode(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of every text, without special tokens.

    The strings of special tokens in a text are ordinary text. Null and empty
    texts give an empty list, texts of any length are encoded whole. Repeated
    rows stay repeated. The vocabulary file (under 1 MB) is read by the driver
    and sent along.
    """
    with open(vocabulary, "rb") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(content.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                lists = [v.encode(t) if t else [] for t in b.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column(0), ids], [key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, ids array<int>")


def decode(df: DataFrame, key: str, ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text): the text of every list of ids; a null or empty list gives an empty text, bytes that are no UTF-8 a replacement character."""
    with open(vocabulary, "rb") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(content.value)
        for b in batches:
            texts = [v.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, text string")
