"""Exact byte-level BPE encoding of a text column (problem 8).

An Aho-Corasick automaton over the reversed vocabulary gives, in one pass over a
piece, the longest token that starts at every byte. The encoder walks from left to
right, taking the longest token whose pair with the token before is *compatible*
(the two tokens' joint bytes merge back to exactly those two tokens) and steps back
where no token fits. A position found dead is never entered again, so the work is
linear in the piece. Compatible neighbours everywhere make the result equal to the
merge order's, which tests/llm compares with two public libraries.

Vocabularies stay where they are; their path is a parameter.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the vocabulary is by default, and the public pre-tokenisation pattern of byte-level BPE.
VOCABULARY = os.environ.get("TESSELLA_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

#: Remembered pieces per worker; the memory is emptied when full, which changes speed only.
REMEMBERED = 400_000


#: The first byte of a character of several bytes.
_LEAD = re.compile("[\xc2-\xf4]")


class Encoder(dict):
    """Maps a piece of text to its token ids; ``encode`` maps a whole text."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        super().__init__()
        self.rank: dict[str, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, number = line.split()
                    self.rank[base64.b64decode(token).decode("latin-1")] = int(number)
        self.text = {v: k for k, v in self.rank.items()}
        self.split = regex.compile(pattern).findall
        self._longest = ahocorasick.Automaton()
        for t in self.rank:
            self._longest.add_word(t[::-1], t)
        self._longest.make_automaton()
        self._joined = {t[i : i + 2] for t in self.rank for i in range(len(t) - 1) if t[i + 1] >= "\xc2"}
        self._parts: dict[str, tuple[int, ...]] = {}
        self._shorter: dict[str, str | None] = {}
        self._pairs: dict[tuple[str, str], bool] = {}
        self._spines: dict[tuple[str, bool], list[tuple[str, int]]] = {}

    # -- vocabulary relations, filled as they are met ---------------------------------
    def shorter(self, token: str) -> str | None:
        """The longest token that is a proper prefix of ``token``."""
        if token not in self._shorter:
            self._shorter[token] = next((token[:k] for k in range(len(token) - 1, 0, -1) if token[:k] in self.rank), None)
        return self._shorter[token]

    def spine(self, token: str, right: bool) -> list[tuple[str, int]]:
        """What stands at one edge of ``token`` while it is merged, the whole token first.

        With each goes the rank of the merge that absorbs it; none absorbs the token itself.
        """
        key = (token, right)
        if (known := self._spines.get(key)) is None:
            known = [(token, 1 << 30)]
            if len(token) > 1:
                parts, own = list(token), self.rank[token]
                while len(parts) > 2:
                    at = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], 1 << 30))
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
                inner = self.spine(parts[1] if right else parts[0], right)
                known += [(inner[0][0], own), *inner[1:]]
            self._spines[key] = known
        return known

    def compatible(self, left: str, right: str) -> bool:
        """Whether the bytes of both tokens, merged in rank order, end as these two tokens.

        They do unless some merge across the border comes before one of its two sides is
        absorbed on its own. Of equal ranks the one further left is done first.
        """
        key = (left, right)
        if (known := self._pairs.get(key)) is None:
            if len(self._pairs) > 4 * REMEMBERED:
                self._pairs.clear()
            rank, known = self.rank, True
            for a, a_gone in self.spine(left, True):
                for b, b_gone in self.spine(right, False):
                    across = rank.get(a + b)
                    if across is not None and across < a_gone and across <= b_gone and rank[b] < a_gone and rank[a] < b_gone:
                        known = False
            self._pairs[key] = known
        return known

    # -- encoding ---------------------------------------------------------------------
    def encode_bytes(self, data: str) -> tuple[int, ...]:
        """Ids of one piece, its bytes given as Latin-1 characters."""
        if data in self.rank:
            return (self.rank[data],)
        n = len(data)
        starts: list[str | None] = [None] * n
        for end, token in self._longest.iter(data[::-1]):
            if (have := starts[n - 1 - end]) is None or len(token) > len(have):
                starts[n - 1 - end] = token
        pairs, compatible, dead = self._pairs, self.compatible, set()
        token = last = starts[0]
        out, at = [token], len(token)
        while at < n:
            token = starts[at]
            while token is not None:
                fits = pairs.get((last, token))
                if (compatible(last, token) if fits is None else fits) and (not dead or at + len(token) not in dead):
                    break
                token = self.shorter(token)
            while token is None:  # nothing fits here: give up the token before for a shorter one
                dead.add(at)
                token = out.pop()
                at -= len(token)
                token = self.shorter(token)
                last = out[-1] if out else None
                while token is not None and (at + len(token) in dead or (out and not compatible(last, token))):
                    token = self.shorter(token)
            out.append(token)
            last = token
            at += len(token)
        rank = self.rank
        return tuple([rank[t] for t in out])

    def __missing__(self, piece: str) -> tuple[int, ...]:
        """Encode a piece not met before, part by part.

        No merge can cross a border whose two bytes stand together in no token, so the
        parts between such borders are encoded, and remembered, on their own.
        """
        data = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        joined, parts = self._joined, self._parts
        cuts = [m.start() for m in _LEAD.finditer(data, 1) if data[m.start() - 1 : m.start() + 1] not in joined]
        ids: tuple[int, ...] = ()
        for a, b in zip([0, *cuts], [*cuts, len(data)]):
            part = data[a:b]
            if (known := parts.get(part)) is None:
                if len(parts) >= REMEMBERED:
                    parts.clear()
                known = parts[part] = self.encode_bytes(part)
            ids += known
        if len(self) >= REMEMBERED:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; null and empty texts give an empty list."""
        out: list[int] = []
        extend = out.extend
        if text:
            for piece in self.split(text):
                extend(self[piece])
        return out

    # -- decoding ---------------------------------------------------------------------
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """All tokens' bytes in id order, one after another, and the offset of each."""
        size = max(self.text) + 1
        lengths = np.array([len(self.text.get(i, "")) for i in range(size)])
        return np.frombuffer("".join(self.text.get(i, "") for i in range(size)).encode("latin-1"), np.uint8), np.concatenate(([0], np.cumsum(lengths)))

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``, gathered from the offset table."""
        if not hasattr(self, "_table"):
            self._table = self.table()
        data, offsets = self._table
        ids_ = np.asarray(ids, np.int64)
        if not len(ids_):
            return ""
        lengths = offsets[ids_ + 1] - offsets[ids_]
        first = np.repeat(offsets[ids_] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
        return data[first + np.arange(lengths.sum())].tobytes().decode("utf-8", "replace")


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str = VOCABULARY, pattern: str = PATTERN) -> Encoder:
    """The worker's encoder for a vocabulary; built once a process."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def encode_texts(df: DataFrame, key: str, text: str, ids: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` of every row of ``df``.

    Null text and empty text both give an empty list. Rows are neither dropped nor
    merged; repeated rows stay repeated. Other columns of ``df`` are not read.
    One narrow pass: no shuffle, a batch at a time, integers written straight to Arrow.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            flat: list[int] = []
            offsets = [0]
            for t in _column(batch, "t").to_pylist():
                if t:
                    for piece in e.split(t):
                        flat.extend(e[piece])
                offsets.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([_column(batch, "k"), lists], names=[key, ids])

    source = df.select(df[key].alias("k"), df[text].alias("t"))
    return source.mapInArrow(run, f"`{key}` {kind}, `{ids}` array<int>")


def count_tokens(df: DataFrame, key: str, text: str, size: str = "size", path: str = VOCABULARY) -> DataFrame:
    """``key`` and the number of tokens of every row; 0 for null and empty texts."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            sizes = [sum(len(e[p]) for p in e.split(t)) if t else 0 for t in _column(batch, "t").to_pylist()]
            yield pa.RecordBatch.from_arrays([_column(batch, "k"), pa.array(sizes, pa.int32())], names=[key, size])

    return df.select(df[key].alias("k"), df[text].alias("t")).mapInArrow(run, f"`{key}` {kind}, `{size}` int")
