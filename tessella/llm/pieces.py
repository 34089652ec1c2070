"""Oversized texts cut into pieces at natural boundaries (problem 2).

A text is measured once: the offsets of its units (code points or tokens) form a prefix
sum, and the places where it may be cut form one sorted array for each rank - articles,
paragraphs, sentences, clauses, words. For each piece the last boundary under the limit
is found by binary search, best rank first; without one the piece is cut hard. The next
piece starts at the given overlap before the cut, so consecutive pieces share it exactly.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.tokens import VOCABULARY, encoder

# Where a text may be cut, best first; the cut is at the end of the match.
BOUNDARIES = (
    re.compile(r"\n(?=[ \t　]*(?:第[一二三四五六七八九十百零〇\d]{1,6}[章节節条條]|[一二三四五六七八九十]{1,3}、|(?:Chapter|Part|Section|Article) \d|#{1,6} ))"),
    re.compile(r"\n(?=\s*\n)|\n\s*\n|\n"),
    re.compile(r"[。！？!?…][”’』」）)\"]*|(?<=[A-Za-z0-9)])\.[\"”)]*(?=\s)|[;；]"),
    re.compile(r"[，、：,:](?!\d)|(?= / )"),
    re.compile(r"\s+"),
)
#: A boundary of a rank is used if the piece before it fills this share of the limit; lower ranks are tried otherwise.
LEAST_FILL = 0.5


def cuts(text: str, limit: int, overlap: int, sums: list[int] | None = None) -> list[tuple[int, int]]:
    """Spans (start, end) of the pieces of ``text``, in code points.

    ``sums``: ascending units before each code point and at the end; by default one unit a
    code point. Every piece has at most ``limit`` units; each but the first starts
    ``overlap`` units (or, where a unit is longer than a code point, the nearest fewer)
    before the end of the one before. A text within the limit is one piece, an empty text none.
    """
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError("0 <= overlap < limit is required")
    n = len(text)
    if not n:
        return []
    at = sums if sums is not None else range(n + 1)
    if at[n] <= limit:
        return [(0, n)]
    ranks = [sorted({m.end() for m in b.finditer(text)}) for b in BOUNDARIES]
    out, start = [], 0
    while True:
        far = bisect_right(at, at[start] + limit) - 1
        if far >= n:
            out.append((start, n))
            return out
        far = max(far, start + 1)
        least = max(start + 1, bisect_right(at, at[start] + max(overlap, int(limit * LEAST_FILL))))
        end = far
        for marks in ranks:
            k = bisect_right(marks, far) - 1
            if k >= 0 and marks[k] >= least:
                end = marks[k]
                break
        out.append((start, end))
        start = max(start + 1, end if not overlap else bisect_right(at, at[end] - overlap - 1))


def token_sums(text: str, path: str = VOCABULARY) -> list[int]:
    """Tokens that end at or before each code point, a token counting where its last byte lies."""
    e = encoder(path)
    sums, done, count = [0] * (len(text) + 1), 0, 0
    lengths = [len(c.encode("utf-8", "surrogatepass")) for c in text]
    ends, total = [], 0
    for i in e.encode(text):
        total += len(e.text[i])
        ends.append(total)
    for i, size in enumerate(lengths):
        done += size
        while count < len(ends) and ends[count] <= done:
            count += 1
        sums[i + 1] = count
    return sums


def split(df: DataFrame, keys: list[str], text: str, limit: int, overlap: int, unit: str = "characters", path: str = VOCABULARY) -> DataFrame:
    """``keys`` and, for every piece of every text, ``piece_no`` (from 0), ``start``, ``stop``, ``piece``.

    Defined cases: a null or empty text gives no piece, a text within the limit one piece
    equal to it; repeated rows are split each; other columns are ignored. A narrow pass,
    a row at a time; a text needs memory for itself and its boundaries only.
    """
    if unit not in ("characters", "tokens"):
        raise ValueError(f"unknown unit {unit!r}")
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, spans = [], []
            for i, t in enumerate(batch[text]):
                found = cuts(t, limit, overlap, token_sums(t, path) if unit == "tokens" else None) if t else []
                rows += [i] * len(found)
                spans += [(k, a, b, t[a:b]) for k, (a, b) in enumerate(found)]
            out = batch[keys].iloc[rows].reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame(spans, columns=["piece_no", "start", "stop", "piece"])], axis=1)

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", piece_no int, start int, stop int, piece string"
    return df.select(*keys, text).where(F.col(text).isNotNull()).mapInPandas(run, schema)
