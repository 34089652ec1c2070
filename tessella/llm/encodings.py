"""Text decoded with the wrong character encoding, found and restored (problem 7).

States are texts. An operation re-encodes a text in one encoding and decodes the bytes in
another, run by run (or unescapes references); a best-first search takes the state of
least cost first, remembers visited states by hash and ends at the cheapest reachable
text. The cost is the implausibility of the characters: minus the logarithm of their
share in the corpus, counted over every text that holds no suspect character. A run is
replaced only if its bytes are valid in the other encoding and what comes out is as
plausible as ordinary text, so foreign, accented, traditional and look-alike letters stay.
"""

from __future__ import annotations

import codecs
import heapq
import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.forms import INVISIBLE, LOOKALIKES, RADICALS

#: Encodings in which text is wrongly read, and in which it was written.
WRONG_SINGLE = (
    "cp1252", "cp437", "cp1251", "koi8_r", "mac_roman", "cp850", "cp866", "cp1250", "cp1253", "cp1254", "cp1257", "cp852", "cp855", "cp858", "cp1255", "cp1256", "cp1258", "koi8_u", "mac_cyrillic", "mac_latin2", "mac_greek",
    "iso8859_1", "iso8859_2", "iso8859_4", "iso8859_5", "iso8859_7", "iso8859_9", "iso8859_10", "iso8859_13", "iso8859_15", "iso8859_16",
)
COMMON = WRONG_SINGLE[:4]
WRONG_MULTI = ("gb18030", "big5hkscs", "cp932", "cp949")
WRITTEN = ("utf-8", "gb18030", "big5")

#: Nats a character of restored text may cost on average; ordinary text of the corpus costs about 6.
PLAUSIBLE = 8.5
#: Nats that a run must gain: a chance match of a few bytes gains less.
GAIN = 12.0
#: Bytes beyond ASCII that a run must have to be read in another encoding than the common ones.
LONG = 8
#: Share of the best state's gain that an open state may lack.
BEHIND = 0.25
#: Changes of script within a stretch of letters and signs of foreign scripts that no language makes.
SWITCHES = 3


def _codes(first: range, second: range, encoding: str) -> set[str]:
    out = set()
    for a in first:
        for b in second:
            try:
                out.add(bytes((a, b)).decode(encoding))
            except UnicodeDecodeError:
                pass
    return {c for c in out if len(c) == 1}


@lru_cache(1)
def plain() -> set[str]:
    """Characters that are no sign of wrong decoding: usual Han, punctuation, forms, letters."""
    han = _codes(range(0xB0, 0xF8), range(0xA1, 0xFF), "gb2312") | _codes(range(0xA4, 0xC7), range(0x40, 0xFF), "big5")
    marks = set("、。〈〉《》「」『』【】〔〕〖〗—–‐‑−‘’“”…·•※①②③④⑤⑥⑦⑧⑨⑩ⅠⅡⅢⅣⅤ℃≤≥≠±×÷°§©®™€£¥←→↑↓★☆●○■□▲△◆◇✓￥")
    wide = {chr(c) for c in range(0xFF00, 0xFF5F)} | {chr(c) for c in range(0xFFE0, 0xFFE7)} | {chr(c) for c in range(0x3040, 0x3100)}
    forms = {chr(c) for c in [*range(0x2E80, 0x2FE0), *range(0xF900, 0xFB00), *range(0x2070, 0x209D), *range(0x2160, 0x2180), *range(0x2460, 0x2474)]} | set("¹²³")
    blanks = {chr(c) for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) in ("Zs", "Zl", "Zp", "Cf", "Mn")}
    return han | marks | wide | forms | blanks | set(LOOKALIKES) | set(RADICALS)


def _ranges(codes: list[int]) -> str:
    out: list[list[int]] = []
    for c in codes:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in out)


class Signs:
    """Patterns that send a text to the search."""

    def __init__(self) -> None:
        ok = {ord(c) for c in plain()} | set(range(0x20, 0x7F)) | {9, 10, 11, 12, 13}
        letters = {c for c in range(0xC0, 0x250) if unicodedata.category(chr(c))[0] == "L"}
        odd = [c for c in range(0x80, 0x10000) if c not in ok and c not in letters and not 0xD800 <= c < 0xE000]
        self.odd = re.compile(f"[{_ranges(odd)}]")
        latin = _ranges(sorted(letters | set(range(0x80, 0xC0)) | {0x2C6, 0x2DC, *range(0x2013, 0x203B), 0x20AC, 0x2122}))
        self.pair = re.compile(f"[À-ÿŒ-ž][{latin}]")
        self.inside = re.compile("[A-Za-z][一-鿿]{1,2}[a-z]|[一-鿿]�|锟斤|斤拷")
        # The last two are replacement characters that were themselves decoded wrongly.
        self.lost = re.compile("[\ufffd\x80-\x84\x86-\x9f\ue000-\uf8ff]|锟斤|斤拷")

    def suspect(self, text: str) -> bool:
        return not text.isascii() and bool(self.odd.search(text) or self.pair.search(text) or self.inside.search(text))


@lru_cache(1)
def signs() -> Signs:
    return Signs()


class Plausibility(dict):
    """Cost in nats of a character, from its share in the corpus."""

    def __init__(self, counts: dict[int, int]):
        total = sum(counts.values()) + 10_000
        self._unseen = float(np.log(total / 0.3))
        super().__init__((chr(c), float(np.log(total / (n + 0.3)))) for c, n in counts.items())

    def __missing__(self, c: str) -> float:
        if c in LOOKALIKES or c in RADICALS or c.isascii():
            known = 8.0
        elif c in plain():
            known = min(self._unseen, 11.0)
        else:
            known = self._unseen + (6.0 if signs().lost.match(c) else 0.0)
        self[c] = known
        return known

    def of(self, text: str | list[str]) -> float:
        return sum(map(self.__getitem__, text))


def _sloppy(encoding: str) -> dict[str, int]:
    """Byte of each character of a one-byte encoding; bytes it leaves open keep their number."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes((b,)).decode(encoding)] = b
        except UnicodeDecodeError:
            pass
        out.setdefault(chr(b), b)
    return out


@lru_cache(None)
def _single(encoding: str) -> tuple[dict[int, int], re.Pattern]:
    """Translation to bytes given as Latin-1, and the runs it can take: two odd characters at least, with ASCII between."""
    table = _sloppy(encoding)
    high = "".join(re.escape(c) for c in table)
    return {ord(c): b for c, b in table.items()}, re.compile(f"[{high}](?:[{high}]|[\x20-\x7e�](?=[\x20-\x7e�]{{0,24}}[{high}]))*[{high}]")


@lru_cache(1)
def _readers() -> dict[str, int]:
    """For each character the one-byte encodings that hold it, as bits."""
    out: dict[str, int] = {}
    for k, e in enumerate(WRONG_SINGLE):
        for c in _sloppy(e):
            out[c] = out.get(c, 0) | 1 << k
    return out


@lru_cache(1 << 12)
def _reading(characters: str) -> tuple[str, ...]:
    """The one-byte encodings worth trying for a line with these characters: those that hold the most, in the stated order."""
    masks = [m for c in characters if (m := _readers().get(c))]
    held = [sum(m >> k & 1 for m in masks) for k in range(len(WRONG_SINGLE))]
    best = max(held, default=0)
    # A line may hold ordinary characters beside the garbled ones, of which another encoding happens to know a few more.
    return tuple(e for e, n in zip(WRONG_SINGLE, held) if n >= 2 and n >= 0.9 * best)


@lru_cache(1 << 10)
def codec(declared: str | None) -> str | None:
    """The name of a declared encoding among those tried here, however it is spelled; None for others."""
    try:
        name = codecs.lookup(re.sub(r"[^a-z0-9]+", "-", (declared or "").strip().lower()).strip("-")).name
    except LookupError:
        return None
    return next((e for e in (*WRONG_SINGLE, *WRONG_MULTI, *WRITTEN) if codecs.lookup(e).name == {"gbk": "gb18030", "gb2312": "gb18030"}.get(name, name)), None)


_UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2})(?:[\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2})*")
_UTF8_HEAD = re.compile(rb"[\xc2-\xf4][\x80-\xbf]")
#: Two such sequences, one of three bytes: what ordinary Han text hardly holds in another encoding.
_UTF8_RUN = re.compile(rb"[\xe0-\xef][\x80-\xbf]{2}[\xc2-\xef][\x80-\xbf]|[\x20-\x7e](?:[\xc2-\xdf][\x80-\xbf]|\xe2[\x80-\x84][\x80-\xbf])[\x20-\x7e]")
_HAN = re.compile("[\u3100-\u312f\u3400-\u9fff\uac00-\ud7a3\uff61-\uff9f]")
_HANGUL = re.compile("[\uac00-\ud7a3]")
_PIECES = re.compile("([\ufffd\n]|[\x20-\x7e]+)")
_BEYOND = re.compile("[^\x00-\x7f]")
_HIGH = re.compile(rb"[\x80-\xff]")


class Search:
    """The best-first search with one plausibility table."""

    def __init__(self, cost: Plausibility):
        self.cost = cost
        self.hint: str | None = None

    # -- operations -------------------------------------------------------------------
    def _accept(self, before: str, after: str, sure: bool, gain: float = GAIN) -> bool:
        """Whether ``after`` reads better than ``before``. ``sure``: the bytes alone prove it."""
        odd = _BEYOND.findall(after)
        lost = signs().lost
        if not odd or lost.search(after) or any(c < " " and c not in "\n\t\r" for c in odd):
            good = [c for c in odd if c != "�"]
            if not good or len(good) * 2 < len(odd) or any(lost.match(c) for c in good) and len(good) < len(odd):
                return False
            odd = good
        now = self.cost.of(odd)
        was = self.cost.of(_BEYOND.findall(before))
        if sure and now < was:
            return True
        return was - now >= gain and now <= PLAUSIBLE * len(odd)

    def _single(self, text: str) -> Iterator[str]:
        """Lines in which the runs of a one-byte encoding are read as they were written; encodings that give the same bytes are one.

        The other encodings are tried where the common ones give no reading, and on runs of at
        least ``LONG`` bytes: in few bytes so many encodings find something by chance.
        """
        done: set[str] = set()
        some = False
        for wrong in _reading("".join(sorted({c for c in text if not c.isascii()}))):
            common = wrong in COMMON or wrong == self.hint
            if some and not common:
                break
            table, runs = _single(wrong)
            found = []
            for m in runs.finditer(text):
                data = m[0].replace("�", "").translate(table).encode("latin-1", "replace")
                if (high := len(_HIGH.findall(data))) >= (2 if common else LONG):
                    found.append((*m.span(), m[0], data, high))
            key = repr([(a, data) for a, _, _, data, _ in found])
            if not found or key in done:
                continue
            done.add(key)
            for written in WRITTEN:
                out, pos = [], 0
                for a, b, run, data, high in found:
                    if written == "utf-8" and not _UTF8_HEAD.search(data):
                        continue
                    after = data.decode(written, "replace" if written == "utf-8" else "ignore")
                    good = after.replace("�", "")
                    kept = len(good.encode(written, "ignore")) - len(good.encode("ascii", "ignore"))
                    if kept >= 0.8 * high and self._accept(run, after, written == "utf-8" and kept == high, GAIN / 2 if self.hint in (wrong, written) else GAIN):
                        out += [text[pos:a], after]
                        pos = b
                if out:
                    some = some or common
                    yield "".join([*out, text[pos:]])

    def _multi(self, line: str, wrong: str) -> Iterator[str]:
        """Runs of a line whose bytes in ``wrong`` are valid UTF-8 (or GBK) and read better so."""
        try:
            data = line.encode(wrong)
        except UnicodeEncodeError:
            data = b"".join([_bytes(c, wrong) for c in line])
        if _UTF8_RUN.search(data) or signs().inside.search(line):
            starts = {0: 0}
            at = 0
            for i, u in enumerate([_bytes(c, wrong) for c in line]):
                at += len(u)
                starts[at] = i + 1
            pos, piece = 0, []
            for m in _UTF8.finditer(data):
                a, b = m.span()
                while a not in starts:
                    a += 1
                while b not in starts:
                    b -= 1
                if a >= b:
                    continue
                i, j = starts[a], starts[b]
                before, after = line[i:j], data[a:b].decode("utf-8", "ignore")
                if self._better(before, after, line, i, j):
                    piece += [line[pos:i], after]
                    pos = j
            if piece:
                yield "".join([*piece, line[pos:]])
        if wrong != "gb18030":
            yield from self._swapped(line, wrong, "gb18030")
        else:
            yield from self._swapped(line, wrong, "big5")

    def _swapped(self, line: str, wrong: str, written: str) -> Iterator[str]:
        """Runs of Han read in one two-byte encoding and written in another: the stretches of greatest gain."""
        out, changed = [], False
        for run in _PIECES.split(line):
            if len(run) < 3 or run.isascii():
                out.append(run)
                continue
            gains, after = [], []
            if wrong == "cp932":
                data = b"".join([_bytes(c, wrong) for c in run])
                text = data.replace(b"\0", b"").decode(written, "ignore")
                if self._accept(run, text, False):
                    out.append(text)
                    changed = True
                    continue
                out.append(run)
                continue
            for c in run:
                other = _reread(c, wrong, written)
                after.append(other if other is not None else c)
                gains.append(-6.0 if other is None or other == c else self.cost[c] - self.cost[other])
            # The stretch with the greatest sum of gains, and the sum.
            best, best_a, best_b, total, a = 0.0, 0, 0, 0.0, 0
            for i, g in enumerate(gains):
                if total <= 0:
                    total, a = 0.0, i
                total += g
                if total > best:
                    best, best_a, best_b = total, a, i + 1
            new = "".join(after[best_a:best_b])
            if best >= 1.5 * GAIN and best_b - best_a >= 3 and self.cost.of(new) <= PLAUSIBLE * len(new) and self.cost.of(run[best_a:best_b]) > PLAUSIBLE * len(new):
                out.append(run[:best_a] + new + run[best_b:])
                changed = True
            else:
                out.append(run)
        if changed:
            yield "".join(out)

    def _better(self, before: str, after: str, line: str, a: int, b: int) -> bool:
        odd = [c for c in before if not c.isascii()]
        if after.isascii() or not odd:
            return False
        if len(odd) <= 2 and all("\xa0" <= c <= "\u024f" or "\u2010" <= c <= "\u20bf" for c in after if not c.isascii()):
            # One or two Han characters inside or beside a Latin word: its accent, quotation mark or currency sign.
            return bool(re.search("[A-Za-z]", line[max(0, a - 1) : a] + before + line[b : b + 1]))
        return len(odd) >= 3 and self._accept(before, after, False) and self.cost.of(odd) > PLAUSIBLE * len(odd)

    def steps(self, line: str) -> Iterator[str]:
        """Lines one operation away."""
        s = signs()
        if s.odd.search(line) or s.pair.search(line):
            yield from self._single(line)
        if _HAN.search(line):
            for wrong in WRONG_MULTI:
                if wrong != "cp949" or _HANGUL.search(line):
                    yield from self._multi(line, wrong)
        if "&" in line and (plainer := html.unescape(line)) != line and s.suspect(plainer):
            yield plainer

    # -- search -----------------------------------------------------------------------
    def restore_line(self, line: str) -> str:
        """The cheapest line reachable from ``line``.

        The search ends where nothing is open, where the cheapest open state holds nothing
        suspect, or where all open states are further from the best than it is from ``line``
        by ``BEHIND``: states that far behind have read little of what the best has.
        """
        best, start = line, self.cost.of(line)
        least = start
        queue, seen, tie = [(start, 0, line)], {hash(line)}, 0
        while queue:
            now, _, state = heapq.heappop(queue)
            if state is not line and (not signs().suspect(state) or now > least + BEHIND * (start - least)):
                break
            for step in self.steps(state):
                if (h := hash(step)) not in seen:
                    seen.add(h)
                    tie += 1
                    cost = self.cost.of(step)
                    heapq.heappush(queue, (cost, tie, step))
                    if cost < least:
                        best, least = step, cost
        return best

    def restore(self, text: str, declared: str | None = None) -> str:
        """The text with each suspect line replaced by the cheapest line reachable from it; ``declared``: its stated encoding, a hint."""
        s = signs()
        if not suspicious(text):
            return text
        self.hint = codec(declared)
        return "\n".join([self.restore_line(x) if s.suspect(x) or _escaped(x) else x for x in text.split("\n")])


def _escaped(text: str) -> bool:
    """Whether a text holds references that stand for suspect characters."""
    return "&" in text and (plainer := html.unescape(text)) != text and signs().suspect(plainer)


def suspicious(text: str) -> bool:
    """Whether a text goes to the search."""
    return signs().suspect(text) or _escaped(text)


@lru_cache(1 << 17)
def _reread(c: str, wrong: str, written: str) -> str | None:
    """The character whose bytes in ``written`` are those of ``c`` in ``wrong``."""
    data = _bytes(c, wrong)
    if len(data) != 2:
        return None
    try:
        other = data.decode(written)
    except UnicodeDecodeError:
        return None
    return other if len(other) == 1 else None


@lru_cache(1 << 17)
def _bytes(c: str, encoding: str) -> bytes:
    try:
        return c.encode(encoding)
    except UnicodeEncodeError:
        return b"\0"


def _script(c: str) -> str:
    """The foreign script or kind of sign a character belongs to; empty for ordinary ones."""
    if c.isascii() or c in plain():
        return ""
    code = ord(c)
    for name, low, high in (("latin", 0xC0, 0x250), ("greek", 0x370, 0x400), ("cyrillic", 0x400, 0x530), ("sign", 0x80, 0xC0), ("hebrew", 0x590, 0x600), ("arabic", 0x600, 0x700), ("drawn", 0x2500, 0x25A0), ("mark", 0x2000, 0x2500), ("katakana", 0xFF61, 0xFFA0), ("hangul", 0xAC00, 0xD7A4), ("han", 0x3400, 0xA000)):
        if low <= code < high:
            return name
    return "other"


def mixed(text: str) -> bool:
    """Whether somewhere foreign scripts and signs follow each other as no language writes them: what cannot be restored still shows."""
    last, switches = "", 0
    for c in text:
        now = _script(c)
        if not now:
            last, switches = "", 0
            continue
        switches += bool(last) and now != last
        if switches >= SWITCHES:
            return True
        last = now
    return False


def garbled(text: str, restored: str) -> bool:
    """Whether a text holds wrongly decoded characters: it could be restored, or some are lost or mixed beyond it."""
    return restored != text or bool(signs().lost.search(text)) or mixed(text)


def character_counts(df: DataFrame, text: str) -> dict[int, int]:
    """How often each code point stands in the texts that hold no suspect character.

    Every text is counted, in partial sums; the driver gets one row a code point, of which
    Unicode has at most 1.1 million.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0x110000, np.int64)
        s = signs()
        for batch in batches:
            joined = "".join([t for t in batch["t"] if t and not s.suspect(t)])
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            found, n = np.unique(codes, return_counts=True)
            total[found] += n
        used = np.flatnonzero(total)
        yield pd.DataFrame({"code": used, "n": total[used]})

    rows = df.select(F.col(text).alias("t")).mapInPandas(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    return {r.code: r.n for r in rows}


def restored(df: DataFrame, keys: list[str], text: str, declared: str | None = None) -> DataFrame:
    """``keys`` and ``text`` of the records with wrongly decoded characters, and ``restored``.

    ``declared`` names a column with the stated encoding, which is tried on weaker evidence
    than others and may be null, unknown or wrong. Defined cases: null and empty texts hold
    none; of characters lost beyond restoring (U+FFFD, control and private characters) what
    can be read is restored around them; texts mixed of scripts beyond restoring come out as
    they are; repeated rows are kept; other columns are ignored. One pass counts characters,
    one narrow pass restores; the counts, of as many code points as the corpus has and
    Unicode allows, are broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(character_counts(df, text))
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = Search(Plausibility(shared.value))
        for batch in batches:
            batch = batch[[bool(t) and suspicious(t) for t in batch[text]]]
            said = batch[declared] if declared else [None] * len(batch)
            new = [search.restore(t, d) for t, d in zip(batch[text], said)]
            batch = batch[[*keys, text]].assign(restored=new)
            yield batch[[garbled(a, b) for a, b in zip(batch[text], new)]]

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, text]) + ", restored string"
    return df.select(*keys, text, *([declared] if declared else [])).where(F.col(text).isNotNull()).mapInPandas(run, schema)
