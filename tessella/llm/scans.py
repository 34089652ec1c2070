"""Noise of scanned pages taken out of texts (problem 4).

An averaged perceptron edits the text: at every place where the noise model can have left
a trace - a line end, a character that misreading produces - it predicts keep, replace,
insert, delete, join or join with a blank, from the characters, line kinds and line lengths
around. A second one decides which lines are page furniture, from their masked pattern and
position on the page: repetition, what stands before and after, numbers.

Which Han characters are misread for which is learnt from the corpus: of all texts the
trigrams are counted, and a character that stands, in many contexts, where nearly always
another one does, is a misreading of that one. Letters and figures that scanners confuse
are stated. Where a character fits neither of its neighbours and one other fits both, it is
offered that one, whether the pair was learnt or not.

The perceptrons are trained on the corpus itself: from a bounded sample, texts without any
sign of noise are taken as clean, copies of them are put through the noise model (wrapping,
hyphenation, furniture, misreading, specks, lost letters), and the operations that undo it
are the labels. The Latin words that guard the edits are counted over all texts that look clean.
Every text is then edited whole. Places alike in all features share one remembered answer.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.encodings import signs
from tessella.llm.forms import canonical
from tessella.sources.tables import checkpointed

#: Texts sampled for training (by hash of the text), passes over them, and the margin of a prediction over keeping.
SAMPLE, EPOCHS, MARGIN = 1_500, 3, 0.0
#: A word is a misreading of one that this many times as many texts hold.
OUTNUMBERED = 50

#: A trigram stands for its context if it has this share of it and this many texts; another is a misreading in it if it is this many times rarer.
SHARE, SEEN, RARER = 0.6, 20, 12
#: A character misreads another if it does so in this many contexts. Trigrams and bigrams kept make up this share of all at least, so there are at most as many as its inverse.
CONTEXTS, LEAST_SHARE = 4, 1e-6
#: A misreading explains this share of all places where its character stands.
EXPLAINED = 0.1

# Letters and figures and what a scanner reads in their place.
LATIN_MISREAD = {"l": "1", "m": "rn", "e": "c", "o": "0", "t": "f", "I": "l", "S": "5", "rn": "m", "d": "cl", "w": "vv"}
DIGIT_MISREAD = {"0": "O", "1": "l", "5": "S", "8": "B", "2": "Z"}
#: What specks on a page are read as between characters of a word.
SPECKS = "^~¸¦´¨˙"
# Forms of page numbers; n is the page, m the number of pages.
PAGE_FORMS = ("{n}", "- {n} -", "— {n} —", "·{n}·", "第{n}页", "第 {n} 页 共 {m} 页", "Page {n} of {m}", "{n} / {m}", "Page {n}")
BACK = defaultdict(list)
for _a, _b in [*LATIN_MISREAD.items(), *DIGIT_MISREAD.items()]:
    BACK[_b].append(_a)

_UNUSUAL = re.compile("[\u00a0\u0300-\u04ff\u1680\u2000-\u200f\u2010\u2011\u2028-\u202f\u205f-\u2064\u2e80-\u2fdf\u3000\uf900-\ufaff\ufe00-\ufe0f\ufe50-\ufe6f\ufeff\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\uff61-\uff9f]")

_KINDS = (
    ("page", re.compile(r"^(?:[-—–·•]? ?\d{1,4} ?[-—–·•]?|第 ?\d{1,4} ?[页頁](?: ?[共/] ?\d{1,4} ?[页頁])?|[Pp]age \d{1,4}(?: of \d{1,4})?|\d{1,4} ?/ ?\d{1,4})$")),
    ("heading", re.compile(r"^(?:第[一二三四五六七八九十百零〇\d]{1,6}[章节節编編] ?\S{0,24}|[一二三四五六七八九十]{1,3}、[^，。,]{1,24}|(?:Chapter|Part|Section) \d+ [A-Z].{0,40})$")),
    ("list", re.compile(r"^(?:[（(][一二三四五六七八九十\d]{1,3}[)）]|[-*+•] |\d{1,3}[.)] |问：|答：|Q: |A: )")),
    ("row", re.compile(r"^\S+(?: \S+)?(?: {2,}|\t)\S+$|^\|.*\|?$")),
    ("code", re.compile(r"^(?:SELECT|FROM|WHERE|GROUP|ORDER|INSERT|UPDATE|DELETE)\b.*$")),
    ("formula", re.compile(r"^[A-Za-z]\w* ?= ?[\w(].*[-+*/].*$")),
    ("markup", re.compile(r"^(?:[<#>=\\{}\[|!`~*_]|[-=_*]{3,}$)|[<>\\}\]`]$|</?\w+[^<>]*>|\\\w+|\|\||^''")),
    ("remark", re.compile(r"^[（(][^（()）]*[)）]$|^(?:特此|此致|敬礼|Regards|Client desk|Total|合计|合計|附件|附錄|Annex|全文见|全文見|Source)|^\d{4}[-年]\d{1,2}[-月]\d{1,2}日?$|://\S+$")),
)
#: The kinds that whole lines show, in their order, in one pattern.
_BEGUN = re.compile("|".join(f"(?P<{name}>{pattern.pattern})" for name, pattern in _KINDS[:6]))
_MARKUP_HINT = re.compile(r"[-<#>=\\{}\[\]|!`~*_']")
_GROUPS = {**{c: "T" for c in "。！？!?"}, **{c: "C" for c in "，,；;：:、"}, **{c: "Y" for c in "-\u00ad¬"}, **{c: "B" for c in "）)》」』”\"'"}, **{c: "A" for c in "（(《「『“"}, "%": "P", ".": "F", "": "E"}


_INLINE_MARKUP = re.compile(r"\[\[|\]\]|\{\{[^{}|]*\|?|\}\}|'{2,}|</?\w[^<>]*>|&#?\w+;|~~|\*\*|__|`|\\[A-Za-z]+\*?\{?|[{}]|\]\([^()\s]*\)")
_MARKUP_SIGN = re.compile(r"[<\[\]{}'&~*_`\\]")


def kind(line: str) -> str:
    """What a line looks like; answers are remembered, for short lines, which come again, longer than for long ones."""
    return _short_kind(line) if len(line) <= 120 else _long_kind(line)


def _kind(line: str) -> str:
    s = line.strip()
    if not s:
        return "blank"
    if not s.isascii():
        bare = s.rstrip("\u00ad¬").replace("｡", "。").replace("\u00ad", "")
        if "锟斤" in bare or signs().pair.search(bare) or signs().odd.search(bare):
            return "garbled"
    if _MARKUP_SIGN.search(s):
        inner = _INLINE_MARKUP.sub("", s).strip()
        if inner != s:
            for name, pattern in _KINDS[1:3]:
                if pattern.search(inner):
                    return name
    if m := _BEGUN.match(s):
        return m.lastgroup
    markup, remark = _KINDS[6][1], _KINDS[7][1]
    if _MARKUP_HINT.search(s) and markup.search(s):
        return "markup"
    # But for addresses, remarks show at the beginning.
    return "remark" if remark.match(s) or ("://" in s and remark.search(s)) else "text"


_short_kind, _long_kind = lru_cache(1 << 16)(_kind), lru_cache(64)(_kind)


@lru_cache(1 << 14)
def _group(c: str) -> str:
    if c in _GROUPS:
        return _GROUPS[c]
    if c.isdigit():
        return "D"
    if "一" <= c <= "鿿":
        return "H"
    return ("U" if c.isupper() else "L") if c.isalpha() else "O"


_ENDED = re.compile(r"(?:^|[。！？!?.…])[ \t\r]*$")


class Perceptron:
    """Averaged multiclass perceptron over string features."""

    def __init__(self, weights: dict[str, dict[str, float]] | None = None):
        self.weights = weights or {}

    def scores(self, features: list[str], classes: list[str]) -> dict[str, float]:
        out = dict.fromkeys(classes, 0.0)
        for f in features:
            if w := self.weights.get(f):
                for c in classes:
                    out[c] += w.get(c, 0.0)
        return out

    def best(self, features: list[str], classes: list[str]) -> tuple[str, float]:
        """The best class and its lead over the first class, which stands for keeping."""
        s = self.scores(features, classes)
        c = max(classes, key=lambda x: s[x])
        return c, s[c] - s[classes[0]]

    def fit(self, examples: list[tuple[list[str], list[str], str]], epochs: int, rng: random.Random) -> None:
        total: dict[tuple[str, str], float] = defaultdict(float)
        stamp: dict[tuple[str, str], int] = defaultdict(int)
        step = 0
        for _ in range(epochs):
            rng.shuffle(examples)
            for features, classes, label in examples:
                step += 1
                guess, _lead = self.best(features, classes)
                if guess != label:
                    for f in features:
                        w = self.weights.setdefault(f, {})
                        for c, d in ((label, 1.0), (guess, -1.0)):
                            total[f, c] += (step - stamp[f, c]) * w.get(c, 0.0)
                            stamp[f, c] = step
                            w[c] = w.get(c, 0.0) + d
        for f, w in self.weights.items():
            for c in w:
                w[c] = (total[f, c] + (step - stamp[f, c]) * w[c]) / max(1, step)


# -- features -----------------------------------------------------------------------------
_WORD_SPOT = re.compile(r"rn|cl|vv|[cfm]|(?<=[a-z])[10](?![\d])|(?<![\d])[10](?=[a-z])|(?<=[A-Z])5(?=[A-Z])|(?<![\w.,])5(?=[a-z]{3})|l(?=nd|nt)")
_SPOT = re.compile(r"(?<=[\d年月第按为 ,.，])[OlSBZ](?=[\d年月日%元份条个笔,.次项天万亿户])|(?<=\d)[OlSBZ]|[OlSBZ](?=\d)|(?<=[A-Z])5(?=[A-Z])")
_SPECK = re.compile(f"(?<=[A-Za-z一-鿿])[{re.escape(SPECKS)}](?=[A-Za-z一-鿿])")
_HAN_RUN = re.compile("[一-鿿]{3,}")
#: A Latin word that may have been misread; one that clean texts hold is left alone.
_WORD = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]*[a-z][A-Za-z0-9]*")
#: Lines in which nothing is misread: signs and garbled characters are other problems' matter.
_UNTOUCHED = frozenset(("markup", "garbled", "formula"))
#: A line that begins with the mark of a block is not the rest of another.
_BLOCK_MARK = re.compile(r"\s*(?:</?(?:div|p|pre|ul|ol|li|h[1-6]|table|tr|td|source|script|style)\b|\\(?:begin|end|item|chapter|section|subsection)\b|\|[-}]|\{\||~~~|```|={3,}\s*$|-{3,}\s*$)", re.IGNORECASE)
#: A page number on a line of its own or after a title.
_PAGE_LIKE = re.compile(r"(?m)^[ \t]*(?:\W{0,2} ?\d{1,4} ?\W{0,2}|第 ?\d{1,4} ?[页頁].*|[Pp]age \d.*|\d{1,4} ?/ ?\d{1,4})[ \t]*$|\S {1,3}\d{1,4}[ \t]*$")


class Confusions:
    """What is learnt of Han characters: ``back``, each misread character with what it stands for, best first; ``sure``, those that are hardly anything else; ``follows`` and ``precedes``, the usual neighbours of characters with their numbers."""

    def __init__(self, back: dict[str, list[str]] | None = None, sure: frozenset[str] = frozenset(), pairs: dict[str, int] | None = None, few: int = SEEN):
        self.back, self.sure, self.pairs, self.few = back or {}, sure, pairs or {}, few
        self.spot = re.compile("[" + "".join(map(re.escape, sorted(self.back))) + "]") if self.back else re.compile("(?!)")
        self.follows: dict[str, dict[str, int]] = defaultdict(dict)
        self.precedes: dict[str, dict[str, int]] = defaultdict(dict)
        for pair, n in self.pairs.items():
            self.follows[pair[0]][pair[1]] = n
            self.precedes[pair[1]][pair[0]] = n
        self.forth: dict[str, list[str]] = defaultdict(list)
        for c, xs in self.back.items():
            for x in xs:
                self.forth[x].append(c)

    def fitting(self, left: str, right: str) -> str | None:
        """The one character that usually stands between two others, if there is one."""
        a, b = self.follows.get(left), self.precedes.get(right)
        if not a or not b:
            return None
        both = sorted(((min(a[x], b[x]), x) for x in (a if len(a) < len(b) else b) if x in a and x in b), reverse=True)
        return both[0][1] if both and both[0][0] >= self.few and (len(both) == 1 or both[0][0] >= 3 * both[1][0]) else None

    def better(self, line: str, at: int) -> list[str]:
        """What a misread character may stand for in its place: what is far more usual beside its neighbours than it is."""
        l1, r1 = line[at - 1 : at] if at else "", line[at + 1 : at + 2]
        seen = lambda c: self.pairs.get(l1 + c, 0) + self.pairs.get(c + r1, 0)
        own = seen(line[at])
        return [x for x in self.back[line[at]] if seen(x) > 4 * own]

    def odd_places(self, run: str) -> list[int]:
        """Places within a run of Han characters that fit neither neighbour, while these fit theirs."""
        if all(map(self.pairs.__contains__, map(add, run, run[1:]))):
            return []
        new = [k for k, pair in enumerate(map(add, run, run[1:])) if pair not in self.pairs]
        return [k for k, j in zip(new[1:], new) if k == j + 1 and 1 < k < len(run) - 2 and run[k - 2 : k] in self.pairs and run[k + 1 : k + 3] in self.pairs] if len(new) > 1 else []


def spot_features(window: str, at: int, size: int) -> list[str]:
    """Features of a character (or two) that misreading may have made, in its window."""
    x, left, right = window[at : at + size], window[:at], window[at + size :]
    l1, l2, r1, r2 = left[-1:], left[-2:], right[:1], right[:2]
    return ["b", x, f"{x}<{l1}", f"{x}>{r1}", f"{x}<<{l2}", f"{x}>>{r2}", f"{x}<>{l1}{r1}", f"{x}<<<{left[-3:]}", f"{x}>>>{right[:3]}", f"{x}<<>>{l2}|{r2}", f"{x}g{_group(l1)}{_group(r1)}"]


def join_features(prev: str, after: str, widest: int) -> list[str]:
    """Features of the end of line ``prev`` before line ``after``."""
    p, a = prev.rstrip(), after.lstrip()
    pk, ak, pe, ns = kind(p), kind(a), _group(p[-1:]), _group(a[:1])
    fill = min(4, int(5 * len(p) / max(1, widest)))
    wide = "w" if widest < 90 else "W"
    return ["b", f"pe{pe}", f"ns{ns}", f"{pe}{ns}", f"pk{pk}", f"ak{ak}", f"{pk}/{ak}", f"{pe}{pk}{ak}", f"{pe}{ns}{fill}{wide}", f"{pk}{fill}{wide}", f"{pe}{ns}{pk}{ak}", f"e{p[-2:]}", f"s{a[:2]}", f"{p[-1:]}{a[:1]}", f"sp{prev != p}{pe}", f"{wide}{pe}{pk}"]


def furniture_features(lines: list[str], k: int, masked: list[str], count: dict[str, int]) -> list[str]:
    """Features of line ``k`` from its pattern and its place on the page."""
    line = lines[k].strip()
    before = lines[k - 1].rstrip() if k else ""
    after = lines[k + 1].strip() if k + 1 < len(lines) else ""
    own, b, a = kind(line), kind(before) if k else "first", kind(after) if k + 1 < len(lines) else "last"
    again = min(3, count[masked[k]])
    pe, ns = _group(before[-1:]), _group(after[:1])
    near = "n" if b == "page" or a == "page" else "-"
    tail = "t" if re.search(r"(?: {2,}\d{1,4})$", line) else "-"
    size = min(3, len(line) // 12)
    return ["b", f"k{own}", f"k{own}{near}{tail}", f"a{again}{own}", f"{own}{pe}{ns}", f"{own}{b}/{a}", f"{own}{near}{again}{size}", f"{own}{tail}", f"{own}{near}{_group(line[-1:])}", f"m{masked[k]}" if len(masked[k]) < 24 and own == "page" else "m", f"{own}{size}{_group(line[-1:])}{near}"]


# -- noise model --------------------------------------------------------------------------
def looks_clean(text: str, sure: frozenset[str] = frozenset()) -> bool:
    """Whether no line of a text breaks off and no trace of misreading stands out."""
    if sure and not sure.isdisjoint(text) or _TRACE.search(text):
        return False
    lines = text.split("\n")
    # What costs least is asked first: most lines end as sentences do.
    for a, b in zip(lines, lines[1:]):
        p = a.rstrip()
        if _group(p[-1:]) not in "TFBE" and kind(p) == "text" and kind(b) != "blank":
            return False
    return not any(kind(x) in ("page", "garbled") for x in lines)


_TRACE = re.compile(r"\d[OlSB]|[OlSB]\d|[A-Za-z][01]|\u00ad|¬\n|(?:[A-Za-z]-|\s)\n")


def wrapped(line: str, rng: random.Random, width: int) -> list[tuple[str, str]]:
    """A line cut as a page of ``width`` would, each part with the operation that undoes the cut after it."""
    out, s = [], line
    latin = sum(c.isascii() for c in line) > len(line) // 2
    while len(s) > width:
        w = max(6, width + rng.randint(-5, 2))
        op = "join"
        if latin:
            cut = s.rfind(" ", 0, w)
            if rng.random() < 0.15 and w + 2 < len(s) and s[w - 1].isalpha() and s[w].isalpha():
                out.append((s[:w] + rng.choice("--\u00ad¬"), "unhyphen"))
                s = s[w:]
                continue
            cut = cut if cut > 4 else w
            part, s, op = s[:cut], s[cut:].lstrip(" "), "blank"
        else:
            part, s = s[:w], s[w:]
        out.append((part + (" " if rng.random() < 0.12 else ""), op))
    return [*out, (s + (" " if rng.random() < 0.05 else ""), "keep")]


def latin_words(text: str) -> set[str]:
    """The Latin words of a text, in lower case."""
    return {w.lower() for w in re.findall("[A-Za-z]{2,}", text)}


def floor(clean: list[str]) -> int:
    """How many clean-looking texts must hold a word: one where there are few, else three."""
    return min(3, 1 + len(clean) // 100)


def vocabulary(seen: dict[str, int], least: int) -> set[str]:
    """Of words with the numbers of clean-looking texts that hold them, those that are no misreadings.

    A misread word may stand in a text that looks clean; in ``least`` it is a word, unless
    it is rare beside the word that undoing one misreading in it gives.
    """
    undone = lambda w: (w[: m.start()] + x.lower() + w[m.end() :] for m in _WORD_SPOT.finditer(w) for x in BACK[m[0]])
    return {w for w, n in seen.items() if n >= least and not any(seen.get(x, 0) >= OUTNUMBERED * n for x in undone(w))}


class Editor:
    """The two perceptrons; trains from clean texts and edits texts."""

    def __init__(self, chars: Perceptron, joins: Perceptron, furniture: Perceptron, words: set[str] | None = None, confusions: Confusions | None = None):
        self.chars, self.joins, self.furniture, self.words = chars, joins, furniture, words or set()
        self.han = confusions or Confusions()
        self._spots: dict[tuple[str, int, str], str] = {}
        self._joins: dict[tuple[str, ...], tuple[str, float]] = {}
        self._lines: dict[tuple[str, ...], bool] = {}

    JOIN_OPS = ["keep", "join", "blank", "unhyphen"]

    @classmethod
    def train(cls, texts: list[str], epochs: int = EPOCHS, seed: int = 7, words: set[str] | None = None, confusions: Confusions | None = None) -> Editor:
        """An editor from clean texts; ``words`` and ``confusions`` are those of the whole corpus, else those of ``texts``."""
        if confusions is None:
            confusions = learnt(dict(trigram_counts(texts)))
        rng = random.Random(seed)
        chars, joins, lines_ = [], [], []
        for t in texts:
            cls._clean_examples(t, confusions, chars, joins, lines_)
            cls._noisy_examples(t, rng, confusions, chars, joins, lines_)
        if words is None:
            seen: dict[str, int] = defaultdict(int)
            for t in texts:
                for w in latin_words(t):
                    seen[w] += 1
            words = vocabulary(seen, floor(texts))
        made = cls(Perceptron(), Perceptron(), Perceptron(), words, confusions)
        made.chars.fit(chars, epochs, rng)
        made.joins.fit(joins, epochs, rng)
        made.furniture.fit(lines_, epochs, rng)
        return made

    @staticmethod
    def _clean_examples(t: str, han: Confusions, chars: list, joins: list, furniture: list) -> None:
        lines = t.split("\n")
        for line in lines:
            if kind(line) in _UNTOUCHED:
                continue
            for m in (*_SPOT.finditer(line), *_WORD_SPOT.finditer(line)):
                a, b = m.span()
                chars.append((spot_features(line[max(0, a - 3) : b + 3], min(3, a), b - a), ["keep", *BACK[m[0]]], "keep"))
            for m in han.spot.finditer(line):
                chars.append((_han_features(line, m.start(), han), ["keep", *han.back[m[0]]], "keep"))
            for m in _SPECK.finditer(line):
                chars.append((_speck_features(line, m.start()), ["keep", "delete"], "keep"))
            for m in _HAN_RUN.finditer(line):
                for k in han.odd_places(m[0]):
                    if (x := han.fitting(m[0][k - 1], m[0][k + 1])) and x != m[0][k]:
                        chars.append((_fit_features(line, m.start() + k, x, han), ["keep", "fit"], "keep"))
        widest = max(map(len, lines))
        for p, a in zip(lines, lines[1:]):
            joins.append((join_features(p, a, widest), Editor.JOIN_OPS, "keep"))
        masked, count = _masks(lines)
        for k, line in enumerate(lines):
            if line.strip():
                furniture.append((furniture_features(lines, k, masked, count), ["keep", "delete"], "keep"))

    @staticmethod
    def _noisy_examples(t: str, rng: random.Random, han: Confusions, chars: list, joins: list, furniture: list) -> None:
        # Misreading: every place that could be misread is an example of undoing it.
        for a, c in enumerate(t):
            if c in han.forth and rng.random() < 0.4:
                x = rng.choice(han.forth[c])
                chars.append((_han_features(t[:a][-4:] + x + t[a + 1 : a + 5], min(4, a), han), ["keep", *han.back[x]], c))
        # Any character in another's place, known or not: offered is the one that fits.
        strange = sorted(han.follows) or ["甲"]
        for m in _HAN_RUN.finditer(t):
            if rng.random() < 0.15:
                k = rng.randrange(1, max(2, len(m[0]) - 1))
                x = rng.choice(strange)
                run = m[0][:k] + x + m[0][k + 1 :]
                if k in han.odd_places(run) and han.fitting(run[k - 1], run[k + 1]) == m[0][k]:
                    line = t[: m.start()][-4:] + run + t[m.end() : m.end() + 4]
                    chars.append((_fit_features(line, min(4, m.start()) + k, m[0][k], han), ["keep", "fit"], "fit"))
        for m in re.finditer(r"rn|[lmeotISdw]|[01258]", t):
            x = LATIN_MISREAD.get(m[0]) or DIGIT_MISREAD[m[0]]
            a, b = m.span()
            left, right = t[max(0, a - 3) : a], t[b : b + 3]
            spot = _WORD_SPOT.match(left + x + right, len(left)) or _SPOT.match(left + x + right, len(left))
            if spot and spot[0] == x and rng.random() < 0.5:
                chars.append((spot_features(left + x + right, len(left), len(x)), ["keep", *BACK[x]], m[0]))
        for m in re.finditer(r"(?<=[A-Za-z一-鿿])(?=[A-Za-z一-鿿])", t):
            if rng.random() < 0.01:
                line = t[: m.start()][-4:] + rng.choice(SPECKS) + t[m.end() :][:4]
                chars.append((_speck_features(line, min(4, m.start())), ["keep", "delete"], "delete"))
        for m in re.finditer("[A-Za-z]{6,}", t):
            if rng.random() < 0.1:
                k = rng.randrange(1, len(m[0]))
                chars.append((_lost_features(m[0][:k] + m[0][k + 1 :], k, m[0][k]), ["keep", "insert"], "insert"))
        # Wrapping and furniture.
        latin = sum(c.isascii() for c in t) > len(t) // 2
        width = rng.randint(38, 78) if latin else rng.randint(16, 42)
        page, pages, form, title = rng.randint(1, 180), 200, rng.choice(PAGE_FORMS), _title(t, rng)
        numbered = rng.random() < 0.8  # else the pages have running headers and no numbers
        parts: list[tuple[str, str]] = []
        for line in t.split("\n"):
            parts += wrapped(line, rng, width) if kind(line) not in ("markup", "blank") else [(line, "keep")]
        lines, ops, left = [], [], rng.randint(3, 12)
        for s, op in parts:
            lines.append(s)
            ops.append(op)
            left -= 1
            if left <= 0:
                left = rng.randint(4, 14)
                if numbered:
                    lines.append(form.format(n=page, m=pages))
                    ops.append("page")
                if not numbered or rng.random() < 0.6:
                    lines.append(title + (f"  {page + 1}" if numbered and rng.random() < 0.5 else ""))
                    ops.append("page")
                page += 1
        if numbered and rng.random() < 0.3:
            lines.append(form.format(n=page, m=pages))
            ops.append("page")
        masked, count = _masks(lines)
        for k, line in enumerate(lines):
            if line.strip():
                furniture.append((furniture_features(lines, k, masked, count), ["keep", "delete"], "delete" if ops[k] == "page" else "keep"))
        kept = [(s, op) for s, op in zip(lines, ops) if op != "page"]
        widest = max(len(s) for s, _ in kept)
        for (p, op), (a, _) in zip(kept, kept[1:]):
            joins.append((join_features(p, a, widest), Editor.JOIN_OPS, op))

    # -- editing ----------------------------------------------------------------------
    def _spot(self, text: str, m: re.Match) -> str:
        a, b = m.span()
        key = (text[max(0, a - 3) : a], m[0], text[b : b + 3])
        if (known := self._spots.get(key)) is None:
            classes = ["keep", *BACK[m[0]]] if BACK[m[0]] else ["keep"]
            w = "".join(key)
            c, lead = self.chars.best(spot_features(w, len(key[0]), b - a), classes)
            known = c if c != "keep" and lead > MARGIN else m[0]
            self._remember(self._spots, key, known)
        return known

    def _lead(self, features: list[str], classes: list[str]) -> str:
        key = ("\0", *features)
        if (known := self._lines.get(key)) is None:
            c, lead = self.chars.best(features, classes)
            known = c if lead > MARGIN else "keep"
            self._remember(self._lines, key, known)
        return known

    @staticmethod
    def _remember(memory: dict, key: tuple, answer: object) -> None:
        if len(memory) > 200_000:
            memory.clear()
        memory[key] = answer

    def _word(self, line: str, m: re.Match) -> str:
        word = m[0]
        if word.lower() in self.words:
            return word
        if _WORD_SPOT.search(word):
            out, pos, odd = [], m.start(), re.search("[01]", word)
            for s in _WORD_SPOT.finditer(line, *m.span()):
                out += [line[pos : s.start()], self._spot(line, s)]
                pos = s.end()
            new = "".join([*out, line[pos : m.end()]])
            if new.lower() in self.words or (odd and new.isalpha() and len(new) > 3 and new.islower()):
                return new
        return self._lost_letter(line, m)

    def _lost_letter(self, line: str, m: re.Match) -> str:
        """A word no text holds, with the one letter put in that makes it a word; a line's last word may be cut and stays."""
        word = m[0]
        if len(word) < 5 or not word.isalpha() or not word[1:].islower() or m.end() == len(line.rstrip()):
            return word
        low = word.lower()
        found = {(k, x) for k in range(1, len(low)) for x in "abcdefghijklmnopqrstuvwxyz" if low[:k] + x + low[k:] in self.words}
        if len({low[:k] + x + low[k:] for k, x in found}) != 1:
            return word
        k, x = min(found)
        return word[:k] + x + word[k:] if self._lead(_lost_features(word, k, x), ["keep", "insert"]) == "insert" else word

    def _han(self, line: str) -> str:
        """A line with its misread Han characters put right: those known to be misreadings, then those that do not fit."""
        han, out = self.han, None
        for m in han.spot.finditer(line):
            a = m.start()
            if not (offered := han.better(line, a)):
                continue
            c = self._lead(_han_features(line, a, han), ["keep", *offered])
            if c != "keep":
                out = out or list(line)
                out[a] = c
        line = "".join(out) if out else line
        if not han.pairs:
            return line
        for m in _HAN_RUN.finditer(line):
            for k in han.odd_places(m[0]):
                a = m.start() + k
                x = han.fitting(line[a - 1], line[a + 1])
                if x and x != line[a] and self._lead(_fit_features(line, a, x, han), ["keep", "fit"]) == "fit":
                    line = line[:a] + x + line[a + 1 :]
        return line

    def _characters(self, line: str) -> str:
        """A line or paragraph with its misread characters put right; what stands inside signs of markup is left alone."""
        word, spot = _WORD.search(line), _SPOT.search(line)
        if not (word or spot or _HAN_RUN.search(line)) or kind(line) in _UNTOUCHED:
            return line
        line = self._han(line)
        if (speck := _SPECK.search(line)) and not _MARKUP_SIGN.search(line.replace(speck[0], "")):
            line = _SPECK.sub(lambda m: "" if self._lead(_speck_features(line, m.start()), ["keep", "delete"]) == "delete" else m[0], line)
        word, spot = word and _WORD.search(line), spot and _SPOT.search(line)
        if not (word or spot):
            return line
        signs_ = [m.span() for m in _INLINE_MARKUP.finditer(line)] if _MARKUP_SIGN.search(line) else []
        free = lambda m: not any(a < m.end() and m.start() < b for a, b in signs_)
        if spot:
            new = _SPOT.sub(lambda m: self._spot(line, m) if not signs_ or free(m) else m[0], line)
            if len(new) == len(line):
                line = new
        return _WORD.sub(lambda m: self._word(line, m) if not signs_ or free(m) else m[0], line) if word else line

    def edit(self, text: str) -> tuple[str, int, int, int]:
        """The repaired text and how many characters, line ends and furniture lines were edited."""
        if _UNUSUAL.search(text):
            text = canonical(text.replace("\u00ad\n", "-\n"))
        fixed = 0
        lines = text.split("\n")
        gone = 0
        # Furniture is a page number, what stands beside one, or a line that comes again; a text without any has none.
        full = [x for x in lines if x and not x.isspace()]
        if len(set(full)) < len(full) or _PAGE_LIKE.search(text):
            masked, count = _masks(lines)
            kept = [x for k, x in enumerate(lines) if not (x.strip() and self._furniture(lines, k, masked, count))]
            gone = len(lines) - len(kept)
            lines = kept
        joined = 0
        if len(lines) > 1:
            widest = max(map(len, lines))
            # A line that ends as a sentence does proves nothing; only on a page with broken lines may it be one of them.
            ops = ["keep" if _ENDED.search(p) or not a.strip() else self._join(p, a, widest) for p, a in zip(lines, lines[1:])]
            joined = sum(op != "keep" for op in ops)
            if joined > 1:
                ops = [self._join(p, a, widest) if op == "keep" and a.strip() and p.strip() else op for op, p, a in zip(ops, lines, lines[1:])]
            out = lines[:1]
            for op, a in zip(ops, lines[1:]):
                if op == "keep":
                    out.append("\n" + a)
                    continue
                out[-1] = out[-1].rstrip()
                if op == "unhyphen" and out[-1][-1:] in "-\u00ad¬":
                    out[-1] = out[-1][:-1]
                out.append((" " if op == "blank" or (op == "join" and out[-1][-1:].isascii() and a.lstrip()[:1].isascii() and out[-1][-1:].isalpha()) else "") + a.lstrip())
            lines = "".join(out).split("\n")
        for k, line in enumerate(lines):
            new = self._characters(line)
            if new != line:
                fixed += sum(a != b for a, b in zip(line, new)) or 1
                lines[k] = new
        text = "\n".join(lines)
        return text, fixed, joined, gone

    def _furniture(self, lines: list[str], k: int, masked: list[str], count: dict[str, int]) -> bool:
        features = tuple(furniture_features(lines, k, masked, count))
        if (known := self._lines.get(features)) is None:
            c, lead = self.furniture.best(list(features), ["keep", "delete"])
            known = c == "delete" and lead > MARGIN
            self._remember(self._lines, features, known)
        return known

    def _join(self, p: str, a: str, widest: int) -> str:
        pk, ak = kind(p), kind(a)
        if "garbled" in (pk, ak) or "blank" in (pk, ak) or pk == ak == "code" or _BLOCK_MARK.match(a):
            return "keep"
        features = tuple(join_features(p, a, widest))
        if (known := self._joins.get(features)) is None:
            c, lead = self.joins.best(list(features), self.JOIN_OPS)
            known = c if lead > MARGIN else "keep"
            self._remember(self._joins, features, known)
        return known


def _han_features(line: str, at: int, han: Confusions) -> list[str]:
    """Features of a Han character that may be misread, and how its reading and the likeliest other fit the neighbours."""
    x, l1, r1 = line[at], line[at - 1 : at] if at else "", line[at + 1 : at + 2]
    other = han.back[x][0]
    fit = lambda c: f"{(l1 + c in han.pairs):d}{(c + r1 in han.pairs):d}"
    return [*spot_features(line[max(0, at - 3) : at + 4], min(3, at), 1), f"fit{fit(x)}{fit(other)}", f"{x}fit{fit(x)}{fit(other)}", f"sure{x in han.sure}{fit(x)}"]


def _size(n: int) -> int:
    return min(9, max(n, 1).bit_length())


def _fit_features(line: str, at: int, x: str, han: Confusions) -> list[str]:
    """Features of a Han character that fits neither neighbour, against ``x`` that fits both."""
    l1, r1 = line[at - 1], line[at + 1]
    a, b = _size(han.pairs.get(l1 + x, 0)), _size(han.pairs.get(x + r1, 0))
    outer = f"{(line[at - 2 : at] in han.pairs):d}{(line[at + 1 : at + 3] in han.pairs):d}"
    return ["f", f"f{min(a, b)}", f"fo{outer}", f"fo{outer}{min(a, b)}", f"fk{line[at] in han.follows}", f"fs{_size(sum(han.follows.get(line[at], {}).values()))}", f"fx{l1}{x}{r1}", f"f{l1}{x}", f"f{x}{r1}"]


def _speck_features(line: str, at: int) -> list[str]:
    l1, r1 = line[at - 1 : at], line[at + 1 : at + 2]
    return ["d", f"d{line[at]}", f"d{_group(l1)}{_group(r1)}", f"d{line[at]}{_group(l1)}{_group(r1)}", f"d{line[at]}{r1}"]


def _lost_features(word: str, k: int, x: str) -> list[str]:
    return ["i", f"i{min(len(word), 12)}", f"i{x}", f"i{word[k - 1 : k]}{x}{word[k : k + 1]}", f"ie{k == len(word)}", f"id{x in (word[k - 1 : k], word[k : k + 1])}"]


@lru_cache(1 << 14)
def _simplified(c: str) -> bool:
    """Whether simplified texts are written with a character."""
    try:
        return bool(c.encode("gb2312"))
    except UnicodeEncodeError:
        return False


def trigram_counts(texts: list[str]) -> list[tuple[int, int]]:
    """The trigrams of Han characters in some texts, packed into whole numbers, with their numbers; and single characters, as trigrams whose outer parts are ``NONE``."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) - 0x4E00
    if len(codes) < 3:
        return []
    han = (codes >= 0) & (codes < 0x5200)
    whole = han[:-2] & han[1:-1] & han[2:]
    packed, n = np.unique((codes[:-2] << 32 | codes[1:-1] << 16 | codes[2:])[whole], return_counts=True)
    single, m = np.unique(codes[han], return_counts=True)
    return [*zip(packed.tolist(), n.tolist()), *zip((single << 16 | (NONE << 32 | NONE)).tolist(), m.tolist())]


NONE = 0xFFFF


def _unpacked(t: int) -> str:
    return "".join(chr(0x4E00 + (t >> s & 0xFFFF)) for s in (32, 16, 0))


def learnt(counts: dict[int, int]) -> Confusions:
    """Confusions from trigram counts held in one place: those of a few texts."""
    contexts: dict[tuple[str, str], list[tuple[int, str]]] = defaultdict(list)
    left: dict[str, int] = defaultdict(int)
    right: dict[str, int] = defaultdict(int)
    single: dict[str, int] = defaultdict(int)
    for t, n in counts.items():
        if t & NONE == NONE:
            single[chr(0x4E00 + (t >> 16 & NONE))] = n
            continue
        a, c, b = _unpacked(t)
        contexts[a, b].append((n, c))
        left[a + c] += n
        right[c + b] += n
    found: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])
    few = support(sum(n for t, n in counts.items() if t & NONE != NONE))
    for seen in contexts.values():
        n, x = max(seen)
        if n >= few and n >= SHARE * sum(m for m, _ in seen):
            for m, c in seen:
                if c != x and m * RARER <= n:
                    found[c, x][0] += 1
                    found[c, x][1] += m
    rows = [(c, x, k, n, single[c]) for (c, x), (k, n) in found.items() if k >= CONTEXTS]
    # A pair begins or ends a trigram; at the end of a run it only ends one.
    pairs = {p: max(left.get(p, 0), right.get(p, 0)) for p in {*left, *right}}
    return confusions(rows, {p: n for p, n in pairs.items() if n >= 3}, few)


def support(total: int) -> int:
    """How often what stands for a context must be seen: ``SEEN`` times, less where there are few texts at all."""
    return min(SEEN, 3 + total // 50_000)


def confusions(rows: list[tuple[str, str, int, int, int]], pairs: dict[str, int], few: int = SEEN) -> Confusions:
    """Confusions from rows (character, what it stands for, contexts, places, all places of the character)."""
    back: dict[str, list[str]] = defaultdict(list)
    explained: dict[str, float] = defaultdict(float)
    for c, x, _, n, every in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if not (_simplified(c) and _simplified(x)):
            continue  # a traditional character is another form of its simplified one, no misreading
        # A character read for others stands for few of them: what it is put for at random is spread thin.
        if n >= EXPLAINED * every:
            back[c].append(x)
            explained[c] += n / max(1, every)
    return Confusions({c: x for c, x in back.items() if x}, frozenset(c for c, e in explained.items() if e >= 0.5), pairs, few)


def _masks(lines: list[str]) -> tuple[list[str], dict[str, int]]:
    masked = [re.sub(r"\d+", "9", x.strip()) for x in lines]
    count: dict[str, int] = defaultdict(int)
    for m in masked:
        count[m] += 1
    return masked, count


def _title(t: str, rng: random.Random) -> str:
    found = re.findall(r"《([^》\n]{4,24})》", t) or re.findall(r"(?:[A-Z][a-zé]+ ){1,3}Fund", t)
    return rng.choice(found).upper() if found and found[0].isascii() else rng.choice(found) if found else "年度报告"


def word_counts(df: DataFrame, text: str, sure: frozenset[str]) -> DataFrame:
    """``w``, ``n``: the Latin words of all clean-looking texts and how many different texts hold each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(w, h) for t, h in dict(zip(batch["t"], batch["h"])).items() if looks_clean(t, sure) for w in latin_words(t)]
            yield pd.DataFrame(found, columns=["w", "h"]).astype({"h": "int64"})

    t = F.col(text)
    rows = df.where(t.rlike("[A-Za-z]{2}")).select(t.alias("t"), F.xxhash64(t).alias("h"))
    return rows.mapInPandas(run, "w string, h long").distinct().groupBy("w").agg(F.count("*").alias("n"))


def corpus_confusions(df: DataFrame, text: str) -> Confusions:
    """Confusions learnt from the trigrams of all texts: counted in partial sums, compared within their contexts by a join of each context's usual trigram with its rare ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(trigram_counts([t for t in batch["t"] if t]), columns=["g", "n"]).astype("int64")

    counted = df.select(F.col(text).alias("t")).where(F.col("t").isNotNull()).mapInPandas(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    part = lambda shift: F.shiftright("g", shift).bitwiseAND(F.lit(0xFFFF)).cast("int")
    g = checkpointed(counted.select(part(32).alias("a"), part(16).alias("c"), part(0).alias("b"), "n"))
    every = g.where(F.col("a") == NONE).select("c", F.col("n").alias("every"))
    g = g.where(F.col("a") != NONE)
    total = g.agg(F.sum("n")).first()[0] or 0
    few = support(int(total))
    least = max(few, total * LEAST_SHARE)
    usual = g.groupBy("a", "b").agg(F.max_by("c", F.struct("n", "c")).alias("x"), F.max("n").alias("top"), F.sum("n").alias("s")).where((F.col("top") >= least) & (F.col("top") >= SHARE * F.col("s")))
    rare = g.join(usual, ["a", "b"]).where((F.col("c") != F.col("x")) & (F.col("n") * RARER <= F.col("top")))
    pairs = rare.groupBy("c", "x").agg(F.count("*").alias("k"), F.sum("n").alias("n")).where(F.col("k") >= CONTEXTS)
    char = lambda n: chr(0x4E00 + n)
    # Pairs that explain a tenth of a character's places: at most ten a character.
    rows = [(char(r.c), char(r.x), r.k, r.n, r.every) for r in pairs.join(every, "c").where(F.col("n") >= EXPLAINED * F.col("every")).collect()]
    # A pair begins or ends a trigram; at the end of a run it only ends one.
    pair = g.select(F.inline(F.array(F.struct(F.col("a").alias("x"), F.col("c").alias("y"), F.col("n").alias("l"), F.lit(0).cast("long").alias("r")), F.struct(F.col("c").alias("x"), F.col("b").alias("y"), F.lit(0).cast("long").alias("l"), F.col("n").alias("r")))))
    bigrams = pair.groupBy("x", "y").agg(F.greatest(F.sum("l"), F.sum("r")).alias("n")).where(F.col("n") >= max(3, total * LEAST_SHARE)).collect()
    return confusions(rows, {char(r.x) + char(r.y): r.n for r in bigrams}, few)


def trained(df: DataFrame, text: str, sample: int = SAMPLE) -> Editor:
    """An editor trained on at most ``sample`` different texts of ``df``, the first by hash, on all words of clean-looking texts and the confusions of all texts."""
    t = F.col(text)
    rows = df.where(t.isNotNull() & (F.length(t) >= 40)).select(t.alias("t"), F.xxhash64(t).alias("h"))
    # Only the share of hashes that holds about two samples is looked at, so that no task sends the driver more.
    share = min(1.0, 2 * sample / max(1, rows.agg(F.approx_count_distinct("h")).first()[0]))
    rows = rows.where(F.pmod("h", F.lit(1_000_000)) < F.lit(int(1_000_000 * share) + 1)).dropDuplicates(["h"]).orderBy("h").limit(sample).collect()
    han = corpus_confusions(df, text)
    clean = [r.t for r in rows if looks_clean(r.t, han.sure)]
    least = floor(clean)
    words = vocabulary({r.w: r.n for r in word_counts(df, text, han.sure).where(F.col("n") >= least).collect()}, least)
    return Editor.train(clean, words=words, confusions=han)


def repaired(df: DataFrame, keys: list[str], text: str, only_found: bool = False, sample: int = SAMPLE) -> DataFrame:
    """``keys``, ``repaired`` text and the numbers of edits of every row that is not null.

    Defined cases: null texts are left out, empty and clean texts come back as they are
    (in the one form of problem 3 where they hold unusual forms); repeated rows are kept;
    other columns are ignored; an empty table trains an editor that keeps everything.
    With ``only_found`` only ``keys`` of the rows with an edit are returned. The editor is
    some megabytes, its weights bounded by the sample and its words by the corpus's
    vocabulary; editing is one narrow pass.
    """
    editor = trained(df, text, sample)
    shared = df.sparkSession.sparkContext.broadcast((editor.chars.weights, editor.joins.weights, editor.furniture.weights, editor.words, (editor.han.back, editor.han.sure, editor.han.pairs, editor.han.few)))
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Editor(*(Perceptron(w) for w in shared.value[:3]), shared.value[3], Confusions(*shared.value[4]))
        for batch in batches:
            got = [own.edit(t) for t in batch[text]]
            if only_found:
                yield batch[keys][[a + b + c > 0 for _, a, b, c in got]]
            else:
                yield batch[keys].assign(repaired=[g[0] for g in got], n_characters=[g[1] for g in got], n_line_ends=[g[2] for g in got], n_furniture=[g[3] for g in got])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    if not only_found:
        schema += ", repaired string, n_characters int, n_line_ends int, n_furniture int"
    return df.select(*keys, text).where(F.col(text).isNotNull()).mapInPandas(run, schema)
