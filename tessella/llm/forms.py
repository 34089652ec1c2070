"""One form for text that looks the same (problem 3).

A code point is *stable* if it maps to itself under the fold below, starts no
composition and takes part in none: the quick check of Unicode normalisation, widened
to look-alikes and invisible characters. A regular expression made of the unstable code
points isolates the segments that may change; only these, with the base character
before them as boundary context, are normalised and spliced back into the untouched
text. Texts without an unstable code point are returned as they are.

Folded: width of forms, kinds of blank, invisible characters, composition of accents,
look-alike letters of Latin, Greek and Cyrillic, hyphens, Han compatibility forms and
radicals, line ends. Kept apart: digits, raised and circled digits, letter case, accents,
traditional and simplified characters, other punctuation marks.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.sources.tables import checkpointed

# Latin letters, each with the Greek and Cyrillic letters drawn like it.
LOOKALIKES = {
    other: latin
    for latin, others in {
        "A": "ΑА", "B": "ΒВ", "C": "СϹ", "E": "ΕЕ", "G": "Ԍ", "H": "ΗН", "I": "ΙІӀ", "J": "ͿЈ", "K": "ΚК", "M": "ΜМ", "N": "Ν", "O": "ΟО", "P": "ΡР", "Q": "Ԛ",
        "S": "Ѕ", "T": "ΤТ", "W": "Ԝ", "X": "ΧХ", "Y": "ΥҮ", "Z": "Ζ", "a": "аɑ", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "і", "j": "јϳ",
        "o": "оο", "p": "рρ", "q": "ԛ", "s": "ѕ", "v": "ѵ", "w": "ԝ", "x": "х", "y": "у", "\u03bc": "\u00b5",
    }.items()
    for other in others
}
# Hyphens drawn like the hyphen-minus.
HYPHENS = "\u02d7\u2010\u2011\u2043\u2212\ufe63\uff0d"
# Han radicals without a compatibility mapping, and the characters drawn like them.
RADICALS = dict(
    zip(
        "⺀⺄⺅⺇⺈⺉⺊⺌⺍⺎⺐⺒⺓⺔⺕⺖⺗⺘⺙⺛⺝⺞⺟⺠⺡⺣⺤⺥⺦⺨⺩⺪⺫⺬⺭⺯⺰⺱⺲⺶⺷⺸⺹⺺⺻⺼⺽⺾⺿⻀⻁⻂⻃⻄⻅⻆⻇⻈⻉⻋⻌⻍⻎⻐⻑⻒⻓⻔⻖⻗⻘⻙⻚⻛⻜⻝⻟⻠⻢⻣⻤⻥⻦⻧⻨⻩⻪⻬⻮⻯⻰⻳",
        "冫乙亻几刀刂卜小小兀尣巳幺彑彐忄心扌攵旡月歺母民氵灬爫爫丬犭王疋目示礻糸纟罓罒羊羋羊耂肀聿月臼艹艹艹虎衤覀西见角角讠贝车辶辶辶钅長镸长门阝雨青韦页风飞食飠饣马骨鬼鱼鸟卤麦黄黾齐齿竜龙龟",
    )
)
# Ranges of characters that show nothing.
INVISIBLE = (
    r"­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮"
    r"⁠-⁯︀-️﻿ﾠ￹-￻\U000e0000-\U000e0fff"
)


def _width_like(c: str) -> bool:
    """Whether the compatibility form of ``c`` only differs in width, ligature or Han form."""
    code = ord(c)
    return (
        0xFF00 <= code <= 0xFFEF
        or 0xFE50 <= code <= 0xFE6F
        or 0xFB00 <= code <= 0xFB06
        or 0x2E80 <= code <= 0x2FDF
        or 0xF900 <= code <= 0xFAFF
        or 0x2F800 <= code <= 0x2FA1F
        or 0x2160 <= code <= 0x217F
        or 0x3131 <= code <= 0x318E
        or 0x1D400 <= code <= 0x1D7FF
    )


@lru_cache(1 << 16)
def fold_character(c: str) -> str:
    """The form of one code point, before composition."""
    if c in RADICALS:
        return RADICALS[c]
    if _width_like(c):
        wide = unicodedata.normalize("NFKC", c)
        return wide if wide == c else "".join(map(fold_character, wide))
    if c in HYPHENS:
        return "-"
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c not in "\n\r" and (unicodedata.category(c) == "Zs" or c in "\t\v\f"):
        return " "
    if c in "\u2028\u2029":
        return "\n"
    return c


_EXACT = {*LOOKALIKES, *RADICALS, *HYPHENS}


class Unstable:
    """Patterns for the segments that may change, made from the properties of all code points."""

    def __init__(self) -> None:
        alone, marks = [*map(ord, "\t\v\f\r")], []
        for code in range(0x80, 0x30000):  # beyond lie no characters with another form
            c = chr(code)
            if not (unicodedata.decomposition(c) or unicodedata.combining(c) or c in _EXACT or unicodedata.category(c) in ("Zs", "Zl", "Zp") or 0x1100 <= code <= 0x11FF):
                continue
            if unicodedata.combining(c) or 0x1161 <= code <= 0x11FF:
                marks.append(code)
            elif fold_character(c) != c or not unicodedata.is_normalized("NFC", c) or any(x in LOOKALIKES for x in unicodedata.normalize("NFD", c)):
                alone.append(code)

        def ranges(codes: list[int]) -> str:
            out: list[list[int]] = []
            for c in codes:
                if out and c == out[-1][1] + 1:
                    out[-1][1] = c
                else:
                    out.append([c, c])
            return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in out)

        self.hidden = re.compile(f"[{INVISIBLE}]+")
        self.mark = re.compile(f"[{ranges(marks)}]")
        self.composed = re.compile(f".[{ranges(marks)}]+", re.DOTALL)
        self.alone = re.compile(f"[{ranges(alone)}]+")


@lru_cache(1)
def unstable() -> Unstable:
    return Unstable()


@lru_cache(1 << 16)
def _fold(segment: str) -> str:
    """The form of one segment: folded, decomposed, folded again below its marks, composed."""
    text = "".join(map(fold_character, segment))
    return unicodedata.normalize("NFC", "".join(map(fold_character, unicodedata.normalize("NFD", text))))


def canonical(text: str | None) -> str | None:
    """The one form of ``text``; null stays null. Applying it twice changes nothing more."""
    if text is None:
        return None
    u = unstable()
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text.isascii():
        if u.hidden.search(text):
            text = u.hidden.sub("", text)
        if u.mark.search(text):
            text = u.composed.sub(lambda m: _fold(m[0]), text)
    return u.alone.sub(lambda m: _fold(m[0]), text)


@F.pandas_udf(T.StringType())
def canonical_form(text: pd.Series) -> pd.Series:
    """``canonical`` over a column, an Arrow batch at a time."""
    return text.map(canonical)


def form_members(df: DataFrame, key: str, text: str, group: str) -> DataFrame:
    """``g``, ``k``, ``r``, ``f``: every record's group, key, hash of its text and hash of its form.

    Records with one ``f`` look the same, those with one ``r`` are the same. Null and empty
    texts are no record's text; a key that occurs twice with one text is one record. Only
    hashes are kept; the texts are read and folded once.
    """
    raw, form = F.col(text), canonical_form(F.col(text))
    d = df.where(raw.isNotNull() & (raw != "")).select(F.col(group).alias("g"), F.col(key).alias("k"), _hash(raw).alias("r"), _hash(form).alias("f")).distinct()
    return checkpointed(d)


def form_classes(members: DataFrame) -> DataFrame:
    """``g``, ``f``, ``n_spellings``, ``n_records`` of every form that stands in several spellings: one row a class, no pairs."""
    spelled = members.groupBy("g", "f", "r").agg(F.count("*").alias("n"))
    return spelled.groupBy("g", "f").agg(F.count("*").alias("n_spellings"), F.sum("n").alias("n_records")).where("n_spellings > 1")


def lookalikes(df: DataFrame, key: str, text: str, group: str, salted: int = 1000) -> DataFrame:
    """Pairs of records of one ``group`` that look the same but differ in characters.

    Returned are ``group``, ``id_a`` < ``id_b``. Defined cases: null texts are no record's
    text and give no pair; empty texts are equal to each other, so give none; identical
    texts give none; a key that occurs twice is one record; other columns are ignored.

    Texts meet by a 128-bit hash of their form. First each form is reduced to its number
    of distinct raw texts, with partial aggregates; only forms with several take part in
    the join, so a large group of exact copies costs one aggregate and never meets itself.
    Where a form has more than ``salted`` records, one side of the pairs is dealt over salts,
    so that the pairs of a large class, which the result demands, are written by many tasks.
    """
    members = form_members(df, key, text, group)
    classes = checkpointed(form_classes(members).select("g", "f", F.ceil(F.col("n_records") / salted).cast("int").alias("salts")))
    d = members.join(classes, ["g", "f"])
    a = d.select(F.col("g").alias("ag"), F.col("f").alias("af"), F.col("k").alias("ak"), F.col("r").alias("ar"), F.pmod(F.xxhash64("k"), F.col("salts")).cast("int").alias("a_salt"))
    b = d.select(F.col("g").alias("bg"), F.col("f").alias("bf"), F.col("k").alias("bk"), F.col("r").alias("br"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("b_salt"))
    met = a.join(b, (F.col("ag") == F.col("bg")) & (F.col("af") == F.col("bf")) & (F.col("a_salt") == F.col("b_salt")) & (F.col("ak") < F.col("bk")) & (F.col("ar") != F.col("br")))
    return met.select(F.col("ag").alias(group), F.col("ak").alias("id_a"), F.col("bk").alias("id_b")).distinct()


def _hash(c: Column) -> Column:
    return F.unhex(F.md5(c.cast("binary")))
