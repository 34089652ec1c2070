"""Text functions: retrieval tokens, Chinese numerals, content ids, names."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The blanks stripped from segments, and a Latin word.
BLANKS = r"\s\u00a0\u2000-\u200a\u202f\u205f\u3000"
WORD = "[A-Za-z0-9]+"
_DIGITS = {c: i for i, c in enumerate("〇一二三四五六七八九")} | {"零": 0, "两": 2}
_UNITS = {"十": 10, "百": 100, "千": 1000}


def retrieval_tokens(text: Column) -> Column:
    """Latin words, lower-cased, and the bigrams of what stands between them.

    Segments between words are stripped of blanks at their ends; bigrams keep inner blanks
    and marks; a segment of one character gives none. Null gives null. All on the JVM, in
    time linear in the text.
    """
    words = F.transform(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.lower)
    ends = f"^[{BLANKS}]+|[{BLANKS}]+$"
    segments = F.transform(F.split(text, WORD), lambda s: F.regexp_replace(s, ends, ""))
    # A lookahead alone would step by UTF-16 units; a consumed character steps by code points.
    first = lambda s: F.regexp_extract_all(s, F.lit(r"(?s)(.)(?=.)"), F.lit(1))
    second = lambda s: F.regexp_extract_all(s, F.lit(r"(?s).(?=(.))"), F.lit(1))
    grams = F.flatten(F.transform(F.filter(segments, lambda s: F.length(s) > 1), lambda s: F.zip_with(first(s), second(s), lambda a, b: F.concat(a, b))))
    return F.concat(words, grams)


def retrieval_length(text: Column) -> Column:
    """The number of retrieval tokens, without making them."""
    ends = f"^[{BLANKS}]+|[{BLANKS}]+$"
    inner = F.aggregate(F.split(text, WORD), F.lit(0), lambda n, s: n + F.greatest(F.length(F.regexp_replace(s, ends, "")) - 1, F.lit(0)))
    return F.regexp_count(text, F.lit(WORD)) + inner


def numeral(text: str) -> int | None:
    """A Chinese or Arabic whole number below ten thousand; None for anything else."""
    if text.isascii() and text.isdigit():
        return int(text)
    if not text or any(c not in _DIGITS and c not in _UNITS for c in text):
        return None
    if not any(c in _UNITS for c in text):
        return int("".join(str(_DIGITS[c]) for c in text))
    total, digit = 0, None
    for c in text:
        if c in _DIGITS:
            digit = _DIGITS[c]
        else:
            total += (1 if digit is None else digit) * _UNITS[c]
            digit = None
    return total + (digit or 0)


def canonical_json(value: Any) -> str:
    """JSON with sorted keys and nothing between its parts; characters stay as they are."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def content_id(prefix: str, *columns: Column) -> Column:
    """An identity made of content: the same content has the same id. Null and empty differ."""
    parts = [F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws("|", *parts), 256))


def local_name(column: Column) -> Column:
    """What follows the last '#' or '/' of an identity."""
    return F.regexp_extract(column, r"([^#/]*)$", 1)


def han_numeral(n: int) -> str:
    """A whole number from 1 to 9999 in Chinese, as articles are counted: what ``numeral`` reads back."""
    out, zero = "", False
    for unit, name in ((1000, "千"), (100, "百"), (10, "十"), (1, "")):
        d, n = divmod(n, unit)
        if d:
            out += ("零" if zero and out else "") + ("" if d == 1 and unit == 10 and not out else "一二三四五六七八九"[d - 1]) + name
            zero = False
        elif out:
            zero = True
    return out


def token_estimate(text: Column) -> Column:
    """About how many tokens a text has: one for each run of ASCII word letters, one for each other character. Null gives null."""
    runs = F.regexp_count(text, F.lit("[A-Za-z0-9_-]+"))
    return runs + F.length(F.regexp_replace(text, "[A-Za-z0-9_-]+", ""))


def strict_day(text: Column) -> Column:
    """The day of a text that is written YYYY-MM-DD and is one; null otherwise."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def normal_url(url: Column) -> Column:
    """An address in one form: scheme and host in lower case, no default port, no fragment, no slash at the end, parameters sorted."""
    head = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*", 0))
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    plain = F.regexp_replace(F.regexp_replace(F.concat(head, path), r"^(http://[^/:]*):80(/|$)", "$1$2"), r"^(https://[^/:]*):443(/|$)", "$1$2")
    asked = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.concat(plain, F.when(asked != "", F.concat(F.lit("?"), F.array_join(F.array_sort(F.split(asked, "&")), "&"))).otherwise(""))
