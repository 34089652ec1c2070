"""HTML bodies and headed sections of legal texts, row by row in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import numeral

_SKIPPED = frozenset(("script", "style", "noscript", "template"))
_BLOCK = frozenset(("p", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "br", "table", "ul", "ol", "section", "article"))


class _Body(HTMLParser):
    """Collects the text of one container's blocks, white space collapsed."""

    def __init__(self, container: str):
        super().__init__(convert_charrefs=True)
        self.container, self.depth, self.skipped, self.found = container, 0, 0, 0
        self.lines: list[str] = [""]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == self.container:
            self.found += self.depth == 0
            self.depth += 1
        if tag in _SKIPPED:
            self.skipped += 1
        if tag in _BLOCK:
            self.lines.append("")

    def handle_endtag(self, tag: str) -> None:
        if tag == self.container and self.depth:
            self.depth -= 1
        if tag in _SKIPPED and self.skipped:
            self.skipped -= 1
        if tag in _BLOCK:
            self.lines.append("")

    def handle_data(self, data: str) -> None:
        if self.depth and not self.skipped:
            self.lines[-1] += data


def body_lines(raw: str, container: str = "div") -> list[str] | None:
    """The lines of the one outermost ``container``; None if there is none or more than one."""
    p = _Body(container)
    p.feed(raw)
    p.close()
    lines = [re.sub(r"\s+", " ", x).strip() for x in p.lines]
    return [x for x in lines if x] if p.found == 1 else None


_HEAD = re.compile(r"^(第)([一二三四五六七八九十百千〇零两\d]{1,8})([编章节條条])\s*(.*)$")


def headings(text: str) -> list[tuple[int, int, str, int, str]]:
    """(start, stop, kind, number, title) of each section that a heading line opens, to the next heading's start."""
    out, at = [], 0
    for line in text.split("\n"):
        if m := _HEAD.match(line):
            n = numeral(m[2])
            if n is not None:
                out.append([at, len(text), m[3], n, m[4]])
                if len(out) > 1:
                    out[-2][1] = at
        at += len(line) + 1
    return [tuple(x) for x in out]


def html_bodies(df: DataFrame, key: str, text: str, container: str = "div") -> DataFrame:
    """``key``, ``line_no``, ``line`` of the texts that have exactly one container; null texts give nothing."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, x) for k, t in zip(b["k"], b["t"]) for i, x in enumerate(body_lines(t, container) or [])]
            yield pd.DataFrame(rows, columns=[key, "line_no", "line"])

    return df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"`{key}` {kind}, line_no int, line string")


def headed_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``start``, ``stop``, ``kind``, ``number``, ``title`` of every headed section."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *s) for k, t in zip(b["k"], b["t"]) for s in headings(t)]
            yield pd.DataFrame(rows, columns=[key, "start", "stop", "kind", "number", "title"])

    return df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"`{key}` {kind}, start int, stop int, kind string, number int, title string")


# -- articles ----------------------------------------------------------------------------
_COUNT = "[一二三四五六七八九十百千零〇0-9]+"
_ARTICLE = re.compile(rf"^第({_COUNT})条[ \t\u3000]+(?=\S)")
_CHAPTER = re.compile(rf"^第{_COUNT}[章节][ \t\u3000]+\S")
_APPENDIX = re.compile(r"(?m)^[ \t]*(?:#{1,6}[ \t]+)?附[件录](?:[ \t]*[:：]|[ \t]+|\r?$)")
_PREFIX = re.compile(r"^[ \t]*(?:#{1,6}[ \t]+)?(?=第)")


class SectionError(ValueError):
    """Articles that do not run from 1 on without a gap."""


def articles(text: str, expected: int | None = None) -> list[tuple[int, int, int, str | None]]:
    """(start, stop, number, chapter) of the articles of a legal text, in order.

    An article begins with its line and ends before the next one or a chapter's heading, blanks at
    its end left out. Numbers must run 1..N, to ``expected`` where it is given; else ``SectionError``.
    """
    out: list[list] = []
    chapter, at, open_ = None, 0, False
    for line in text.splitlines(keepends=True):
        bare = line.rstrip("\r\n")
        head, article = _CHAPTER.match(bare), _ARTICLE.match(bare)
        if (head or article) and open_:
            out[-1][1] = at
            open_ = False
        if head:
            chapter = bare.strip()
        if article:
            out.append([at, len(text), numeral(article[1]) or 0, chapter])
            open_ = True
        at += len(line)
    numbers = [a[2] for a in out]
    if not numbers or numbers != list(range(1, (expected or len(out)) + 1)):
        raise SectionError(f"articles must run 1..{expected or len(out)}: {numbers[:20]}")
    return [(a, a + len(text[a:b].rstrip()), n, c) for a, b, n, c in out]


def body_sections(text: str, first_line: int, expected: int | None) -> list[tuple[int, int, str]]:
    """(start, stop, heading) of a catalogue's Markdown body, which begins at ``first_line`` (from 1), in offsets of the whole text.

    With ``expected`` articles these are the sections, heading marks before them not in the way; an
    appendix ends the article it stands in, and what lies between sections and says more than a
    chapter's heading is ``supplementary_body``. Else every Markdown heading opens a section.
    """
    lines = text.splitlines(keepends=True)
    if not 1 <= first_line <= len(lines):
        raise SectionError("the body does not begin within the text")
    start = sum(map(len, lines[: first_line - 1]))
    body = text[start:]
    if not body.strip():
        raise SectionError("the body is empty")
    if expected is None:
        marks = [(m.start(), m[1].strip()) for m in re.finditer(r"(?m)^#{1,6}[ \t]+(.+)$", body)]
        if not marks or marks[0][0] > 0:
            marks.insert(0, (0, "document"))
        ends = [a for a, _ in marks[1:]] + [len(body)]
        return [(start + a, start + b, h) for (a, h), b in zip(marks, ends) if body[a:b].strip()]
    # Prefixes are taken out; each character that stays knows where it was.
    kept, places, begins, at = [], [], {}, start
    size = 0
    for line in body.splitlines(keepends=True):
        m = _PREFIX.match(line)
        cut = m.end() if m else 0
        begins[size] = at
        kept.append(line[cut:])
        places.extend(range(at + cut, at + len(line)))
        at += len(line)
        size += len(line) - cut
    found = [[begins[a], places[b - 1] + 1, f"第{n}条"] for a, b, n, _ in articles("".join(kept), expected)]
    if appendix := _APPENDIX.search(body):
        cut = start + appendix.start()
        for s in found:
            if s[0] < cut < s[1]:
                s[1] = cut
    cursor, more = start, []
    for a, b, _ in [*found, [len(text), len(text), ""]]:
        offset, said = cursor, []
        for line in text[cursor:a].splitlines(keepends=True):
            if line.strip() and not _CHAPTER.match(line[_PREFIX.match(line).end() :] if _PREFIX.match(line) else line):
                said.append((offset, offset + len(line.rstrip("\r\n"))))
            offset += len(line)
        if said:
            more.append([said[0][0], said[-1][1], "supplementary_body"])
        cursor = max(cursor, b)
    return sorted(map(tuple, [*found, *more]))


def article_status(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``n_articles``, ``consecutive``: how many articles a text has and whether they run 1..N; null texts give no row."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b["k"], b["t"]):
                n = sum(bool(_ARTICLE.match(x)) for x in t.replace("\r", "").split("\n"))
                try:
                    rows.append((k, n, len(articles(t)) == n))
                except SectionError:
                    rows.append((k, n, False))
            yield pd.DataFrame(rows, columns=[key, "n_articles", "consecutive"])

    return df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"`{key}` {kind}, n_articles int, consecutive boolean")


def legal_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``start``, ``stop``, ``number``, ``chapter`` of the texts whose articles run 1..N; others give no row, as ``article_status`` says."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b["k"], b["t"]):
                try:
                    rows += [(k, *a) for a in articles(t)]
                except SectionError:
                    continue
            yield pd.DataFrame(rows, columns=[key, "start", "stop", "number", "chapter"])

    return df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"`{key}` {kind}, start int, stop int, number int, chapter string")


def inventory(df: DataFrame, key: str, text: str, incomplete: tuple[str, ...], complete: str) -> DataFrame:
    """``key``, ``articles``, ``missing``, ``n_links``, ``completeness``: what a Markdown text holds and how complete it says to be.

    A line with a mark of ``incomplete`` never speaks for completeness. ``missing`` are the
    numbers up to the greatest that no line opens. Classes: incomplete (a mark, a range of
    articles or a missing one), explicit_full, uncertain (said or with articles), unclassified.
    """
    kind = dict(df.dtypes)[key]
    opens = re.compile(r"^\s*(?:#{1,6}\s+)?第([一二三四五六七八九十百千万零〇0-9]+)条(?!至)")
    ranges = re.compile(r"^\s*(?:#{1,6}\s+)?第[一二三四五六七八九十百千万零〇0-9]+条?至第?[一二三四五六七八九十百千万零〇0-9]+条")
    full = re.compile(complete)

    def one(t: str) -> tuple[list[int], list[int], int, str]:
        lines = t.splitlines()
        cut = any(m in x for x in lines for m in incomplete)
        said = [m[0] for x in lines if not any(y in x for y in incomplete) for m in full.finditer(x)]
        ranged = any(ranges.search(x) for x in lines)
        numbers = sorted({n for x in lines if not ranges.search(x) and (m := opens.match(x)) and (n := numeral(m[1]) or 0) > 0})
        declared = max((int(d) for s in said for d in re.findall(r"\d+", s)), default=0)
        missing = sorted(set(range(1, min(max([declared, *numbers], default=0), 10_000) + 1)) - set(numbers))
        kind_ = "incomplete" if cut or ranged or missing else "explicit_full" if said and numbers else "uncertain" if said or numbers else "unclassified"
        return numbers, missing, len(re.findall(r"https?://[^\s)）>]+", t)), kind_

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *one(t)) for k, t in zip(b["k"], b["t"])], columns=[key, "articles", "missing", "n_links", "completeness"])

    return df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"`{key}` {kind}, articles array<int>, missing array<int>, n_links int, completeness string")
