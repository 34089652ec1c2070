"""HTML, Markdown, wiki and LaTeX markup turned into clean, still structured text (problem 1).

All four notations are read into one tree of elements, tolerant of unclosed, crossed and
broken marks. For every node the composite text density - link-adjusted characters per
tag - is computed, the densities of the children are summed, and the subtree of greatest
sum among those a page is laid out with is the main content; the least density on its path
to the body is the threshold below which layout elements beside it (menus, side columns,
footers) are left out. What remains is given out as blocks that say what they are: heading,
paragraph, list item, table row, code, formula, quote, note. A text holds markup if the
blocks say it in other characters: marks were removed, converted or their content left out.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names that are read as tags, in HTML and wiki texts.
TAGS = (
    "a abbr article aside b big blockquote body br button caption center cite code col colgroup dd del div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head "
    "header hr html i iframe img input ins kbd label li link main math meta nav nowiki o:p ol option p pre ref s samp script section select small source span strike strong style "
    "sub sup table tbody td tfoot th thead title tr tt u ul var"
).split()
VOID = frozenset("br hr img input link meta col o:p".split())
DROPPED = frozenset("script style head title iframe select button form".split())
BLOCKS = frozenset("p div article aside section main header footer nav body html blockquote ul ol dl dt dd li table tr td th tbody thead tfoot caption pre figure figcaption center h1 h2 h3 h4 h5 h6 formula note".split())
# LaTeX commands by what is done with their argument.
LATEX_STYLE = {"textbf": "b", "textit": "i", "emph": "em", "underline": "u", "texttt": "code", "textsc": "span", "text": "span", "mathrm": "span", "mbox": "span"}
LATEX_HEADING = {"part": "h1", "chapter": "h1", "section": "h2", "subsection": "h3", "subsubsection": "h4", "paragraph": "h5", "title": "h1"}
LATEX_DROPPED = frozenset("cite citep citet label ref eqref pageref documentclass usepackage vspace hspace includegraphics bibliography bibliographystyle".split())

_TAG = rf"</?(?:{'|'.join(sorted(map(re.escape, TAGS), key=len, reverse=True))})(?=[\s>/&'=\]*_~`\[{{\\])"
_ENTITY = r"&(?:[A-Za-z]{2,8}|#\d{2,6}|#[xX][0-9A-Fa-f]{2,5});"
# Signs within lines, each alternative beginning with its own letter, and signs at the start of lines.
_SIGN = re.compile(
    rf"<(?:(?i:{_TAG[1:]})|!--|!\[|!(?i:doctype))|-->|{_ENTITY}|`|\*\*|__(?!_)|~~|\](?:\([^()\s]*\)|\])|!\[|\[(?:\^\w+\]|\[)|\{{\{{|\}}\}}|''|\\(?:[A-Za-z]+|[%&_#${{}}()\[\]\\,;!])|\$\$"
    r"|\*(?! )[^*\n]+(?<! )\*"
)
_LINE = re.compile(
    r"\n(?:[ \t]*#{1,6} +\S|(?:={3,}|-{3,})[ \t]*\r?(?=\n)|(?:\*{3,}|_{3,})[ \t]*\r?(?=\n)|[ \t]*[-+*] +(?!\d+ ?-[ \t]*\r?\n)\S|[ \t]*>[ \t]?\S|[ \t]*\|.*\|[ \t]*\r?(?=\n)"
    r"|[ \t]*={1,6} *\S.*\S *={1,6}[ \t]*\r?(?=\n)|\{\||\|[-}]|[*#:;]{1,4} +\S|[ \t]*\d{1,3}[.)] +\S)"
)


def hinted(text: str) -> bool:
    """Whether a text holds any markup at all; most texts end here."""
    return bool(_SIGN.search(text) or _LINE.search(f"\n{text}\n"))


class Node:
    """An element: its name, its attributes' text and its children, strings or nodes."""

    __slots__ = ("tag", "info", "kids", "density", "chars", "tags", "link_chars", "link_tags", "sum")

    def __init__(self, tag: str, info: str = ""):
        self.tag, self.info, self.kids = tag, info, []


class Tree:
    """Builds a tree from marks as they come."""

    def __init__(self) -> None:
        self.root = Node("body")
        self.stack = [self.root]
        self.inside: dict[str, int] = {}
        self.marks = 0

    def text(self, s: str) -> None:
        if s:
            self.stack[-1].kids.append(s)

    def _cut(self, depth: int) -> None:
        """Leave all elements from ``depth`` on."""
        for n in self.stack[depth:]:
            self.inside[n.tag] -= 1
        del self.stack[depth:]

    def _nearest(self, *tags: str) -> str | None:
        """Which of some elements is open, the innermost."""
        return next((n.tag for n in reversed(self.stack) if n.tag in tags), None) if any(self.inside.get(t) for t in tags) else None

    def open(self, tag: str, info: str = "", mark: bool = True) -> None:
        self.marks += mark
        if tag == "li" and self.inside.get("li") and self._nearest("li", "ul", "ol") == "li":
            self.close("li", mark=False)
        elif tag in ("td", "th", "tr"):
            for t in ("td", "th") if tag != "tr" else ("td", "th", "tr"):
                if self.inside.get(t) and self._nearest(t, "table") == t:
                    self.close(t, mark=False)
        elif tag in BLOCKS and self.stack[-1].tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            self._cut(len(self.stack) - 1)
        node = Node(tag, info)
        self.stack[-1].kids.append(node)
        if tag not in VOID:
            self.stack.append(node)
            self.inside[tag] = self.inside.get(tag, 0) + 1

    def close(self, tag: str, mark: bool = True) -> None:
        self.marks += mark
        heading = tag[:1] == "h" and tag[1:].isdigit()
        if not (any(self.inside.get(f"h{n}") for n in range(1, 7)) if heading else self.inside.get(tag)):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.stack[k].tag
            if name == tag or (heading and name[:1] == "h" and name[1:].isdigit()):
                self._cut(k)
                return

    def toggle(self, tag: str) -> None:
        self.close(tag) if self.inside.get(tag) else self.open(tag)

    def drop(self) -> None:
        self.marks += 1


_TOKEN = re.compile(
    rf"(?P<comment><!--.*?-->|<!\[.*?\]>|<!--|-->)|(?P<doctype><!(?i:doctype)[^>]*>?)|(?P<tag>(?i:{_TAG})(?:[^<>\n]|\n(?=[^<>\n]*>))*>?)|(?P<entity>{_ENTITY})"
    r"|(?P<env>\\(?:begin|end)\{\w+\*?\}(?:\{[^{}]*\})?)|(?P<frac>\\frac\{(?P<top>[^{}]*)\}\{(?P<low>[^{}]*)\})|\\(?P<cmd>[A-Za-z]+)\*?(?P<arg>\{)?[ ]?|(?P<esc>\\[%&_#${}])"
    r"|(?P<row>\\\\)|(?P<math>\\[\[\](),;!]|\$\$)|(?P<group>\{\\(?:it|bf|em|tt|sl|sc)\b ?)|(?P<image>!\[(?P<alt>[^\]\n]*)\]\([^()\s]*\))|(?P<link>(?<!\[)\[(?P<shown>[^\[\]\n]*)\]\((?P<url>[^()\s]*)\))"
    r"|(?P<foot>\[\^\w+\](?::)?)|(?P<wiki>\[\[(?P<wl>[^\[\]\n]*)\]\])|(?P<tpl>\{\{(?P<tp>[^{}\n]*)\}\})|(?P<loose>\[\[|\]\]|\{\{|\}\}|\]\([^()\s]*\)|!\[)|(?P<quote>'{2,5})"
    r"|(?P<strong>\*\*|(?<!_)__(?!_))|(?P<strike>~~)|(?P<tick>`+)|(?P<star>\*(?! )(?P<em>[^*\n]+)(?<! )\*)|(?P<brace>[{}])|(?P<amp>&)|(?P<dollar>\$(?P<tex>[^$\n]*(?:\\[A-Za-z]|=)[^$\n]*)\$)",
    re.DOTALL,
)
_SPECIAL = re.compile(r"[<&\\!\[\]{}'*_~`$]|-->")


def _formula(s: str) -> str:
    """A formula in one line of plain signs."""
    s = re.sub(r"\\frac\{([^{}]*)\}\{([^{}]*)\}", r"(\1) / \2", s)
    s = re.sub(r"\\(?:times|cdot)\b", "×", s)
    return re.sub(r"\s+", " ", re.sub(r"\\[A-Za-z]+\*?|\\[,;! ]|[{}]", "", s)).strip()


class Reader:
    """Reads a text of mixed notations into a ``Tree``."""

    def __init__(self, text: str):
        self.tree = Tree()
        self.braces: list[str] = []
        self.tabular = 0
        self._lines(text.replace("\r\n", "\n").replace("\r", "\n"))

    # -- lines ------------------------------------------------------------------------
    def _lines(self, text: str) -> None:
        tree, lines, k = self.tree, text.split("\n"), 0
        run: list[str] = []

        def flush() -> None:
            if run:
                self._inline("\n".join(run) + "\n")
                run.clear()

        while k < len(lines):
            line = lines[k]
            bare = line.strip()
            fence = re.match(r"(```+|~~~+)", bare)
            verbatim = None if fence else re.match(r"\\begin\{(verbatim|lstlisting)\}", bare)
            if fence or verbatim:
                flush()
                until = next((j for j in range(k + 1, len(lines)) if lines[j].strip().startswith(fence[1] if fence else rf"\end{{{verbatim[1]}}}")), None)
                if until is not None:
                    tree.open("pre", bare)
                    tree.text("\n".join(lines[k + 1 : until]))
                    tree.close("pre")
                    k = until + 1
                    continue
            follows = lines[k + 1].strip() if k + 1 < len(lines) else ""
            if m := re.match(r"(#{1,6}) +(\S.*)$", bare):
                # '# ' may be a wiki list as well; a heading ends without a full stop.
                if len(m[1]) > 1 or not re.search(r"[。.;；]$", bare):
                    flush()
                    self._block(f"h{len(m[1])}", m[2])
                else:
                    flush()
                    self._block("li", m[2])
            elif bare and re.fullmatch(r"={3,}|-{3,}", follows) and not bare.startswith("|"):
                flush()
                self._block("h1" if follows[0] == "=" else "h2", bare)
                k += 1
            elif re.fullmatch(r"[-*_=]{3,}", bare):
                flush()
                tree.open("hr")
            elif (m := re.match(r"(={1,6}) *(\S|\S.*?\S) *={1,6}$", bare)) and not bare.strip("=") == "":
                flush()
                self._block(f"h{len(m[1])}", m[2])
            elif bare.startswith("{|"):
                flush()
                tree.open("table", bare)
            elif bare.startswith("|}"):
                flush()
                tree.close("table")
            elif re.fullmatch(r"\|?(?:\s*:?-{2,}:?\s*\|)+\s*:?-*:?\s*\|?", bare):
                flush()
                tree.drop()
            elif bare.startswith("|-"):
                flush()
                tree.drop()
                tree.open("tr", mark=False)
            elif m := re.match(r"\[\^\w+\]:[ \t]*(.*)$", bare):
                flush()
                tree.drop()
                self._block("note", m[1])
            elif re.match(r"[|!].*", bare) and (re.match(r"\|.*\|$", bare) or tree.inside.get("table")) and not bare.startswith("!["):
                flush()
                cells = re.split(r"\|\||\|", bare.strip("|!"))
                inside = tree.inside.get("tr")
                if not inside:
                    tree.open("tr")
                for c in cells:
                    self._block("td", c.strip())
                if not inside:
                    tree.close("tr")
            elif (m := re.match(r"[*#:;]{1,4} +(\S.*)$|[-+*] +(\S.*)$|\d{1,3}[.)] +(\S.*)$", bare)) and not re.fullmatch(r"- ?\d+ ?-", bare):
                flush()
                self._block("li", re.sub(r"^\[[ xX]\] ", "", m[1] or m[2] or m[3]))
            elif m := re.match(r">[ \t]?(\S.*)$", bare):
                flush()
                self._block("blockquote", m[1])
            elif not bare:
                flush()
                tree.text("\n\n")
            else:
                run.append(line)
            k += 1
        flush()

    def _block(self, tag: str, content: str) -> None:
        depth = len(self.tree.stack)
        self.tree.open(tag)
        self._inline(content)
        self.tree._cut(depth)

    # -- signs within lines -----------------------------------------------------------
    def _inline(self, s: str) -> None:
        tree, pos = self.tree, 0
        for sign in _SPECIAL.finditer(s):
            if sign.start() < pos or not (m := _TOKEN.match(s, sign.start())):
                continue
            tree.text(s[pos : m.start()])
            pos = m.end()
            kind, tok = m.lastgroup, m[0]
            if m["comment"] or m["doctype"]:
                tree.drop()
            elif m["tag"]:
                self._tag(tok)
            elif m["entity"]:
                tree.drop()
                tree.text(html.unescape(tok))
            elif m["env"]:
                self._environment(tok)
            elif m["frac"]:
                tree.drop()
                tree.text(f"({m['top']}) / {m['low']}")
            elif m["cmd"]:
                pos = self._command(s, m)
            elif m["esc"]:
                tree.drop()
                tree.text(tok[1])
            elif m["row"]:
                tree.drop()
                if self.tabular:
                    tree.open("tr", mark=False)
                    tree.open("td", mark=False)
                else:
                    tree.text("\n")
            elif m["math"]:
                if tok in (r"\[", r"\("):
                    tree.open("formula")
                elif tok in (r"\]", r"\)"):
                    tree.close("formula")
                elif tok == "$$":
                    tree.toggle("formula")
                else:
                    tree.drop()
            elif m["dollar"]:
                if re.search(r"\\[A-Za-z]|^[A-Za-z]\w* = ", m["tex"]):
                    tree.open("formula")
                    tree.text(m["tex"])
                    tree.close("formula")
                else:
                    tree.text("$")
                    pos = m.start() + 1
            elif m["group"]:
                tree.open("i")
                self.braces.append("i")
            elif m["image"]:
                tree.drop()
                tree.text(m["alt"])
            elif m["link"]:
                tree.open("a", m["url"])
                self._inline(m["shown"])
                tree.close("a")
            elif m["foot"]:
                tree.drop()
            elif m["wiki"]:
                tree.open("a", m["wl"])
                self._inline(m["wl"].rpartition("|")[2])
                tree.close("a")
            elif m["tpl"]:
                tree.drop()
                if "|" in m["tp"]:
                    self._inline(m["tp"].rpartition("|")[2])
            elif m["loose"]:
                tree.drop()
            elif m["quote"]:
                tree.toggle("b" if len(tok) > 2 else "i")
            elif m["strong"]:
                tree.toggle("strong")
            elif m["strike"]:
                tree.toggle("del")
            elif m["tick"]:
                tree.toggle("code")
            elif m["star"]:
                tree.open("em")
                self._inline(m["em"])
                tree.close("em")
            elif m["brace"]:
                if tok == "}" and self.braces:
                    if tag := self.braces.pop():
                        tree.close(tag, mark=False)
                else:
                    tree.text(tok)
            elif m["amp"]:
                if self.tabular:
                    tree.open("td", mark=False)
                else:
                    tree.text("&")
            else:
                tree.text(tok if kind is None else "")
        tree.text(s[pos:])

    def _tag(self, tok: str) -> None:
        m = re.match(r"<(/?)([A-Za-z][\w:]*)", tok)
        name = m[2].lower()
        if name == "math":
            name = "formula"
        elif name in ("source", "pre", "samp") and name != "pre":
            name = "pre"
        elif name == "ref":
            name = "note"
        if m[1]:
            self.tree.close(name)
        elif name == "br" or name == "hr":
            self.tree.open("br")
        else:
            self.tree.open(name, tok[m.end() :])
            if tok.rstrip(">").endswith("/") and name not in VOID:
                self.tree.close(name, mark=False)

    def _environment(self, tok: str) -> None:
        name = re.search(r"\{(\w+)", tok)[1]
        tag = {"itemize": "ul", "enumerate": "ol", "description": "dl", "tabular": "table", "table": "div", "equation": "formula", "align": "formula", "quote": "blockquote", "verbatim": "pre", "lstlisting": "pre"}.get(name, "div")
        if tok.startswith(r"\begin"):
            self.tree.open(tag, name)
            if tag == "table":
                self.tabular += 1
                self.tree.open("tr", mark=False)
                self.tree.open("td", mark=False)
        else:
            self.tabular -= tag == "table" and self.tabular > 0
            self.tree.close(tag)

    def _command(self, s: str, m: re.Match) -> int:
        name, tree, end = m["cmd"], self.tree, m.end()
        if name == "item":
            tree.open("li")
            return m.start() + 5 + (s[m.start() + 5 : m.start() + 6] == " ")
        if m["arg"] and (name in LATEX_STYLE or name in LATEX_HEADING):
            tag = LATEX_STYLE.get(name) or LATEX_HEADING[name]
            tree.open(tag)
            self.braces.append(tag)
            return m.start() + m[0].index("{") + 1
        if m["arg"] and (name in LATEX_DROPPED or name == "footnote"):
            tree.drop()
            close = s.find("}", end)
            close = len(s) if close < 0 else close
            if name == "footnote":
                tree.open("note", mark=False)
                tree.text(s[m.start() + m[0].index("{") + 1 : close])
                tree.close("note", mark=False)
            return min(len(s), close + 1)
        tree.drop()
        if m["arg"]:
            self.braces.append("")
            return m.start() + m[0].index("{") + 1
        if name in ("quad", "qquad", "newline", "par"):
            tree.text(" ")
        return end


# -- density ------------------------------------------------------------------------------
#: Elements a page is laid out with: only these are its main content, or stand beside it as furniture.
LAYOUT = frozenset("body div article section main aside nav header footer center".split())


def walked(root: Node) -> list[tuple[Node, Node | None, bool]]:
    """All nodes with their parents and whether they stand in a link, parents first."""
    out: list[tuple[Node, Node | None, bool]] = [(root, None, root.tag == "a")]
    for node, _, linked in out:
        out += [(k, node, linked or k.tag == "a") for k in node.kids if isinstance(k, Node)]
    return out


def measure(nodes: list[tuple[Node, Node | None, bool]]) -> None:
    """Characters, tags, link characters and link tags of every node, bottom up."""
    for node, _, linked in nodes:
        node.chars = sum(len(k.strip()) for k in node.kids if isinstance(k, str))
        node.link_chars = node.chars * linked
        node.tags = node.link_tags = 0
    for node, parent, _ in reversed(nodes):
        if parent is not None:
            parent.chars += node.chars
            parent.tags += node.tags + 1
            parent.link_chars += node.link_chars
            parent.link_tags += node.link_tags + (node.tag == "a")


def densities(nodes: list[tuple[Node, Node | None, bool]]) -> None:
    """Composite text density of every node and the sum of its children's."""
    root = nodes[0][0]
    share = root.link_chars / max(1, root.chars)
    for n, _, _ in nodes:
        c, t, lc, lt = n.chars, max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
        base = math.log(c / max(1, c - n.link_chars) * n.link_chars + share * c + math.e)
        inner = max(1.0, c / lc * t / lt)
        n.density = c / t * (math.log(inner) / math.log(base) if base > 1 + 1e-9 else math.log(inner + 1)) if c else 0.0
        n.sum = 0.0
    for n, parent, _ in nodes:
        if parent is not None:
            parent.sum += n.density


def main_content(root: Node) -> tuple[Node, float, set[int]]:
    """The layout subtree of greatest density sum, the least density on its path to the body, and the furniture: ids of nodes to leave out.

    The threshold is a share of the subtree's density. Beside the path, a layout element is
    furniture if its density is below the threshold or its density sum below that share of the
    subtree's: a second article is content, a side column is not. So is a list or table below the
    threshold that is mostly links, also within the subtree; else that is given out whole.
    """
    nodes = walked(root)
    measure(nodes)
    densities(nodes)
    above = {id(n): parent for n, parent, _ in nodes}
    best = max((n for n, _, _ in nodes if n.tag in LAYOUT), key=lambda n: n.sum)
    path, n = [best], above[id(best)]
    while n is not None:
        path.append(n)
        n = above[id(n)]
    threshold = min(n.density for n in path)
    least = best.sum * threshold / best.density if best.density > 0 else 0.0
    on_path, within, out = set(map(id, path)), set(), set()
    for n, parent, _ in nodes:
        if n is best or (parent is not None and id(parent) in within):
            within.add(id(n))
        if id(n) in on_path:
            continue
        low, linked = n.density < threshold, n.link_chars * 2 > n.chars
        beside = n.tag in LAYOUT and id(n) not in within and (low or max(n.sum, n.density) < least)
        if beside or (low and linked and n.tags > 1 and n.tag in BLOCKS):
            out.add(id(n))
    return best, threshold, out


# -- blocks -------------------------------------------------------------------------------
def blocks(root: Node) -> list[tuple[str, int, str]]:
    """(kind, level, text) of the content in order, without furniture; a walk with its own stack, however deep elements nest."""
    _, _, furniture = main_content(root)
    out: list[tuple[str, int, str]] = []
    notes: list[tuple[str, int, str]] = []
    text: list[str] = []

    def flush(kind: str, level: int) -> None:
        s = "".join(text)
        text.clear()
        if kind == "code":
            s = s.strip("\n")
            if s.strip():
                out.append((kind, level, s))
            return
        for part in re.split(r"\n{2,}", s) if kind == "paragraph" else [s]:
            part = re.sub(r"[ \t]*\n[ \t]*", "\n", re.sub(r"[ \t]+", " ", part)).strip()
            if kind != "paragraph":
                part = part.replace("\n", " ")
            if kind == "formula":
                part = _formula(part)
            if part:
                out.append((kind, level, part))

    rows: list[list[str]] = []

    def end_cell() -> None:
        rows[-1].append(re.sub(r"\s+", " ", "".join(text)).strip())
        text.clear()

    def end_row() -> None:
        cells = rows.pop()
        if any(cells):
            out.append(("table_row", 0, "\t".join(cells)))

    # What is to be done: a node or string with its kind and level, or a call.
    todo: list = [(k, "paragraph", 0) for k in reversed(root.kids)]
    while todo:
        item = todo.pop()
        if callable(item):
            item()
            continue
        k, kind, level = item
        if isinstance(k, str):
            text.append(k)
            continue
        tag = k.tag
        if tag in DROPPED or id(k) in furniture:
            continue
        inside = lambda kind, level, k=k: [(x, kind, level) for x in reversed(k.kids)]
        if tag in ("br", "hr"):
            text.append("\n")
        elif tag == "note":
            inner = "".join(x for x in k.kids if isinstance(x, str)).strip()
            if inner:
                notes.append(("note", 0, inner))
        elif tag == "tr":
            flush(kind, level)
            rows.append([])
            todo.append(end_row)
            for cell in reversed(k.kids):
                if isinstance(cell, Node):
                    todo.append(end_cell)
                    todo += [(x, "cell", level) for x in reversed(cell.kids)]
        elif tag in BLOCKS or (tag == "code" and kind == "code"):
            own, depth = kind, level
            if tag[0] == "h" and tag[1:].isdigit():
                own, depth = "heading", int(tag[1:])
            elif tag in ("li", "dt", "dd"):
                own = "list_item"
            elif tag in ("ul", "ol"):
                depth = level + 1 if kind == "list_item" else 1
            elif tag == "pre":
                own = "code"
            elif tag == "formula":
                own = "formula"
            elif tag == "blockquote":
                own = "quote"
            if own == "formula" and kind in ("paragraph", "list_item", "cell", "heading", "quote") and not re.search(r"\\|=", "".join(x for x in k.kids if isinstance(x, str))):
                todo += inside(kind, level)  # brackets around words, no formula
                continue
            if kind != "cell":
                flush(kind, level)
                todo.append(lambda own=own, depth=depth: flush(own, depth))
            todo += inside(own, depth)
        else:
            todo += inside(kind, level)
    flush("paragraph", 0)
    return out + notes


def clean(text: str | None) -> tuple[bool, list[tuple[str, int, str]]]:
    """Whether ``text`` holds markup, and its blocks; without markup its paragraphs are its lines, unchanged."""
    if not text:
        return False, []
    if not hinted(text):
        return False, [("paragraph", 0, text)]
    reader = Reader(text)
    if not reader.tree.marks:  # what looked like a sign was none in its place
        return False, [("paragraph", 0, text)]
    found = blocks(reader.tree.root)
    return _bare(plain(found)) != _bare(text), found


def _bare(text: str) -> str:
    """A text without its white space."""
    return "".join(text.split())


def plain(found: list[tuple[str, int, str]]) -> str:
    """Blocks as one text: list items after a bullet, cells by tabs, code and formulas on lines of their own."""
    return "\n".join(("• " if kind == "list_item" else "") + s for kind, _, s in found)


def cleaned(df: DataFrame, keys: list[str], text: str, only_found: bool = False) -> DataFrame:
    """``keys``, ``has_markup``, ``clean_text`` and ``blocks`` of every row.

    Defined cases: null gives null text and no blocks, an empty text an empty one; texts
    without markup come back unchanged; repeated rows are kept; other columns are ignored.
    With ``only_found`` rows without markup are left out and the texts are not returned.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [clean(t) for t in batch[text]]
            if only_found:
                yield batch[keys][[f for f, _ in got]]
                continue
            yield batch[keys].assign(
                has_markup=[f for f, _ in got],
                clean_text=[None if t is None else plain(b) for t, (_, b) in zip(batch[text], got)],
                blocks=[[{"kind": k, "level": n, "text": s} for k, n, s in b] for _, b in got],
            )

    if not only_found:
        schema += ", has_markup boolean, clean_text string, blocks array<struct<kind: string, level: int, text: string>>"
    return df.select(*keys, text).mapInPandas(run, schema)
