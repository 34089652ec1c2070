"""File sources and sinks: JSON lines, texts with hashes, Turtle with imports, N-Triples, JSON bodies, Word documents, selected HTML, vectors."""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.tables import existing


# -- JSON lines and texts ----------------------------------------------------------------
def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines in a stated schema. Blank lines are skipped, a missing path gives no rows, a line that is no object stops the job."""
    if not existing(spark, path):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def text_files(spark: SparkSession, path: str, pattern: str = "*", expected: DataFrame | None = None) -> DataFrame:
    """``path``, ``sha256``, ``n_bytes``, ``text``, ``error`` of every file below a path.

    Bytes that are no UTF-8 give no text but an error, as do files without a character and,
    with ``expected`` (``path``, ``sha256``), files whose hash is another.
    """
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    raw = F.col("content")
    d = f.select(F.col("path"), F.sha2(raw, 256).alias("sha256"), F.col("length").alias("n_bytes"), F.try_validate_utf8(raw.cast("string")).alias("text"))
    wrong = F.lit(False)
    if expected is not None:
        d = d.join(expected.select("path", F.col("sha256").alias("_want")), "path", "left")
        wrong = F.coalesce(F.col("_want") != F.col("sha256"), F.lit(True))
    error = F.when(F.col("text").isNull(), "not utf-8").when(F.trim("text") == "", "empty").when(wrong, "other hash")
    return d.select("path", "sha256", "n_bytes", F.when(error.isNull(), F.col("text")).alias("text"), error.alias("error"))


# -- Turtle ------------------------------------------------------------------------------
_TURTLE = re.compile(
    r'\s+|#[^\n]*|(?P<prefix>@prefix\s+(?P<name>[\w-]*):\s*<(?P<ns>[^<>]*)>\s*\.)|(?P<base>@base\s*<(?P<root>[^<>]*)>\s*\.)|(?P<iri><[^<>\s]*>)'
    r'|(?P<long>"""(?:[^"\\]|\\.|"(?!""))*""")|(?P<string>"(?:[^"\\\n]|\\.)*")|(?P<lang>@[a-zA-Z-]+)|(?P<type>\^\^)|(?P<number>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)'
    r"|(?P<blank>_:\w+)|(?P<pname>(?:[\w-]+)?:[\w.-]*[\w-]|(?:[\w-]+)?:)|(?P<word>a\b|true\b|false\b)|(?P<mark>[.;,\[\]()])",
    re.DOTALL,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", '"': '"', "\\": "\\"}
RDF_TYPE, RDF_FIRST, RDF_REST, RDF_NIL = (f"http://www.w3.org/1999/02/22-rdf-syntax-ns#{x}" for x in ("type", "first", "rest", "nil"))
OWL_IMPORTS = "http://www.w3.org/2002/07/owl#imports"


def turtle(text: str) -> list[tuple[str, str, str]]:
    """The triples of a Turtle text, as identities and plain literal values; blank nodes are named by their order.

    For vocabularies, which fit the driver; facts are read by ``n_triples``. Unknown prefixes and
    open statements raise.
    """
    tokens, at = [], 0
    while at < len(text):
        m = _TURTLE.match(text, at)
        if not m:
            raise ValueError(f"no Turtle at {at}: {text[at : at + 20]!r}")
        if m.lastgroup:
            tokens.append(m)
        at = m.end()
    names: dict[str, str] = {}
    base, pos, made = "", 0, 0
    out: list[tuple[str, str, str]] = []

    def blank() -> str:
        nonlocal made
        made += 1
        return f"_:b{made}"

    def peek() -> str:
        return tokens[pos][0] if pos < len(tokens) else ""

    def take(mark: str) -> None:
        nonlocal pos
        if peek() != mark:
            raise ValueError(f"{mark!r} expected, not {peek()!r}")
        pos += 1

    def term() -> str:
        nonlocal pos
        if pos >= len(tokens):
            raise ValueError("a statement stays open")
        m = tokens[pos]
        t = m[0]
        pos += 1
        if m["iri"]:
            return t[1:-1] if "://" in t or t.startswith("<urn:") else base + t[1:-1]
        if m["word"]:
            return RDF_TYPE if t == "a" else t
        if m["pname"]:
            name, local = t.split(":", 1)
            if name not in names:
                raise ValueError(f"unknown prefix {name!r}")
            return names[name] + local
        if m["long"] or m["string"]:
            s = t[3:-3] if m["long"] else t[1:-1]
            s = re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda e: chr(int(e[1] or e[2], 16)) if e[1] or e[2] else _ESCAPES.get(e[3], e[3]), s, flags=re.DOTALL)
            if pos < len(tokens) and tokens[pos]["lang"]:
                pos += 1
            elif pos < len(tokens) and tokens[pos]["type"]:
                pos += 1
                term()
            return s
        if m["number"] or m["blank"]:
            return t
        if t == "[":
            node = blank()
            if peek() != "]":
                properties(node)
            take("]")
            return node
        if t == "(":
            items = []
            while peek() != ")":
                items.append(term())
            take(")")
            head = RDF_NIL
            for x in reversed(items):
                node = blank()
                out.extend([(node, RDF_FIRST, x), (node, RDF_REST, head)])
                head = node
            return head
        raise ValueError(f"no term: {t!r}")

    def properties(s: str) -> None:
        nonlocal pos
        while True:
            p = term()
            out.append((s, p, term()))
            while peek() == ",":
                pos += 1
                out.append((s, p, term()))
            if peek() != ";":
                return
            while peek() == ";":
                pos += 1
            if peek() in (".", "]", ""):
                return

    while pos < len(tokens):
        m = tokens[pos]
        if m["prefix"]:
            names[m["name"]] = m["ns"]
            pos += 1
        elif m["base"]:
            base = m["root"]
            pos += 1
        else:
            s = term()
            if peek() != ".":
                properties(s)
            take(".")
    return out


def loaded(texts: dict[str, str], start: str) -> tuple[list[tuple[str, str, str]], dict[str, str]]:
    """Triples of a vocabulary and of all it imports, however far, and the hash of each text read.

    ``texts`` maps identities to Turtle texts. Imports are followed breadth first, each text is read
    once, so circles end; imports that ``texts`` does not hold are left out.
    """
    queue, seen, out = [start], {}, []
    for name in queue:
        if name in seen or name not in texts:
            continue
        seen[name] = hashlib.sha256(texts[name].encode()).hexdigest()
        own = turtle(texts[name])
        out += own
        queue += [o for _, p, o in own if p == OWL_IMPORTS]
    return list(dict.fromkeys(out)), seen


def n_triples(spark: SparkSession, path: str) -> DataFrame:
    """``s``, ``p``, ``o`` of a path of N-Triples, a row a line, comments and blank lines skipped; facts of any size."""
    line = r'^\s*(?:<([^<>]*)>|(_:\w+))\s+<([^<>]*)>\s+(?:<([^<>]*)>|(_:\w+)|"((?:[^"\\]|\\.)*)"\S*)\s*\.\s*$'
    d = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(?:#.*)?$"))
    part = lambda k: F.regexp_extract("value", line, k)
    wrong = F.raise_error(F.concat(F.lit("no triple: "), F.substring("value", 1, 80)))
    s = F.when(F.col("value").rlike(line), F.concat(part(1), part(2))).otherwise(wrong)
    return d.select(s.alias("s"), part(3).alias("p"), F.concat(part(4), part(5), part(6)).alias("o"))


def write_n_triples(triples: DataFrame, path: str) -> None:
    """Facts as N-Triples; values with marks are escaped."""
    name = lambda c: F.concat(F.lit("<"), F.col(c), F.lit(">"))
    triples.select(F.concat_ws(" ", name("s"), name("p"), name("o"), F.lit("."))).write.mode("overwrite").text(path)


# -- bodies ------------------------------------------------------------------------------
def json_bodies(df: DataFrame, key: str, text: str, fields: tuple[str, ...]) -> DataFrame:
    """``key``, ``body``, ``error``: the first of some fields, nested ones by dots, that holds text in a JSON answer; HTML in it is left as it is."""
    paths = [F.get_json_object(F.col(text), f"$.{f}") for f in fields]
    body = F.coalesce(*[F.when(F.trim(p) != "", p) for p in paths])
    error = F.when(F.try_parse_json(F.col(text)).isNull(), "no json").when(body.isNull(), "no body")
    return df.select(key, body.alias("body"), error.alias("error"))


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def word_lines(content: bytes) -> list[str]:
    """The paragraphs of a Word document's body in order, tables' rows as cells by tabs; empty ones left out."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    body = root.find(f"{_W}body")
    said = lambda e: "".join((t.text or "") if t.tag == f"{_W}t" else "\t" for t in e.iter() if t.tag in (f"{_W}t", f"{_W}tab")).strip()
    out = []
    for e in body if body is not None else ():
        if e.tag == f"{_W}p":
            out.append(said(e))
        elif e.tag == f"{_W}tbl":
            out += ["\t".join(said(c) for c in row.iter(f"{_W}tc")) for row in e.iter(f"{_W}tr")]
    return [x for x in out if x.strip()]


def word_document(lines: list[str]) -> bytes:
    """A Word document of paragraphs: what ``word_lines`` reads back."""
    from xml.sax.saxutils import escape

    xml = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W[1:-1]}"><w:body>' + "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in lines) + "</w:body></w:document>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def word_bodies(df: DataFrame, key: str, content: str) -> DataFrame:
    """``key``, ``line_no``, ``line`` of Word documents in a binary column; null gives nothing, a broken document stops the job."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, x) for k, c in zip(b["k"], b["c"]) for i, x in enumerate(word_lines(bytes(c)))]
            yield pd.DataFrame(rows, columns=[key, "line_no", "line"])

    return df.where(F.col(content).isNotNull()).select(F.col(key).alias("k"), F.col(content).alias("c")).mapInPandas(run, f"`{key}` {kind}, line_no int, line string")


_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SELECTOR = re.compile(r"^(?P<tag>[a-z][a-z0-9]*)?(?:#(?P<id>[\w-]+))?(?:\.(?P<cls>[\w-]+))?(?:\[(?P<attr>[\w-]+)(?:=[\"']?(?P<value>[^\"'\]]*)[\"']?)?\])?$")


class _Selected(HTMLParser):
    """The source of the elements that a selector names, as written; notes tags that do not pair."""

    def __init__(self, selector: str):
        super().__init__(convert_charrefs=False)
        m = _SELECTOR.match(selector)
        if not m or not m[0]:
            raise ValueError(f"no selector: {selector!r}")
        self.want, self.stack, self.spans, self.begun, self.balanced = m, [], [], None, True

    def _place(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def select(self, raw: str) -> list[tuple[int, int]]:
        self.starts = [0, *[m.end() for m in re.finditer("\n", raw)]]
        self.feed(raw)
        self.close()
        self.balanced = self.balanced and not self.stack
        return self.spans

    def _fits(self, tag: str, attrs: list) -> bool:
        a, w = dict(attrs), self.want
        return (
            (not w["tag"] or w["tag"] == tag) and (not w["id"] or a.get("id") == w["id"]) and (not w["cls"] or w["cls"] in (a.get("class") or "").split())
            and (not w["attr"] or w["attr"] in a and (w["value"] is None or a[w["attr"]] == w["value"]))
        )

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _VOID:
            return
        if self.begun is None and self._fits(tag, attrs):
            self.begun = (len(self.stack), self._place() + len(self.get_starttag_text() or ""))
        self.stack.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        pass

    def handle_endtag(self, tag: str) -> None:
        if tag in _VOID:
            return
        if not self.stack or self.stack[-1] != tag:
            self.balanced = False
            return
        self.stack.pop()
        if self.begun and self.begun[0] == len(self.stack):
            self.spans.append((self.begun[1], self._place()))
            self.begun = None


def selected_html(df: DataFrame, key: str, text: str, selector: str) -> DataFrame:
    """``key``, ``body``, ``error``: the source within the one element a selector (tag, #id, .class, [attribute=value]) names, tables and images as written.

    Texts with none or several such elements, or whose tags do not pair, give an error and no body; null texts give no row.
    """
    kind = dict(df.dtypes)[key]

    def one(raw: str) -> tuple[str | None, str | None]:
        p = _Selected(selector)
        spans = p.select(raw)
        if not p.balanced:
            return None, "unbalanced"
        return (raw[spans[0][0] : spans[0][1]], None) if len(spans) == 1 else (None, "none" if not spans else "several")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *one(t)) for k, t in zip(b["k"], b["t"])], columns=[key, "body", "error"])

    return df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"`{key}` {kind}, body string, error string")


# -- sinks -------------------------------------------------------------------------------
def write_vectors(vectors: DataFrame, path: str, source: DataFrame, model: str) -> None:
    """Vectors with a row of metadata: the model, their number, and the hash of the source (``id``, ``text``) they were made of."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    digest(source).withColumns({"model": F.lit(model), "n_vectors": F.lit(vectors.count())}).write.mode("overwrite").parquet(f"{path}/metadata")


def digest(source: DataFrame) -> DataFrame:
    """``source_sha256`` of rows ``id``, ``text``, in any order: a hash of sorted hashes of 4096 buckets."""
    h = source.select(F.sha2(F.concat_ws("\0", F.col("id").cast("string"), "text"), 256).alias("h"))
    b = h.groupBy(F.substring("h", 1, 3).alias("b")).agg(F.sum(F.conv(F.substring("h", 4, 12), 16, 10).cast("decimal(38,0)")).alias("x"), F.count("*").alias("n"))
    return b.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "b", F.col("x").cast("string"), F.col("n").cast("string")))), "\n"), 256).alias("source_sha256"))


def read_vectors(spark: SparkSession, path: str, source: DataFrame, model: str) -> DataFrame:
    """Vectors that are of this source and model; stale ones raise."""
    kept, now = spark.read.parquet(f"{path}/metadata").first(), digest(source).first()
    if (kept.source_sha256, kept.model) != (now.source_sha256, model):
        raise ValueError("the vectors are of another source or model")
    return spark.read.parquet(f"{path}/vectors")


def write_run(results: DataFrame, path: str, run: dict) -> None:
    """A run's results as parquet and what it was as one line of JSON; a run that is there already is not overwritten."""
    results.write.mode("errorifexists").parquet(f"{path}/results")
    results.sparkSession.createDataFrame([(json.dumps(run, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/run")
