"""What follows from the vocabulary: types by domain and range, sub-properties, equivalents; and the schema's own listings."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.vocabulary import Vocabulary, iri


def inferred_types(v: Vocabulary, spark: SparkSession, folder: str) -> DataFrame:
    """``entity``, ``type``, ``rule``: the types that subjects have by a property's domain and objects by its range, and equivalents of them; each once."""
    out, held = [], {}
    for name, p in v.properties.items():
        if p.inverse_of:
            continue
        # Subjects of all properties of one table and domain are found in one scan.
        held.setdefault((p.table, p.domain), []).append(F.expr(p.value).isNotNull())
        if p.range_table:
            ends = v.edges(spark, folder, name).select(F.col("o").alias("key")).distinct()
            out.append(ends.select(iri(p.range_table, "key").alias("entity"), F.lit(p.range_class).alias("type"), F.lit("range").alias("rule")))
    for (t, cls), some in held.items():
        rows = v.rows(spark, folder, t).where(reduce(lambda a, b: a | b, some)).select("key")
        rows = rows if v.unique(t) else rows.distinct()
        out.append(rows.select(iri(t, "key").alias("entity"), F.lit(cls).alias("type"), F.lit("domain").alias("rule")))
    typed = reduce(lambda a, b: a.unionByName(b), out).distinct()
    pairs = [(a, b) for c in v.classes() for a, b in ((c, x) for x in v.equivalents(c))]
    same = spark.createDataFrame(pairs or [("", "")], "type string, other string")
    equal = typed.join(F.broadcast(same), "type").select("entity", F.col("other").alias("type"), F.lit("equivalent").alias("rule")).distinct()
    return typed.unionByName(equal)


def super_facts(v: Vocabulary, spark: SparkSession, folder: str) -> DataFrame:
    """``s``, ``p``, ``o`` that follow from sub-properties, through however many levels; each once."""
    out = []
    for name in v.properties:
        above = v.subproperties.get(name)
        s, o = v.sides(name)
        while above:
            out.append(v.edges(spark, folder, name).select(iri(s, "s").alias("s"), F.lit(above).alias("p"), iri(o, "o").alias("o")))
            above = v.subproperties.get(above)
    return reduce(lambda a, b: a.unionByName(b), out).distinct()


def applicable(v: Vocabulary) -> list[tuple[str, str, str, bool]]:
    """(class, property, declared on, inherited): the properties whose domain is among a class's superclasses."""
    return [(c, n, p.domain, p.domain != c) for c in v.classes() for n, p in sorted(v.properties.items()) if p.domain in v.ancestors(c)]


def restrictions(v: Vocabulary) -> list[tuple[str, str, str, str, bool]]:
    """(class, property, restriction, text, inherited) for every class and the restrictions on it and its superclasses."""
    out = []
    for c in v.classes():
        for r in v.restrictions:
            if r[0] in v.ancestors(c):
                out.append((c, r[1], r[2], render(("restriction", *r[1:])), r[0] != c))
    return out


# -- class expressions -------------------------------------------------------------------
_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z_][\w:]*|\d+)")
_KINDS = ("some", "only", "value", "self", "min", "max", "exactly")


def expression(text: str) -> tuple:
    """The tree of a class expression: names, ``and``, ``or``, ``not``, and restrictions ``p some C``, ``p only C``, ``p value x``, ``p self``, ``p min|max|exactly n [C]``.

    A tree is ('class', name), ('and' | 'or', parts), ('not', part) or ('restriction', property, kind, value).
    """
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no expression at {at}: {text!r}")
        tokens.append(m[1])
        at = m.end()
    pos = 0

    def peek() -> str | None:
        return tokens[pos] if pos < len(tokens) else None

    def take() -> str:
        nonlocal pos
        if pos >= len(tokens):
            raise ValueError(f"an expression ends early: {text!r}")
        pos += 1
        return tokens[pos - 1]

    def joined(word: str, inner) -> tuple:  # noqa: ANN001
        parts = [inner()]
        while peek() == word:
            take()
            parts.append(inner())
        return parts[0] if len(parts) == 1 else (word, tuple(parts))

    def unit() -> tuple:
        t = take()
        if t == "(":
            e = either()
            if take() != ")":
                raise ValueError(f"a bracket stays open: {text!r}")
            return e
        if t == "not":
            return ("not", unit())
        if peek() in _KINDS:
            kind = take()
            if kind == "self":
                return ("restriction", t, "self", None)
            if kind in ("min", "max", "exactly"):
                n = int(take())
                filler = unit() if peek() not in (None, ")", "and", "or") else None
                return ("restriction", t, kind, (n, filler))
            return ("restriction", t, kind, unit())
        return ("class", t)

    def both() -> tuple:
        return joined("and", unit)

    def either() -> tuple:
        return joined("or", both)

    out = either()
    if peek() is not None:
        raise ValueError(f"something follows the expression: {text!r}")
    return out


def render(tree: tuple, inside: bool = False) -> str:
    """A tree as text; ``expression`` reads it back."""
    head = tree[0]
    if head == "class":
        return tree[1]
    if head == "not":
        return f"not {render(tree[1], True)}"
    if head in ("and", "or"):
        s = f" {head} ".join(render(p, True) for p in tree[1])
        return f"({s})" if inside else s
    _, p, kind, value = tree
    if kind == "self":
        s = f"{p} self"
    elif kind in ("min", "max", "exactly"):
        s = f"{p} {kind} {value[0]}" + (f" {render(value[1], True)}" if value[1] else "")
    else:
        s = f"{p} {kind} {render(value, True)}"
    return f"({s})" if inside else s


def summary(v: Vocabulary) -> list[tuple[str, str, int, int, int]]:
    """(module, class, depth, subclasses, own properties): the tree of modules, which are the classes below the top, and what lies in them."""
    top = [c for c in v.classes() if not v.parents.get(c)]
    out = []
    for c in v.classes():
        up = v.ancestors(c)
        root = next((t for t in top if t in up), c)
        chain = up[root]
        module = chain[-2] if len(chain) > 1 else c
        out.append((module, c, len(chain) - 1, len(v.descendants(c)) - 1, sum(p.domain == c for p in v.properties.values())))
    return out
