"""Constraints as a table of shapes, run over whole tables.

A shape names a frame of focus nodes and its constraints. Constraints of a row's own values
are checked side by side in one pass and exploded into one row for each violation; those
that look at other rows - uniqueness, classes of values, overlap, thresholds - are each one
aggregate, anti join or window on narrow columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Constraint:
    """One demand on ``path`` (a column): ``kind`` with its ``value``.

    Kinds of a row: min_count, max_count (values or elements of an array), pattern, datatype
    (date, long, double), min_inclusive, max_length, in, either (one of several paths),
    not_after (a column), implies (a condition on other columns), not_itself. Kinds of several
    rows: unique (with other paths), class (a frame of ids), no_overlap (start, end).
    """

    path: str
    kind: str
    value: object = None


@dataclass(frozen=True)
class Shape:
    """A named shape: the column of the focus node and the constraints."""

    name: str
    focus: str
    constraints: tuple[Constraint, ...] = field(default=())


#: How values of each datatype are written.
DATATYPES = {"date": r"^\d{4}-\d{2}-\d{2}$", "long": r"^[+-]?\d+$", "double": r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$"}
ROW_KINDS = ("min_count", "max_count", "pattern", "datatype", "min_inclusive", "max_length", "in", "either", "not_after", "implies", "not_itself")


def _violated(c: Constraint, kinds: dict[str, str]) -> Column:
    """Whether a row violates a constraint; only min_count, class and either speak of absent values."""
    v = F.col(c.path) if c.path else F.lit(None)
    array = kinds.get(c.path, "").startswith("array")
    if c.kind == "min_count":
        return (F.coalesce(F.size(F.filter(v, lambda x: x.isNotNull())), F.lit(0)) < c.value) if array else v.isNull()
    if c.kind == "max_count":
        return (F.size(v) > c.value) if array else F.lit(False)
    if c.kind in ("pattern", "datatype"):
        pattern = c.value if c.kind == "pattern" else DATATYPES[c.value]
        wrong = ~v.cast("string").rlike(pattern)
        return v.isNotNull() & (wrong | v.cast("string").try_cast("date").isNull()) if c.kind == "datatype" and c.value == "date" else wrong
    if c.kind == "min_inclusive":
        return v < c.value
    if c.kind == "max_length":
        return F.length(v) > c.value
    if c.kind == "in":
        return ~v.isin(*c.value)
    if c.kind == "either":
        return reduce(lambda a, b: a & b, [F.col(p).isNull() for p in (c.path, *c.value)])
    if c.kind == "not_after":
        return v > F.col(c.value)
    if c.kind == "implies":
        return F.expr(c.value[0]) & ~F.coalesce(F.expr(c.value[1]), F.lit(False))
    if c.kind == "not_itself":
        return v == F.col(c.value)
    raise ValueError(f"unknown kind {c.kind!r}")


def _of_many(shape: Shape, rows: DataFrame, c: Constraint, classes: dict[str, DataFrame]) -> DataFrame:
    focus = F.col(shape.focus).cast("string")
    if c.kind == "unique":
        keys = [c.path, *(c.value or ())]
        d = rows.select(focus.alias("focus"), *keys).dropna().distinct()
        many = d.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
        return d.join(many, keys, "left_semi").select("focus")
    if c.kind == "class":
        d = rows.where(F.col(c.path).isNotNull()).select(focus.alias("focus"), F.col(c.path).alias("id"))
        return d.join(classes[c.value].select("id").distinct(), "id", "left_anti").select("focus").distinct()
    if c.kind == "forbidden":
        d = rows.where(F.col(c.path).isNotNull()).select(focus.alias("focus"), F.col(c.path).alias("id"))
        return d.join(classes[c.value].select("id").distinct(), "id", "left_semi").select("focus").distinct()
    if c.kind == "no_overlap":
        start, end = c.value
        before = Window.partitionBy(c.path).orderBy(start, shape.focus).rowsBetween(Window.unboundedPreceding, -1)
        d = rows.where(F.col(start).isNotNull() & F.col(c.path).isNotNull()).select(focus.alias("focus"), c.path, start, shape.focus, F.coalesce(F.col(end), F.lit("9999-12-31").cast("date")).alias("_end"))
        return d.withColumn("_until", F.max("_end").over(before)).where(F.col("_until") > F.col(start)).select("focus").distinct()
    raise ValueError(f"unknown kind {c.kind!r}")


def violations(shape: Shape, rows: DataFrame, classes: dict[str, DataFrame] | None = None) -> DataFrame:
    """``shape``, ``focus``, ``path``, ``kind`` of every violation in ``rows``; rows without a focus are left out."""
    rows = rows.where(F.col(shape.focus).isNotNull())
    kinds = dict(rows.dtypes)
    own = [c for c in shape.constraints if c.kind in ROW_KINDS]
    out = []
    if own:
        checks = F.array(*[F.when(F.coalesce(_violated(c, kinds), F.lit(False)), F.struct(F.lit(c.path).alias("path"), F.lit(c.kind).alias("kind"))) for c in own])
        out.append(rows.select(F.col(shape.focus).cast("string").alias("focus"), F.inline(F.filter(checks, lambda x: x.isNotNull()))))
    for c in shape.constraints:
        if c.kind not in ROW_KINDS:
            out.append(_of_many(shape, rows, c, classes or {}).select("focus", F.lit(c.path).alias("path"), F.lit(c.kind).alias("kind")))
    return reduce(lambda a, b: a.unionByName(b), out).select(F.lit(shape.name).alias("shape"), "focus", "path", "kind")


def report(found: DataFrame, shapes: list[Shape]) -> DataFrame:
    """``shape``, ``path``, ``kind``, ``n`` of every constraint, those without violations with 0."""
    listed = found.sparkSession.createDataFrame([(s.name, c.path, c.kind) for s in shapes for c in s.constraints], "shape string, path string, kind string")
    counts = found.groupBy("shape", "path", "kind").agg(F.count("*").alias("n"))
    return listed.join(counts, ["shape", "path", "kind"], "left").select("shape", "path", "kind", F.coalesce("n", F.lit(0)).alias("n"))
