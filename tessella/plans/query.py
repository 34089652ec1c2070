"""The declarative query plan, its checks against the vocabulary, and its compilation.

A plan names a target class and conditions on paths through the graph. Compilation keeps
the tables' own keys, folds hops into equi-joins, existence tests into semi and anti joins
and conditions into filters of the scans, and leaves the physical strategy to the
optimizer. Identities are put together only for the rows that come out.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.plans.vocabulary import Vocabulary, iri

OPERATORS = ("=", "!=", ">", ">=", "<", "<=", "contains", "in")


class PlanError(ValueError):
    """A plan that does not fit the vocabulary."""


@dataclass(frozen=True)
class Hop:
    """One step along a property; ``inverse`` against its direction. Optional demands on where it arrives."""

    property: str
    inverse: bool = False
    cls: str | None = None
    label: str | None = None
    key: Any = None


@dataclass(frozen=True)
class Test:
    """A comparison of a datatype property at the end of ``path`` (empty: at the target)."""

    property: str
    op: str
    value: Any
    path: tuple[Hop, ...] = ()


@dataclass(frozen=True)
class Exists:
    """Whether ``path`` leads anywhere."""

    path: tuple[Hop, ...]


@dataclass(frozen=True)
class Not:
    inner: Any


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Aggregate:
    """``fn`` over the distinct ends of the related path, or over a measure there; ``having`` as (op, number)."""

    fn: str
    measure: str | None = None
    distinct: bool = False
    having: tuple[str, float] | None = None


@dataclass(frozen=True)
class Plan:
    """A query. ``anchor`` is a (table, key) the traversal starts from and must end at the target."""

    target: str
    anchor: tuple[str, Any] | None = None
    traversal: tuple[Hop, ...] = ()
    related: tuple[Hop, ...] = ()
    tests: tuple[Test, ...] = ()
    where: Any = None
    exclude: tuple[tuple[str, Any], ...] = ()
    date_range: tuple[str, str | None, str | None] | None = None
    related_date_range: tuple[str, str | None, str | None] | None = None
    latest: str | None = None
    project: dict[str, tuple[tuple[Hop, ...], str]] = field(default_factory=dict)
    aggregate: Aggregate | None = None
    count: bool = False
    order: tuple[str, bool] | None = None
    limit: int | None = None
    offset: int = 0


def compare(column: Column, op: str, value: Any) -> Column:
    """A typed comparison; a list is only taken by ``in``."""
    if op not in OPERATORS:
        raise PlanError(f"unknown operator {op!r}")
    if (op == "in") != isinstance(value, (list, tuple)):
        raise PlanError("a list needs 'in', and 'in' a list")
    if op == "contains":
        return column.contains(value)
    if op == "in":
        return column.isin(list(value))
    return {"=": column == value, "!=": column != value, ">": column > value, ">=": column >= value, "<": column < value, "<=": column <= value}[op]


class Compiler:
    """Compiles plans over one folder of tables."""

    def __init__(self, vocabulary: Vocabulary, spark: SparkSession, folder: str):
        self.v, self.spark, self.folder = vocabulary, spark, folder

    # -- checks -------------------------------------------------------------------------
    def _arrives(self, at: str, hop: Hop) -> str:
        """The table a hop from table ``at`` leads to."""
        if hop.property not in self.v.properties:
            raise PlanError(f"no property {hop.property!r}")
        s, o = self.v.sides(hop.property)
        if o is None:
            raise PlanError(f"{hop.property} leads to no entity")
        start, end = (o, s) if hop.inverse else (s, o)
        if start != at:
            raise PlanError(f"{hop.property} does not start at {at}")
        if hop.cls and end not in self.v.tables_of(hop.cls):
            raise PlanError(f"{hop.property} does not lead to {hop.cls}")
        return end

    def _literal(self, at: str, name: str) -> None:
        if name not in self.v.properties or self.v.sides(name) != (at, None):
            raise PlanError(f"{name!r} is no datatype property of {at}")

    # -- pieces -------------------------------------------------------------------------
    def _stored(self, hop: Hop) -> tuple[str, str, bool]:
        """Where a hop is stored: the table, the expression of the foreign key, and whether the hop goes along it (from the table) or against it."""
        p, along = self.v.properties[hop.property], not hop.inverse
        while p.inverse_of:
            p, along = self.v.properties[p.inverse_of], not along
        return p.table, p.value, along

    def _single(self, at: str, hops: tuple[Hop, ...]) -> bool:
        """Whether no pair of a path comes out twice: one hop, or hops along foreign keys only, between tables with unique keys."""
        stored = [self._stored(h) for h in hops]
        return self.v.unique(at) and (all(along for _, _, along in stored) or (len(hops) == 1 and self.v.unique(stored[0][0])))

    def _demands(self, to: str, hop: Hop, e: DataFrame, end: str) -> DataFrame:
        """Edges that arrive where a hop demands."""
        if hop.key is not None:
            e = e.where(F.col(end) == hop.key)
        if hop.cls:
            e = e.join(self.v.entities(self.spark, self.folder, hop.cls)[to].select(F.col("key").alias(end)), end, "left_semi")
        if hop.label is not None:
            names = self.v.label(self.spark, self.folder, to).where(F.col("label") == hop.label)
            e = e.join(names.select(F.col("key").alias(end)), end, "left_semi")
        return e

    def _step(self, at: str, hop: Hop, start: str, end: str, rows: DataFrame | None = None, carry: dict[str, str] | None = None) -> tuple[str, DataFrame, dict[str, str]]:
        """Edges of a hop as columns ``start`` and ``end``; taken from ``rows`` where the hop is stored there.

        ``carry`` maps names of columns to datatype properties of the end; those that the
        scan of the edges holds anyway are added, the others returned. Where the edges are rows
        of the end's own table, its class is a filter of the same scan.
        """
        to = self._arrives(at, hop)
        name, value, along = self._stored(hop)
        more: dict[str, str] = {}
        left = dict(carry or {})
        if along and rows is not None and self.v.unique(at):
            e = rows.select(F.col("key").alias(start), F.expr(value).alias(end))
        else:
            source = self.v.rows(self.spark, self.folder, name)
            if not along and hop.cls:
                source = source.where(self.v.tables_of(hop.cls)[to])
                hop = Hop(hop.property, hop.inverse, None, hop.label, hop.key)
            if not along:
                more = {c: p for c, p in left.items() if self._own(to, p)}
                left = {c: p for c, p in left.items() if c not in more}
            s, o = (F.col("key"), F.expr(value)) if along else (F.expr(value), F.col("key"))
            e = source.select(s.alias(start), o.alias(end), *[F.expr(self.v.properties[p].value).alias(c) for c, p in more.items()])
        return to, self._demands(to, hop, e.where(F.col(start).isNotNull() & F.col(end).isNotNull()), end), left

    def _path(self, at: str, hops: tuple[Hop, ...], start: str = "key", end: str = "end", rows: DataFrame | None = None, carry: dict[str, str] | None = None) -> tuple[str, DataFrame]:
        """Pairs (start, end) of a path with the columns of ``carry``; with ``rows`` only pairs that start there."""
        if not hops:
            raise PlanError("an empty path")
        out: DataFrame | None = None
        left: dict[str, str] = {}
        began = at
        for i, hop in enumerate(hops):
            a, b, last = (start if i == 0 else f"_{i}"), (end if i == len(hops) - 1 else f"_{i + 1}"), i == len(hops) - 1
            at, e, left = self._step(at, hop, a, b, rows if i == 0 else None, carry if last else None)
            out = e if out is None else out.join(e, a).drop(a)
        if rows is not None and not (self._stored(hops[0])[2] and self.v.unique(began)):
            out = out.join(rows.select(F.col("key").alias(start)), start, "left_semi")
        if left:
            for p in left.values():
                self._literal(at, p)
            own = self.v.rows(self.spark, self.folder, at).select(F.col("key").alias(end), *[F.expr(self.v.properties[p].value).alias(c) for c, p in left.items()])
            out = out.join(own, end)
        return at, out

    def _own(self, at: str, name: str) -> bool:
        """Whether a datatype property is a column of a table."""
        self._literal(at, name)
        return self.v.properties[name].table == at

    def _column(self, at: str, c: Any) -> Column | None:
        """A condition as a test of the row itself, where that is all it takes; null stands for no."""
        if isinstance(c, Test) and not c.path and self.v.unique(at) and self._own(at, c.property):
            return F.coalesce(compare(F.expr(self.v.properties[c.property].value), c.op, c.value), F.lit(False))
        if isinstance(c, Exists) and len(c.path) == 1 and self.v.unique(at):
            hop = c.path[0]
            self._arrives(at, hop)
            _, value, along = self._stored(hop)
            if along and not hop.cls and hop.label is None:
                return F.expr(value).isNotNull() if hop.key is None else F.coalesce(F.expr(value) == hop.key, F.lit(False))
        if isinstance(c, Not) and (inner := self._column(at, c.inner)) is not None:
            return ~inner
        parts = [self._column(at, x) for x in c.parts] if isinstance(c, (And, Or)) else [None]
        if all(x is not None for x in parts):
            return reduce((lambda a, b: a & b) if isinstance(c, And) else (lambda a, b: a | b), parts)
        return None

    def _keys(self, at: str, c: Test | Exists) -> DataFrame:
        """Keys for which a test holds for some value at the end of its path, or whose path leads somewhere."""
        if isinstance(c, Exists):
            return self._path(at, c.path)[1].select("key")
        if not c.path:
            return self.v.edges(self.spark, self.folder, c.property).where(compare(F.col("o"), c.op, c.value)).select(F.col("s").alias("key"))
        _, pairs = self._path(at, c.path, carry={"_v": c.property})
        return pairs.where(compare(F.col("_v"), c.op, c.value)).select("key")

    def _condition(self, at: str, rows: DataFrame, c: Any) -> DataFrame:
        """Rows of ``rows`` for which a condition tree holds. What a row says itself is a filter of its scan; AND narrows, OR flags, NOT is an anti join."""
        if (own := self._column(at, c)) is not None:
            return rows.where(own)
        if isinstance(c, And):
            # Filters first: they reach the scan.
            return reduce(lambda d, x: self._condition(at, d, x), sorted(c.parts, key=lambda x: self._column(at, x) is None), rows)
        if isinstance(c, (Test, Exists)):
            return rows.join(self._keys(at, c), "key", "left_semi")
        if isinstance(c, Not):
            held = self._keys(at, c.inner) if isinstance(c.inner, (Test, Exists)) else self._condition(at, rows, c.inner).select("key")
            return rows.join(held, "key", "left_anti")
        if isinstance(c, Or):
            hits = reduce(lambda a, b: a.union(b), [self._condition(at, rows, x).select("key") for x in c.parts])
            return rows.join(hits, "key", "left_semi")
        raise PlanError(f"no condition: {c!r}")

    @staticmethod
    def _between(column: Column, low: str | None, high: str | None) -> Column:
        out = F.lit(True)
        if low is not None:
            out = out & (column >= F.lit(low).cast("date"))
        if high is not None:
            out = out & (column <= F.lit(high).cast("date"))
        return out

    # -- plans --------------------------------------------------------------------------
    def _rows(self, plan: Plan, at: str, entities: DataFrame) -> DataFrame:
        rows = entities
        for test in plan.tests:
            rows = self._condition(at, rows, test)
        if plan.where is not None:
            rows = self._condition(at, rows, plan.where)
        keys = [k for t, k in plan.exclude if t == at]
        if keys:
            rows = rows.where(~F.col("key").isin(keys))
        if plan.date_range:
            name, low, high = plan.date_range
            if not self._own(at, name):
                raise PlanError(f"{name} is no column of {at}")
            rows = rows.where(self._between(F.expr(self.v.properties[name].value), low, high))
        return rows

    def _anchored(self, plan: Plan) -> tuple[str, DataFrame]:
        at, key = plan.anchor
        hops, reached = plan.traversal, None
        for i, hop in enumerate(hops):
            at, e, _ = self._step(at, hop, "from", "key")
            if i == 0:
                reached = e.where(F.col("from") == key).select("key").distinct()
            else:
                reached = e.join(reached.withColumnRenamed("key", "from"), "from").select("key").distinct()
        if reached is None:
            raise PlanError("an anchor needs a traversal")
        return at, reached

    def run(self, plan: Plan) -> DataFrame:
        """The result: ``entity`` and what the plan adds; a count gives ``n`` alone."""
        tables = self.v.entities(self.spark, self.folder, plan.target)
        if plan.anchor:
            at, reached = self._anchored(plan)
            if at not in tables:
                raise PlanError(f"the traversal does not end at {plan.target}")
            tables = {at: tables[at].join(reached, "key", "left_semi")}
        parts = [self._one(plan, at, rows) for at, rows in tables.items() if not plan.related or self._fits(at, plan.related)]
        if not parts:
            raise PlanError("no table of the target fits the plan")
        out = reduce(lambda a, b: a.unionByName(b), parts)
        if plan.count:
            return out.agg(F.count_distinct("entity").alias("n"))
        return self._ordered(plan, out)

    def _fits(self, at: str, hops: tuple[Hop, ...]) -> bool:
        try:
            for h in hops:
                at = self._arrives(at, h)
        except PlanError:
            return False
        return True

    def _one(self, plan: Plan, at: str, rows: DataFrame) -> DataFrame:
        rows = self._rows(plan, at, rows)
        columns = [iri(at, "key").alias("entity")]
        single = self.v.unique(at)
        if plan.related:
            carry = {}
            if plan.related_date_range:
                carry["_in"] = plan.related_date_range[0]
            if plan.latest:
                carry["_d"] = plan.latest
            if plan.aggregate and plan.aggregate.measure:
                carry["_m"] = plan.aggregate.measure
            to, pairs = self._path(at, plan.related, rows=rows, carry=carry)
            single = single and self._single(at, plan.related)
            if plan.related_date_range:
                pairs = pairs.where(self._between(F.col("_in"), *plan.related_date_range[1:]))
            if plan.latest:
                # The newest day of each key from partial aggregates, joined back: ties stay, and no key is sorted in one task.
                newest = pairs.groupBy("key").agg(F.max("_d").alias("_d"))
                pairs = pairs.join(newest, ["key", "_d"], "left_semi")
            if plan.aggregate:
                return self._aggregated(plan, at, pairs if single else pairs.distinct())
            columns.append(iri(to, "end").alias("related"))
            if not plan.project:
                out = pairs.select(*columns)
                return out if single else out.distinct()
            rows = rows.join(pairs.select("key", "end"), "key")
        for name, (hops, prop) in plan.project.items():
            if hops:
                _, values = self._path(at, hops, end="_e", carry={f"_{name}": prop})
                rows = rows.join(values.select("key", f"_{name}"), "key", "left")
                single = single and self._single(at, hops)
            elif self.v.unique(at) and self._own(at, prop):
                rows = rows.withColumn(f"_{name}", F.expr(self.v.properties[prop].value))
            else:
                rows = rows.join(self.v.edges(self.spark, self.folder, prop).select(F.col("s").alias("key"), F.col("o").alias(f"_{name}")), "key", "left")
            columns.append(F.col(f"_{name}").alias(name))
        out = rows.select(*columns)
        # Only where the way to a row was unique it cannot come out twice.
        return out if single and not any(hops for hops, _ in plan.project.values()) else out.distinct()

    def _aggregated(self, plan: Plan, at: str, pairs: DataFrame) -> DataFrame:
        a = plan.aggregate
        if (a.measure is None) != (a.fn == "count") or a.fn not in ("count", "sum", "avg", "min", "max"):
            raise PlanError("count takes no measure, every other function one")
        m = F.col("_m") if a.measure else None
        if a.fn == "count":
            value = F.count_distinct("end")
        elif a.distinct and a.fn in ("sum", "avg"):
            value = F.sum_distinct(m) if a.fn == "sum" else F.sum_distinct(m) / F.count_distinct(m)
        else:
            value = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[a.fn](m)
        if a.fn != "count":
            value = F.round(value.cast("double"), 4)
        out = pairs.groupBy("key").agg(value.alias("value"))
        if a.having:
            out = out.where(compare(F.col("value"), *a.having))
        return out.select(iri(at, "key").alias("entity"), "value")

    def _ordered(self, plan: Plan, out: DataFrame) -> DataFrame:
        if plan.order is None and plan.limit is None:
            return out
        by, descending = plan.order or ("entity", False)
        first = F.desc_nulls_last(by) if descending else F.asc_nulls_last(by)
        keys = [first, F.asc("entity")]
        out = out.orderBy(*keys)
        if plan.offset:
            out = out.offset(plan.offset)
        if plan.limit is None:
            return out  # a whole result is ordered by ranges; only a page is ranked
        out = out.limit(plan.limit)
        # What is left is a page; its order is given out as a rank.
        return out.withColumn("rk", F.row_number().over(Window.orderBy(*keys)) + plan.offset)
