"""Closure, materialisation, verification, neighbourhoods and shapes over a graph in tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.vocabulary import Vocabulary, iri
from tessella.sources.tables import checkpointed, table


# -- transitive closure of data-sized edges ----------------------------------------------
def transitive_closure(edges: DataFrame, most: int = 32) -> DataFrame:
    """Pairs ``s``, ``o``, ``steps`` reachable along ``edges`` (s, o), with the least number of steps.

    Semi-naive: each round joins only the newly found pairs with the edges and keeps those
    not known before, so cycles end. Rounds are cut off by checkpoints; nulls are no nodes.
    Paths longer than ``most`` steps raise, they are never silently lost.
    """
    e = checkpointed(edges.select("s", "o").dropna().distinct())
    found = e.withColumn("steps", F.lit(1))
    new = found
    for step in range(2, most + 2):
        grown = new.select("s", F.col("o").alias("via")).join(e.select(F.col("s").alias("via"), "o"), "via").select("s", "o").distinct()
        new = checkpointed(grown.join(found, ["s", "o"], "left_anti").withColumn("steps", F.lit(step)))
        if new.isEmpty():
            return found
        if step > most:
            raise ValueError(f"paths of more than {most} steps")
        found = found.unionByName(new)  # each round is written once, as what it adds
    return found


# -- triples -----------------------------------------------------------------------------
def object_triples(v: Vocabulary, spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    """``s``, ``p``, ``o`` of object properties that are stored, identities put together."""
    out = []
    for name in names or [n for n, p in v.properties.items() if p.range_table and not p.inverse_of]:
        s, o = v.sides(name)
        out.append(v.edges(spark, folder, name).select(iri(s, "s").alias("s"), F.lit(name).alias("p"), iri(o, "o").alias("o")).distinct())
    return reduce(lambda a, b: a.unionByName(b), out)


def materialised(v: Vocabulary, spark: SparkSession, folder: str) -> DataFrame:
    """Facts that follow by declared inverses and chains of two, with rule and least premises.

    A fact that is stated, or already follows by an earlier rule, is not derived again.
    """
    out = []
    for name, p in v.properties.items():
        if p.inverse_of:
            s, o = v.sides(name)
            e = v.edges(spark, folder, name).distinct()
            premise = F.concat_ws(" ", iri(o, "o"), F.lit(p.inverse_of), iri(s, "s"))
            out.append(e.select(iri(s, "s").alias("s"), F.lit(name).alias("p"), iri(o, "o").alias("o"), F.lit("inverse").alias("rule"), premise.alias("premises")))
    for name, (first, second) in v.chains.items():
        (s, m), (_, o) = v.sides(first), v.sides(second)
        a = v.edges(spark, folder, first).select("s", F.col("o").alias("m")).distinct()
        b = v.edges(spark, folder, second).select(F.col("s").alias("m"), "o").distinct()
        premise = F.concat(iri(s, "s"), F.lit(f" {first} "), iri(m, "m"), F.lit("; "), iri(m, "m"), F.lit(f" {second} "), iri(o, "o"))
        derived = a.join(b, "m").groupBy("s", "o").agg(F.min(premise).alias("premises"))
        if name in v.properties:
            derived = derived.join(v.edges(spark, folder, name), ["s", "o"], "left_anti")
        out.append(derived.select(iri(s, "s").alias("s"), F.lit(name).alias("p"), iri(o, "o").alias("o"), F.lit("chain").alias("rule"), "premises"))
    return reduce(lambda a, b: a.unionByName(b), out)


def type_evidence(v: Vocabulary, spark: SparkSession, folder: str, cls: str) -> DataFrame:
    """Each instance of ``cls``, its stated type and the chain of superclasses that makes it one."""
    out = []
    for c in v.descendants(cls):
        if c in v.bindings:
            t, condition = v.bindings[c]
            chain = v.ancestors(c)[cls]
            rows = table(spark, folder, t).where(condition).select(F.expr(v.keys[t]).alias("key"))
            out.append(rows.select(iri(t, "key").alias("entity"), F.lit(c).alias("stated_type"), F.lit(" > ".join(chain)).alias("chain"), F.lit("declared" if c == cls else "inferred").alias("evidence")))
    return reduce(lambda a, b: a.unionByName(b), out).distinct()


def verify(v: Vocabulary, subject: str, relation: str, obj: str) -> str:
    """Whether the schema entails, contradicts or leaves open a statement about classes or properties."""
    known = set(v.classes())
    if relation in ("subclass_of", "disjoint_with", "equivalent_to"):
        if subject not in known or obj not in known:
            return "INVALID_REQUEST"
        up = obj in v.ancestors(subject)
        if relation == "subclass_of":
            return "ENTAILED" if up else "CONTRADICTED" if v.are_disjoint(subject, obj) else "UNKNOWN"
        if relation == "disjoint_with":
            return "ENTAILED" if v.are_disjoint(subject, obj) else "CONTRADICTED" if up or subject in v.ancestors(obj) else "UNKNOWN"
        return "ENTAILED" if subject == obj or obj in v.equivalents(subject) else "CONTRADICTED" if v.are_disjoint(subject, obj) else "UNKNOWN"
    if relation in ("domain_of", "range_of", "inverse_of"):
        if subject not in v.properties or (relation == "inverse_of" and obj not in v.properties) or (relation != "inverse_of" and obj not in known):
            return "INVALID_REQUEST"
        p = v.properties[subject]
        if relation == "inverse_of":
            return "ENTAILED" if p.inverse_of == obj or v.properties[obj].inverse_of == subject else "UNKNOWN"
        own = p.domain if relation == "domain_of" else p.range_class
        if own is None:
            return "UNKNOWN"
        return "ENTAILED" if obj in v.ancestors(own) else "CONTRADICTED" if v.are_disjoint(own, obj) else "UNKNOWN"
    return "INVALID_REQUEST"


def schema_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Schema-sized rows as a frame."""
    return spark.createDataFrame(rows, schema)


# -- neighbourhoods ----------------------------------------------------------------------
def neighbourhood(triples: DataFrame, focus: str, hops: int = 1) -> DataFrame:
    """The triples at most ``hops`` steps around ``focus``, in both directions.

    Each step but the last is checkpointed, so that the next does not search all triples for it again.
    """
    reached = triples.sparkSession.createDataFrame([(focus,)], "node string")
    found = None
    for hop in range(hops):
        near = triples.join(reached.withColumnRenamed("node", "s"), "s", "left_semi").unionByName(triples.join(reached.withColumnRenamed("node", "o"), "o", "left_semi")).distinct()
        near = checkpointed(near) if hop + 1 < hops else near
        found = near if found is None else found.unionByName(near).distinct()
        reached = near.select(F.col("s").alias("node")).union(near.select("o")).union(reached).distinct()
    return found


def degrees(triples: DataFrame) -> DataFrame:
    """Each node with its numbers of outgoing and incoming edges."""
    ends = triples.select(F.col("s").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(triples.select(F.col("o").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return ends.groupBy("node").agg(F.sum("out").alias("n_out"), F.sum("in").alias("n_in"))


def orphans(v: Vocabulary, spark: SparkSession, folder: str) -> DataFrame:
    """``entity``, ``property``: entities of a stored object property's range that no edge of it reaches."""
    out = []
    for name, p in v.properties.items():
        if p.range_table and not p.inverse_of:
            ends = v.edges(spark, folder, name).select(F.col("o").alias("key"))
            free = v.rows(spark, folder, p.range_table).select("key").join(ends, "key", "left_anti")
            out.append(free.select(iri(p.range_table, "key").alias("entity"), F.lit(name).alias("property")))
    return reduce(lambda a, b: a.unionByName(b), out)


def chain_audit(v: Vocabulary, spark: SparkSession, folder: str) -> DataFrame:
    """``chain``, ``n_pairs``, ``n_open``: pairs that each chain closes, and those of them no stored fact states."""
    out = []
    for name, (first, second) in v.chains.items():
        a = v.edges(spark, folder, first).select("s", F.col("o").alias("m"))
        b = v.edges(spark, folder, second).select(F.col("s").alias("m"), "o")
        pairs = a.join(b, "m").select("s", "o").distinct()
        stated = v.edges(spark, folder, name).withColumn("stated", F.lit(1)) if name in v.properties else None
        joined = pairs.join(stated.distinct(), ["s", "o"], "left") if stated is not None else pairs.withColumn("stated", F.lit(None).cast("int"))
        out.append(joined.agg(F.lit(name).alias("chain"), F.count("*").alias("n_pairs"), (F.count("*") - F.count("stated")).alias("n_open")))
    return reduce(lambda a, b: a.unionByName(b), out)


def anchor_layers(v: Vocabulary, spark: SparkSession, folder: str, hops: list[str]) -> DataFrame:
    """``anchor``, ``layer``, ``property``, ``n_nodes``: how many nodes each hop against the properties reaches from every anchor."""
    out, reached = [], None
    top = v.sides(hops[0])[1]
    for n, hop in enumerate(hops):
        e = v.edges(spark, folder, hop)
        if reached is None:
            reached = e.select(F.col("o").alias("anchor"), F.col("s").alias("node")).distinct()
        else:
            reached = e.select(F.col("o").alias("node"), "s").join(reached, "node").select("anchor", F.col("s").alias("node")).distinct()
        reached = checkpointed(reached) if n + 1 < len(hops) else reached
        out.append(reached.groupBy("anchor").agg(F.count("*").alias("n_nodes")).select(iri(top, "anchor").alias("anchor"), F.lit(n + 1).alias("layer"), F.lit(hop).alias("property"), "n_nodes"))
    return reduce(lambda a, b: a.unionByName(b), out)


def witness_paths(v: Vocabulary, spark: SparkSession, folder: str, hops: list[str]) -> DataFrame:
    """``entity``, ``reached``, ``path``: for every pair a path of properties connects, the least chain of facts that shows it."""
    at = v.sides(hops[0])[0]
    start, found = at, None
    for hop in hops:
        s, o = v.sides(hop)
        e = v.edges(spark, folder, hop)
        fact = F.concat(iri(s, "node"), F.lit(f" {hop} "), iri(o, "o"))
        if found is None:
            found = e.select(F.col("s").alias("start"), F.col("s").alias("node"), "o").select("start", F.col("o").alias("end"), fact.alias("path"))
        else:
            step = found.select("start", F.col("end").alias("node"), "path").join(e.select(F.col("s").alias("node"), "o"), "node")
            found = step.select("start", F.col("o").alias("end"), F.concat("path", F.lit("; "), fact).alias("path"))
        at = o
    return found.groupBy("start", "end").agg(F.min("path").alias("path")).select(iri(start, "start").alias("entity"), iri(at, "end").alias("reached"), "path")


def graph_hash(triples: DataFrame) -> DataFrame:
    """A hash of the set of triples, the same however they are ordered or partitioned.

    Rows are hashed, hashes gathered into 4096 buckets by their first digits; a bucket's
    hash and the hash over all buckets are of sorted lists, whose size the buckets bound.
    """
    h = F.sha2(F.concat_ws("\t", "s", "p", "o"), 256)
    rows = triples.select(h.alias("h")).distinct().withColumn("b", F.substring("h", 1, 3))
    buckets = rows.groupBy("b").agg(F.sum(F.conv(F.substring("h", 4, 8), 16, 10).cast("decimal(38,0)")).alias("x"), F.sum(F.conv(F.substring("h", 12, 8), 16, 10).cast("decimal(38,0)")).alias("y"), F.count("*").alias("n"))
    line = F.concat_ws(":", "b", F.col("x").cast("string"), F.col("y").cast("string"), F.col("n").cast("string"))
    return buckets.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("graph_hash"), F.sum("n").alias("n_triples"))


# -- shapes ------------------------------------------------------------------------------
def overlapping_intervals(rows: DataFrame, key: str, start: str, end: str, name: str) -> DataFrame:
    """Intervals that overlap an earlier one of the same key: a running maximum of ends, no self-join.

    Half-open at the end; a null end is open. Each interval is reported once, with the
    greatest end among those that start before it.
    """
    from pyspark.sql import Window

    before = Window.partitionBy(key).orderBy(start, name).rowsBetween(Window.unboundedPreceding, -1)
    far = F.lit("9999-12-31").cast("date")
    d = rows.where(F.col(start).isNotNull() & F.col(key).isNotNull()).withColumn("_end", F.coalesce(F.col(end), far))
    d = d.withColumn("covered_until", F.max("_end").over(before))
    return d.where(F.col("covered_until") > F.col(start)).select(key, name, start, "covered_until")
