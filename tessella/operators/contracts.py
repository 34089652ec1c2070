"""Evaluation contracts: cases checked, matched, scored in full and run; pluggable models held to what they must return."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import canonical_json


def typed_equal(a: Any, b: Any) -> bool:
    """Equality that tells truth values from numbers and takes 1 and 1.0 as the same, also inside lists and maps."""
    if isinstance(a, bool) or isinstance(b, bool):
        return isinstance(a, bool) and isinstance(b, bool) and a == b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a == b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(typed_equal(a[k], b[k]) for k in a)
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(map(typed_equal, a, b))
    return type(a) is type(b) and a == b


def phrase_check(text: str, allowed: set[str], banned: tuple[str, ...], mark: str = "#") -> list[str]:
    """What a generated text must not hold: banned phrases, and marked ids that were not given to it."""
    import re

    said = set(re.findall(rf"{re.escape(mark)}(\w+)", text))
    return [f"phrase {p}" for p in banned if p in text] + [f"id {x}" for x in sorted(said - allowed)]


# -- scoring in full ---------------------------------------------------------------------
def full_scores(cases: DataFrame, found: DataFrame, targets: DataFrame, allowed: DataFrame) -> DataFrame:
    """One row a case: targets and required groups hit, first rank, scope violations, whether the status is right, and whether it passes.

    cases: ``id``, ``expected`` (retrieved or unresolved); found: ``id``, ``doc``, ``rk``; targets:
    ``id``, ``doc``, ``grp``; allowed: ``id``, ``doc``. A case is ordinary if it has targets, else
    a control, which passes if nothing is found where nothing is expected. Repeated rows count once.
    """
    t = targets.dropna(subset=["id", "doc"]).distinct()
    f = found.dropna(subset=["id", "doc"]).groupBy("id", "doc").agg(F.min("rk").alias("rk"))
    hit = t.join(f, ["id", "doc"], "left")
    groups = hit.groupBy("id", "grp").agg(F.count_distinct("doc").alias("n"), F.count_distinct(F.when(F.col("rk").isNotNull(), F.col("doc"))).alias("h"), F.min("rk").alias("first"))
    per = groups.groupBy("id").agg(F.sum("n").alias("n_target"), F.sum("h").alias("n_hit"), F.count("*").alias("n_group"), F.sum((F.col("h") > 0).cast("long")).alias("n_group_hit"), F.min("first").alias("first"))
    outside = f.join(allowed.dropna().distinct(), ["id", "doc"], "left_anti").groupBy("id").agg(F.count("*").alias("n_outside"))
    any_found = f.groupBy("id").agg(F.count("*").alias("n_found"))
    d = cases.select("id", "expected").distinct().join(per, "id", "left").join(outside, "id", "left").join(any_found, "id", "left").fillna(0, ["n_target", "n_hit", "n_group", "n_group_hit", "n_outside", "n_found"])
    status = F.when(F.col("n_found") > 0, "retrieved").otherwise("unresolved")
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(0.0)
    d = d.withColumns({"ordinary": F.col("n_target") > 0, "recall": share("n_hit", "n_target"), "groups": share("n_group_hit", "n_group"), "mrr": F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6), "status_ok": status == F.coalesce("expected", F.lit(""))})
    gate = F.when(F.col("ordinary"), (F.col("n_hit") == F.col("n_target")) & (F.col("n_group_hit") == F.col("n_group"))).otherwise(F.lit(True)) & (F.col("n_outside") == 0) & F.col("status_ok")
    return d.select("id", "ordinary", "n_target", "n_hit", "recall", "groups", "mrr", "n_outside", "status_ok", gate.alias("passed"))


def gate_summary(scores: DataFrame, *by: str) -> DataFrame:
    """Means over ordinary cases and over all, with the number of cases as fixed denominators, and the gate's count."""
    o = F.col("ordinary")
    n, n_o = F.count("*"), F.sum(o.cast("long"))
    mean = lambda c: F.round(F.sum(F.when(o, F.col(c)).otherwise(0.0)) / F.nullif(n_o, F.lit(0)), 6)
    return scores.groupBy(*by).agg(n.alias("n"), n_o.alias("n_ordinary"), (n - n_o).alias("n_control"), mean("recall").alias("recall"), mean("mrr").alias("mrr"), F.round(F.avg("recall"), 6).alias("recall_all"), F.sum(F.col("passed").cast("long")).alias("n_passed"))


def with_empty(summary: DataFrame, grid: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """A summary with a row for every group of a fixed grid; counts of empty groups are 0, their means null."""
    return grid.join(summary, keys, "left").fillna(0, counts)


def judge_summary(rows: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """``by``, ``metric``, ``n``, ``mean``: the mean of each metric only where every row of the group has it."""
    m = rows.select(by, F.inline(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).cast("double").alias("v")) for x in metrics])))
    return m.groupBy(by, "metric").agg(F.count("*").alias("n"), F.when(F.count("v") == F.count("*"), F.round(F.avg("v"), 6)).alias("mean"))


def span_scores(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``key``, lengths of the unions of expected and found spans (``a``, ``b``) and of what both cover, recall and precision.

    Ends of spans are swept in order with the numbers of open spans on either side: no span meets another.
    """
    from pyspark.sql import Window

    def ends(d: DataFrame, e: int, f: int) -> DataFrame:
        s = d.where("a < b").select(key, "a", "b")
        return s.select(key, F.inline(F.array(F.struct(F.col("a").alias("x"), F.lit(e).alias("e"), F.lit(f).alias("f")), F.struct(F.col("b").alias("x"), F.lit(-e).alias("e"), F.lit(-f).alias("f")))))

    at = ends(expected, 1, 0).unionByName(ends(found, 0, 1)).groupBy(key, "x").agg(F.sum("e").alias("e"), F.sum("f").alias("f"))
    w = Window.partitionBy(key).orderBy("x")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = at.select(key, "x", F.sum("e").over(run).alias("e"), F.sum("f").over(run).alias("f"), (F.lead("x").over(w) - F.col("x")).alias("n"))
    size = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    g = d.groupBy(key).agg(size(F.col("e") > 0).alias("n_expected"), size(F.col("f") > 0).alias("n_found"), size((F.col("e") > 0) & (F.col("f") > 0)).alias("n_both"))
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(0.0)
    return g.select(key, "n_expected", "n_found", "n_both", share("n_both", "n_expected").alias("recall"), share("n_both", "n_found").alias("precision"))


def same_ids(**sides: DataFrame) -> DataFrame:
    """``id`` and, for every side, whether it has it: the ids that not all sides have."""
    names = list(sides)
    flags = [d.select("id").dropna().distinct().select("id", *[F.lit(n == m).cast("int").alias(m) for m in names]) for n, d in sides.items()]
    out = flags[0]
    for f in flags[1:]:
        out = out.unionByName(f)
    out = out.groupBy("id").agg(*[(F.max(m) > 0).alias(m) for m in names])
    return out.where(~(F.expr(" and ".join(names))))


# -- running -----------------------------------------------------------------------------
#: How a case may end.
OUTCOMES = ("pass", "fail", "error", "timeout", "skip", "not_run")


def run_suite(cases: DataFrame, columns: list[str], adapter: Callable[[dict], Any], expected: str, seconds: float = 60.0, skip: Column | None = None) -> DataFrame:
    """``id``, ``outcome``, ``detail`` of every case: the adapter's answer against the expected one, by ``typed_equal``.

    The adapter gets the named columns of a case. An exception is an error with its text, an
    answer later than ``seconds`` a timeout; cases under ``skip`` are not handed to it, and of a
    case without an id nothing is run. Cases run where their rows are, an Arrow batch at a time.
    """
    rows = cases.select("id", *columns, F.col(expected).alias("_expected"), (skip if skip is not None else F.lit(False)).alias("_skip"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                if r["id"] is None or r["_skip"]:
                    out.append((r["id"], "not_run" if r["id"] is None else "skip", None))
                    continue
                began = time.monotonic()
                try:
                    got = adapter({c: r[c] for c in columns})
                except Exception as e:  # noqa: BLE001 - whatever an adapter raises is the case's error
                    out.append((r["id"], "error", f"{type(e).__name__}: {e}"))
                    continue
                late = time.monotonic() - began > seconds
                out.append((r["id"], "timeout" if late else "pass" if typed_equal(got, r["_expected"]) else "fail", None if late else canonical_json(got)))
            yield pd.DataFrame(out, columns=["id", "outcome", "detail"])

    return rows.mapInPandas(run, "id string, outcome string, detail string")


# -- models as resources -------------------------------------------------------------------
class ResourceError(ValueError):
    """A model returned what its contract does not allow."""


def checked_scores(scores: list, n: int) -> list[float]:
    """A reranker's answer: each of the ``n`` candidates once, with a finite number; anything else raises."""
    if sorted(i for i, _ in scores) != list(range(n)):
        raise ResourceError("every candidate must be scored once")
    out = [0.0] * n
    for i, s in scores:
        if isinstance(s, bool) or not isinstance(s, (int, float)) or not math.isfinite(s):
            raise ResourceError("a score must be a finite number")
        out[i] = float(s)
    return out


def checked_vectors(vectors: list, n: int) -> list[list[float]]:
    """An embedder's answer: ``n`` vectors of one length, finite and not zero; anything else raises."""
    if len(vectors) != n or len({len(v) for v in vectors}) > 1:
        raise ResourceError("one vector of one length for every text")
    out = [[float(x) for x in v] for v in vectors]
    if any(not v or not all(map(math.isfinite, v)) or not any(v) for v in out):
        raise ResourceError("a vector must be finite and not zero")
    return out


def reranked(candidates: DataFrame, model: Callable[[str, list[str]], list[tuple[int, float]]], k: int) -> DataFrame:
    """``q``, ``d``, ``score``, ``rk`` of candidates (``q``, ``d``, ``rk``, ``query``, ``text``) in a model's order: score first, then former rank.

    Fails closed: a model that leaves out or doubles a candidate, or gives no finite number,
    stops the job. A query's candidates are a bounded list; null texts are given as empty.
    """
    kinds = dict(candidates.dtypes)

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("rk")
        scores = checked_scores(model(d["query"].iloc[0] or "", [t or "" for t in d["text"]]), len(d))
        d = d.assign(score=[round(s, 6) for s in scores]).sort_values(["score", "rk"], ascending=[False, True]).head(k)
        return pd.DataFrame({"q": d.q, "d": d.d, "score": d.score, "rk": range(1, len(d) + 1)})

    return candidates.groupBy("q").applyInPandas(run, f"q {kinds['q']}, d {kinds['d']}, score double, rk int")


def embedded(texts: DataFrame, key: str, text: str, model: Callable[[list[str]], list[list[float]]], config: str, cache: str) -> DataFrame:
    """``key``, ``hash``, ``vector`` of every text that is not null; vectors are kept at ``cache`` under a hash of configuration and text.

    Only texts whose hash is not kept yet go to the model, each once; its answers are checked
    before they are kept. A kept vector of another length than the others raises.
    """
    spark = texts.sparkSession
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("t"), F.sha2(F.concat(F.lit(config), F.lit("\0"), F.col(text)), 256).alias("hash"))
    missing = rows.select("hash", "t").dropDuplicates(["hash"])
    try:
        missing = missing.join(spark.read.parquet(cache).select("hash"), "hash", "left_anti")
    except Exception as e:  # noqa: BLE001 - nothing is kept yet
        if "PATH_NOT_FOUND" not in str(e):
            raise

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"hash": b["hash"], "vector": checked_vectors(model(list(b["t"])), len(b))})

    missing.mapInPandas(run, "hash string, vector array<double>").write.mode("append").parquet(cache)
    kept = spark.read.parquet(cache)
    if kept.select(F.size("vector").alias("n")).distinct().limit(2).count() > 1:
        raise ResourceError("kept vectors differ in length")
    return rows.drop("t").join(kept, "hash").select(key, "hash", "vector")
