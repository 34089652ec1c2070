"""Scores of retrieval runs, distributions, interval coverage and set comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retrieval_scores(cases: DataFrame, found: DataFrame, targets: DataFrame, allowed: DataFrame) -> DataFrame:
    """One row a case: recall of its targets, reciprocal rank of the first, scope violations and whether it passes.

    cases: ``id``; found: ``id``, ``doc``, ``rk``; targets and allowed: ``id``, ``doc``. A
    case without targets scores 0 and stays in; repeated rows count once.
    """
    t = targets.dropna().distinct()
    f = found.dropna(subset=["id", "doc"]).groupBy("id", "doc").agg(F.min("rk").alias("rk"))
    hits = t.join(f, ["id", "doc"]).groupBy("id").agg(F.count("*").alias("n_hit"), F.min("rk").alias("first"))
    n = t.groupBy("id").agg(F.count("*").alias("n_target"))
    outside = f.join(allowed.dropna().distinct(), ["id", "doc"], "left_anti").groupBy("id").agg(F.count("*").alias("n_outside"))
    out = cases.select("id").distinct().join(n, "id", "left").join(hits, "id", "left").join(outside, "id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = out.select("id", zero("n_target").alias("n_target"), zero("n_hit").alias("n_hit"), "first", zero("n_outside").alias("n_outside"))
    recall = F.when(F.col("n_target") > 0, F.col("n_hit") / F.col("n_target")).otherwise(0.0)
    mrr = F.coalesce(1.0 / F.col("first"), F.lit(0.0))
    passed = (F.col("n_target") > 0) & (F.col("n_hit") == F.col("n_target")) & (F.col("n_outside") == 0)
    return out.select("id", "n_target", "n_hit", F.round(recall, 6).alias("recall"), F.round(mrr, 6).alias("reciprocal_rank"), "n_outside", passed.alias("passed"))


def by_groups(scores: DataFrame, columns: list[str]) -> DataFrame:
    """Means over every column's groups and over all: each row stands once in each of its groups, in one aggregation."""
    pairs = [F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias("value")) for c in columns]
    pairs.append(F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")))
    d = scores.select(F.inline(F.array(*pairs)), "recall", "reciprocal_rank", "passed")
    return d.groupBy("dimension", "value").agg(
        F.count("*").alias("n"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.sum(F.col("passed").cast("long")).alias("n_passed")
    )


def distribution(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Number, mean, median and 95th percentile (nearest rank) of a value in each group; null unless every value is known."""
    v = F.col(value)
    whole = F.count(v) == F.count("*")
    when = lambda c: F.when(whole, c)
    return rows.groupBy(group).agg(
        F.count("*").alias("n"), when(F.round(F.avg(v), 6)).alias("mean"), when(F.round(F.median(v), 6)).alias("p50"), when(F.expr(f"percentile_disc(0.95) within group (order by {value})")).alias("p95")
    )


def covered_length(spans: DataFrame, key: str, start: str, stop: str, low: Column, high: Column) -> DataFrame:
    """How much of [low, high) the union of the spans of each key covers, overlaps counted once.

    Spans are clipped, sorted, and each adds what lies beyond the greatest end before it.
    """
    s = spans.select(key, F.greatest(F.col(start), low).alias("a"), F.least(F.col(stop), high).alias("b")).where("a < b")
    before = Window.partitionBy(key).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("reached", F.coalesce(F.max("b").over(before), F.col("a")))
    return s.groupBy(key).agg(F.sum(F.greatest(F.col("b") - F.greatest(F.col("a"), F.col("reached")), F.lit(0))).alias("covered"))


def set_difference(left: DataFrame, right: DataFrame, key: str, item: str) -> DataFrame:
    """For each key the sorted items that only one side has; keys without a difference do not come out."""
    a, b = left.select(key, item).dropna().distinct(), right.select(key, item).dropna().distinct()
    missing = a.join(b, [key, item], "left_anti").withColumn("side", F.lit("missing"))
    extra = b.join(a, [key, item], "left_anti").withColumn("side", F.lit("unexpected"))
    return missing.unionByName(extra).groupBy(key, "side").agg(F.array_join(F.array_sort(F.collect_set(item)), ",").alias("items"))


def compared(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """Two runs side by side: cases won, lost, equal, or in one run only."""
    a, b = first.select(key, F.col(value).alias("va")), second.select(key, F.col(value).alias("vb"))
    outcome = F.when(F.col("va").isNull() | F.col("vb").isNull(), "unpaired").when(F.col("va") > F.col("vb"), "first").when(F.col("va") < F.col("vb"), "second").otherwise("equal")
    return a.join(b, key, "full_outer").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
