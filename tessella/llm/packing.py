"""Items packed into containers of fixed capacity by a grouping genetic algorithm (problem 9).

Items are dealt by hash into groups of bounded size. Every group is evolved on several
islands. An individual is a packing; crossover injects another packing's best-filled bins
whole, dissolves the bins that now hold an item twice and puts the displaced items back
by best fit, largest first. An island keeps its population from epoch to epoch; after each
it sends its elite to its neighbour; the best packing of all islands is the group's. A group ends with at most a few slack bins, so
dealing into groups of ``GROUP`` items costs a fraction of a percent of space.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections.abc import Callable
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.tables import checkpointed

#: Items of a group; islands and epochs of each; packings of an island, crossovers of an epoch, packings sent to the neighbour.
GROUP, ISLANDS, EPOCHS, POPULATION, CROSSOVERS, ELITE = 2_000, 3, 3, 6, 12, 1

Bins = list[list[int]]


def best_fit(items: list[int], sizes: list[int], capacity: int, bins: Bins, order: list[int] | None = None) -> Bins:
    """Add ``items``, largest first (or in ``order``), each to the bin it leaves the least space in; opens bins as needed."""
    bins = [b[:] for b in bins]
    free = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    for i in order if order is not None else sorted(items, key=lambda x: -sizes[x]):
        at = bisect_left(free, (sizes[i], -1))
        if at < len(free):
            space, k = free.pop(at)
            bins[k].append(i)
        else:
            space, k = capacity, len(bins)
            bins.append([i])
        if space > sizes[i]:
            insort(free, (space - sizes[i], k))
        elif sizes[i] == 0:
            insort(free, (0, k))
    return bins


def fitness(bins: Bins, sizes: list[int], capacity: int) -> float:
    """Few bins first, then unequal filling: full bins beside nearly empty ones can still be emptied."""
    return sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins)) - len(bins)


def crossover(a: Bins, b: Bins, sizes: list[int], capacity: int, rng: random.Random) -> Bins:
    """``a`` with a share of ``b``'s best-filled bins put in whole."""
    ranked = sorted(b, key=lambda x: -sum(sizes[i] for i in x))
    take = ranked[: max(1, int(len(ranked) * rng.uniform(0.2, 0.7)))]
    taken = {i for x in take for i in x}
    kept = [x for x in a if taken.isdisjoint(x)]
    displaced = [i for x in a if not taken.isdisjoint(x) for i in x if i not in taken]
    # The emptiest bins are dissolved as well: without this few slack bins would ever meet.
    kept.sort(key=lambda x: sum(sizes[i] for i in x))
    cut = max(1, len(kept) // 20) if kept else 0
    displaced += [i for x in kept[:cut] for i in x]
    return best_fit(displaced, sizes, capacity, take + kept[cut:])


def evolve(sizes: list[int], capacity: int, seeds: list[Bins], rng: random.Random, population: int = POPULATION, crossovers: int = CROSSOVERS) -> list[Bins]:
    """The population of one island after an epoch that starts from ``seeds``, the best packing first.

    Places that ``seeds`` leave open are filled by best fit: the first by size, the others by sizes put out of order a little.
    """
    everything = list(range(len(sizes)))
    people = list(seeds)
    while len(people) < population:
        noisy = sorted(everything, key=lambda i: -sizes[i] * rng.uniform(0.85, 1.15)) if people else None
        people.append(best_fit(everything, sizes, capacity, [], noisy))
    scored = sorted(((fitness(p, sizes, capacity), -k, p) for k, p in enumerate(people)), reverse=True, key=lambda x: x[:2])
    least = -(-sum(sizes) // capacity)
    for k in range(crossovers):
        if len(scored[0][2]) <= least:
            break
        # Tournaments of two choose the parents.
        a, b = (min(rng.sample(range(len(scored)), 2)) for _ in range(2)) if len(scored) > 1 else (0, 0)
        child = crossover(scored[a][2], scored[b if b != a else (a + 1) % len(scored)][2], sizes, capacity, rng)
        scored.append((fitness(child, sizes, capacity), -len(people) - k, child))
        scored = sorted(scored, reverse=True, key=lambda x: x[:2])[:population]
    return [p for _, _, p in scored[:population]]


def _parts(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """``k``, ``part``, ``size``, ``uid`` of every item, one above the capacity in several parts."""
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    whole = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("int")
    parts = items.select(F.col(key).alias("k"), whole.alias("w")).select(
        "k", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("w") / capacity).cast("int") - 1, F.lit(0)))).alias("part")
    )
    return parts.select("k", "part", F.least(F.lit(capacity), F.col("w") - F.col("part") * capacity).alias("size"), F.monotonically_increasing_id().alias("uid"))


def plain_containers(items: DataFrame, key: str, size: str, capacity: int, group: int = GROUP) -> DataFrame:
    """``n``: how many containers plain best fit, largest first, takes for the same items in groups of the same size: what the algorithm is measured against."""
    parts = checkpointed(_parts(items, key, size, capacity))
    groups = max(1, round(parts.count() / group))

    def fit(d: pd.DataFrame) -> pd.DataFrame:
        sizes = d["size"].tolist()
        return pd.DataFrame({"n": [len(best_fit(list(range(len(sizes))), sizes, capacity, []))]})

    dealt = parts.select("size", F.pmod(F.xxhash64("k", "part", "uid"), F.lit(groups)).alias("g"))
    return dealt.groupBy("g").applyInPandas(fit, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def pack(items: DataFrame, key: str, size: str, capacity: int, group: int = GROUP, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """``key``, ``part_no``, ``part_size`` and ``container`` of every item.

    An item above the capacity, and no other, is split: into parts of the capacity and
    one of the rest. Defined cases: a null size counts as 0; items of size 0 take no
    space; repeated items are packed each; an empty table gives an empty result; other
    columns are ignored. What is shuffled is one small row an item, island and epoch.
    """
    kind = dict(items.dtypes)[key]
    parts = checkpointed(_parts(items, key, size, capacity))
    groups = max(1, round(parts.count() / group))
    state = parts.select(
        "uid", "size", F.pmod(F.xxhash64("k", "part", "uid"), F.lit(groups)).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
        F.lit(0).alias("origin"), F.array().cast("array<int>").alias("bins"),
    )

    def epoch(d: pd.DataFrame, number: int) -> pd.DataFrame:
        d = d.sort_values("uid", kind="stable")
        g, island = int(d.g.iloc[0]), int(d.island.iloc[0])
        # The island's own people first, then those sent to it.
        origins = [d[d.origin == o] for o in sorted(d.origin.unique(), key=lambda o: (o != island, o))]
        first, seeds = origins[0], []
        for one in origins:
            for packing in zip(*one["bins"]):
                bins: dict[int, list[int]] = {}
                for i, b in enumerate(packing):
                    bins.setdefault(b, []).append(i)
                seeds.append(list(bins.values()))
        sizes = first["size"].tolist()
        people = evolve(sizes, capacity, seeds, random.Random(g * 1_000_003 + island * 1_009 + number))
        where = [[0] * len(sizes) for _ in people]
        for p, packing in enumerate(people):
            for k, b in enumerate(packing):
                for i in b:
                    where[p][i] = k
        return pd.DataFrame({"uid": first.uid, "size": first["size"], "g": g, "island": island, "bins": list(map(list, zip(*where))), "score": fitness(people[0], sizes, capacity)})

    def step(number: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        return lambda d: epoch(d, number)

    schema = "uid long, size int, g long, island int, bins array<int>, score double"
    for n in range(epochs):
        if n:
            # The population stays; its elite goes to the next island of the ring as well.
            stay = F.struct(F.col("island").alias("to"), F.col("bins").alias("sent"))
            go = F.struct(F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("to"), F.slice("bins", 1, ELITE).alias("sent"))
            state = state.select("uid", "size", "g", F.col("island").alias("origin"), F.explode(F.array(stay, go) if islands > 1 else F.array(stay)).alias("x"))
            state = state.select("uid", "size", "g", F.col("x.to").alias("island"), "origin", F.col("x.sent").alias("bins"))
        else:
            state = state.withColumn("origin", F.col("island"))
        state = state.groupBy("g", "island").applyInPandas(step(n), schema)
    ranked = state.groupBy("uid").agg(F.max_by(F.struct("g", F.element_at("bins", 1).alias("bin")), F.struct("score", -F.col("island"))).alias("best"))
    return parts.join(ranked, "uid").select(
        F.col("k").cast(kind).alias(key), F.col("part").alias("part_no"), F.col("size").alias("part_size"), F.concat_ws("-", "best.g", "best.bin").alias("container")
    )
