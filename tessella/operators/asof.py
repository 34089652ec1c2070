"""Attributes as known at event time (problem 5): an as-of join over validity intervals.

Events and changes are co-grouped by entity; inside a group a vectorised binary search
finds, for all events at once, the last change recorded by the event time; for those that
meet one not in force then, a sweep over time finds the last that was.

No entity may flood a task: both sides are counted first (partial aggregates, one row
an entity), and an entity with more than ``block`` events or changes is cut into a grid
of event slices x change slices. Every cell finds its own best change; one max per event
over the cells, aggregated before the shuffle, gives the result. Entities below the
bound form one cell and pay nothing.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.tables import checkpointed

#: Rows of either side that a cell holds at most and a co-grouped call on average.
BLOCK = 50_000


def latest_valid(recorded: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Index of the last change from ``first`` on with recorded <= at, start <= at and end > at; -1 if none.

    ``recorded`` is sorted. A binary search finds, for all events at once, the last change
    recorded; where it was not in force, a sweep over time finds the last one that was: changes
    enter a heap when they are known and begun and leave it when they have ended, so runs of
    ended changes cost n log n, not a step back for each.
    """
    pos = np.searchsorted(recorded, at, side="right") - 1
    known = pos >= first
    found = np.where(known & (start[pos] <= at) & (end[pos] > at), pos, -1) if len(recorded) else np.full(len(at), -1, np.int64)
    open_ = np.flatnonzero(known & (found < 0))
    if not len(open_):
        return found
    begins = np.maximum(recorded, start)
    entering = np.argsort(begins, kind="stable")
    heap: list[int] = []
    k = 0
    for e in open_[np.argsort(at[open_], kind="stable")].tolist():
        now = at[e]
        while k < len(entering) and begins[entering[k]] <= now:
            heapq.heappush(heap, -int(entering[k]))
            k += 1
        while heap and end[-heap[0]] <= now:
            heapq.heappop(heap)  # time only goes on: what has ended never comes back
        if heap and -heap[0] >= first[e]:
            found[e] = -heap[0]
    return found


def _sliced(df: DataFrame, own: str, other: str, name: str, other_name: str, spread: list[str]) -> DataFrame:
    """Give each row its own slice, and one copy for every slice of the other side."""
    slot = F.pmod(F.xxhash64(*spread), F.col(own)).cast("int")
    return df.withColumn(name, slot).withColumn(other_name, F.explode(F.sequence(F.lit(0), F.col(other).cast("int") - 1)))


def asof_join(events: DataFrame, changes: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each event and entity the change known and in force at the event time.

    events: ``event_id``, ``entity``, ``at`` (date). changes: ``entity``, ``change_id``,
    ``recorded`` (date), ``start``, ``end`` (dates, null: open). Returned are ``event_id``,
    ``entity``, ``change_id``, one row for each event and entity that has such a change.

    Defined cases: a null key, ``at`` or ``recorded`` never matches; repeated events and
    changes count once; of changes recorded on the same day the greater ``change_id``
    wins; either side may be empty. Other columns, whatever their names, are ignored.
    """
    # Written once, the few columns needed: they are counted before they are dealt.
    e = checkpointed(events.select("event_id", "entity", "at").dropna().distinct())
    c = checkpointed(changes.select("entity", "change_id", "recorded", "start", "end").dropna(subset=["entity", "change_id", "recorded"]).distinct())
    e_count = e.groupBy("entity").agg(F.count("*").alias("ne"), F.ceil(F.count("*") / block).alias("e_slices"))
    c_count = c.groupBy("entity").agg(F.count("*").alias("nc"), F.ceil(F.count("*") / block).alias("c_slices"))
    counted = e_count.join(c_count, "entity")
    grid, sizes = counted.select("entity", "e_slices", "c_slices"), counted
    days = lambda x: F.datediff(x, F.lit("1970-01-01").cast("date")).cast("long")
    e = e.join(grid, "entity").select("entity", "event_id", days(F.col("at")).alias("at"), "e_slices", "c_slices")
    c = c.join(grid, "entity").select(
        "entity", "change_id", "e_slices", "c_slices",
        days(F.col("recorded")).alias("recorded"),
        F.coalesce(days(F.col("start")), F.lit(-(1 << 60))).alias("start"),
        F.coalesce(days(F.col("end")), F.lit(1 << 60)).alias("end"),
    )
    e = _sliced(e, "e_slices", "c_slices", "e_slice", "c_slice", ["event_id"]).drop("e_slices", "c_slices")
    c = _sliced(c, "c_slices", "e_slices", "c_slice", "e_slice", ["change_id"]).drop("e_slices", "c_slices")
    # A Python call for each entity would be slow, so a call takes a bucket of cells, of which there are as many as the rows counted need.
    rows = sizes.agg(F.sum(F.col("ne") * F.col("c_slices") + F.col("nc") * F.col("e_slices"))).first()[0] or 0
    buckets = max(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(rows) // block))
    cell = ["entity", "e_slice", "c_slice"]
    key = F.pmod(F.xxhash64(*cell), F.lit(buckets)).alias("k")

    def search(e: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        cells = c[cell].drop_duplicates()
        cells["no"] = np.arange(len(cells), dtype=np.int64)
        e, c = e.merge(cells, on=cell), c.merge(cells, on=cell).sort_values(["no", "recorded", "change_id"])
        # All cells lie in one sorted array, each at its own multiple of a stride wider than any day.
        base, e_base = c.no.to_numpy() << 32, e.no.to_numpy() << 32
        day = lambda x: np.clip(x.to_numpy(np.int64), -(1 << 31) + 1, (1 << 31) - 1)
        first = np.searchsorted(c.no.to_numpy(), e.no.to_numpy())
        found = latest_valid(day(c.recorded) + base, day(c.start) + base, day(c.end) + base, day(e["at"]) + e_base, first)
        c = c.iloc[found[found >= 0]]
        return pd.DataFrame({"event_id": e.event_id[found >= 0].array, "entity": c.entity.array, "change_id": c.change_id.array, "recorded": c.recorded.array})

    kinds = dict(events.dtypes) | dict(changes.dtypes)
    schema = f"event_id {kinds['event_id']}, entity {kinds['entity']}, change_id {kinds['change_id']}, recorded long"
    found = e.groupBy(key).cogroup(c.groupBy(key)).applyInPandas(search, schema)
    best = found.groupBy("event_id", "entity").agg(F.max(F.struct("recorded", "change_id")).alias("best"))
    return best.select("event_id", "entity", F.col("best.change_id").alias("change_id"))
