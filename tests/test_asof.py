"""The as-of join against brute force, with its defined cases."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from tessella.functions.dates import day
from tessella.operators.asof import asof_join, latest_valid

EVENTS = "event_id string, entity string, at date, change_id int"
CHANGES = "entity string, change_id string, recorded date, start date, end date, at int"


def d(n):
    return None if n is None else dt.date(2020, 1, 1) + dt.timedelta(days=n)


def brute(events, changes):
    out = {}
    for e, entity, at in {x[:3] for x in events}:
        ok = [(r, c) for n, c, r, s, t in {x[:5] for x in changes} if None not in (at, r, n, c) and n == entity and r <= at and (s is None or s <= at) and (t is None or t > at)]
        if ok and e is not None:
            out[e, entity] = max(ok)[1]
    return out


def run(spark, events, changes, block):
    e = spark.createDataFrame([(*x[:2], d(x[2]), 7) for x in events], EVENTS)
    c = spark.createDataFrame([(*x[:2], *map(d, x[2:5]), 9) for x in changes], CHANGES)
    return {(r.event_id, r.entity): r.change_id for r in asof_join(e, c, block).collect()}


def test_matches_brute_force_with_hot_entities_cut_into_cells(spark):
    rng = random.Random(3)
    pick = lambda lo, hi: rng.choice([None, *[rng.randint(lo, hi)] * 4])
    events = [(f"e{i}", rng.choice(["hot", "hot", "a", "b", None]), pick(0, 60)) for i in range(120)]
    events += events[:9]
    changes = [(rng.choice(["hot", "hot", "a", "c"]), f"v{i % 50}", pick(0, 50), pick(0, 60), pick(5, 80)) for i in range(60)]
    expected = brute(events, changes)
    assert expected
    for block in (7, 50_000):
        assert run(spark, events, changes, block) == expected


def test_empty_sides_and_ties(spark):
    assert run(spark, [], [("a", "v", 1, None, None)], 10) == {}
    assert run(spark, [("e", "a", 3)], [], 10) == {}
    assert run(spark, [("e", "a", 3)], [("a", "v1", 1, None, None), ("a", "v2", 1, None, None)], 10) == {("e", "a"): "v2"}
    assert run(spark, [("e", "a", 3)], [("a", "v1", 1, None, 3)], 10) == {}


def test_never_takes_what_became_known_later(spark):
    assert run(spark, [("e", "a", 3)], [("a", "old", 1, None, None), ("a", "new", 4, 0, None)], 10) == {("e", "a"): "old"}


def test_binary_search_steps_back_within_its_entity():
    recorded = np.array([1, 2, 3, 11, 12])
    found = latest_valid(recorded, np.array([0, 0, 9, 0, 0]), np.array([9, 2, 99, 12, 12]), np.array([3, 12]), np.array([0, 3]))
    assert found.tolist() == [0, -1]


def test_days_in_several_writings(spark):
    rows = ["2024-05-01", "2024/5/1", "20240501", "2024年5月1日", " 2024-05-01 ", "２０２４-０５-０１", "2024-13-01", "", None, "May 2024"]
    got = [r.d for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, t string").orderBy("i").select(day(F.col("t")).alias("d")).collect()]
    assert got == [dt.date(2024, 5, 1)] * 6 + [None] * 4


def test_runs_of_ended_changes_cost_no_walk():
    import time

    import numpy as np

    from tessella.operators.asof import latest_valid

    def run(n):
        recorded, start, end = np.arange(n), np.arange(n), np.arange(n) + 1
        end[0] = 1 << 40
        at, first = np.full(n, n + 5), np.zeros(n, np.int64)
        began = time.perf_counter()
        found = latest_valid(recorded, start, end, at, first)
        assert (found == 0).all()
        return time.perf_counter() - began

    run(1000)
    assert run(40_000) < 40 * max(run(4_000), 0.002)


def test_sweep_against_brute_force():
    import numpy as np

    from tessella.operators.asof import latest_valid

    rng = np.random.default_rng(4)
    for _ in range(50):
        n = 30
        recorded = np.sort(rng.integers(0, 20, n))
        start, at = rng.integers(0, 20, n), rng.integers(0, 25, 40)
        end = start + rng.integers(0, 6, n)
        got = latest_valid(recorded, start, end, at, np.zeros(40, np.int64))
        want = [max([i for i in range(n) if recorded[i] <= t and start[i] <= t < end[i]], default=-1) for t in at]
        assert got.tolist() == want
