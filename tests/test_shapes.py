"""Constraints of every kind on small rows, spans and gates."""

import datetime

import pytest

from tessella.functions.text import han_numeral, numeral
from tessella.operators import contracts
from tessella.operators.shapes import Constraint as C
from tessella.operators.shapes import Shape, report, violations


def day(n):
    return datetime.date(2020, 1, n)


def test_every_kind(spark):
    rows = [
        ("a", "x", 1, ["p"], day(1), day(5), "a2020", "k", None, "a"),
        ("b", None, -1, ["p", "q"], day(4), day(3), "2020-01-01", "k", "y", "zz"),
        ("c", "long", None, None, day(9), None, "2020-02-31", None, None, None),
        (None, None, -9, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id string, t string, n int, xs array<string>, f date, w date, d string, k string, alt string, ref string")
    shape = Shape("S", "id", (
        C("t", "min_count", 1), C("t", "max_length", 3), C("n", "min_inclusive", 0), C("xs", "max_count", 1), C("xs", "min_count", 1), C("d", "datatype", "date"), C("f", "not_after", "w"), C("t", "in", ("x",)),
        C("t", "either", ("alt",)), C("k", "unique", ()), C("ref", "class", "ids"), C("ref", "forbidden", "ids"), C("ref", "not_itself", "id"), C("n", "implies", ("n > 0", "alt is not null")), C("k", "no_overlap", ("f", "w")), C("d", "pattern", "^2"),
    ))
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    got = {(r.focus, r.path, r.kind) for r in violations(shape, df, {"ids": ids}).collect()}
    assert got == {
        ("b", "t", "min_count"), ("c", "t", "max_length"), ("b", "n", "min_inclusive"), ("b", "xs", "max_count"), ("c", "xs", "min_count"), ("a", "d", "datatype"), ("c", "d", "datatype"), ("b", "f", "not_after"), ("c", "t", "in"),
        ("a", "k", "unique"), ("b", "k", "unique"), ("b", "ref", "class"), ("a", "ref", "forbidden"), ("a", "ref", "not_itself"), ("a", "n", "implies"), ("b", "k", "no_overlap"), ("a", "d", "pattern"),
    }
    counts = {(r.path, r.kind): r.n for r in report(violations(shape, df.limit(0), {"ids": ids}), [shape]).collect()}
    assert len(counts) == len(shape.constraints) and set(counts.values()) == {0}
    with pytest.raises(ValueError):
        violations(Shape("S", "id", (C("t", "other"),)), df)


def test_span_scores_against_sets(spark):
    import random

    rng = random.Random(8)
    e = [("k", a, a + rng.randint(0, 9)) for a in (rng.randrange(60) for _ in range(8))]
    f = [("k", a, a + rng.randint(0, 9)) for a in (rng.randrange(60) for _ in range(8))]
    x, y = ({n for _, a, b in s for n in range(a, b)} for s in (e, f))
    frame = lambda s: spark.createDataFrame(s, "id string, a long, b long")
    r = contracts.span_scores(frame(e), frame(f), "id").first()
    assert (r.n_expected, r.n_found, r.n_both) == (len(x), len(y), len(x & y))
    assert r.recall == pytest.approx(len(x & y) / len(x), abs=1e-6)


def test_full_scores_of_controls_and_groups(spark):
    cases = spark.createDataFrame([("o", "retrieved"), ("c", "unresolved"), ("w", "unresolved")], "id string, expected string")
    found = spark.createDataFrame([("o", "d1", 1), ("o", "d1", 2), ("w", "d9", 1)], "id string, doc string, rk int")
    targets = spark.createDataFrame([("o", "d1", 1), ("o", "d2", 2)], "id string, doc string, grp int")
    allowed = spark.createDataFrame([("o", "d1"), ("w", "d9")], "id string, doc string")
    got = {r.id: (r.ordinary, r.recall, r.groups, r.mrr, r.status_ok, r.passed) for r in contracts.full_scores(cases, found, targets, allowed).collect()}
    assert got == {"o": (True, 0.5, 0.5, 1.0, True, False), "c": (False, 0.0, 0.0, 0.0, True, True), "w": (False, 0.0, 0.0, 0.0, False, False)}
    s = contracts.gate_summary(contracts.full_scores(cases, found, targets, allowed)).first()
    assert (s.n, s.n_ordinary, s.n_control, s.recall, s.n_passed) == (3, 1, 2, 0.5, 1)


def test_numerals_read_back():
    assert all(numeral(han_numeral(n)) == n for n in range(1, 10_000))
