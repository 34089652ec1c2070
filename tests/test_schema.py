"""Paths, search, resolution, slices and questions over the schema."""

import pytest

from tessella.plans.query import Aggregate, Compiler, Hop, Plan
from tessella.plans.schema import best_path, class_search, question_plan, recovered, relation_paths, resolve, slice_for
from tessella.plans.vocabulary import COMMERCE as V


def test_paths_are_bounded_and_shortest_first():
    paths = relation_paths(V, "Customer", "Region")
    assert paths[0] == (Hop("locatedIn"), Hop("inRegion")) and all(len(p) <= 3 for p in paths) and len(paths) <= 12
    assert relation_paths(V, "Region", "Part") == []


def test_best_path_and_questions():
    assert best_path(V, "orders placed by customers", "Customer", "Order") == (Hop("placedBy", inverse=True),)
    assert question_plan(V, "How many suppliers are there?") == Plan("Supplier", count=True)
    p = question_plan(V, "customers with at least 3 filled orders")
    assert p.related[-1].cls == "FilledOrder" and p.aggregate == Aggregate("count", having=(">=", 3))
    assert question_plan(V, "what is the weather") is None


def test_search_and_resolution():
    assert class_search(V, "order")[0] == ("Order", 0)
    assert {c for c, _ in class_search(V, "part")} >= {"Part", "PromoPart"}
    assert class_search(V, "") == []
    assert resolve(V, "promo part") == ("class", "PromoPart") and resolve(V, "placedBy") == ("property", "placedBy") and resolve(V, "nothing") is None


def test_slice_keeps_what_is_required():
    plan = Plan("Customer", related=(Hop("hasOrder"),))
    got = slice_for(V, plan)
    assert got[0] == "Customer < Party" and "hasOrder: Customer -> Order" in got
    with pytest.raises(ValueError, match="required"):
        slice_for(V, plan, budget=10)


def test_an_empty_anchored_query_takes_another_path(spark, folder):
    c = Compiler(V, spark, folder)
    plan = Plan("Customer", anchor=("nation", 3), traversal=(Hop("suppliedFrom", inverse=True), Hop("suppliedFrom"), Hop("locatedIn", inverse=True, key=-1)))
    other, rows = recovered(c, plan)
    assert other.traversal == (Hop("locatedIn", inverse=True),) and rows.count() > 0
