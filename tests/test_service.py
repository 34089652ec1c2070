"""Router, anchors, schema retrieval, engine and streams."""

import pandas as pd
import pytest

from tessella import service
from tessella.plans.query import Hop
from tessella.plans.schema import anchored_plan, question_plan, retrieved_schema
from tessella.plans.vocabulary import COMMERCE as V
from tessella.streaming import events


def test_turns_of_questions():
    p = question_plan(V, "nations by the average balance of their customers")
    assert p.aggregate.fn == "avg" and p.aggregate.measure == "balance" and p.target == "Nation"
    assert question_plan(V, "customers and their latest orders").latest == "orderDate"
    assert question_plan(V, "how many events").count and question_plan(V, "good morning") is None


def test_anchors():
    assert anchored_plan(V, ("nation", 3), "Order").traversal[0] == Hop("locatedIn", inverse=True)
    p = anchored_plan(V, ("nation", 3), "Nation")
    assert p.exclude == (("nation", 3),) and len(p.traversal) == 2
    assert anchored_plan(V, ("nation", 3), "Nothing") is None


def test_schema_retrieval_keeps_what_is_required():
    got = retrieved_schema(V, "orders placed by building customers", 600)
    assert ("class", "BuildingCustomer", True) in got and ("property", "placedBy", True) in got
    with pytest.raises(ValueError, match="required"):
        retrieved_schema(V, "orders placed by building customers", 10)
    assert retrieved_schema(V, "", 100) == []


def test_engine_calls_back_and_lets_itself_be_overridden(spark, folder):
    phases, texts = [], []
    e = service.Engine(spark, folder, on_phase=lambda n, _: phases.append(n), on_text=texts.append)
    a = e.ask("how many suppliers")
    assert a.status == "answered" and phases == list(service.PHASES) and len(texts) == 1
    assert e.ask("good morning").status == "unresolved"
    e.handlers.append(lambda q: service.Answer("answered", text="own") if "own" in q else None)
    assert e.ask("own suppliers").text == "own"


def test_transformed_queries():
    r = service.Resources(transform=lambda q, m: f"{m} {q}")
    assert service.transformed("x", "identity", r) == {"sparse": "x", "dense": "x"}
    assert service.transformed("x", "rewrite", r) == {"sparse": "rewrite x", "dense": "rewrite x"}
    assert service.transformed("x", "hyde", r) == {"sparse": "x", "dense": "hyde x"}
    for mode, res in (("rewrite", service.Resources()), ("other", r), ("rewrite", service.Resources(transform=lambda q, m: " "))):
        with pytest.raises(ValueError):
            service.transformed("x", mode, res)


def test_first_of_each_holds_over_batches(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    schema = "id string, k string, at long"
    got = []
    for n, rows in enumerate([[("a", "x", 2), ("b", "x", 1), ("c", None, 1)], [("d", "x", 0), ("e", "y", 5)]]):
        pd.DataFrame(rows, columns=["id", "k", "at"]).to_parquet(source / f"{n}.parquet")
        s = events.first_of_each(spark.readStream.schema(schema).parquet(str(source)), "k", ["at", "id"], ["id", "k"])
        s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        got = {r.id: r.accepted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": False, "b": True, "c": False, "d": False, "e": True}


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    pd.DataFrame({"k": [1, 2, 2, None], "v": ["a", "b", "b", "c"]}).astype({"k": "Int64"}).to_parquet(source / "0.parquet")
    stream = lambda: spark.readStream.schema("k long, v string").parquet(str(source))
    for state in ("s1", "s1", "s2"):
        events.import_stream(stream(), str(tmp_path / "store"), "k", str(tmp_path / state))
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "store")).collect()) == [1, 2]


def test_increments_equal_the_whole(spark, tmp_path):
    a = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "s long, m long")
    b = spark.createDataFrame([(10, 100), (11, 101), (11, 100)], "m long, o long")
    for n, (x, y) in enumerate([(a.where("s = 1"), b.where("m = 10")), (a.where("s > 1"), b.limit(0)), (a.limit(0), b)]):
        events.chain_increment(str(tmp_path), x, y, n)
        events.chain_increment(str(tmp_path), x, y, n)
    got = [(r.s, r.o) for r in spark.read.parquet(str(tmp_path / "pairs")).collect()]
    assert sorted(got) == [(1, 100), (2, 100), (3, 100), (3, 101)]
