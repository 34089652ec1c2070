"""Evaluation contracts, resources, file sources, expressions and plans."""

import pandas as pd
import pytest

from tessella.operators import contracts, inference, retrieval
from tessella.plans import graph_queries
from tessella.plans import query
from tessella.plans.query import Aggregate, Compiler, Hop, Plan
from tessella.plans.vocabulary import COMMERCE
from tessella.sources import files


def test_typed_equal():
    assert contracts.typed_equal(1, 1.0) and not contracts.typed_equal(1, True) and contracts.typed_equal([1, {"a": 2.0}], [1.0, {"a": 2}])
    assert not contracts.typed_equal("1", 1) and not contracts.typed_equal({"a": 1}, {"b": 1}) and contracts.typed_equal(None, None)


def test_phrases():
    assert contracts.phrase_check("保证收益 #a1 #b2", {"a1"}, ("保证收益",)) == ["phrase 保证收益", "id b2"]


def test_suite_outcomes(spark):
    def adapter(case):
        if case["x"] == 0:
            raise ValueError("zero")
        return case["x"] * 2

    df = spark.createDataFrame([("a", 1, 2), ("b", 1, 3), ("c", 0, 0), ("d", 5, 10), (None, 1, 2)], "id string, x long, want long")
    got = {(r.id, r.outcome) for r in contracts.run_suite(df, ["x"], adapter, "want", skip=df.id == "d").collect()}
    assert got == {("a", "pass"), ("b", "fail"), ("c", "error"), ("d", "skip"), (None, "not_run")}
    late = contracts.run_suite(df.where("id = 'a'"), ["x"], lambda c: __import__("time").sleep(0.05) or 2, "want", seconds=0.01)
    assert late.first().outcome == "timeout"


@pytest.mark.parametrize("scores", [[(0, 1.0)], [(0, 1.0), (0, 2.0)], [(0, 1.0), (1, float("nan"))], [(0, 1.0), (1, True)], [(0, 1.0), (2, 1.0)]])
def test_reranker_contract(scores):
    with pytest.raises(contracts.ResourceError):
        contracts.checked_scores(scores, 2)


def test_embeddings_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def model(texts):
        made.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None)], "k long, t string")
    path = str(tmp_path / "cache")
    for _ in range(2):
        got = {r.k: list(r.vector) for r in contracts.embedded(df, "k", "t", model, "m1", path).collect()}
        assert got == {1: [1.0, 1.0], 2: [2.0, 1.0], 3: [1.0, 1.0]}
    assert made.value == 2
    for bad in ([[0.0, 0.0]], [[float("inf")]], [[1.0], [1.0, 2.0]]):
        with pytest.raises(contracts.ResourceError):
            contracts.checked_vectors(bad, len(bad))


def test_bm25_pruning_equals_brute_force():
    import math
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    docs = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(60)], k=rng.randint(3, 30))) for _ in range(300)]
    units = pd.DataFrame({"d": range(300), **retrieval._counted(docs)})
    df = {w: sum(w in d.split() for d in docs) for w in words}
    avgdl = sum(len(d.split()) for d in docs) / 300
    for k in (1, 5, 20):
        for _ in range(20):
            asked = sorted(set(rng.choices(words, k=5)))
            codes = {w: int(retrieval.token_codes(w)[0]) for w in asked}
            idf = {w: math.log(1 + (300 - df[w] + 0.5) / (df[w] + 0.5)) for w in asked}
            import numpy as np

            cell = retrieval.Cell(units, np.unique(list(codes.values())), avgdl)
            ids, scores = cell.best(np.array([codes[w] for w in asked]), np.array([idf[w] for w in asked]), k)
            want = []
            for i, d in enumerate(docs):
                t = d.split()
                s = sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for w in asked)
                if s > 0:
                    want.append((-round(s, 6), i))
            assert [(i, round(float(s), 5)) for i, s in zip(ids.tolist(), scores)] == [(i, round(-s, 5)) for s, i in sorted(want)[:k]]


def test_turtle_with_imports():
    texts = {
        "urn:a": '@prefix o: <http://www.w3.org/2002/07/owl#> . <urn:a> o:imports <urn:b> , <urn:gone> . # note',
        "urn:b": '@prefix o: <http://www.w3.org/2002/07/owl#> . @prefix e: <urn:e#> . <urn:b> o:imports <urn:a> . e:x a e:C ; e:p "say \\"no\\""@en , 3.5 ; e:l ( e:y ) .',
    }
    triples, hashes = files.loaded(texts, "urn:a")
    assert set(hashes) == {"urn:a", "urn:b"} and ("urn:e#x", "urn:e#p", 'say "no"') in triples and ("urn:e#x", "urn:e#p", "3.5") in triples
    assert sum(p == files.RDF_FIRST for _, p, _ in triples) == 1
    for bad in ("e:a e:b e:c .", "<urn:a> <urn:b> <urn:c>", "<urn:a> ."[:-2] + " <urn:b>"):
        with pytest.raises(ValueError):
            files.turtle(bad)


def test_text_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("正文".encode())
    (tmp_path / "b.md").write_bytes(b"\xff\xfe")
    (tmp_path / "c.md").write_bytes(b"  ")
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in files.text_files(spark, str(tmp_path), "*.md").collect()}
    assert got == {"a.md": ("正文", None), "b.md": (None, "not utf-8"), "c.md": (None, "empty")}


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n  \n{"a": 2}\n')
    assert sorted(r.a for r in files.json_lines(spark, str(tmp_path), "a long").collect()) == [1, 2]
    assert files.json_lines(spark, str(tmp_path / "none"), "a long").count() == 0


def test_selected_html(spark):
    rows = [(1, '<p>x</p><div class="a main">y<table><tr><td>1</td></tr></table></div>'), (2, "<div class='main'>a</div><div class='main'>b</div>"), (3, "<p>a</p>"), (4, "<div class='main'><p>a</div>"), (5, None)]
    got = {r.k: (r.body, r.error) for r in files.selected_html(spark.createDataFrame(rows, "k long, t string"), "k", "t", "div.main").collect()}
    assert got == {1: ("y<table><tr><td>1</td></tr></table>", None), 2: (None, "several"), 3: (None, "none"), 4: (None, "unbalanced")}


def test_stale_vectors(spark, tmp_path):
    src = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    vec = spark.createDataFrame([(1, [1.0])], "id long, v array<double>")
    files.write_vectors(vec, str(tmp_path), src, "m")
    assert files.read_vectors(spark, str(tmp_path), src.orderBy("text", ascending=False), "m").count() == 1
    for other, model in ((src.limit(1), "m"), (src, "n")):
        with pytest.raises(ValueError):
            files.read_vectors(spark, str(tmp_path), other, model)


@pytest.mark.parametrize("text", ["A", "A and not B", "p some (A or B)", "p exactly 1 A and q max 2", "p self or p only A", "not (A and B)"])
def test_expressions_read_back(text):
    tree = inference.expression(text)
    assert inference.expression(inference.render(tree)) == tree


def test_broken_expressions():
    for bad in ("", "A and", "(A", "p some", "A B", "p min x A"):
        with pytest.raises(ValueError):
            inference.expression(bad)


def scans_of(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


@pytest.mark.parametrize("name, scans", [("filter_in_codes", 1), ("filter_numeric_range", 1), ("date_range_target", 1), ("path_forward", 1), ("filter_eq_iri", 1), ("optional_projection_order", 1), ("where_and_or_not", 2), ("agg_count_having", 2)])
def test_own_columns_are_filters_of_one_scan(spark, folder, name, scans):
    plan = graph_queries.QUERIES[name](spark, folder)
    assert scans_of(plan) == scans


def test_distinct_average(spark, folder):
    c = Compiler(COMMERCE, spark, folder)
    run = lambda d: {r.entity: r.value for r in c.run(Plan("Nation", related=(Hop("locatedIn", inverse=True),), aggregate=Aggregate("avg", "balance", distinct=d))).collect()}
    customers = pd.read_parquet(f"{folder}/customer.parquet")
    for k, g in customers.groupby("c_nationkey"):
        values = g.c_acctbal.astype(float).round(2)
        assert run(True)[f"nation/{k}"] == pytest.approx(values.drop_duplicates().mean(), abs=1e-3)
        break


def test_order_without_limit_is_not_ranked(spark, folder):
    out = Compiler(COMMERCE, spark, folder).run(Plan("Part", tests=(query.Test("partSize", ">", 10),), project={"price": ((), "retailPrice")}, order=("price", True)))
    assert "rk" not in out.columns and "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
