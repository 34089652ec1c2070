"""Retrieval, chunks, corpus rules, evaluation and streams on small fixtures."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.text import numeral, retrieval_length, retrieval_tokens
from tessella.operators import evaluation, retrieval
from tessella.sources import corpus, markup_files
from tessella.streaming import events

TEXTS = ["Fund NAV 净值公告", "基金 净值", None, "", "净", "a净值😀b 基金管理人", "  Fund\tfund "]


def tokens(t):
    out, rest = [w.lower() for w in re.findall("[A-Za-z0-9]+", t)], re.split("[A-Za-z0-9]+", t)
    for s in rest:
        s = s.strip()
        out += [s[i : i + 2] for i in range(len(s) - 1)]
    return out


def test_tokens_and_lengths_match_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    for r in df.select("t", retrieval_tokens(F.col("t")).alias("k"), retrieval_length(F.col("t")).alias("n")).collect():
        assert (r.k is None and r.n is None) if r.t is None else sorted(r.k) == sorted(tokens(r.t)) and r.n == len(r.k)


def test_bm25_matches_python(spark):
    docs = [(i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(docs, "id int, t string")
    q = spark.createDataFrame([(100, "净值 fund"), (101, None)], "qid int, q string")
    got = {r.d: r.score for r in retrieval.bm25(q, df, "qid", "q", "id", "t", 10).collect()}
    bag = {i: tokens(t) for i, t in docs if t and tokens(t)}
    n, avg = len(bag), sum(map(len, bag.values())) / len(bag)
    want = {}
    for i, b in bag.items():
        s = 0.0
        for w in set(tokens("净值 fund")):
            f = sum(w in x for x in bag.values())
            if w in b:
                s += math.log(1 + (n - f + 0.5) / (f + 0.5)) * b.count(w) * 2.5 / (b.count(w) + 1.5 * (0.25 + 0.75 * len(b) / avg))
        if s:
            want[i] = round(s, 6)
    assert got == pytest.approx(want)


def test_dense_blocks_match_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(40)] + [(90, None), (91, [0.0] * 5)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(r.q, r.rk): r.d for r in retrieval.dense(df.where("id < 4"), df, "id", "v", "id", "v", 3, block=7).collect()}
    m = np.array([v for _, v in rows[:40]])
    m /= np.linalg.norm(m, axis=1)[:, None]
    for q in range(4):
        best = np.argsort(-np.round(m[q] @ m.T, 6), kind="stable")[:3]
        assert [got[q, k + 1] for k in range(3)] == best.tolist()


def test_children_cover_the_text():
    t = "甲乙丙。" * 200
    parts = retrieval.children(t)
    assert "".join(parts) == t and all(len(p) <= 240 for p in parts) and all(p.endswith("。") for p in parts[:-1])


def test_numerals():
    assert [numeral(x) for x in ("十", "十二", "一百零三", "二十", "两百", "三千零五", "12", "二〇二四", "", "abc")] == [10, 12, 103, 20, 200, 3005, 12, 2024, None, None]


def test_html_body_and_headings():
    assert markup_files.body_lines("<div><p>a  b</p><script>x</script>c<br>d</div>") == ["a b", "c", "d"]
    assert markup_files.body_lines("<div>a</div><div>b</div>") is None
    assert markup_files.headings("x\n第一章 总则\ny\n第十二节 附则") == [(2, 11, "章", 1, "总则"), (11, 18, "节", 12, "附则")]


def test_import_is_idempotent_and_all_or_nothing(spark, tmp_path):
    cols = "version_id string, document_id string, title string, publisher string, source_uri string, sha256 string, issued_date string, status string, authority string"
    good = ("v1", "d1", "t", "p", "corpus://x", "a" * 64, "2020-01-01", "verified", "synthetic")
    path = str(tmp_path / "store")
    df = spark.createDataFrame([good], cols)
    assert corpus.import_manifest(df, path, "a") == "completed" and corpus.import_manifest(df, path, "b") == "completed"
    bad = spark.createDataFrame([("v2", "d2", None, *good[3:5], "b" * 64, *good[6:]), ("v3", "d3", "t", *good[3:5], "c" * 64, *good[6:])], cols)
    assert corpus.import_manifest(bad, path, "c") == "failed" and corpus.import_manifest(bad.limit(0), path, "d") == "failed"
    assert corpus.stored(spark, path).count() == 1
    runs = {r.run: (r.status, r.n_rows, r.n_errors, r.n_inserted, r.n_reused) for r in spark.read.parquet(f"{path}/runs").collect()}
    assert runs == {"a": ("completed", 1, 0, 1, 0), "b": ("completed", 1, 0, 0, 1), "c": ("failed", 2, 1, 0, 0), "d": ("failed", 0, 0, 0, 0)}


def test_snapshots_are_for_good(spark, tmp_path):
    from pyspark.sql import functions as F

    v = spark.createDataFrame([("d1", "v1", "authoritative_original", "verified", "2020-01-01"), ("d1", "v2", "authoritative_original", "verified", "2021-01-01"), ("d2", "v3", "synthetic", "unverified", None)], "document_id string, version_id string, authority string, status string, issued string")
    v = v.withColumn("issued", F.col("issued").cast("date"))
    pick = lambda *ids: v.where(F.col("version_id").isin(*ids)).select("document_id", "version_id")
    path = str(tmp_path)
    for _ in range(2):
        assert corpus.publish(pick("v1"), v, "trusted", "s", path).count() == 1
    with pytest.raises(ValueError, match="another membership"):
        corpus.publish(pick("v2"), v, "trusted", "s", path)
    with pytest.raises(ValueError, match="kind"):
        corpus.published(pick("v3"), v, "trusted")
    with pytest.raises(ValueError, match="second version"):
        corpus.published(pick("v1", "v2"), v, "trusted")
    with pytest.raises(ValueError, match="member"):
        corpus.published(pick("zz"), v, "regression")


def test_articles_and_body_sections():
    t = "序言\n第一章 总则\n第一条 甲。\n乙。\n\n第二条\u3000丙。\n第二章 附则\n第三条 丁。\n"
    got = markup_files.articles(t, 3)
    assert [(t[a:b], n, c) for a, b, n, c in got] == [("第一条 甲。\n乙。", 1, "第一章 总则"), ("第二条\u3000丙。", 2, "第一章 总则"), ("第三条 丁。", 3, "第二章 附则")]
    for bad in ("第二条 甲", "第一条 甲\n第三条 乙", "没有"):
        with pytest.raises(markup_files.SectionError):
            markup_files.articles(bad)
    m = "# 标题\n来源\n## 第一章 总则\n### 第一条 甲。\n说明在此。\n### 第二条 乙。\n附件：\n表格\n"
    got = markup_files.body_sections(m, 3, 2)
    assert [(m[a:b], h) for a, b, h in got] == [("### 第一条 甲。\n说明在此。", "第1条"), ("### 第二条 乙。\n", "第2条"), ("附件：\n表格", "supplementary_body")]
    assert [h for _, _, h in markup_files.body_sections("x\n# A\na\n# B\nb", 1, None)] == ["document", "A", "B"]
    with pytest.raises(markup_files.SectionError):
        markup_files.body_sections("a", 2, None)


def test_covered_length_counts_overlaps_once(spark):
    s = spark.createDataFrame([("a", 0, 5), ("a", 3, 8), ("a", 4, 6), ("a", 10, 99), ("b", 50, 60)], "k string, a int, b int")
    got = {r.k: r.covered for r in evaluation.covered_length(s, "k", "a", "b", F.lit(1), F.lit(20)).collect()}
    assert got == {"a": 17}


def test_stream_equals_batch(spark, folder):
    batch = events.windowed_counts(spark.read.parquet(f"{folder}/events.parquet"), "ts", "event_type", "value")
    stream = events.run_to_end(events.windowed_counts(events.event_stream(spark, folder), "ts", "event_type", "value"), "t")
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, stream.collect()))


def test_every_registered_query_with_sql_has_both_sides(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
