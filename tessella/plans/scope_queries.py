"""Scopes, mentions, locators, budgets and invariants, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.plans import retrieval_queries as r
from tessella.plans.vocabulary import COMMERCE as V
from tessella.sources.tables import table


def plain_name(name: Column) -> Column:
    """A title without its marks and without year or edition notes at its end, however many follow each other."""
    bare = F.regexp_replace(name, "[《》\\s]", "")
    return F.regexp_replace(bare, "(?:（[^（）]*）|\\([^()]*\\)|第[一二三四五六七八九十0-9]+[版期])+$", "")


def scope_union(spark: SparkSession, folder: str) -> DataFrame:
    """Nations that have to do with a part: where its suppliers are, and where those who ordered it are."""
    # A line's key holds its part, supplier and order, so these are read side by side instead of joined by the key.
    lines = table(spark, folder, "lineitem").where("l_partkey is not null")
    supplier = lines.select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("x")).distinct()
    one = supplier.join(V.edges(spark, folder, "suppliedFrom").select(F.col("s").alias("x"), F.col("o").alias("nation")), "x").select("part", "nation")
    order = lines.select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("x")).distinct()
    buyer = V.edges(spark, folder, "placedBy").select(F.col("s").alias("x"), F.col("o").alias("c"))
    two = order.join(buyer, "x").join(V.edges(spark, folder, "locatedIn").select(F.col("s").alias("c"), F.col("o").alias("nation")), "c").select("part", "nation")
    return reduce(lambda a, b: a.union(b), [one, two]).distinct()


def title_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that a question names by title: plain names meet as equals, so no text is searched in another."""
    q = table(spark, folder, "questions").select("id", F.explode(F.regexp_extract_all("question", F.lit("《([^《》]+)》"), F.lit(1))).alias("t")).select("id", plain_name(F.col("t")).alias("name")).distinct()
    d = table(spark, folder, "document_versions").where("title is not null").select("document_id", plain_name(F.col("title")).alias("name")).where("name <> ''").distinct()
    return q.join(d, "name").select("id", "document_id", "name")


def chunk_locators(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that can be shown where they stand: a page and an ordinal, a section, and no draft."""
    c = table(spark, folder, "rag_chunks").select("chunk_id", "version_id", "section", "status", "locator_json").distinct()
    at = lambda p: F.get_json_object("locator_json", p).try_cast("int")
    c = c.withColumns({"page": at("$.page"), "ordinal": at("$.ordinal")})
    return c.where("page > 0 and ordinal >= 0 and section is not null and status = 'verified'").select("chunk_id", "version_id", "page", "ordinal")


def evidence_budget(spark: SparkSession, folder: str) -> DataFrame:
    """The found documents of every query with what fits into a budget of characters, in rank order."""
    size = table(spark, folder, "documents").select(F.col("doc_id").alias("d"), "n_chars")
    before = Window.partitionBy("q").orderBy("rk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = r.bm25_topk(spark, folder).join(size, "d").withColumn("used", F.sum("n_chars").over(before))
    return found.select("q", "d", "rk", "used", (F.col("used") <= 4000).alias("within"))


def window_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Windows that break their rule: too long, not covering, or not sharing what they should. None is right."""
    c = r.chunk_windows(spark, folder)
    n = table(spark, folder, "documents").select("doc_id", F.length("text").alias("n"))
    w = Window.partitionBy("doc_id").orderBy("chunk_no")
    c = c.join(n, "doc_id").withColumns({"next": F.lead("start").over(w)})
    bad = (F.col("stop") - F.col("start") > 400) | (F.col("next").isNotNull() & (F.col("stop") - F.col("next") != 80)) | (F.col("next").isNull() & (F.col("stop") != F.col("n")))
    return c.agg(F.count("*").alias("n_windows"), F.sum(bad.cast("int")).cast("long").alias("n_broken"))


def best_labels(spark: SparkSession, folder: str) -> DataFrame:
    """One label a document: its longest current title, else its publisher, else its own id."""
    v = table(spark, folder, "document_versions").select("document_id", "title", "publisher").distinct()
    best = lambda c: F.max(F.struct(F.length(c).alias("n"), F.col(c).alias("v")))["v"]
    return v.groupBy("document_id").agg(F.coalesce(best("title"), best("publisher"), F.first("document_id")).alias("label"))


_PLAIN = "regexp_replace(regexp_replace({}, '[《》\\s]', '', 'g'), '(?:（[^（）]*）|\\([^()]*\\)|第[一二三四五六七八九十0-9]+[版期])+$', '')"
SQL: dict[str, str] = {
    "scope_union": "select distinct l_partkey as part, s_nationkey as nation from lineitem join supplier on l_suppkey = s_suppkey union select l_partkey, c_nationkey from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey",
    "title_mentions": f"with q as (select distinct id, {_PLAIN.format('t')} as name from (select id, unnest(regexp_extract_all(question, '《([^《》]+)》', 1)) as t from questions)), d as (select distinct document_id, {_PLAIN.format('title')} as name from document_versions where title is not null) select id, document_id, name from q join d using (name) where name <> ''",
    "chunk_locators": "with c as (select distinct chunk_id, version_id, section, status, locator_json from rag_chunks), x as (select *, try_cast(json_extract_string(locator_json, '$.page') as int) as page, try_cast(json_extract_string(locator_json, '$.ordinal') as int) as ordinal from c) select chunk_id, version_id, page, ordinal from x where page > 0 and ordinal >= 0 and section is not null and status = 'verified'",
    "evidence_budget": f"select q, d, rk, used, used <= 4000 as within from (select q, d, rk, sum(n_chars) over (partition by q order by rk rows unbounded preceding)::bigint as used from ({r.SQL['bm25_topk']}) join documents on d = doc_id)",
    "window_invariants": f"with c as ({r.SQL['chunk_windows']}), w as (select c.*, length(d.text) as n, lead(c.start) over (partition by c.doc_id order by c.chunk_no) as after from c join documents d using (doc_id)) select count(*) as n_windows, sum((stop - start > 400 or (after is not null and stop - after <> 80) or (after is null and stop <> n))::int)::bigint as n_broken from w",
    "best_labels": "with v as (select distinct document_id, title, publisher from document_versions) select document_id, coalesce(arg_max(title, (length(title), title)), arg_max(publisher, (length(publisher), publisher)), document_id) as label from v group by document_id",
}

QUERIES = {f.__name__: f for f in (scope_union, title_mentions, chunk_locators, evidence_budget, window_invariants, best_labels)}
