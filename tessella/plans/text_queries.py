"""Cues, amounts, links, citations, blocks and case matching over the corpus, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.text import retrieval_tokens
from tessella.plans.query import Compiler
from tessella.plans.retrieval_queries import _tok
from tessella.plans.schema import class_search, question_plan, relation_paths
from tessella.plans.vocabulary import COMMERCE
from tessella.sources.tables import table


def question_cues(spark: SparkSession, folder: str) -> DataFrame:
    """Titles, fund codes and article numbers that each question names."""
    q = table(spark, folder, "questions").select("id", "question").distinct()
    found = [q.select("id", F.lit(n).alias("cue"), F.explode(F.regexp_extract_all("question", F.lit(p), F.lit(1))).alias("value")) for n, p in (("title", "《([^《》]+)》"), ("code", "(SF[0-9]{5})"), ("article", "第([一二三四五六七八九十百0-9]+)条"))]
    return found[0].union(found[1]).union(found[2]).distinct()


def amounts(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts written with a unit of ten thousand or a hundred million, as exact numbers."""
    d = table(spark, folder, "documents").where("text is not null")
    a = d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"([0-9]+(?:\.[0-9]+)?[万亿])"), F.lit(1))).alias("written")).distinct()
    factor = F.when(F.col("written").endswith("亿"), F.lit(100_000_000)).otherwise(F.lit(10_000))
    return a.select("doc_id", "written", (F.expr("substr(written, 1, length(written) - 1)").cast("decimal(18,4)") * factor).cast("decimal(28,0)").cast("string").alias("amount"))


def link_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """Sources by scheme and host, scheme and host in lower case, without a trailing slash."""
    v = table(spark, folder, "document_versions").select("version_id", "source_uri").distinct()
    uri = F.regexp_replace(F.trim("source_uri"), "/+$", "")
    return v.select(F.lower(F.regexp_extract(uri, "^([A-Za-z]+)://", 1)).alias("scheme"), F.lower(F.regexp_extract(uri, "^[A-Za-z]+://([^/]+)", 1)).alias("host")).groupBy("scheme", "host").agg(F.count("*").alias("n"))


def citation_validity(spark: SparkSession, folder: str) -> DataFrame:
    """Target articles that name a document the corpus does not hold."""
    o = table(spark, folder, "oracle_rows").select("id", F.explode("target_articles").alias("t")).select("id", F.col("t.doc_id").alias("doc_id"), F.col("t.article_number").alias("article_number")).distinct()
    return o.join(table(spark, folder, "document_versions").select(F.col("document_id").alias("doc_id")).distinct(), "doc_id", "left_anti")


def case_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a question's documents are those its oracle row allows, as sets."""
    o = table(spark, folder, "oracle_rows").select("id", "allowed_doc_ids").distinct()
    q = table(spark, folder, "questions").select("id", "doc_ids").distinct()
    as_set = lambda c: F.array_sort(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>"))))
    return o.join(q, "id").select("id", (as_set("allowed_doc_ids") == as_set("doc_ids")).alias("equal")).groupBy("equal").agg(F.count("*").alias("n"))


def block_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Valid page blocks with their places in the version's joined text; blocks follow page and index."""
    b = table(spark, folder, "review_blocks").select("block_id", "version_id", "block_index", "content").distinct()
    b = b.select("block_id", "version_id", "block_index", F.col("content.page_idx").alias("page"), F.col("content.bbox").alias("box"), F.length("content.text").alias("n"))
    fits = (F.size("box") == 4) & F.forall("box", lambda x: (x >= 0) & (x <= 1000)) & (F.element_at("box", 1) < F.element_at("box", 3)) & (F.element_at("box", 2) < F.element_at("box", 4))
    b = b.where(fits & (F.col("n") > 0))
    order = Window.partitionBy("version_id").orderBy("page", "block_index", "block_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("n") + 1).over(order), F.lit(0))
    return b.select("block_id", "version_id", start.cast("long").alias("start"), (start + F.col("n")).cast("long").alias("stop"))


def bigram_faithfulness(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks whose section title's bigrams mostly stand in their text."""
    c = table(spark, folder, "rag_chunks").select("chunk_id", "section", "text").distinct().where("section is not null and text is not null")
    c = c.select("chunk_id", F.array_distinct(retrieval_tokens(F.col("section"))).alias("a"), F.array_distinct(retrieval_tokens(F.col("text"))).alias("b")).where("size(a) > 0")
    share = F.round(F.size(F.array_intersect("a", "b")) / F.size("a"), 6)
    return c.select("chunk_id", share.alias("share"), (share >= 0.6).alias("faithful"))


def quality_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks by type, authority and status in all combinations, with subtotals."""
    c = table(spark, folder, "rag_chunks").select("chunk_id", "doc_type", "authority", "status").distinct()
    return c.cube("doc_type", "authority", "status").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def class_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Ranked classes for a few words."""
    rows = [(w, c, tier, k + 1) for w in ("order", "part", "event", "customer build", "house") for k, (c, tier) in enumerate(class_search(COMMERCE, w))]
    return spark.createDataFrame(rows, "words string, class string, tier int, rk int")


def relation_path_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Paths between some classes."""
    show = lambda p: " / ".join(("^" if h.inverse else "") + h.property for h in p)
    rows = [(a, b, k + 1, show(p)) for a, b in (("Customer", "Region"), ("Part", "Supplier"), ("Order", "Part"), ("Event", "Order")) for k, p in enumerate(relation_paths(COMMERCE, a, b))]
    return spark.createDataFrame(rows, "start string, end string, rk int, path string")


def asked_top_customers(spark: SparkSession, folder: str) -> DataFrame:
    """A question in words, planned and run."""
    return Compiler(COMMERCE, spark, folder).run(question_plan(COMMERCE, "top 10 customers by orders"))


SQL: dict[str, str] = {
    "question_cues": "with q as (select distinct id, question from questions) select distinct id, cue, value from (select id, 'title' as cue, unnest(regexp_extract_all(question, '《([^《》]+)》', 1)) as value from q union all select id, 'code', unnest(regexp_extract_all(question, '(SF[0-9]{5})', 1)) from q union all select id, 'article', unnest(regexp_extract_all(question, '第([一二三四五六七八九十百0-9]+)条', 1)) from q)",
    "amounts": "with a as (select distinct doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?[万亿]')) as written from documents where text is not null) select doc_id, written, cast(cast(cast(left(written, -1) as decimal(18,4)) * case when right(written, 1) = '亿' then 100000000 else 10000 end as decimal(28,0)) as varchar) as amount from a",
    "link_hosts": "with v as (select distinct version_id, regexp_replace(trim(source_uri), '/+$', '') as u from document_versions) select lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) as scheme, lower(regexp_extract(u, '^[A-Za-z]+://([^/]+)', 1)) as host, count(*) as n from v group by 1, 2",
    "citation_validity": "select distinct id, t.doc_id as doc_id, t.article_number as article_number from (select id, unnest(target_articles) as t from oracle_rows) where t.doc_id not in (select document_id from document_versions)",
    "case_matches": "with o as (select distinct id, allowed_doc_ids from oracle_rows), q as (select distinct id, doc_ids from questions) select list_sort(list_distinct(coalesce(allowed_doc_ids, []))) = list_sort(list_distinct(coalesce(doc_ids, []))) as equal, count(*) as n from o join q using (id) group by 1",
    "block_spans": "with b as (select distinct block_id, version_id, block_index, content.page_idx as page, content.bbox as box, length(content.text) as n from review_blocks), g as (select * from b where len(box) = 4 and list_min(box) >= 0 and list_max(box) <= 1000 and box[1] < box[3] and box[2] < box[4] and n > 0), s as (select *, coalesce(sum(n + 1) over (partition by version_id order by page, block_index, block_id rows between unbounded preceding and 1 preceding), 0) as start from g) select block_id, version_id, start::bigint as start, (start + n)::bigint as stop from s",
    "bigram_faithfulness": f"with c as (select distinct chunk_id, section, text from rag_chunks where section is not null and text is not null), t as (select chunk_id, list_distinct({_tok('section')}) as a, list_distinct({_tok('text')}) as b from c), x as (select chunk_id, round(len(list_intersect(a, b)) / len(a), 6) as share from t where len(a) > 0) select chunk_id, share, share >= 0.6 as faithful from x",
    "quality_by_source": "with c as (select distinct chunk_id, doc_type, authority, status from rag_chunks) select doc_type, authority, status, count(*) as n, grouping(doc_type, authority, status)::int as level from c group by cube (doc_type, authority, status)",
    "asked_top_customers": "select entity, value, rk from (select entity, value, row_number() over (order by value desc, entity) as rk from (select 'customer/' || c_custkey as entity, count(distinct o_orderkey) as value from customer join orders on o_custkey = c_custkey group by 1)) where rk <= 10",
}

QUERIES = {
    f.__name__: f
    for f in (question_cues, amounts, link_hosts, citation_validity, case_matches, block_spans, bigram_faithfulness, quality_by_source, class_lookup, relation_path_catalogue, asked_top_customers)
}
