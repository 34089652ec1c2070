"""The shape table over versions, chunks, receipts and orders, record enforcement, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.dates import day
from tessella.operators.shapes import Constraint as C
from tessella.operators.shapes import Shape, report, violations
from tessella.plans.asof_queries import _sql_day
from tessella.plans.ontology_queries import _accepted, _receipts
from tessella.sources.tables import table

SHAPES = {
    "Version": Shape("Version", "version_id", (
        C("title", "min_count", 1), C("publisher", "min_count", 1), C("sha256", "pattern", "^[0-9a-f]{64}$"), C("issued_date", "datatype", "date"), C("effective_from", "datatype", "date"), C("title", "max_length", 20),
        C("status", "in", ("verified", "unverified", "quarantined")), C("fund_code", "either", ("report_period", "issued_date")), C("i", "not_after", "f"), C("f", "not_after", "w"),
        C("status", "implies", ("status = 'verified'", "license is not null")), C("supersedes", "not_itself", "version_id"), C("supersedes", "class", "versions"), C("title", "unique", ("issued_date",)), C("document_id", "no_overlap", ("f", "w")),
    )),
    "Chunk": Shape("Chunk", "chunk_id", (C("text", "min_count", 1), C("section", "min_count", 1), C("text", "max_length", 1200), C("page", "min_inclusive", 1), C("version_id", "class", "versions"), C("version_id", "class", "extracted"), C("version_id", "forbidden", "quarantined"))),
    "Receipt": Shape("Receipt", "id", (C("http_status", "in", (200, 206)), C("byte_count", "min_inclusive", 1), C("pdf_pages", "min_count", 1), C("content_type", "pattern", "^application/(pdf|octet-stream)$"), C("version_id", "class", "versions"), C("sha256", "unique", ()))),
    "Question": Shape("Question", "id", (C("doc_ids", "min_count", 1), C("doc_ids", "max_count", 3), C("as_of", "datatype", "date"), C("question", "max_length", 200))),
    "Order": Shape("Order", "o_orderkey", (C("o_totalprice", "min_inclusive", 1000.0), C("o_custkey", "class", "customers"), C("o_orderpriority", "pattern", "^[1-5]-[A-Z ]+$"))),
}


def _frames(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    v = table(spark, folder, "document_versions").drop("acquired_at").distinct().withColumns({"i": day(F.col("issued_date")), "f": day(F.col("effective_from")), "w": day(F.col("withdrawn_date"))})
    frames = {
        "Version": v,
        "Chunk": table(spark, folder, "rag_chunks").drop("indexed_at").distinct().withColumn("page", F.get_json_object("locator_json", "$.page").try_cast("int")),
        "Receipt": table(spark, folder, "receipts").select("id", "version_id", "http_status", "content_type", "byte_count", "sha256", "pdf_pages").distinct(),
        "Question": table(spark, folder, "questions").select("id", "question", "as_of", "doc_ids").distinct(),
        "Order": table(spark, folder, "orders"),
    }
    ids = lambda d, c: d.select(F.col(c).alias("id"))
    classes = {
        "versions": ids(v, "version_id"), "quarantined": ids(v.where("status = 'quarantined'"), "version_id"),
        "extracted": ids(table(spark, folder, "document_extractions"), "version_id"), "customers": ids(table(spark, folder, "customer"), "c_custkey"),
    }
    return frames, classes


def _all(spark: SparkSession, folder: str) -> DataFrame:
    frames, classes = _frames(spark, folder)
    return reduce(lambda a, b: a.unionByName(b), [violations(s, frames[n], classes) for n, s in SHAPES.items()])


def shape_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Every violation of every shape. A path checked for two classes shows twice, as its constraints do."""
    return _all(spark, folder)


def shape_report(spark: SparkSession, folder: str) -> DataFrame:
    """Violations of versions, questions and orders counted for each constraint, also where there are none."""
    frames, classes = _frames(spark, folder)
    some = ["Version", "Question", "Order"]
    return report(reduce(lambda a, b: a.unionByName(b), [violations(SHAPES[n], frames[n], classes) for n in some]), [SHAPES[n] for n in some])


def enforced_triples(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted receipts as triples: their type and each of their values, absent ones left out."""
    d = _accepted(_receipts(spark, folder))
    pair = lambda p, v: F.struct(F.lit(p).alias("p"), v.cast("string").alias("o"))
    facts = F.array(pair("type", F.lit("Receipt")), pair("ofVersion", F.concat(F.lit("version/"), "version_id")), pair("byteCount", F.col("byte_count")), pair("sha256", F.col("sha256")), pair("contentType", F.col("content_type")))
    return d.select(F.concat(F.lit("receipt/"), "id").alias("s"), F.inline(facts)).where("o is not null")


_V = f"v as (select distinct * exclude (acquired_at), {_sql_day('issued_date')} as i, {_sql_day('effective_from')} as f, {_sql_day('withdrawn_date')} as w from document_versions)"
_CH = "ch as (select distinct chunk_id, version_id, section, text, try_cast(json_extract_string(locator_json, '$.page') as int) as page from rag_chunks)"
_RE = "re as (select distinct id, version_id, http_status, content_type, byte_count, sha256, pdf_pages from receipts)"
_QU = "qu as (select distinct id, question, as_of, doc_ids from questions)"
_NO_DAY = "({0} is not null and (not regexp_full_match({0}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') or try_cast({0} as date) is null))"


def _v(path: str, kind: str, where: str, shape: str = "Version", focus: str = "version_id", source: str = "v") -> str:
    return f"select '{shape}' as shape, {focus}::varchar as focus, '{path}' as path, '{kind}' as kind from {source} where {where}"


_VERSION_SQL = [
    _v("title", "min_count", "title is null"), _v("publisher", "min_count", "publisher is null"), _v("sha256", "pattern", "not regexp_full_match(sha256, '[0-9a-f]{64}')"), _v("issued_date", "datatype", _NO_DAY.format("issued_date")),
    _v("effective_from", "datatype", _NO_DAY.format("effective_from")), _v("title", "max_length", "length(title) > 20"), _v("status", "in", "status not in ('verified', 'unverified', 'quarantined')"), _v("fund_code", "either", "fund_code is null and report_period is null and issued_date is null"),
    _v("i", "not_after", "i > f"), _v("f", "not_after", "f > w"), _v("status", "implies", "status = 'verified' and license is null"), _v("supersedes", "not_itself", "supersedes = version_id"),
    _v("supersedes", "class", "supersedes is not null and supersedes not in (select version_id from v)"),
    _v("title", "unique", "(title, issued_date) in (select (title, issued_date) from v where title is not null and issued_date is not null group by title, issued_date having count(distinct version_id) > 1)"),
    _v("document_id", "no_overlap", "u > f", source="(select *, max(coalesce(w, date '9999-12-31')) over (partition by document_id order by f, version_id rows between unbounded preceding and 1 preceding) as u from v where f is not null)"),
]
_QUESTION_SQL = [
    _v("doc_ids", "min_count", "coalesce(len(list_filter(doc_ids, lambda x: x is not null)), 0) < 1", "Question", "id", "qu"), _v("doc_ids", "max_count", "len(doc_ids) > 3", "Question", "id", "qu"), _v("as_of", "datatype", _NO_DAY.format("as_of"), "Question", "id", "qu"), _v("question", "max_length", "length(question) > 200", "Question", "id", "qu"),
]
_ORDER_SQL = [
    _v("o_totalprice", "min_inclusive", "o_totalprice < 1000", "Order", "o_orderkey", "orders"), _v("o_custkey", "class", "o_custkey not in (select c_custkey from customer)", "Order", "o_orderkey", "orders"), _v("o_orderpriority", "pattern", "not regexp_full_match(o_orderpriority, '[1-5]-[A-Z ]+')", "Order", "o_orderkey", "orders"),
]
_OTHER_SQL = [
    _v("text", "min_count", "text is null", "Chunk", "chunk_id", "ch"), _v("section", "min_count", "section is null", "Chunk", "chunk_id", "ch"), _v("text", "max_length", "length(text) > 1200", "Chunk", "chunk_id", "ch"), _v("page", "min_inclusive", "page < 1", "Chunk", "chunk_id", "ch"),
    _v("version_id", "class", "version_id not in (select version_id from v)", "Chunk", "chunk_id", "ch"), _v("version_id", "class", "version_id not in (select version_id from document_extractions)", "Chunk", "chunk_id", "ch"), _v("version_id", "forbidden", "version_id in (select version_id from v where status = 'quarantined')", "Chunk", "chunk_id", "ch"),
    _v("http_status", "in", "http_status not in (200, 206)", "Receipt", "id", "re"), _v("byte_count", "min_inclusive", "byte_count < 1", "Receipt", "id", "re"), _v("pdf_pages", "min_count", "pdf_pages is null", "Receipt", "id", "re"), _v("content_type", "pattern", "not regexp_full_match(content_type, 'application/(pdf|octet-stream)')", "Receipt", "id", "re"),
    _v("version_id", "class", "version_id not in (select version_id from v)", "Receipt", "id", "re"), _v("sha256", "unique", "sha256 in (select sha256 from re where sha256 is not null group by sha256 having count(distinct id) > 1)", "Receipt", "id", "re"),
]
_WITH = f"with {_V}, {_CH}, {_RE}, {_QU}"
_LISTED = ", ".join(f"('{s.name}', '{c.path}', '{c.kind}')" for n, s in SHAPES.items() if n in ("Version", "Question", "Order") for c in s.constraints)
_RECORDS = """
r as (select * from (select *, row_number() over (partition by id order by fetched_at) as k from receipts) where k = 1),
g as (select *, row_number() over (partition by version_id order by fetched_at, id) as n from r where http_status = 200 and content_type = 'application/pdf' and byte_count > 0 and regexp_full_match(sha256, '[0-9a-f]{64}'))
"""
SQL = {
    "shape_violations": f"{_WITH} {' union all '.join(_VERSION_SQL + _QUESTION_SQL + _ORDER_SQL + _OTHER_SQL)}",
    "shape_report": f"{_WITH}, x as ({' union all '.join(_VERSION_SQL + _QUESTION_SQL + _ORDER_SQL)}), l(shape, path, kind) as (values {_LISTED}) select l.shape, l.path, l.kind, count(x.focus) as n from l left join x using (shape, path, kind) group by all",
    "enforced_triples": f"with {_RECORDS}, a as (select 'receipt/' || id as s, unnest([{{'p': 'type', 'o': 'Receipt'}}, {{'p': 'ofVersion', 'o': 'version/' || version_id}}, {{'p': 'byteCount', 'o': byte_count::varchar}}, {{'p': 'sha256', 'o': sha256}}, {{'p': 'contentType', 'o': content_type}}]) as x from g where n = 1) select s, x.p as p, x.o as o from a where x.o is not null",
}
QUERIES = {f.__name__: f for f in (shape_violations, shape_report, enforced_triples)}
