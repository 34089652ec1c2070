"""Files read back, manifests imported, snapshots published and verified, catalogues and inventories, with their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import han_numeral, numeral
from tessella.operators import graphs
from tessella.plans.asof_queries import _sql_day
from tessella.plans.ontology_queries import _NEAR
from tessella.plans.vocabulary import COMMERCE as V
from tessella.sources import corpus, files, markup_files
from tessella.sources.tables import shared_folder, table

_CHUNK = "chunk_id string, doc_id string, version_id string, section string, text string, status string"
# Marks of an incomplete text, and of a complete one.
INCOMPLETE = ("摘要", "摘录", "摘编", "核心条款整理", "核心制度内容", "非逐条全文", "未能直接抓取", "未完整获取", "暂未能", "暂未抓取", "需通过", "建议后续补充", "不属于全文")
COMPLETE = "逐条全文|(?<!非)全文\\s*[0-9]+\\s*条|[0-9]+\\s*条全文|(?<!非)全文收录"


def jsonl_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks written as JSON lines, blank lines among them, and read in a stated schema."""
    c = table(spark, folder, "rag_chunks").select("chunk_id", "doc_id", "version_id", "section", "text", "status").distinct()
    path = shared_folder(spark, "jsonl")
    c.select(F.explode(F.array(F.to_json(F.struct(*c.columns)), F.lit("  "))).alias("value")).write.text(path)
    return files.json_lines(spark, path, _CHUNK)


def text_file_sources(spark: SparkSession, folder: str) -> DataFrame:
    """A text file for every nation, read with its hash."""
    path = shared_folder(spark, "texts")
    table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("value")).write.partitionBy("n_nationkey").text(path)
    f = files.text_files(spark, path, "*.txt")
    return f.select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int").alias("n_nationkey"), "sha256", F.rtrim("text", F.lit("\n")).alias("n_name"), "error")


def turtle_schema(spark: SparkSession, folder: str) -> DataFrame:
    """The vocabulary written as two Turtle texts, one importing the other, and its sub-class statements read back."""
    top = "@prefix c: <urn:c#> . @prefix s: <http://www.w3.org/2000/01/rdf-schema#> . "
    own = top + " ".join(f"c:{c} s:subClassOf {', '.join('c:' + p for p in ps)} ." for c, ps in sorted(V.parents.items()))
    main = "@prefix o: <http://www.w3.org/2002/07/owl#> . <urn:main> o:imports <urn:classes> , <urn:unknown> ."
    triples, _ = files.loaded({"urn:main": main, "urn:classes": own}, "urn:main")
    rows = [(s.split("#")[1], o.split("#")[1]) for s, p, o in triples if p.endswith("#subClassOf")]
    return spark.createDataFrame(rows, "sub string, sup string")


def ntriples_graph(spark: SparkSession, folder: str) -> DataFrame:
    """The whole graph written as N-Triples and read back: triples and different subjects of every property."""
    path = shared_folder(spark, "triples")
    files.write_n_triples(graphs.object_triples(V, spark, folder), path)
    return files.n_triples(spark, path).groupBy("p").agg(F.count("*").alias("n"), F.count_distinct("s").alias("n_subjects"))


def json_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as JSON answers, their bodies read; half of them under another field."""
    d = table(spark, folder, "documents").select("doc_id", "title", "text")
    inner = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct("title", F.struct(F.col("text").alias("content")).alias("data")))).otherwise(F.to_json(F.struct("title", F.col("text").alias("body"))))
    b = files.json_bodies(d.select("doc_id", inner.alias("answer")), "doc_id", "answer", ("data.content", "body"))
    return b.select("doc_id", F.sha2("body", 256).alias("sha256"), "error")


def word_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Noted paragraphs of conversions as Word documents, their lines read back."""
    w = table(spark, folder, "word_conversions").select("id", F.col("observations.first_nonempty_paragraphs").alias("p")).distinct().where("p is not null")
    clean = F.transform(F.filter("p", lambda x: x.isNotNull()), lambda x: F.regexp_replace(x, "[^ -~ -퟿-�]", ""))

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "content": [files.word_document(list(x)) for x in b["p"]]})

    made = w.select("id", clean.alias("p")).mapInPandas(documents, "id string, content binary")
    return files.word_bodies(made, "id", "content").groupBy("id").agg(F.count("*").alias("n_lines"))


def import_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Three imports of a store: the whole manifest, which has errors; its good rows; the same again."""
    v = corpus.versions(spark, folder).select("version_id", "document_id", "title", "publisher", "source_uri", "sha256", "issued_date", "status", "authority")
    good = v.join(corpus.manifest_errors(v).select("version_id").distinct(), "version_id", "left_anti")
    path = shared_folder(spark, "store")
    for n, rows in enumerate((v, good, good)):
        corpus.import_manifest(rows, path, f"run-{n + 1}")
    return spark.read.parquet(f"{path}/runs").select("run", "status", "n_rows", "n_errors", "n_inserted", "n_reused")


def snapshot_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """A snapshot of each kind from the versions it may hold, with its membership hash."""
    v = corpus.versions(spark, folder)
    out = None
    for kind in corpus.KINDS:
        members = v.where(corpus.admitted(kind)).groupBy("document_id").agg(F.max("version_id").alias("version_id"))
        one = corpus.published(members, v, kind)
        out = one if out is None else out.unionByName(one)
    return out


def publication_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Why all versions together are no trusted snapshot."""
    v = corpus.versions(spark, folder)
    return corpus.publication_errors(v.select("document_id", "version_id"), v, "trusted")


def snapshot_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks that a trusted snapshot gives to retrieval: of verified originals in force, with text, checked and no draft."""
    s = corpus.snapshot(spark, folder, "2016-06-30")
    c = table(spark, folder, "rag_chunks").select("chunk_id", "version_id", "section", "text", "status", "authority").distinct()
    return c.where("text is not null and status = 'verified' and authority = 'authoritative_original'").join(s, "version_id").select("document_id", "version_id", "chunk_id", "section", F.sha2("text", 256).alias("sha256"))


def snapshot_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What a snapshot of all versions in force breaks: members without extraction, with an empty text, with no chunk, chunks that their text does not hold."""
    return corpus.verified(spark, folder, corpus.snapshot(spark, folder, "2016-06-30", trusted=False))


def exact_readback(spark: SparkSession, folder: str) -> DataFrame:
    """Every extracted text as stored: its hash, characters and bytes, with the original's hash and path."""
    e = table(spark, folder, "document_extractions").drop("extracted_at").distinct()
    v = table(spark, folder, "document_versions").select("version_id", F.col("sha256").alias("original_sha256")).distinct()
    return e.join(v, "version_id", "left").select("version_id", "original_sha256", "artifact_sha256", "artifact_path", F.sha2("normalized_text", 256).alias("text_sha256"), F.length("normalized_text").alias("n_characters"), F.octet_length("normalized_text").alias("n_bytes"))


def catalogue_status(spark: SparkSession, folder: str) -> DataFrame:
    """How far each version has come, and why it is not ready."""
    return corpus.catalogue(spark, folder)


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Converted texts by the articles they hold and miss and how complete they say to be."""
    t = table(spark, folder, "word_conversions").select("id", "markdown_text").distinct().where("markdown_text is not null")
    return markup_files.inventory(t, "id", "markdown_text", INCOMPLETE, COMPLETE)


def legal_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the articles of each text run 1..N, with their number."""
    t = table(spark, folder, "document_extractions").select("version_id", "normalized_text").distinct()
    return markup_files.article_status(t, "version_id", "normalized_text")


_V = f"v as (select distinct * exclude (acquired_at), {_sql_day('issued_date')} as i, {_sql_day('effective_from')} as f, {_sql_day('withdrawn_date')} as w from document_versions)"
_IN = "(effective_from is null or f <= date '2016-06-30') and (withdrawn_date is null or w > date '2016-06-30')"
_MEMBERS = "select document_id, version_id from (select document_id, version_id, row_number() over (partition by document_id order by coalesce(i, date '0001-01-01') desc, version_id desc) as n from v where {}) where n = 1"
_ERRORS = "list_filter([case when title is null or trim(title) = '' then 'title' end, case when publisher is null then 'publisher' end, case when source_uri is null or not regexp_matches(source_uri, '^[a-z]+://.+') then 'source_uri' end, case when sha256 is null or not regexp_full_match(sha256, '[0-9a-f]{64}') then 'sha256' end, case when issued_date is not null and not regexp_full_match(issued_date, '\\d{4}-\\d{2}-\\d{2}') then 'issued_date' end, case when status is null or status not in ('verified', 'unverified', 'quarantined') then 'status' end, case when authority is null or authority not in ('authoritative_original', 'research_note', 'synthetic') then 'authority' end], lambda x: x is not null)"
_KIND = {"trusted": "authority = 'authoritative_original' and status = 'verified' and i is not null", "research": "authority = 'research_note' and status <> 'quarantined'", "regression": "authority = 'synthetic' and status <> 'quarantined'"}
_PUBLISHED = " union all ".join(f"select '{k}' as kind, count(*) as n_members, sha256(string_agg(b || ':' || h, chr(10) order by b)) as members_sha256 from (select b, sha256(string_agg(version_id, chr(10) order by version_id)) as h, count(*) as c from (select max(version_id) as version_id, substring(sha256(max(version_id)), 1, 3) as b from v where {c} group by document_id) group by 1)".replace("count(*) as n_members", "sum(c)::bigint as n_members") for k, c in _KIND.items())
_NUM = ", ".join(f"('{x}', {n})" for x, n in sorted({(x, numeral(x)) for x in (*map(str, range(0, 400)), *(han_numeral(n) for n in range(1, 400)))}))
_ARTICLE = r"^第([一二三四五六七八九十百千零〇0-9]+)条[ \t\x{3000}]+\S"
SQL = {
    "jsonl_chunks": "select distinct chunk_id, doc_id, version_id, section, text, status from rag_chunks",
    "text_file_sources": "select n_nationkey::int as n_nationkey, sha256(n_name || chr(10)) as sha256, n_name, null::varchar as error from nation",
    "turtle_schema": f"select * from (values {', '.join(f'({c!r}, {p!r})' for c, ps in sorted(V.parents.items()) for p in ps)}) t(sub, sup)",
    "ntriples_graph": f"select 'p' as x, p, count(*) as n, count(distinct s) as n_subjects from (select distinct * from ({_NEAR})) group by p".replace("'p' as x, ", ""),
    "json_bodies": "select doc_id, case when trim(text) <> '' then sha256(text) end as sha256, case when text is null or trim(text) = '' then 'no body' end as error from documents",
    "word_bodies": "with p as (select distinct id, observations.first_nonempty_paragraphs as p from word_conversions), x as (select id, regexp_replace(unnest(p), '[^ -~\\x{00a0}-\\x{d7ff}\\x{e000}-\\x{fffd}]', '', 'g') as t from p) select id, count(*) as n_lines from x where trim(t, ' 　 ') <> '' group by 1",
    "import_runs": f"with {_V}, e as (select version_id, {_ERRORS} as e, row_number() over (partition by case when len({_ERRORS}) = 0 then 1 end, document_id, sha256, issued_date order by version_id) as k from v), n as (select count(*) as n, sum(len(e))::bigint as x, count(*) filter (len(e) = 0) as g, count(*) filter (len(e) = 0 and k = 1) as d from e) select 'run-1' as run, 'failed' as status, n as n_rows, x as n_errors, 0::bigint as n_inserted, 0::bigint as n_reused from n union all select 'run-2', 'completed', g, 0, d, g - d from n union all select 'run-3', 'completed', g, 0, 0, g from n",
    "snapshot_kinds": f"with {_V} {_PUBLISHED}",
    "publication_errors": f"with {_V} select version_id, 'kind' as error from v where not coalesce({_KIND['trusted']}, false) union all select version_id, 'second version' from v where document_id in (select document_id from v group by 1 having count(distinct version_id) > 1)",
    "snapshot_chunks": f"with {_V}, m as ({_MEMBERS.format(f'''i <= date '2016-06-30' and status = 'verified' and authority = 'authoritative_original' and {_IN}''')}) select distinct document_id, version_id, chunk_id, section, sha256(text) as sha256 from rag_chunks join m using (version_id) where text is not null and status = 'verified' and authority = 'authoritative_original'",
    "snapshot_audit": f"with {_V}, m as ({_MEMBERS.format(f'''(i <= date '2016-06-30' or issued_date is null) and {_IN}''')}), e as (select distinct version_id, normalized_text as t from document_extractions), c as (select distinct chunk_id, version_id, text from rag_chunks) select version_id, 'no extraction' as violation, 1::bigint as n from m where version_id not in (select version_id from e) union all select version_id, 'empty text', 1 from m join e using (version_id) where t is null or trim(t) = '' union all select version_id, 'no chunk', 1 from m where version_id not in (select version_id from c) union all select version_id, 'chunk without text', count(*) from m join c using (version_id) where text is null group by 1 union all select version_id, 'foreign chunk', count(*) from m join c using (version_id) join e using (version_id) where text is not null and t is not null and not contains(t, text) group by 1",
    "exact_readback": "with e as (select distinct * exclude (extracted_at) from document_extractions), v as (select distinct version_id, sha256 from document_versions) select version_id, v.sha256 as original_sha256, artifact_sha256, artifact_path, sha256(normalized_text) as text_sha256, length(normalized_text)::int as n_characters, strlen(normalized_text)::int as n_bytes from e left join v using (version_id)",
    "catalogue_status": f"with {_V}, r as (select version_id, max((http_status = 200 and byte_count > 0)::int) as got from receipts group by 1), e as (select version_id, max((normalized_text is not null and trim(normalized_text) <> '')::int) as txt from document_extractions group by 1), d as (select distinct version_id, coalesce(got, 0) as got, coalesce(txt, 0) as txt, status, authority, publisher, i from v left join r using (version_id) left join e using (version_id)) select version_id, case when got = 1 and txt = 1 and status = 'verified' and authority = 'authoritative_original' and publisher is not null and i is not null then 'ready' when txt = 1 then 'converted_unverified' when got = 1 then 'downloaded' else 'unresolved' end as state, array_to_string(list_filter([case when got = 0 then 'no receipt' end, case when txt = 0 then 'no text' end, case when status is distinct from 'verified' then 'not verified' end, case when authority is distinct from 'authoritative_original' then 'no original' end, case when publisher is null then 'no publisher' end, case when i is null then 'no issue date' end], lambda x: x is not null), ', ') as reasons from d",
}
_LINES = "l as (select id, k, replace(line, chr(13), '') as line from (select id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as k from x))"
SQL["legal_articles"] = (
    f"with num(x, n) as (values {_NUM}), x as (select distinct version_id as id, normalized_text as t from document_extractions where normalized_text is not null), {_LINES}, a as (select id, k, n from l join num on x = regexp_extract(line, '{_ARTICLE}', 1) where regexp_matches(line, '{_ARTICLE}')), "
    "s as (select id, count(*) as c, list(n order by k) as ns from a group by 1) select x.id as version_id, coalesce(c, 0)::int as n_articles, coalesce(ns = range(1, c + 1), false) as consecutive from x left join s using (id)"
)
SQL["headed_sections"] = (
    f"with num(x, n) as (values {_NUM}), x as (select distinct version_id as id, normalized_text as t from document_extractions where normalized_text is not null), l as (select id, length(t) as size, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as k from x), "
    "o as (select *, coalesce(sum(length(line) + 1) over (partition by id order by k rows between unbounded preceding and 1 preceding), 0) as a from l), "
    "h as (select id, size, a, line, regexp_extract(line, '^第([一二三四五六七八九十百千〇零两0-9]{1,8})([编章节條条])\\s*(.*)$', ['n', 'kind', 'title']) as m from o where regexp_matches(line, '^第([一二三四五六七八九十百千〇零两0-9]{1,8})([编章节條条])\\s*(.*)$')) "
    "select id as version_id, a::int as start, coalesce(lead(a) over (partition by id order by a), size)::int as stop, m.kind as kind, num.n as number, m.title as title from h join num on num.x = m.n"
)
QUERIES = {
    f.__name__: f
    for f in (
        jsonl_chunks, text_file_sources, turtle_schema, ntriples_graph, json_bodies, word_bodies, import_runs, snapshot_kinds, publication_errors, snapshot_chunks, snapshot_audit, exact_readback, catalogue_status, inventory, legal_articles,
    )
}
