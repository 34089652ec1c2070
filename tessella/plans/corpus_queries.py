"""Corpus, evaluation and streaming queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.dates import day
from tessella.operators import evaluation
from tessella.plans.asof_queries import _sql_day
from tessella.sources import corpus, markup_files
from tessella.sources.tables import table
from tessella.streaming import events

DAY = "2016-06-30"


def manifest_check(spark: SparkSession, folder: str) -> DataFrame:
    """What versions fail of a manifest's demands."""
    return corpus.manifest_errors(corpus.versions(spark, folder))


def asof_versions(spark: SparkSession, folder: str) -> DataFrame:
    """All versions in force on a day, undated ones included."""
    return corpus.versions(spark, folder).where(corpus.valid_on(F.lit(DAY).cast("date"), undated=True)).select("version_id")


def snapshot_members(spark: SparkSession, folder: str) -> DataFrame:
    """A snapshot's versions with their extraction and the number of their chunks."""
    s = corpus.snapshot(spark, folder, DAY, trusted=False)
    e = table(spark, folder, "document_extractions").select("version_id", "artifact_sha256", "page_count").distinct()
    c = table(spark, folder, "rag_chunks").select("chunk_id", "version_id").distinct().groupBy("version_id").agg(F.count("*").alias("n_chunks"))
    return s.join(e, "version_id", "left").join(c, "version_id", "left").select("document_id", "version_id", "artifact_sha256", "page_count", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def trusted_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """A snapshot of verified originals only."""
    return corpus.snapshot(spark, folder, DAY)


def version_idempotence(spark: SparkSession, folder: str) -> DataFrame:
    """What importing all versions adds to those issued before a day."""
    v = corpus.versions(spark, folder)
    return corpus.new_versions(v, v.where(F.col("issued") < F.lit("2014-01-01").cast("date"))).select("version_id")


def markdown_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """Links, days and article references named in every document."""
    d = table(spark, folder, "documents").where("text is not null")
    number = lambda p: F.size(F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(1)))
    return d.select("doc_id", number("[a-z]+://[0-9A-Za-z./_-]+").alias("n_links"), number("[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日").alias("n_days"), number("第[一二三四五六七八九十百0-9]+条").alias("n_articles"))


def headed_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of extracted texts that a numbered heading opens."""
    t = table(spark, folder, "document_extractions").select("version_id", "normalized_text").distinct()
    return markup_files.headed_sections(t, "version_id", "normalized_text")


def html_body_text(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of converted texts that hold exactly one list as their container."""
    t = table(spark, folder, "word_conversions").select("id", "markdown_text").distinct()
    return markup_files.html_bodies(t, "id", "markdown_text", "ul")


def _cases(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "oracle_rows").distinct()
    q = table(spark, folder, "questions").select("id", "doc_ids").distinct()
    return o.join(q, "id")


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    c = _cases(spark, folder)
    found = c.select("id", F.posexplode("doc_ids").alias("k", "doc")).select("id", "doc", (F.col("k") + 1).alias("rk"))
    return evaluation.retrieval_scores(c, found, c.select("id", F.explode("target_articles.doc_id").alias("doc")), c.select("id", F.explode("allowed_doc_ids").alias("doc")))


def retrieval_score(spark: SparkSession, folder: str) -> DataFrame:
    """Each question's document list scored against its oracle row."""
    return _scores(spark, folder)


def score_by_group(spark: SparkSession, folder: str) -> DataFrame:
    """Means by suite, category and expected status."""
    groups = _cases(spark, folder).select("id", "suite", "category", "expected_status").distinct()
    return evaluation.by_groups(_scores(spark, folder).join(groups, "id"), ["suite", "category", "expected_status"])


def latency_distribution(spark: SparkSession, folder: str) -> DataFrame:
    """Mean, median and 95th percentile of a value by event type."""
    return evaluation.distribution(table(spark, folder, "events"), "event_type", "value")


def span_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Days of a decade on which some version of each document was in force."""
    number = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    v = corpus.versions(spark, folder).where("effective is not null").select("document_id", number(F.col("effective")).alias("a"), F.coalesce(number(F.col("withdrawn")), F.lit(99999)).alias("b"))
    return evaluation.covered_length(v, "document_id", "a", "b", F.lit(14610), F.lit(18262)).select("document_id", F.col("covered").cast("long").alias("covered"))


def scope_set_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Documents a question may use and those it names, where they differ."""
    c = _cases(spark, folder)
    return evaluation.set_difference(c.select("id", F.explode("allowed_doc_ids").alias("doc")), c.select("id", F.explode("doc_ids").alias("doc")), "id", "doc")


def run_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """The lists as given against the lists reversed, by reciprocal rank."""
    c = _cases(spark, folder)
    turned = c.select("id", F.posexplode(F.reverse("doc_ids")).alias("k", "doc")).select("id", "doc", (F.col("k") + 1).alias("rk"))
    second = evaluation.retrieval_scores(c, turned, c.select("id", F.explode("target_articles.doc_id").alias("doc")), c.select("id", F.explode("allowed_doc_ids").alias("doc")))
    return evaluation.compared(_scores(spark, folder), second, "id", "reciprocal_rank")


def question_days(spark: SparkSession, folder: str) -> DataFrame:
    """The day each question names, however it is written."""
    return table(spark, folder, "questions").select("id", day(F.col("as_of")).alias("day")).distinct()


def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events in daily windows, in one batch."""
    return events.windowed_counts(table(spark, folder, "events"), "ts", "event_type", "value")


def stream_event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The same from a stream with a watermark."""
    return events.run_to_end(events.windowed_counts(events.event_stream(spark, folder), "ts", "event_type", "value"), "event-windows")


_V = f"v as (select distinct * exclude (acquired_at), {_sql_day('issued_date')} as i, {_sql_day('effective_from')} as f, {_sql_day('withdrawn_date')} as w from document_versions)"
_ON = f"(effective_from is null or f <= date '{DAY}') and (withdrawn_date is null or w > date '{DAY}')"
_MEMBERS = "select document_id, version_id from (select document_id, version_id, row_number() over (partition by document_id order by coalesce(i, date '0001-01-01') desc, version_id desc) as n from v where {}) where n = 1"
_C = "c as (select distinct o.id, o.suite, o.category, o.expected_status, o.target_articles, o.allowed_doc_ids, q.doc_ids from oracle_rows o join questions q using (id))"
_S = f"""{_C}, t as (select distinct id, unnest(target_articles).doc_id as doc from c), a as (select distinct id, unnest(allowed_doc_ids) as doc from c),
f as (select id, doc, min(rk) as rk from (select id, unnest(DOCS) as doc, generate_subscripts(doc_ids, 1) as rk from c) where doc is not null group by 1, 2),
s as (select c.id, c.suite, c.category, c.expected_status, (select count(*) from t where t.id = c.id) as n_target, (select count(*) from t join f using (id, doc) where t.id = c.id) as n_hit,
 (select min(rk) from t join f using (id, doc) where t.id = c.id) as first, (select count(*) from f where f.id = c.id and not exists (select 1 from a where a.id = f.id and a.doc = f.doc)) as n_outside from c),
r as (select id, suite, category, expected_status, n_target, n_hit, round(case when n_target > 0 then n_hit / n_target else 0.0 end, 6) as recall, round(coalesce(1.0::double / first, 0.0), 6) as reciprocal_rank, n_outside, n_target > 0 and n_hit = n_target and n_outside = 0 as passed from s)"""
_GIVEN = _S.replace("DOCS", "doc_ids")
_MEANS = "count(*) as n, round(avg(recall), 6) as recall, round(avg(reciprocal_rank), 6) as mrr, sum(passed::int)::bigint as n_passed from r group by 1, 2"
_WINDOWS = "select date_trunc('day', ts) as window_start, event_type, count(*) as n, round(sum(cast(value as decimal(18,2)))::double, 2) as total from events group by 1, 2"

SQL: dict[str, str] = {
    "manifest_check": f"with {_V} select version_id, unnest(list_filter([case when title is null or trim(title) = '' then 'title' end, case when publisher is null then 'publisher' end, case when source_uri is null or not regexp_matches(source_uri, '^[a-z]+://.+') then 'source_uri' end, case when sha256 is null or not regexp_full_match(sha256, '[0-9a-f]{{64}}') then 'sha256' end, case when issued_date is not null and not regexp_full_match(issued_date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then 'issued_date' end, case when status is null or status not in ('verified', 'unverified', 'quarantined') then 'status' end, case when authority is null or authority not in ('authoritative_original', 'research_note', 'synthetic') then 'authority' end], lambda x: x is not null)) as error from v",
    "asof_versions": f"with {_V} select version_id from v where (i <= date '{DAY}' or issued_date is null) and {_ON}",
    "snapshot_members": f"with {_V}, m as ({_MEMBERS.format(f'''(i <= date '{DAY}' or issued_date is null) and {_ON}''')}) select m.document_id, m.version_id, e.artifact_sha256, e.page_count, coalesce(c.n, 0) as n_chunks from m left join (select distinct version_id, artifact_sha256, page_count from document_extractions) e using (version_id) left join (select version_id, count(distinct chunk_id) as n from rag_chunks group by 1) c using (version_id)",
    "trusted_snapshot": f"with {_V} {_MEMBERS.format(f'''i <= date '{DAY}' and status = 'verified' and authority = 'authoritative_original' and {_ON}''')}",
    "version_idempotence": f"with {_V} select version_id from v where not exists (select 1 from v o where o.i < date '2014-01-01' and o.document_id is not distinct from v.document_id and o.sha256 is not distinct from v.sha256 and o.issued_date is not distinct from v.issued_date)",
    "markdown_inventory": "select doc_id, len(regexp_extract_all(text, '[a-z]+://[0-9A-Za-z./_-]+'))::int as n_links, len(regexp_extract_all(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日'))::int as n_days, len(regexp_extract_all(text, '第[一二三四五六七八九十百0-9]+条'))::int as n_articles from documents where text is not null",
    "retrieval_score": f"with {_GIVEN} select id, n_target, n_hit, recall, reciprocal_rank, n_outside, passed from r",
    "score_by_group": f"with {_GIVEN} select 'suite' as dimension, coalesce(suite, '(none)') as value, {_MEANS} union all select 'category', coalesce(category, '(none)'), {_MEANS} union all select 'expected_status', coalesce(expected_status, '(none)'), {_MEANS} union all select 'all', 'all', {_MEANS}",
    "latency_distribution": "select event_type, count(*) as n, case when count(value) = count(*) then round(avg(value), 6) end as mean, case when count(value) = count(*) then round(median(value), 6) end as p50, case when count(value) = count(*) then quantile_disc(value, 0.95) end as p95 from events group by 1",
    "span_coverage": f"with {_V}, x as (select distinct document_id, unnest(range(greatest(f - date '1970-01-01', 14610), least(coalesce(w - date '1970-01-01', 99999), 18262))) as d from v where f is not null) select document_id, count(*) as covered from x group by 1",
    "scope_set_diff": f"with {_C}, a as (select distinct id, unnest(allowed_doc_ids) as d from c), b as (select distinct id, unnest(doc_ids) as d from c), x as (select id, 'missing' as side, d from a where d is not null and not exists (select 1 from b where b.id = a.id and b.d = a.d) union all select id, 'unexpected', d from b where d is not null and not exists (select 1 from a where b.id = a.id and b.d = a.d)) select id, side, string_agg(d, ',' order by d) as items from x group by 1, 2",
    "run_comparison": f"with x as (with {_GIVEN} select id, reciprocal_rank as va from r), y as (with {_S.replace('DOCS', 'list_reverse(doc_ids)')} select id, reciprocal_rank as vb from r) select case when va > vb then 'first' when va < vb then 'second' else 'equal' end as outcome, count(*) as n from x join y using (id) group by 1",
    "question_days": f"select distinct id, {_sql_day('as_of')} as day from questions",
    "event_windows": _WINDOWS,
    "stream_event_windows": _WINDOWS,
}

QUERIES = {
    f.__name__: f
    for f in (
        manifest_check, asof_versions, snapshot_members, trusted_snapshot, version_idempotence, markdown_inventory, headed_sections, html_body_text, retrieval_score, score_by_group, latency_distribution,
        span_coverage, scope_set_diff, run_comparison, question_days, event_windows, stream_event_windows,
    )
}
