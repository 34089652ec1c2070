"""Cases, gates, outcomes, spans, reranking and scope resolution, with their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.dates import day
from tessella.operators import contracts, retrieval
from tessella.plans import retrieval_queries as r
from tessella.plans.asof_queries import _sql_day
from tessella.plans.corpus_queries import _cases
from tessella.plans.scope_queries import _PLAIN, plain_name
from tessella.sources.tables import table

SPLITS = ("train", "dev", "test", "challenge", "holdout")
CATEGORIES = ("business", "system")
STATUSES = ("retrieved", "unresolved")
#: Phrases that promise too much.
BANNED = ("保证收益", "绝对", "一定盈利", "承诺保本", "guaranteed", "risk-free")


def _full(spark: SparkSession, folder: str) -> DataFrame:
    c = _cases(spark, folder)
    found = c.select("id", F.posexplode("doc_ids").alias("k", "doc")).select("id", "doc", (F.col("k") + 1).alias("rk"))
    targets = c.select("id", F.explode("target_articles").alias("t")).select("id", F.col("t.doc_id").alias("doc"), F.ceil(F.col("t.article_number") / 50).alias("grp"))
    return contracts.full_scores(c.select("id", F.col("expected_status").alias("expected")), found, targets, c.select("id", F.explode("allowed_doc_ids").alias("doc")))


def full_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every case scored in full: targets, required groups, first rank, scope, status, gate."""
    return _full(spark, folder)


def gate_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Means and gate by suite, ordinary cases and controls apart."""
    return contracts.gate_summary(_full(spark, folder).join(_cases(spark, folder).select("id", "suite").distinct(), "id"), "suite")


def gate_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    """The same for every category, split and expected status, groups without a case included."""
    split = F.lower(F.regexp_replace("split", r"^\s+|\s+$", ""))
    keys = ["category", "split", "expected_status"]
    c = _cases(spark, folder).select("id", "category", split.alias("split"), "expected_status").distinct()
    s = contracts.gate_summary(_full(spark, folder).join(c, "id"), *keys).select(*keys, "n", "n_ordinary", "recall", "n_passed")
    grid = spark.createDataFrame([(a, b, x) for a in CATEGORIES for b in SPLITS for x in STATUSES], "category string, split string, expected_status string")
    return contracts.with_empty(s, grid, keys, ["n", "n_ordinary", "n_passed"])


def judge_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Means of two counts by suite, given only where every question has them."""
    q = table(spark, folder, "questions").select("id", "suite", "question", "doc_ids").distinct()
    return contracts.judge_summary(q.select("suite", F.length("question").alias("length"), F.when(F.col("doc_ids").isNotNull(), F.size("doc_ids")).alias("documents")), "suite", ["length", "documents"])


def span_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Days on which verified versions of a document are in force against the days of all its versions."""
    number = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    v = table(spark, folder, "document_versions").drop("acquired_at").distinct().select("document_id", "status", number(day(F.col("effective_from"))).alias("a"), F.coalesce(number(day(F.col("withdrawn_date"))), F.lit(22000)).alias("b")).where("a is not null")
    return contracts.span_scores(v.where("status = 'verified'"), v, "document_id")


def id_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Ids that questions, oracle rows and dated questions do not share."""
    q = table(spark, folder, "questions")
    return contracts.same_ids(in_questions=q, in_oracle=table(spark, folder, "oracle_rows"), in_dated=q.where(day(F.col("as_of")).isNotNull()))


def case_contracts(spark: SparkSession, folder: str) -> DataFrame:
    """What oracle rows fail of a case's contract."""
    o = table(spark, folder, "oracle_rows").drop("reviewed_at").distinct()
    docs = F.col("target_articles.doc_id")
    checks = {
        "category": F.col("category").isNull(),
        "split": ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)),
        "status": ~F.coalesce(F.col("expected_status").isin(*STATUSES), F.lit(False)),
        "targets": (F.col("expected_status") == "retrieved") & (F.coalesce(F.size("target_articles"), F.lit(0)) < 1),
        "article": F.exists("target_articles", lambda t: F.coalesce(t["article_number"] < 1, F.lit(True))),
        "scope": F.size(F.array_except(docs, F.coalesce("allowed_doc_ids", F.array().cast("array<string>")))) > 0,
        "repeated": F.size(F.array_distinct("target_articles")) < F.size("target_articles"),
    }
    errors = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return o.select("id", F.explode(errors).alias("error"))


def case_matcher(spark: SparkSession, folder: str) -> DataFrame:
    """Every case matched: the set of documents, the slot of the day, one target whose documents are all named, the status."""
    c = _cases(spark, folder).join(table(spark, folder, "questions").select("id", "as_of").distinct(), "id")
    given, may = F.coalesce("doc_ids", F.array().cast("array<string>")), F.coalesce("allowed_doc_ids", F.array().cast("array<string>"))
    sets = (F.size(F.array_except(given, may)) == 0) & (F.size(F.array_except(may, given)) == 0)
    slots = day(F.col("as_of")).isNotNull()
    evidence = F.coalesce(F.exists("target_articles.doc_id", lambda d: F.array_contains(given, d)), F.lit(False))
    status = F.coalesce(F.col("expected_status") == F.when(F.size(given) > 0, "retrieved").otherwise("unresolved"), F.lit(False))
    return c.select("id", sets.alias("sets"), slots.alias("slots"), evidence.alias("evidence"), status.alias("status"), (sets & slots & evidence & status).alias("matched"))


def suite_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """How the cases of each suite end with an adapter that reads the first document's last digit: undated ones are skipped, those without documents are errors."""
    q = table(spark, folder, "questions").select("id", "suite", "doc_ids", "as_of").distinct()
    q = q.withColumns({"first": F.col("doc_ids")[0], "want": F.when(F.col("suite") == "natural_facts_v1", F.lit("a")).otherwise(F.right(F.col("doc_ids")[0], F.lit(1)))})
    ran = contracts.run_suite(q, ["first"], lambda c: c["first"][-1], "want", skip=F.col("as_of").isNull())
    return ran.join(q.select("id", "suite").distinct(), "id").groupBy("suite", "outcome").agg(F.count("*").alias("n"))


def natural_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What questions fail of the demands on natural ones: a length, an end, no document id, no repeated wording in their suite."""
    q = table(spark, folder, "questions").select("id", "suite", "question").distinct()
    often = q.groupBy("suite", "question").agg(F.count("*").alias("n")).where("n > 1").select("suite", "question")
    errors = F.array(F.when(F.length("question") > 150, F.lit("long")), F.when(~F.col("question").rlike(r"[?？。.]\s*$"), F.lit("end")), F.when(F.col("question").rlike("d-[0-9a-f]{14}"), F.lit("id")))
    own = q.select("id", F.explode(F.filter(errors, lambda x: x.isNotNull())).alias("error"))
    return own.unionByName(q.join(often, ["suite", "question"], "left_semi").select("id", F.lit("repeated").alias("error")))


def phrase_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a phrase that promises too much."""
    d = table(spark, folder, "documents").select("doc_id", "text")
    return d.select("doc_id", F.explode(F.filter(F.array(*[F.when(F.contains("text", F.lit(p)), F.lit(p)) for p in BANNED]), lambda x: x.isNotNull())).alias("phrase"))


def evidence_completeness(spark: SparkSession, folder: str) -> DataFrame:
    """How much of what each question may use it names, by suite."""
    c = _cases(spark, folder).where("allowed_doc_ids is not null and size(allowed_doc_ids) > 0")
    named = F.size(F.array_intersect("allowed_doc_ids", F.coalesce("doc_ids", F.array().cast("array<string>"))))
    return c.select("suite", (named / F.size(F.array_distinct("allowed_doc_ids"))).alias("share")).groupBy("suite").agg(F.count("*").alias("n"), F.round(F.avg("share"), 6).alias("mean"), F.sum((F.col("share") == 1).cast("long")).alias("n_complete"))


# -- reranking, hints, budgets, dispatch ----------------------------------------------------
def _overlap(query: str, texts: list[str]) -> list[tuple[int, float]]:
    """A model that needs no network: the share of the query's tokens that a text holds."""
    import numpy as np

    asked = np.unique(retrieval.token_codes(query))
    return [(i, float(np.isin(asked, retrieval.token_codes(t)).mean()) if len(asked) else 0.0) for i, t in enumerate(texts)]


def reranked_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty best texts for every title, put into a model's order."""
    d = r._docs(spark, folder)
    found = r._text_channel(spark, folder, 20).select("q", "d", "rk")
    c = found.join(d.select(F.col("doc_id").alias("d"), "text"), "d").join(d.select(F.col("doc_id").alias("q"), F.col("title").alias("query")), "q")
    return contracts.reranked(c, _overlap, 10).withColumn("rk", F.col("rk").cast("int"))


def dense_positive(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest vectors with a positive cosine only."""
    return r.dense_topk(spark, folder).where("score > 0")


def section_hint(spark: SparkSession, folder: str) -> DataFrame:
    """Three chunks of every version: those whose section names the hint first, then the longest."""
    c = table(spark, folder, "rag_chunks").select("chunk_id", "version_id", "section", "text").distinct().select("chunk_id", "version_id", F.coalesce(F.contains("section", F.lit("披露")), F.lit(False)).alias("hinted"), F.coalesce(F.length("text"), F.lit(0)).alias("score"))
    w = Window.partitionBy("version_id").orderBy(F.desc("hinted"), F.desc("score"), "chunk_id")
    return c.withColumn("rk", F.row_number().over(w)).where("rk <= 3").select("version_id", "chunk_id", "hinted", "score", "rk")


def budget_report(spark: SparkSession, folder: str) -> DataFrame:
    """For every query how many found documents fit a budget and how many it excludes."""
    size = table(spark, folder, "documents").select(F.col("doc_id").alias("d"), "n_chars")
    found = r.bm25_topk(spark, folder).join(size, "d").groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rk", "n_chars"))).alias("x"))
    within = F.aggregate("x", F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(0).alias("n")), lambda a, y: F.struct((a["s"] + y["n_chars"]).alias("s"), (a["n"] + (a["s"] + y["n_chars"] <= 4000).cast("int")).alias("n")))
    return found.select("q", F.size("x").alias("n_found"), within["n"].alias("n_within"), (F.size("x") - within["n"]).alias("n_excluded"))


STRATEGIES = {"bm25": r.bm25_topk, "parent_child": r.parent_child_bm25, "hybrid_rrf": r.rrf_fuse, "bm25_rerank": reranked_topk}


def strategy_first(spark: SparkSession, folder: str) -> DataFrame:
    """The first document of every query by each strategy."""
    out = None
    for name, f in STRATEGIES.items():
        one = f(spark, folder).where("rk = 1").select(F.lit(name).alias("strategy"), "q", "d")
        out = one if out is None else out.unionByName(one)
    return out


# -- scope -----------------------------------------------------------------------------------
_ADDRESS = "《([^《》]+)》第([0-9]+)条"


def _named(spark: SparkSession, folder: str) -> DataFrame:
    """``id``, ``name``, ``article``: rules a question names with an article."""
    q = table(spark, folder, "questions").select("id", "question").distinct()
    pairs = F.zip_with(F.regexp_extract_all("question", F.lit(_ADDRESS), F.lit(1)), F.regexp_extract_all("question", F.lit(_ADDRESS), F.lit(2)), lambda a, b: F.struct(a.alias("t"), b.cast("int").alias("article")))
    return q.select("id", F.inline(pairs)).select("id", plain_name(F.col("t")).alias("name"), "article").distinct()


def _titles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "document_versions").where("title is not null").select("document_id", plain_name(F.col("title")).alias("name")).where("name <> ''").distinct()


def article_bypass(spark: SparkSession, folder: str) -> DataFrame:
    """Questions that name an article of exactly one known document: it is looked up, not searched for."""
    t = _titles(spark, folder)
    one = t.groupBy("name").agg(F.count("*").alias("n"), F.first("document_id").alias("document_id")).where("n = 1")
    return _named(spark, folder).join(one, "name").select("id", "document_id", "article")


def scope_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """The scope of every question, or why it has none: unknown ids, a name of several documents, an unknown name, nothing named."""
    q = table(spark, folder, "questions").select("id", "doc_ids").distinct()
    known = table(spark, folder, "document_versions").select(F.col("document_id").alias("doc")).dropna().distinct().withColumn("known", F.lit(1))
    ids = q.select("id", F.explode(F.array_distinct("doc_ids")).alias("doc")).join(known, "doc", "left").groupBy("id").agg(F.count("known").alias("n_known"), (F.count("*") - F.count("known")).alias("n_unknown"))
    names = _named(spark, folder).select("id", "name").distinct().join(_titles(spark, folder), "name", "left").groupBy("id", "name").agg(F.count("document_id").alias("n")).groupBy("id").agg(F.max("n").alias("most"), F.min("n").alias("least"))
    d = q.select("id").join(ids, "id", "left").join(names, "id", "left").fillna(0, ["n_known", "n_unknown"])
    reason = (
        F.when(F.col("n_unknown") > 0, "unknown document").when(F.col("most") > 1, "ambiguous title").when(F.col("least") == 0, "unknown title")
        .when((F.col("n_known") == 0) & F.col("most").isNull(), "nothing named")
    )
    return d.select("id", F.col("n_known").alias("n_documents"), F.coalesce(reason, F.lit("resolved")).alias("reason"))


def citable_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks by what bars them from evidence: metadata without a section, a link to a fund that is rejected, no article address."""
    c = table(spark, folder, "rag_chunks").select("chunk_id", "section", "fund_code", "status", "locator_json").distinct()
    at = lambda p: F.get_json_object("locator_json", p).try_cast("int")
    metadata = F.col("section").isNull() | F.col("section").rlike("术语|Definitions?|Glossary")
    linked = F.col("fund_code").isNotNull() & (F.col("status") != "unverified")
    address = F.coalesce((at("$.page") >= 1) & (at("$.ordinal") >= 0), F.lit(False)) & F.coalesce(F.col("section").rlike("[0-9一二三四五六七八九十]"), F.lit(False))
    return c.select("chunk_id", metadata.alias("metadata"), F.coalesce(linked, F.lit(False)).alias("linked"), address.alias("addressed"))


_FUND = "^(.{2,20}?基金(?:中基金)?)"


def _names(spark: SparkSession, folder: str) -> DataFrame:
    """``name``: rules by their plain titles, and the funds that titles begin with."""
    titles = table(spark, folder, "document_versions").select("title").unionByName(table(spark, folder, "documents").select("title")).where("title is not null")
    funds = titles.select(F.regexp_extract("title", _FUND, 1).alias("name"))
    return _titles(spark, folder).select("name").unionByName(funds).where(F.length("name") >= 4).distinct()


#: Beginnings of names that are sent to where the texts are, at most; beyond that every place of a text meets the names in a join.
BEGINNINGS = 200_000


def _places(docs: DataFrame, names: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``g``: places of texts with the four letters there; only those where a name can begin, if the names' beginnings are few enough to be sent.

    Linear in a text: a substring by place would count from the beginning each time.
    """
    begins = names.select("g").distinct()
    few = begins.limit(BEGINNINGS + 1).collect() if begins.count() <= BEGINNINGS else None
    sent = docs.sparkSession.sparkContext.broadcast(None if few is None else {r.g for r in few})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = sent.value
        for b in batches:
            rows = [(d, k + 1, t[k : k + 4]) for d, t in zip(b["doc_id"], b["text"]) for k in range(len(t) - 3) if known is None or t[k : k + 4] in known]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "g"]).astype({"start": "int32"})

    return docs.mapInPandas(run, "doc_id long, start int, g string")


def title_spans(spark: SparkSession, folder: str) -> DataFrame:
    """At each place of a document the longest name that begins there: names meet texts by their first four letters, places without such letters go no further."""
    names = _names(spark, folder).withColumn("g", F.left("name", F.lit(4)))
    d = table(spark, folder, "documents").select("doc_id", "text").where("length(text) >= 4")
    at = _places(d, names)
    met = at.join(names, "g").join(d, "doc_id").where(F.substr("text", F.col("start"), F.length("name")) == F.col("name"))
    return met.groupBy("doc_id", "start").agg(F.max(F.struct(F.length("name").alias("n"), "name")).alias("b")).select("doc_id", "start", F.col("b.name").alias("name"))


def entity_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """The entity a document speaks of: the longest name in it, else its first code; of equal ones the first."""
    spans = title_spans(spark, folder)
    codes = table(spark, folder, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Z]{2}[0-9]{5})"), F.lit(1))).alias("name"), "text")
    codes = codes.select("doc_id", F.expr("locate(name, text)").alias("start"), "name")
    both = spans.withColumn("kind", F.lit("title")).unionByName(codes.withColumn("kind", F.lit("code")))
    best = F.max(F.struct((F.col("kind") == "title").cast("int").alias("t"), F.length("name").alias("n"), (-F.col("start")).alias("s"), "name", "kind")).alias("b")
    return both.groupBy("doc_id").agg(best).select("doc_id", F.col("b.kind").alias("kind"), F.col("b.name").alias("name"))


_C = "c as (select distinct o.id, o.suite, o.category, lower(regexp_replace(o.split, '^\\s+|\\s+$', '', 'g')) as split, o.expected_status, o.target_articles, o.allowed_doc_ids, q.doc_ids from oracle_rows o join questions q using (id))"
_F = f"""{_C}, t as (select distinct id, x.doc_id as doc, ceil(x.article_number / 50.0) as grp from (select id, unnest(target_articles) as x from c) where x.doc_id is not null),
f as (select id, doc, min(rk) as rk from (select id, unnest(doc_ids) as doc, generate_subscripts(doc_ids, 1) as rk from c) where doc is not null group by 1, 2),
g as (select id, grp, count(distinct t.doc) as n, count(distinct f.doc) as h, min(rk) as first from t left join f using (id, doc) group by 1, 2),
p as (select id, sum(n)::bigint as n_target, sum(h)::bigint as n_hit, count(*) as n_group, sum((h > 0)::int)::bigint as n_group_hit, min(first) as first from g group by 1),
a as (select distinct id, unnest(allowed_doc_ids) as doc from c),
o as (select id, count(*) as n_outside from f where not exists (select 1 from a where a.id = f.id and a.doc = f.doc) group by 1),
k as (select id, count(*) as n_found from f group by 1),
s as (select distinct c.id, expected_status, coalesce(n_target, 0) as n_target, coalesce(n_hit, 0) as n_hit, coalesce(n_group, 0) as n_group, coalesce(n_group_hit, 0) as n_group_hit, first, coalesce(n_outside, 0) as n_outside, coalesce(n_found, 0) as n_found from c left join p using (id) left join o using (id) left join k using (id)),
z as (select id, n_target > 0 as ordinary, n_target, n_hit, case when n_target > 0 then round(n_hit / n_target, 6) else 0.0 end as recall, case when n_group > 0 then round(n_group_hit / n_group, 6) else 0.0 end as groups, round(coalesce(1.0::double / first, 0.0), 6) as mrr, n_outside,
 case when n_found > 0 then 'retrieved' else 'unresolved' end = coalesce(expected_status, '') as status_ok, n_group, n_group_hit from s),
y as (select id, ordinary, n_target, n_hit, recall, groups, mrr, n_outside, status_ok, (not ordinary or (n_hit = n_target and n_group_hit = n_group)) and n_outside = 0 and status_ok as passed from z)"""
_GATE = "count(*) as n, sum(ordinary::int)::bigint as n_ordinary"
_MEAN = "round(sum(case when ordinary then {0} else 0.0 end) / nullif(sum(ordinary::int), 0), 6)"
_NAMED = f"""q as (select distinct id, question, doc_ids from questions), nm as (select distinct id, {_PLAIN.format("regexp_extract(x, '《([^《》]+)》', 1)")} as name, regexp_extract(x, '第([0-9]+)条', 1)::int as article from (select id, unnest(regexp_extract_all(question, '《[^《》]+》第[0-9]+条')) as x from q)),
ti as (select distinct document_id, {_PLAIN.format("title")} as name from document_versions where title is not null), tn as (select * from ti where name <> '')"""
_RERANK = f"""with b as ({r._bm25_sql("text", 20)}), x as (select b.q, b.d, b.rk, round(len(list_intersect(list_distinct({r._tok("t.title")}), list_distinct({r._tok("u.text")}))) / len(list_distinct({r._tok("t.title")})), 6) as score from b join documents t on t.doc_id = b.q join documents u on u.doc_id = b.d)
select q, d, score, k::int as rk from (select q, d, score, row_number() over (partition by q order by score desc, rk) as k from x) where k <= 10"""
_SPANS = f"with {_NAMED}, n as (select name from tn where length(name) >= 4 union select name from (select regexp_extract(title, '{_FUND}', 1) as name from (select title from documents union all select title from document_versions) where title is not null) where length(name) >= 4), d as (select doc_id, text from documents where length(text) >= 4), p as (select doc_id, text, unnest(range(1, length(text) - 2)) as start from d), m as (select doc_id, start, name from p join n on substring(text, start, 4) = left(name, 4) where substring(text, start, length(name)) = name) select doc_id, start::int as start, max_by(name, length(name)) as name from m group by 1, 2"
SQL: dict[str, str] = {
    "full_scores": f"with {_F} select * from y",
    "gate_summary": f"with {_F} select suite, {_GATE}, (count(*) - sum(ordinary::int))::bigint as n_control, {_MEAN.format('recall')} as recall, {_MEAN.format('mrr')} as mrr, round(avg(recall), 6) as recall_all, sum(passed::int)::bigint as n_passed from y join (select distinct id, suite from c) using (id) group by 1",
    "gate_breakdown": f"with {_F}, d(category) as (values {', '.join(f'({x!r})' for x in CATEGORIES)}), e(split) as (values {', '.join(f'({x!r})' for x in SPLITS)}), h(expected_status) as (values {', '.join(f'({x!r})' for x in STATUSES)}), m as (select * from y join (select distinct id, category, split, expected_status from c) using (id)) select category, split, expected_status, count(id) as n, coalesce(sum(ordinary::int), 0)::bigint as n_ordinary, {_MEAN.format('recall')} as recall, coalesce(sum(passed::int), 0)::bigint as n_passed from d cross join e cross join h left join m using (category, split, expected_status) group by 1, 2, 3",
    "judge_summary": "with q as (select distinct id, suite, question, doc_ids from questions), m as (select suite, 'length' as metric, length(question)::double as v from q union all select suite, 'documents', len(doc_ids)::double from q) select suite, metric, count(*) as n, case when count(v) = count(*) then round(avg(v), 6) end as mean from m group by 1, 2",
    "span_scores": f"with v as (select distinct * exclude (acquired_at) from document_versions), s as (select document_id, status, {_sql_day('effective_from')} - date '1970-01-01' as a, coalesce({_sql_day('withdrawn_date')} - date '1970-01-01', 22000) as b from v), f as (select distinct document_id, unnest(range(a, b)) as x from s where a is not null), e as (select distinct document_id, unnest(range(a, b)) as x from s where a is not null and status = 'verified'), n as (select document_id, count(e.x) as n_expected, count(*) as n_found from f left join e using (document_id, x) group by 1) select document_id, n_expected, n_found, n_expected as n_both, case when n_expected > 0 then 1.0 else 0.0 end as recall, case when n_found > 0 then round(n_expected / n_found, 6) else 0.0 end as precision from n",
    "id_sets": f"with a as (select distinct id from questions), b as (select distinct id from oracle_rows), d as (select distinct id from questions where {_sql_day('as_of')} is not null), u as (select id from a union select id from b) select id, id in (select id from a) as in_questions, id in (select id from b) as in_oracle, id in (select id from d) as in_dated from u where not (id in (select id from a) and id in (select id from b) and id in (select id from d))",
    "case_contracts": "with o as (select distinct * exclude (reviewed_at) from oracle_rows) select id, unnest(list_filter([case when category is null then 'category' end, case when split is null or split not in ('train', 'dev', 'test', 'challenge', 'holdout') then 'split' end, case when expected_status is null or expected_status not in ('retrieved', 'unresolved') then 'status' end, case when expected_status = 'retrieved' and coalesce(len(target_articles), 0) < 1 then 'targets' end, case when len(list_filter(target_articles, lambda t: coalesce(t.article_number < 1, true))) > 0 then 'article' end, case when len(list_filter(target_articles, lambda t: not list_contains(coalesce(allowed_doc_ids, []), t.doc_id))) > 0 then 'scope' end, case when len(list_distinct(target_articles)) < len(target_articles) then 'repeated' end], lambda x: x is not null)) as error from o",
    "case_matcher": f"with {_C}, m as (select c.id, len(list_filter(coalesce(doc_ids, []), lambda x: not list_contains(coalesce(allowed_doc_ids, []), x))) = 0 and len(list_filter(coalesce(allowed_doc_ids, []), lambda x: not list_contains(coalesce(doc_ids, []), x))) = 0 as sets, {_sql_day('as_of')} is not null as slots, coalesce(len(list_filter(target_articles, lambda t: list_contains(coalesce(doc_ids, []), t.doc_id))) > 0, false) as evidence, coalesce(expected_status = case when len(coalesce(doc_ids, [])) > 0 then 'retrieved' else 'unresolved' end, false) as status from c join (select distinct id, as_of from questions) using (id)) select *, sets and slots and evidence and status as matched from m",
    "suite_outcomes": "with q as (select distinct id, suite, doc_ids, as_of from questions) select suite, case when as_of is null then 'skip' when doc_ids[1] is null then 'error' when suite <> 'natural_facts_v1' or right(doc_ids[1], 1) = 'a' then 'pass' else 'fail' end as outcome, count(*) as n from q group by 1, 2",
    "natural_checks": "with q as (select distinct id, suite, question from questions) select id, unnest(list_filter([case when length(question) > 150 then 'long' end, case when not regexp_matches(question, '[?？。.]\\s*$') then 'end' end, case when regexp_matches(question, 'd-[0-9a-f]{14}') then 'id' end], lambda x: x is not null)) as error from q union all select id, 'repeated' from q where (suite, question) in (select (suite, question) from q group by suite, question having count(*) > 1)",
    "phrase_gate": f"select doc_id, p as phrase from documents, (values {', '.join(f'({x!r})' for x in BANNED)}) b(p) where contains(text, p)",
    "evidence_completeness": f"with {_C} select suite, count(*) as n, round(avg(s), 6) as mean, sum((s = 1)::int)::bigint as n_complete from (select suite, len(list_intersect(list_distinct(allowed_doc_ids), coalesce(doc_ids, []))) / len(list_distinct(allowed_doc_ids)) as s from c where len(allowed_doc_ids) > 0) group by 1",
    "reranked_topk": _RERANK,
    "dense_positive": f"select * from ({r.SQL['dense_topk']}) where score > 0",
    "section_hint": "with c as (select distinct chunk_id, version_id, section, text from rag_chunks) select version_id, chunk_id, hinted, score::int as score, rk::int as rk from (select *, row_number() over (partition by version_id order by hinted desc, score desc, chunk_id) as rk from (select version_id, chunk_id, coalesce(contains(section, '披露'), false) as hinted, coalesce(length(text), 0) as score from c)) where rk <= 3",
    "budget_report": f"with b as ({r.SQL['bm25_topk']}), u as (select q, sum(n_chars) over (partition by q order by rk) as used from b join documents on doc_id = d) select q, count(*)::int as n_found, sum((used <= 4000)::int)::int as n_within, (count(*) - sum((used <= 4000)::int))::int as n_excluded from u group by 1",
    "strategy_first": f"select 'bm25' as strategy, q, d from ({r.SQL['bm25_topk']}) where rk = 1 union all select 'parent_child', q, d from ({r.SQL['parent_child_bm25']}) where rk = 1 union all select 'hybrid_rrf', q, d from ({r.SQL['rrf_fuse']}) where rk = 1 union all select 'bm25_rerank', q, d from ({_RERANK}) where rk = 1",
    "article_bypass": f"with {_NAMED} select distinct id, document_id, article from nm join (select name, min(document_id) as document_id from tn group by 1 having count(*) = 1) using (name)",
    "scope_resolution": f"with {_NAMED}, kn as (select distinct document_id as doc from document_versions where document_id is not null), i as (select id, count(kn.doc) as k, count(*) - count(kn.doc) as u from (select id, unnest(list_distinct(doc_ids)) as doc from q) x left join kn using (doc) group by 1), n as (select id, max(n) as most, min(n) as least from (select id, name, count(document_id) as n from (select distinct id, name from nm) left join tn using (name) group by 1, 2) group by 1) select q.id, coalesce(k, 0) as n_documents, case when coalesce(u, 0) > 0 then 'unknown document' when most > 1 then 'ambiguous title' when least = 0 then 'unknown title' when coalesce(k, 0) = 0 and most is null then 'nothing named' else 'resolved' end as reason from q left join i using (id) left join n using (id)",
    "citable_chunks": "select distinct chunk_id, section is null or regexp_matches(section, '术语|Definitions?|Glossary') as metadata, coalesce(fund_code is not null and status <> 'unverified', false) as linked, coalesce(try_cast(json_extract_string(locator_json, '$.page') as int) >= 1 and try_cast(json_extract_string(locator_json, '$.ordinal') as int) >= 0, false) and coalesce(regexp_matches(section, '[0-9一二三四五六七八九十]'), false) as addressed from rag_chunks",
    "title_spans": _SPANS,
    "entity_mentions": f"with s as ({_SPANS}), b as (select doc_id, start, name, 'title' as kind from s union all select doc_id, strpos(text, name), name, 'code' from (select doc_id, text, unnest(regexp_extract_all(text, '[A-Z]{{2}}[0-9]{{5}}')) as name from documents)) select doc_id, kind, name from (select *, row_number() over (partition by doc_id order by kind desc, length(name) desc, start, name desc) as n from b) where n = 1",
}
QUERIES = {
    f.__name__: f
    for f in (
        full_scores, gate_summary, gate_breakdown, judge_summary, span_scores, id_sets, case_contracts, case_matcher, suite_outcomes, natural_checks, phrase_gate, evidence_completeness, reranked_topk, dense_positive,
        section_hint, budget_report, strategy_first, article_bypass, scope_resolution, citable_chunks, title_spans, entity_mentions,
    )
}
