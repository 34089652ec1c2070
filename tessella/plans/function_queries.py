"""Token estimates, labels, names, addresses, ordered codes and resolution of terms, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import local_name, normal_url, strict_day, token_estimate
from tessella.operators import graphs
from tessella.plans.ontology_queries import _NEAR
from tessella.plans.query import Compiler, Plan, Test
from tessella.plans.vocabulary import COMMERCE as V
from tessella.sources.tables import table


def token_estimates(spark: SparkSession, folder: str) -> DataFrame:
    """About how many tokens every document has: a unit for each run of ASCII word letters and for each other character."""
    return table(spark, folder, "documents").select("doc_id", token_estimate(F.col("text")).alias("n_tokens"))


def chosen_labels(spark: SparkSession, folder: str) -> DataFrame:
    """One label a document: its first title in Chinese, else its first title, else its own name."""
    v = table(spark, folder, "document_versions").select("document_id", "title").distinct()
    han = F.min(F.when(F.col("title").rlike("[一-鿿]"), F.col("title")))
    return v.groupBy("document_id").agg(F.coalesce(han, F.min("title"), F.first("document_id")).alias("label"))


def local_names(spark: SparkSession, folder: str) -> DataFrame:
    """The local names of all nodes of the graph, and how many nodes share each."""
    t = graphs.object_triples(V, spark, folder)
    nodes = t.select(F.col("s").alias("x")).unionByName(t.select(F.col("o").alias("x"))).distinct()
    return nodes.groupBy(local_name(F.col("x")).alias("name")).agg(F.count("*").alias("n"))


def address_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses named in documents that are the same but for case, default port, fragment, a trailing slash or the order of parameters."""
    d = table(spark, folder, "documents").where("text is not null").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+://[0-9A-Za-z./_?=&:#-]+)"), F.lit(1))).alias("url"))
    v = table(spark, folder, "document_versions").where("source_uri is not null").select(F.col("source_uri").alias("url"))
    return d.unionByName(v).groupBy(normal_url(F.col("url")).alias("address")).agg(F.count("*").alias("n"), F.count_distinct("url").alias("n_writings"))


def strict_days(spark: SparkSession, folder: str) -> DataFrame:
    """Days of versions that are written strictly, and how many are written otherwise, by field."""
    v = table(spark, folder, "document_versions").select("version_id", "issued_date", "effective_from", "withdrawn_date").distinct()
    d = v.select("version_id", F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("said")) for c in ("issued_date", "effective_from", "withdrawn_date")]))).where("said is not null")
    s = strict_day(F.col("said"))
    return d.groupBy("field").agg(F.count("*").alias("n"), F.count(s).alias("n_strict"), F.min(s).alias("first"), F.max(s).alias("last"))


def ordered_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of 'medium or less': the phrase names an order of codes, which becomes a list."""
    return Compiler(V, spark, folder).run(Plan("Order", tests=(Test("priority", "in", list(V.codes_for("priority", "medium or less"))),)))


def terms_resolved(spark: SparkSession, folder: str) -> DataFrame:
    """The words of titles and texts that name an entity of a small table or a class, by tier: equal, equal without case, begins."""
    terms = table(spark, folder, "customer").select(F.initcap(F.col("c_mktsegment")).alias("term")).unionByName(table(spark, folder, "nation").select(F.col("n_name").alias("term"))).unionByName(table(spark, folder, "orders").select(F.col("o_orderpriority").alias("term"))).distinct()
    names = table(spark, folder, "nation").select(F.lit("nation").alias("kind"), F.col("n_name").alias("name")).unionByName(table(spark, folder, "region").select(F.lit("region").alias("kind"), F.col("r_name").alias("name")))
    names = names.unionByName(spark.createDataFrame([("class", c) for c in V.classes()], "kind string, name string"))
    # Names and terms meet by their first four letters in lower case, whatever tier it is.
    a, b = terms.withColumn("g", F.lower(F.left("term", F.lit(4)))), names.withColumn("g", F.lower(F.left("name", F.lit(4))))
    met = a.join(b, "g")
    tier = F.when(F.col("term") == F.col("name"), 0).when(F.lower("term") == F.lower("name"), 1).when(F.startswith(F.lower("name"), F.lower("term")), 2)
    return met.select("term", "kind", "name", tier.alias("tier")).where("tier is not null")


def date_declarations(spark: SparkSession, folder: str) -> DataFrame:
    """Days that documents name, in one form, and how often each is written in each way."""
    d = table(spark, folder, "documents").where("text is not null")
    said = d.select(F.explode(F.regexp_extract_all("text", F.lit("((?:19|20)[0-9]{2}(?:年[0-9]{1,2}月[0-9]{1,2}日|-[0-9]{1,2}-[0-9]{1,2}|/[0-9]{1,2}/[0-9]{1,2}))"), F.lit(1))).alias("said"))
    from tessella.functions.dates import day

    way = F.when(F.contains("said", F.lit("年")), "han").when(F.contains("said", F.lit("/")), "slash").otherwise("dash")
    return said.groupBy(day(F.col("said")).alias("day"), way.alias("way")).agg(F.count("*").alias("n"))


_NORM = "regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*')) || regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), '^(http://[^/:]*):80(/|$)', '\\1\\2'), '^(https://[^/:]*):443(/|$)', '\\1\\2'), '^$', '')"
_DAYS = "case when regexp_full_match(said, '\\d{4}-\\d{2}-\\d{2}') then try_cast(said as date) end"
SQL = {
    "token_estimates": "select doc_id, case when text is null then null else (len(regexp_extract_all(text, '[A-Za-z0-9_-]+')) + length(regexp_replace(text, '[A-Za-z0-9_-]+', '', 'g')))::int end as n_tokens from documents",
    "chosen_labels": "select document_id, coalesce(min(title) filter (regexp_matches(title, '[\\x{4e00}-\\x{9fff}]')), min(title), document_id) as label from document_versions group by 1",
    "local_names": f"with t as ({_NEAR}), n as (select s as x from t union select o from t) select regexp_extract(x, '([^#/]*)$', 1) as name, count(*) as n from n group by 1",
    "address_groups": f"with u as (select unnest(regexp_extract_all(text, '[A-Za-z]+://[0-9A-Za-z./_?=&:#-]+')) as url from documents union all select source_uri from document_versions where source_uri is not null), p as (select url, regexp_extract(url, '\\?([^#]*)', 1) as q from u) select {_NORM} || case when q <> '' then '?' || array_to_string(list_sort(string_split(q, '&')), '&') else '' end as address, count(*) as n, count(distinct url) as n_writings from p group by 1",
    "strict_days": f"with v as (select distinct version_id, issued_date, effective_from, withdrawn_date from document_versions), d as (select 'issued_date' as field, issued_date as said from v union all select 'effective_from', effective_from from v union all select 'withdrawn_date', withdrawn_date from v) select field, count(*) as n, count({_DAYS}) as n_strict, min({_DAYS}) as first, max({_DAYS}) as last from d where said is not null group by 1",
    "ordered_codes": "select 'orders/' || o_orderkey as entity from orders where o_orderpriority in ('3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')",
    "terms_resolved": f"with t as (select distinct upper(left(c_mktsegment, 1)) || lower(substring(c_mktsegment, 2)) as term from customer union select n_name from nation union select o_orderpriority from orders), n as (select 'nation' as kind, n_name as name from nation union all select 'region', r_name from region union all select 'class', x from (values {', '.join(f'({c!r})' for c in V.classes())}) c(x)) select * from (select term, kind, name, case when term = name then 0 when lower(term) = lower(name) then 1 when starts_with(lower(name), lower(term)) then 2 end as tier from t join n on lower(left(term, 4)) = lower(left(name, 4))) where tier is not null",
    "date_declarations": "with s as (select unnest(regexp_extract_all(text, '(?:19|20)[0-9]{2}(?:年[0-9]{1,2}月[0-9]{1,2}日|-[0-9]{1,2}-[0-9]{1,2}|/[0-9]{1,2}/[0-9]{1,2})')) as said from documents), p as (select said, regexp_extract_all(said, '[0-9]+') as x from s) select try_cast(x[1] || '-' || lpad(x[2], 2, '0') || '-' || lpad(x[3], 2, '0') as date) as day, case when contains(said, '年') then 'han' when contains(said, '/') then 'slash' else 'dash' end as way, count(*) as n from p group by 1, 2",
}
QUERIES = {f.__name__: f for f in (token_estimates, chosen_labels, local_names, address_groups, strict_days, ordered_codes, terms_resolved, date_declarations)}
