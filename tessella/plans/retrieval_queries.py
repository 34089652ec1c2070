"""Retrieval, chunking and tokenisation queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.text import content_id, retrieval_tokens
from tessella.operators import retrieval
from tessella.sources.tables import table

K = 10


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text", "title", "fund_code")


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """The stated query set: every document whose id is divisible by 20, asked for by its title."""
    return _docs(spark, folder).where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "title")


def _text_channel(spark: SparkSession, folder: str, k: int = K) -> DataFrame:
    return retrieval.bm25(_asked(spark, folder), _docs(spark, folder), "query_id", "title", "doc_id", "text", k)


def _title_channel(spark: SparkSession, folder: str, k: int = K) -> DataFrame:
    return retrieval.bm25(_asked(spark, folder), _docs(spark, folder), "query_id", "title", "doc_id", "title", k)


def tokenize_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and occurrences of every retrieval token."""
    return retrieval.postings(_docs(spark, folder), "doc_id", "text").groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def corpus_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a token, tokens in all and their mean number."""
    d = _docs(spark, folder).select(F.size(retrieval_tokens(F.col("text"))).alias("dl")).where("dl > 0")
    return d.agg(F.count("*").alias("n"), F.sum("dl").alias("total"), F.round(F.avg("dl"), 6).alias("avgdl"))


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The best documents for every title asked."""
    return _text_channel(spark, folder)


def bm25_scoped(spark: SparkSession, folder: str) -> DataFrame:
    """The same, of one fund's documents only; statistics stay those of all."""
    scope = _docs(spark, folder).where("fund_code = 'SF00417'").select(F.col("doc_id").alias("d"))
    return retrieval.bm25(_asked(spark, folder), _docs(spark, folder), "query_id", "title", "doc_id", "text", K, scope)


def parent_child_bm25(spark: SparkSession, folder: str) -> DataFrame:
    """The best documents by their best child."""
    return retrieval.parent_child(_asked(spark, folder), _docs(spark, folder), "query_id", "title", "doc_id", "text", K)


def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest vectors by cosine of every vector whose id is divisible by 20."""
    e = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return retrieval.dense(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", "vec_id", "embedding", K)


def rrf_fuse(spark: SparkSession, folder: str) -> DataFrame:
    """Texts and titles fused by reciprocal ranks."""
    return retrieval.fuse([(_text_channel(spark, folder, 50), 1.0), (_title_channel(spark, folder, 50), 1.0)], K)


def weighted_rrf(spark: SparkSession, folder: str) -> DataFrame:
    """The same with weights."""
    return retrieval.fuse([(_text_channel(spark, folder, 50), 0.8), (_title_channel(spark, folder, 50), 2.5)], K)


def chunk_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of 400 characters, 80 of them shared with the window before, with content ids."""
    d = _docs(spark, folder).where("length(text) > 0").withColumn("n", F.length("text"))
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - 81, F.lit(0)), F.lit(320))
    c = d.select("doc_id", "text", F.posexplode(starts).alias("chunk_no", "start"), "n")
    piece = F.substr("text", F.col("start") + 1, F.lit(400))
    return c.select("doc_id", "chunk_no", "start", F.least(F.col("start") + 400, F.col("n")).alias("stop"), F.sha2(piece, 256).alias("sha256"))


def chunk_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Sections of Markdown texts: a heading's line to the next heading, and what precedes the first."""
    t = table(spark, folder, "word_conversions").select("id", "markdown_text").distinct().where("length(markdown_text) > 0")
    lines = t.select("id", F.length("markdown_text").alias("n"), F.posexplode(F.split("markdown_text", "\n")).alias("k", "line"))
    order = Window.partitionBy("id").orderBy("k")
    lines = lines.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    heads = lines.where((F.col("k") == 0) | F.col("line").rlike(r"^#{1,6}[ \t]+\S"))
    return heads.select("id", F.col("start").cast("long").alias("start"), F.coalesce(F.lead("start").over(order), F.col("n")).cast("long").alias("stop"))


def chunk_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Content ids of chunks, and how many chunks share each."""
    c = table(spark, folder, "rag_chunks").select("chunk_id", "version_id", "text").distinct()
    return c.select(content_id("chunk-", F.col("version_id"), F.col("text")).alias("content_id")).groupBy("content_id").agg(F.count("*").alias("n"))


_BLANK = r"\s\x{00a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"
_TOK = (
    "list_concat(list_transform(regexp_extract_all({t}, '[A-Za-z0-9]+'), lambda x: lower(x)), flatten(list_transform(list_filter(list_transform(regexp_split_to_array({t}, '[A-Za-z0-9]+'), "
    "lambda s: regexp_replace(s, '^[" + _BLANK + "]+|[" + _BLANK + "]+$', '', 'g')), lambda s: length(s) > 1), lambda s: list_transform(range(1, length(s)), lambda i: substring(s, i, 2)))))"
)


def _tok(column: str) -> str:
    return _TOK.replace("{t}", column)


def _bm25_sql(field: str, k: int, scope: str = "true") -> str:
    return f"""
select q, d, score, rk from (select q, d, score, row_number() over (partition by q order by score desc, d) as rk from (
  with t as (select doc_id as d, fund_code, {_tok(field)} as toks from documents where {field} is not null),
  l as (select d, fund_code, len(toks) as dl, toks from t where len(toks) > 0),
  s as (select count(*) as n, avg(dl) as avgdl from l),
  p as (select d, fund_code, dl, token, count(*) as tf from (select d, fund_code, dl, unnest(toks) as token from l) group by all),
  f as (select token, count(*) as df from p group by 1),
  a as (select distinct q, token from (select doc_id as q, unnest({_tok("title")}) as token from documents where doc_id % 20 = 0 and title is not null))
  select q, d, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score
  from a join p using (token) join f using (token) cross join s where {scope} group by q, d)) where rk <= {k}
"""


_PARENT_SQL = f"""
with recursive c as (
  select doc_id as d, text, length(text) as n, 0::bigint as a, 0::bigint as b from documents where length(text) > 0
  union all
  select d, text, n, b, case when b + 240 < n and length(regexp_extract(substring(text, b + 1, 240), '^(.*[。！？.!?；;\n])', 1, 's')) >= 120
    then b + length(regexp_extract(substring(text, b + 1, 240), '^(.*[。！？.!?；;\n])', 1, 's')) else least(n, b + 240) end from c where b < n),
u as (select d, a, substring(text, a + 1, b - a) as t from c where b > a),
l as (select d, a, len(toks) as dl, toks from (select d, a, {_tok("t")} as toks from u) where len(toks) > 0),
s as (select count(*) as n, avg(dl) as avgdl from l),
p as (select d, a, dl, token, count(*) as tf from (select d, a, dl, unnest(toks) as token from l) group by all),
f as (select token, count(*) as df from p group by 1),
k as (select distinct q, token from (select doc_id as q, unnest({_tok("title")}) as token from documents where doc_id % 20 = 0 and title is not null)),
r as (select q, d, max(score) as score from (
  select q, d, a, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score
  from k join p using (token) join f using (token) cross join s group by q, d, a) group by q, d)
select q, d, score, rk from (select q, d, score, row_number() over (partition by q order by score desc, d) as rk from r) where rk <= {K}
"""


def _fused_sql(a: float, b: float) -> str:
    return (
        f"select q, d, score, rk from (select q, d, score, row_number() over (partition by q order by score desc, d) as rk from (select q, d, round(sum(part), 8) as score from ("
        f"select q, d, {a} / (60.0::double + rk) as part from ({_bm25_sql('text', 50)}) union all select q, d, {b} / (60.0::double + rk) from ({_bm25_sql('title', 50)})) group by q, d)) where rk <= {K}"
    )


SQL: dict[str, str] = {
    "tokenize_counts": f"select token, count(*) as df, sum(tf)::bigint as cf from (select doc_id, token, count(*) as tf from (select doc_id, unnest({_tok("text")}) as token from documents where text is not null) group by all) group by 1",
    "corpus_statistics": f"select count(*) as n, sum(len(t))::bigint as total, round(avg(len(t)), 6) as avgdl from (select {_tok("text")} as t from documents where text is not null) where len(t) > 0",
    "bm25_topk": _bm25_sql("text", K),
    "bm25_scoped": _bm25_sql("text", K, "fund_code = 'SF00417'"),
    "parent_child_bm25": _PARENT_SQL,
    "dense_topk": f"select q, d, score, rk from (select q, d, score, row_number() over (partition by q order by score desc, d) as rk from (select a.vec_id as q, b.vec_id as d, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a, embeddings b where a.vec_id % 20 = 0)) where rk <= {K}",
    "rrf_fuse": _fused_sql(1.0, 1.0),
    "weighted_rrf": _fused_sql(0.8, 2.5),
    "chunk_windows": "select doc_id, ((s) / 320)::int as chunk_no, s::int as start, least(s + 400, n)::int as stop, sha256(substring(text, (s + 1)::int, 400)) as sha256 from (select doc_id, text, length(text) as n, unnest(range(0, greatest(length(text) - 81, 0) + 1, 320)) as s from documents where length(text) > 0)",
    "chunk_sections": "with t as (select distinct id, markdown_text as m from word_conversions where length(markdown_text) > 0), l as (select id, length(m) as n, unnest(string_split(m, chr(10))) as line, generate_subscripts(string_split(m, chr(10)), 1) as k from t), o as (select *, coalesce(sum(length(line) + 1) over (partition by id order by k rows between unbounded preceding and 1 preceding), 0) as start from l), h as (select * from o where k = 1 or regexp_matches(line, '^#{1,6}[ \\t]+\\S')) select id, start::bigint as start, coalesce(lead(start) over (partition by id order by k), n)::bigint as stop from h",
    "chunk_hashes": "with c as (select distinct chunk_id, version_id, text from rag_chunks) select 'chunk-' || sha256(case when version_id is null then 'n' else 'v' || length(version_id) || ':' || version_id end || '|' || case when text is null then 'n' else 'v' || length(text) || ':' || text end) as content_id, count(*) as n from c group by 1",
}

QUERIES = {
    f.__name__: f
    for f in (tokenize_counts, corpus_statistics, bm25_topk, bm25_scoped, parent_child_bm25, dense_topk, rrf_fuse, weighted_rrf, chunk_windows, chunk_sections, chunk_hashes)
}
