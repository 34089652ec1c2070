"""Problem 5 over the fund-regulation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.dates import day
from tessella.operators.asof import asof_join
from tessella.sources.tables import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each question and document with the version issued and in force on the question's day."""
    q = table(spark, folder, "questions").select(F.col("id").alias("event_id"), F.explode("doc_ids").alias("entity"), day(F.col("as_of")).alias("at"))
    v = table(spark, folder, "document_versions").select(
        F.col("document_id").alias("entity"),
        F.col("version_id").alias("change_id"),
        day(F.col("issued_date")).alias("recorded"),
        day(F.col("effective_from")).alias("start"),
        day(F.col("withdrawn_date")).alias("end"),
        # A date that is written but names no day is unknown, not open: such a version is never in force.
        (F.col("effective_from").isNotNull() & day(F.col("effective_from")).isNull()).alias("bad_start"),
        (F.col("withdrawn_date").isNotNull() & day(F.col("withdrawn_date")).isNull()).alias("bad_end"),
    ).where("not bad_start and not bad_end")
    return asof_join(q, v).select(F.col("event_id").alias("question_id"), F.col("entity").alias("document_id"), F.col("change_id").alias("version_id"))


def _sql_day(c: str) -> str:
    c = f"translate(trim({c}), '０１２３４５６７８９－／', '0123456789-/')"
    digits = f"regexp_replace(regexp_replace(trim({c}), '[-/.年月]', '-', 'g'), '日$', '')"
    return (
        f"coalesce(try_cast(try_strptime({digits}, '%Y-%m-%d') as date),"
        f" case when regexp_full_match(trim({c}), '[0-9]{{8}}') then try_cast(try_strptime(trim({c}), '%Y%m%d') as date) end)"
    )


SQL = {
    "p5_found": f"""
with q as (select distinct id as question_id, unnest(doc_ids) as document_id, {_sql_day("as_of")} as d from questions),
v as (select distinct document_id, version_id, {_sql_day("issued_date")} as i, {_sql_day("effective_from")} as f, {_sql_day("withdrawn_date")} as w,
  effective_from as ef, withdrawn_date as wd from document_versions)
select question_id, document_id, version_id from (
  select q.question_id, q.document_id, v.version_id,
    row_number() over (partition by q.question_id, q.document_id order by v.i desc, v.version_id desc) as n
  from q join v on q.document_id = v.document_id
  where v.i <= q.d and (v.ef is null or v.f <= q.d) and (v.wd is null or v.w > q.d)) where n = 1
"""
}
QUERIES = {"p5_found": p5_found}
