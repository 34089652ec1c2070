"""Versioned corpora: manifests checked row by row, immutable versions, snapshots as of a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.dates import day
from tessella.functions.text import content_id
from tessella.sources.tables import existing, table

#: What a version may be and who may speak in a trusted snapshot.
STATUS = ("verified", "unverified", "quarantined")
AUTHORITY = ("authoritative_original", "research_note", "synthetic")


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """One row a version, with its dates as days ``issued``, ``effective``, ``withdrawn``."""
    v = table(spark, folder, "document_versions").drop("acquired_at").distinct()
    return v.withColumns({"issued": day(F.col("issued_date")), "effective": day(F.col("effective_from")), "withdrawn": day(F.col("withdrawn_date"))})


def valid_on(on: Column, undated: bool = False) -> Column:
    """Whether a version was issued and in force on a day; ``undated`` lets versions without an issue date pass."""
    issued = F.coalesce(F.col("issued") <= on, F.lit(undated) & F.col("issued_date").isNull())
    started = F.col("effective_from").isNull() | F.coalesce(F.col("effective") <= on, F.lit(False))
    running = F.col("withdrawn_date").isNull() | F.coalesce(F.col("withdrawn") > on, F.lit(False))
    return issued & started & running


def manifest_errors(rows: DataFrame) -> DataFrame:
    """``version_id``, ``error`` for every demand a manifest row fails; a row without errors does not come out."""
    checks = {
        "title": F.col("title").isNull() | (F.trim("title") == ""),
        "publisher": F.col("publisher").isNull(),
        "source_uri": ~F.coalesce(F.col("source_uri").rlike("^[a-z]+://.+"), F.lit(False)),
        "sha256": ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "issued_date": F.col("issued_date").isNotNull() & ~F.col("issued_date").rlike(r"^\d{4}-\d{2}-\d{2}$"),
        "status": ~F.coalesce(F.col("status").isin(*STATUS), F.lit(False)),
        "authority": ~F.coalesce(F.col("authority").isin(*AUTHORITY), F.lit(False)),
    }
    errors = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return rows.select("version_id", F.explode(errors).alias("error"))


def version_ids(rows: DataFrame) -> DataFrame:
    """``version_id`` and the id its content gives it: equal content, equal id."""
    return rows.select("version_id", content_id("ver-", F.col("document_id"), F.col("sha256"), F.col("issued_date")).alias("content_id"))


def new_versions(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming versions whose content is not stored yet: importing twice adds nothing."""
    return version_ids(incoming).join(version_ids(stored).select("content_id"), "content_id", "left_anti")


def snapshot(spark: SparkSession, folder: str, on: str, trusted: bool = True) -> DataFrame:
    """Members of a snapshot: of each document the version in force on a day, issued last.

    A trusted snapshot takes verified original versions only. One aggregate, no join.
    """
    v = versions(spark, folder).where(valid_on(F.lit(on).cast("date"), undated=not trusted))
    if trusted:
        v = v.where("status = 'verified' and authority = 'authoritative_original'")
    best = F.max(F.struct(F.coalesce("issued", F.lit("0001-01-01").cast("date")).alias("i"), "version_id")).alias("b")
    return v.groupBy("document_id").agg(best).select("document_id", F.col("b.version_id").alias("version_id"))


# -- imports with a record of their runs -----------------------------------------------------
def import_manifest(rows: DataFrame, store: str, run: str) -> str:
    """Import a manifest into ``store``, all or nothing, and record the run; returns its status.

    Every row is checked first. With an error, or without a row, nothing but a failed run is
    written. Else rows whose content is not stored yet are appended, of equal ones the first by id,
    and the run says how many were inserted and reused. Rows are put down under the run's own name
    and only the run's record makes them part of the store, so a run that dies half way leaves none.
    """
    spark = rows.sparkSession
    n, errors = rows.count(), manifest_errors(rows).count()
    status, inserted = ("failed", 0) if errors or not n else ("completed", 0)
    if status == "completed":
        ids = rows.join(version_ids(rows), "version_id")
        first = ids.groupBy("content_id").agg(F.min("version_id").alias("version_id"))
        fresh = ids.join(first, ["content_id", "version_id"], "left_semi")
        if (kept := stored(spark, store)) is not None:
            fresh = fresh.join(kept.select("content_id"), "content_id", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{store}/versions/run={run}")
        inserted = spark.read.parquet(f"{store}/versions/run={run}").count()
    record = [(run, status, n, errors, inserted, n - inserted if status == "completed" else 0)]
    spark.createDataFrame(record, "run string, status string, n_rows long, n_errors long, n_inserted long, n_reused long").coalesce(1).write.mode("append").parquet(f"{store}/runs")
    return status


def stored(spark: SparkSession, store: str) -> DataFrame | None:
    """The versions of all completed runs of a store; None where nothing is stored."""
    if not existing(spark, f"{store}/runs"):
        return None
    runs = [r.run for r in spark.read.parquet(f"{store}/runs").where("status = 'completed'").select("run").collect()]
    return spark.read.parquet(*[f"{store}/versions/run={r}" for r in runs]) if runs else None


# -- snapshots -------------------------------------------------------------------------------
#: Kinds of snapshots.
KINDS = ("trusted", "research", "regression")


def admitted(kind: str) -> Column:
    """Whether a snapshot of a kind may hold a version."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    free = F.col("status") != "quarantined"
    rule = {
        "trusted": (F.col("authority") == "authoritative_original") & (F.col("status") == "verified") & F.col("issued").isNotNull(),
        "research": (F.col("authority") == "research_note") & free,
        "regression": (F.col("authority") == "synthetic") & free,
    }[kind]
    return F.coalesce(rule, F.lit(False))


def publication_errors(members: DataFrame, known: DataFrame, kind: str) -> DataFrame:
    """``version_id``, ``error`` of members (``document_id``, ``version_id``) that a snapshot of a kind may not hold: unknown, of another kind, a second version of a document."""
    d = members.select("version_id").distinct().join(known.select("version_id", "document_id", admitted(kind).alias("ok")), "version_id", "left")
    many = d.groupBy("document_id").agg(F.count_distinct("version_id").alias("n")).where("n > 1").select("document_id")
    wrong = d.select("version_id", F.when(F.col("ok").isNull(), "unknown").when(~F.col("ok"), "kind").alias("error")).where("error is not null")
    return wrong.unionByName(d.join(many, "document_id", "left_semi").select("version_id", F.lit("second version").alias("error")))


def membership(members: DataFrame) -> DataFrame:
    """``n_members``, ``members_sha256`` of a set of versions, however ordered: a hash of the hashes of 4096 sorted buckets."""
    m = members.select("version_id").distinct().groupBy(F.substring(F.sha2("version_id", 256), 1, 3).alias("b"))
    b = m.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("version_id")), "\n"), 256).alias("h"), F.count("*").alias("n"))
    line = F.concat_ws(":", "b", "h")
    return b.agg(F.sum("n").alias("n_members"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("members_sha256"))


def published(members: DataFrame, known: DataFrame, kind: str) -> DataFrame:
    """``kind``, ``n_members``, ``members_sha256`` of a snapshot; a member it may not hold, or none at all, raises."""
    if bad := publication_errors(members, known, kind).limit(1).collect():
        raise ValueError(f"version {bad[0].version_id}: {bad[0].error}")
    if members.isEmpty():
        raise ValueError("a snapshot needs a member")
    return membership(members).select(F.lit(kind).alias("kind"), "n_members", "members_sha256")


def publish(members: DataFrame, known: DataFrame, kind: str, name: str, path: str) -> DataFrame:
    """Store a snapshot under a name for good. The same membership again changes nothing; another one raises."""
    spark = members.sparkSession
    now = published(members, known, kind).first()
    if existing(spark, f"{path}/{name}/record"):
        kept = spark.read.parquet(f"{path}/{name}/record").first()
        if (kept.kind, kept.members_sha256) != (now.kind, now.members_sha256):
            raise ValueError(f"snapshot {name} has another membership")
    else:
        members.select("document_id", "version_id").distinct().write.mode("overwrite").parquet(f"{path}/{name}/members")
        spark.createDataFrame([now], "kind string, n_members long, members_sha256 string").write.parquet(f"{path}/{name}/record")
    return spark.read.parquet(f"{path}/{name}/members")


def verified(spark: SparkSession, folder: str, members: DataFrame) -> DataFrame:
    """``version_id``, ``violation``, ``n`` of a snapshot's members, recomputed from what is stored; nothing comes out of a sound one."""
    m = members.select("version_id")
    e = table(spark, folder, "document_extractions").select("version_id", F.col("normalized_text").alias("t")).distinct()
    c = table(spark, folder, "rag_chunks").select("chunk_id", "version_id", "text").distinct()
    own, parts = m.join(e, "version_id"), m.join(c, "version_id")
    one = lambda d, v: d.select("version_id", F.lit(v).alias("violation"), F.lit(1).cast("long").alias("n"))
    many = lambda d, v: d.groupBy("version_id").agg(F.count("*").alias("n")).select("version_id", F.lit(v).alias("violation"), "n")
    found = one(m.join(e.select("version_id"), "version_id", "left_anti"), "no extraction")
    found = found.unionByName(one(own.where(F.col("t").isNull() | (F.trim("t") == "")), "empty text"))
    found = found.unionByName(one(m.join(c.select("version_id"), "version_id", "left_anti"), "no chunk"))
    found = found.unionByName(many(parts.where("text is null"), "chunk without text"))
    return found.unionByName(many(parts.where("text is not null").join(e.where("t is not null"), "version_id").where(~F.contains("t", "text")), "foreign chunk"))


# -- catalogue -------------------------------------------------------------------------------
def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """``version_id``, ``state``, ``reasons``: whether a version is ready for import, only converted, only downloaded or unresolved, and what it lacks."""
    got = table(spark, folder, "receipts").groupBy("version_id").agg(F.max(((F.col("http_status") == 200) & (F.col("byte_count") > 0)).cast("int")).alias("got"))
    said = table(spark, folder, "document_extractions").groupBy("version_id").agg(F.max((F.col("normalized_text").isNotNull() & (F.trim("normalized_text") != "")).cast("int")).alias("said"))
    d = versions(spark, folder).join(got, "version_id", "left").join(said, "version_id", "left").fillna(0, ["got", "said"])
    lacks = {
        "no receipt": F.col("got") == 0, "no text": F.col("said") == 0, "not verified": ~F.coalesce(F.col("status") == "verified", F.lit(False)), "no original": ~F.coalesce(F.col("authority") == "authoritative_original", F.lit(False)),
        "no publisher": F.col("publisher").isNull(), "no issue date": F.col("issued").isNull(),
    }
    reasons = F.array_join(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in lacks.items()]), lambda x: x.isNotNull()), ", ")
    state = F.when(F.col("reasons") == "", "ready").when(F.col("said") == 1, "converted_unverified").when(F.col("got") == 1, "downloaded").otherwise("unresolved")
    return d.withColumn("reasons", reasons).select("version_id", state.alias("state"), "reasons").distinct()
