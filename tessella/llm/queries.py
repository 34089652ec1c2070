"""The registered queries of problems 1-4 and 6-10, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm import encodings, forms, leakage, markup, packing, pieces, scans, tokens, truncation
from tessella.sources.tables import checkpointed, table


def fields(spark: SparkSession, folder: str, *sources: tuple[str, str, str]) -> DataFrame:
    """Rows ``table_name``, ``field_name``, ``record_id``, ``text`` of several tables' text fields."""
    out = None
    for name, key, field in sources:
        one = table(spark, folder, name).select(
            F.lit(name).alias("table_name"), F.lit(field).alias("field_name"), F.col(key).alias("record_id"), F.col(field).alias("text")
        )
        out = one if out is None else out.unionByName(one)
    return out


def once(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with one row for each key, the rows of a repeated key being alike; a null key is no key.

    Keys are counted first, without the texts. Only the few rows of keys that occur more
    than once are brought together.
    """
    again = df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1").select(*keys)
    return df.join(again, list(keys), "left_anti").unionByName(df.join(again, list(keys), "left_semi").dropDuplicates(list(keys)))


EXTRACTIONS = ("document_extractions", "version_id", "normalized_text")
CHUNKS = ("rag_chunks", "chunk_id", "text")
SECTIONS = ("rag_chunks", "chunk_id", "section")
QUESTIONS = ("questions", "id", "question")
BLOCKS = ("review_blocks", "block_id", "content.text")


CONVERSIONS = ("word_conversions", "id", "markdown_text")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose text holds markup."""
    f = fields(spark, folder, EXTRACTIONS, CONVERSIONS, CHUNKS)
    return markup.cleaned(f, ["table_name", "record_id"], "text", only_found=True).distinct()


def p1_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Every text of problem 1, clean and as blocks."""
    f = once(fields(spark, folder, EXTRACTIONS, CONVERSIONS, CHUNKS), "table_name", "record_id")
    return markup.cleaned(f, ["table_name", "record_id"], "text")


def _limits(spark: SparkSession, folder: str) -> dict[tuple[str, str, str], tuple[int, int, str]]:
    """The rows of ``size_limits``: a handful, one for each field and purpose."""
    rows = table(spark, folder, "size_limits").collect()
    return {(r.table_name, r.field_name, r.purpose): (r.max_size, r.overlap, r.unit) for r in rows}


def _pieces(spark: SparkSession, folder: str, single: bool = False) -> DataFrame:
    limits, out = _limits(spark, folder), None
    for source in (EXTRACTIONS, CHUNKS, SECTIONS):
        size, overlap, unit = limits[source[0], source[2], "piece"]
        f = fields(spark, folder, source)
        one = pieces.split(once(f, "record_id") if single else f, ["table_name", "field_name", "record_id"], "text", size, overlap, unit)
        out = one if out is None else out.unionByName(one)
    return out


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every extracted text, chunk text and chunk section."""
    return _pieces(spark, folder, single=True)


def p2_rejoined(spark: SparkSession, folder: str) -> DataFrame:
    """Every text put together again from its pieces, each without what it shares with the one before: its characters and hash."""
    own = F.when(F.col("piece_no") == 0, F.col("piece")).otherwise(F.substr("piece", F.col("before") - F.col("start") + 1))
    w = Window.partitionBy("table_name", "field_name", "record_id").orderBy("piece_no")  # the pieces of one text
    d = _pieces(spark, folder, single=True).withColumn("before", F.lag("stop").over(w)).select("table_name", "field_name", "record_id", "piece_no", own.alias("own"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "own"))), lambda x: x["own"]), "")
    return d.groupBy("table_name", "field_name", "record_id").agg(whole.alias("t")).select("table_name", "field_name", "record_id", F.length("t").alias("n_chars"), F.sha2("t", 256).alias("sha256"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records with a text above its limit: those that come out in more than one piece."""
    return _pieces(spark, folder).where("piece_no = 1").select("table_name", "field_name", "record_id").distinct()


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records of one table that look the same and differ in characters."""
    return forms.lookalikes(fields(spark, folder, QUESTIONS, EXTRACTIONS, BLOCKS), "record_id", "text", "table_name")


def p3_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every text of problem 3 in its one form."""
    f = once(fields(spark, folder, QUESTIONS, EXTRACTIONS, BLOCKS), "table_name", "record_id")
    return f.select("table_name", "record_id", forms.canonical_form("text").alias("form"))


def _scanned_fields(spark: SparkSession, folder: str) -> DataFrame:
    return fields(spark, folder, BLOCKS, ("receipts", "id", "first_three_pages_text"), EXTRACTIONS)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose text holds noise of scanning: those the editor changes."""
    return scans.repaired(_scanned_fields(spark, folder), ["table_name", "record_id"], "text", only_found=True).distinct()


def p4_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Every text of problem 4 repaired, with the number of edits of each kind."""
    return scans.repaired(once(_scanned_fields(spark, folder), "table_name", "record_id"), ["table_name", "record_id"], "text")


def _split_questions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "oracle_rows").select("id", "split").distinct()
    return table(spark, folder, "questions").select("id", "suite", "question").distinct().join(rows, "id")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a training and an evaluation question that ask the same."""
    pairs = leakage.overlaps(_split_questions(spark, folder), "id", "question", "split")
    return pairs.select(F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b")).distinct()


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    """For each evaluation split and suite and training suite: overlapping pairs and evaluation questions."""
    questions = _split_questions(spark, folder)
    pairs = leakage.overlaps(questions, "id", "question", "split")
    e = questions.select(F.col("id").alias("eval_id"), leakage.side_of(F.col("split")).alias("eval_split"), F.col("suite").alias("eval_suite")).distinct()
    t = questions.select(F.col("id").alias("train_id"), F.col("suite").alias("train_suite")).distinct()
    counts = pairs.join(e, "eval_id").join(t, "train_id").groupBy("eval_split", "eval_suite", "train_suite")
    return counts.agg(F.count("*").alias("n_pairs"), F.countDistinct("eval_id").alias("n_eval_questions"))


def _decoded_fields(spark: SparkSession, folder: str) -> DataFrame:
    """The fields of problem 7 with ``declared``, the encoding a conversion states."""
    conversions = table(spark, folder, "word_conversions")
    named = [F.lit("word_conversions").alias("table_name"), F.col("id").alias("record_id"), F.col("observations.html_encoding").alias("declared")]
    text = conversions.select(*named, F.lit("markdown_text").alias("field_name"), F.col("markdown_text").alias("text"))
    noted = conversions.select(*named, F.lit("observations.first_nonempty_paragraphs").alias("field_name"), F.explode("observations.first_nonempty_paragraphs").alias("text"))
    others = fields(spark, folder, ("receipts", "id", "pdf_text_first_800"), EXTRACTIONS).withColumn("declared", F.lit(None).cast("string"))
    return others.unionByName(text).unionByName(noted)


def p7_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Texts and paragraphs with wrongly decoded characters, as stored and as far as restored."""
    found = encodings.restored(_decoded_fields(spark, folder), ["table_name", "field_name", "record_id"], "text", "declared")
    return found.distinct()


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records that hold wrongly decoded characters."""
    found = encodings.restored(_decoded_fields(spark, folder), ["table_name", "field_name", "record_id"], "text", "declared")
    return found.select("table_name", "record_id").distinct()


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's token ids."""
    return tokens.encode_texts(table(spark, folder, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document, or of each part of one larger than a container."""
    capacity = _limits(spark, folder)["documents", "text", "container"][0]
    sizes = tokens.count_tokens(table(spark, folder, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "size", capacity)


def p9_filling(spark: SparkSession, folder: str) -> DataFrame:
    """How many containers are used and how full they are, beside the least possible number and that of plain best fit."""
    capacity = _limits(spark, folder)["documents", "text", "container"][0]
    sizes = checkpointed(tokens.count_tokens(table(spark, folder, "documents"), "doc_id", "text"))
    used = packing.pack(sizes, "doc_id", "size", capacity).groupBy("container").agg(F.sum("part_size").alias("used"))
    out = used.agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"))
    least = F.ceil(F.col("n_tokens") / capacity)
    out = out.withColumn("least_containers", least).withColumn("filled", F.round(F.col("n_tokens") / (F.col("n_containers") * capacity), 6))
    # Two rows of totals, one each.
    return out.crossJoin(packing.plain_containers(sizes, "doc_id", "size", capacity).select(F.col("n").alias("best_fit_containers")))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose text was cut."""
    return truncation.cut_texts(table(spark, folder, "documents"), "doc_id", "text", "source").where("cut").select("doc_id")


def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    """For each source its texts, its cut texts and their share."""
    rows = truncation.cut_texts(table(spark, folder, "documents"), "doc_id", "text", "source")
    counts = rows.groupBy("source").agg(F.count("*").alias("n_texts"), F.sum(F.col("cut").cast("long")).alias("n_cut"))
    return counts.withColumn("share", F.round(F.col("n_cut") / F.col("n_texts"), 6))


QUERIES = {"p1_found": p1_found, "p1_clean": p1_clean, "p2_pieces": p2_pieces, "p2_rejoined": p2_rejoined, "p2_found": p2_found, "p3_found": p3_found, "p3_forms": p3_forms, "p4_found": p4_found, "p4_repaired": p4_repaired, "p6_found": p6_found, "p6_counts": p6_counts, "p7_restored": p7_restored, "p7_found": p7_found, "p8_ids": p8_ids, "p9_containers": p9_containers, "p9_filling": p9_filling, "p10_found": p10_found, "p10_shares": p10_shares}
SQL: dict[str, str] = {
    "p2_found": """
with f as (
  select 'document_extractions' as table_name, 'normalized_text' as field_name, version_id as record_id, normalized_text as t from document_extractions
  union all select 'rag_chunks', 'text', chunk_id, text from rag_chunks
  union all select 'rag_chunks', 'section', chunk_id, section from rag_chunks)
select distinct f.table_name, f.field_name, f.record_id
from f join size_limits l on l.table_name = f.table_name and l.field_name = f.field_name and l.purpose = 'piece'
where length(f.t) > l.max_size
""",
    "p2_rejoined": """
select distinct 'document_extractions' as table_name, 'normalized_text' as field_name, version_id as record_id, length(normalized_text)::int as n_chars, sha256(normalized_text) as sha256 from document_extractions where normalized_text <> ''
union all select distinct 'rag_chunks', 'text', chunk_id, length(text)::int, sha256(text) from rag_chunks where text <> ''
union all select distinct 'rag_chunks', 'section', chunk_id, length(section)::int, sha256(section) from rag_chunks where section <> ''
""",
}
