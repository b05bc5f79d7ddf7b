"""Readers: chunks, sections, questions, registry, pages, embeddings and contexts, as DataFrames of fixed schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METADATA = ("section_title string, section_heading string, parent_heading string, doc_title string, title string, doc_type string, url string, effective_date string, "
            "status string, code string, parent_doc_id string, commencement_date string, effective_date_source string, labelling_eligible string, context string, `order` int, chars int, part int, parts int")
CHUNKS = f"chunk_id string, doc_id string, section string, text string, metadata struct<{', '.join(f'{n}: {t}' for n, t in (x.strip().rsplit(' ', 1) for x in METADATA.split(',')))}>"
EVIDENCE = "array<struct<doc_id: string, section: string, why: string>>"
QUESTIONS = (f"id string, question string, category string, difficulty string, required_evidence {EVIDENCE}, helpful_evidence {EVIDENCE}, answer_sketch string, "
             "provenance struct<source: string, labelled_on: string, minutes_to_label: double, confidence: string>, retired boolean")
REGISTRY_COLUMNS = ("doc_id", "title", "url")


def _missing(e: Exception) -> bool:
    return "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value: every line of text files with its number in its file.

    A file may be split over tasks. Lines are counted in each split, and a split's first line follows those of the splits before it:
    what is put together is a row for each split, not a line.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    splits = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    splits = splits.select("file", "block", (before - F.col("first") + 1).alias("shift"))
    return rows.join(splits, ["file", "block"]).select("file", (F.col("at") + F.col("shift")).alias("line"), "value")


def json_records(spark: SparkSession, path: str, schema: str, comments: str | None = None) -> DataFrame:
    """file, line, record (a struct of the schema), bad (the line where it isn't such JSON): blank lines, and those that begin with `comments`, are left out."""
    lines = numbered_lines(spark, path).where("trim(value) <> ''")
    if comments:
        lines = lines.where(~F.ltrim("value").startswith(comments))
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.select("file", "line", parsed.alias("record")).select("file", "line", F.col("record").dropFields("_corrupt_record").alias("record"), F.col("record._corrupt_record").alias("bad"))


def _first_bad(records: DataFrame) -> None:
    bad = records.where("bad is not null").orderBy("file", "line").select("file", "line").first()
    if bad:
        raise ValueError(f"{bad.file}:{bad.line}: not valid JSON")


def json_lines(spark: SparkSession, path: str, schema: str, missing_ok: bool = False) -> DataFrame:
    """Blank lines are skipped; a missing path is an error of Spark's reader, or an empty table if that is asked for."""
    try:
        lines = spark.read.text(path)
    except Exception as e:
        if missing_ok and _missing(e):
            return spark.createDataFrame([], schema)
        raise
    rows = lines.where("trim(value) <> ''")
    return rows.select(F.from_json("value", schema).alias("r")).select("r.*")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks or sections; raises ValueError where there are none, and, with file and line, where one isn't JSON."""
    records = json_records(spark, path, CHUNKS)
    _first_bad(records)
    rows = records.select("record.*")
    if not rows.take(1):
        raise ValueError(f"{path} holds no chunks")
    return rows.withColumn("evidence_id", F.concat_ws("::", "doc_id", "section"))


def questions(spark: SparkSession, path: str, low_confidence: bool = False) -> DataFrame:
    """Questions in use. Blank lines and // lines are skipped, retired ones and, unless asked for, those of low confidence left out.

    Raises ValueError, with the line, where one isn't JSON, and where none is left.
    """
    records = json_records(spark, path, QUESTIONS, comments="//")
    _first_bad(records)
    rows = records.select("record.*").where(~F.coalesce("retired", F.lit(False)))
    confidence = F.coalesce("provenance.confidence", F.lit("high"))
    rows = rows.withColumn("confidence", confidence)
    rows = rows if low_confidence else rows.where("confidence <> 'low'")
    if not rows.take(1):
        raise ValueError(f"{path} holds no questions in use")
    key = lambda c: F.transform(F.coalesce(c, F.array().cast(EVIDENCE)), lambda e: F.concat_ws("::", F.trim(e["doc_id"]), F.trim(e["section"])))
    return rows.select("id", "question", "category", "difficulty", key("required_evidence").alias("required"), key("helpful_evidence").alias("helpful"), "confidence")


def registry_rows(spark: SparkSession, path: str) -> DataFrame:
    """The document catalogue as it stands, without any check."""
    rows = spark.read.csv(path, header=True, encoding="UTF-8", escape='"', multiLine=True)  # quotes are doubled
    return rows.toDF(*(c.lstrip("﻿").strip() for c in rows.columns))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The document catalogue; raises ValueError where it breaks a rule."""
    rows = registry_rows(spark, path)
    if missing := [c for c in REGISTRY_COLUMNS if c not in rows.columns]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    rows = rows.select(*(F.coalesce(F.trim(c), F.lit("")).alias(c) for c in rows.columns))
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc_id") == "").alias("blank"), F.countDistinct("doc_id").alias("ids"), F.count_if(~F.col("url").rlike("^https?://[^/]+")).alias("urls")).first()
    for wrong, what in ((not n.n, "is empty"), (n.blank, "has rows without doc_id"), (n.ids < n.n, "repeats a doc_id"), (n.urls, "has a url that isn't absolute")):
        if wrong:
            raise ValueError(f"{path} {what}")
    return rows


def commencements(rows: DataFrame) -> DataFrame:
    """doc_id, commenced: commencement date, else effective date; null where both are blank."""
    date = F.nullif(F.trim(F.coalesce(F.nullif("commencement_date", F.lit("")), "effective_date")), F.lit(""))
    return rows.select("doc_id", F.try_to_date(date).alias("commenced"))


def html_pages(spark: SparkSession, path: str, suffix: str = ".html") -> DataFrame:
    """doc_id (the file's name), html; one row a file."""
    return spark.read.text(path, wholetext=True, pathGlobFilter=f"*{suffix}").select(F.regexp_extract(F.input_file_name(), rf"([^/]+){suffix}$", 1).alias("doc_id"), F.col("value").alias("html"))


def missing_pages(pages: DataFrame, registered: DataFrame) -> DataFrame:
    """doc_id of registered documents that have no page."""
    return registered.select("doc_id").join(pages.select("doc_id"), "doc_id", "left_anti")


def corpus_digest(rows: DataFrame, key: str, value: str) -> str:
    """One sha-256 over the sha-256 of every row, in the order of the key: a changed, moved or missing row changes it.

    Rows are reduced to a digest each before they are put in order; 4,096 of these by the key's hash, then all of them.
    """
    each = rows.select(F.xxhash64(key).alias("h"), F.col(key).cast("string").alias("k"), F.sha2(F.concat_ws("\0", F.col(key).cast("string"), value), 256).alias("d"))
    parts = each.groupBy(F.pmod("h", F.lit(4096)).alias("p")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "d"))), lambda x: x["d"]), ""), 256).alias("d"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda x: x["d"]), ""), 256).alias("d")).first().d


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of every file under path."""
    return spark.read.format("binaryFile").load(path).select(F.col("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports among the JSON files of a folder: those that have both a retriever and per_question."""
    rows = spark.read.json(path, multiLine=True)
    if not {"retriever", "per_question"} <= set(rows.columns):
        return spark.createDataFrame([], "retriever string")
    return rows.where("retriever is not null and per_question is not null")


def cached(spark: SparkSession, path: str, rows: DataFrame, key: str, compute) -> DataFrame:
    """rows with the values that the table at path has for their keys; the missing ones are computed and appended.

    A table that isn't there or can't be read counts as empty; one that can't be read is written anew.
    """
    known, mode = None, "append"
    try:
        known = spark.read.parquet(path).select(key)
        known.take(1)
    except Exception as e:
        known = None
        mode = "append" if _missing(e) else "overwrite"
    new = rows if known is None else rows.join(known, key, "left_anti")
    compute(new.dropDuplicates([key])).write.mode(mode).parquet(path)
    return rows.join(spark.read.parquet(path), key, "left")


def migrate_keys(old: DataFrame, texts: DataFrame) -> DataFrame:
    """old (text, value) -> key, value only where the text belongs to a single chunk. texts (key, text)."""
    single = texts.groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key")).where("n = 1").select("text", "key")
    return single.join(old, "text").select("key", "value")
