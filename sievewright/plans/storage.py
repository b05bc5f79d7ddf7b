"""Registered queries of sources and sinks: tables are written in the formats of the readers to the shared folder and read back.

Each has its SQL in all_sql, which knows the tables only. On a cluster without a shared folder these queries raise.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import readers, scratch, writers
from ..streaming import postings
from . import catalogue as Q
from . import corpus as C
from .catalogue import out, query
from .sql import BASE
from .sql import all_sql as catalogue_sql


def _folder(spark, label: str) -> str:
    path = scratch.path(spark, label)
    if path is None:
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return path


@query
def chunks_round_trip(spark, sf):
    """Documents as chunk records, written as JSON lines and read with their metadata."""
    key = F.col("doc_id").cast("string")
    meta = F.struct(F.col("source").alias("title"), F.col("lang").alias("code"), F.pmod("doc_id", F.lit(5)).cast("int").alias("order"), F.char_length("text").cast("int").alias("chars"))
    rows = C.table(spark, sf, "documents").select(F.concat(key, F.lit("::P")).alias("chunk_id"), key.alias("doc_id"), F.lit("P").alias("section"), "text", meta.alias("metadata"))
    path = _folder(spark, "chunks")
    writers.json_lines(rows, path)
    back = readers.chunks(spark, path)
    return out(back.select("chunk_id", "evidence_id", F.md5("text").alias("digest"), "metadata.title", "metadata.code", F.col("metadata.order").alias("place"), F.col("metadata.chars").alias("chars")))


@query
def numbered_lines(spark, sf):
    """The documents' lines as text files; each line is read with its number in its file, which it was given when it was written."""
    path = _folder(spark, "lines")
    dealt = C.sections(spark, sf).select("evidence_id").repartition(4, "evidence_id")
    dealt.select(F.concat_ws("|", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).cast("string"), "evidence_id").alias("value")).write.text(path)
    parts = F.split("value", r"\|", 2)
    back = readers.numbered_lines(spark, path).select(F.get(parts, 1).alias("evidence_id"), (F.get(parts, 0).cast("long") + 1 == F.col("line")).alias("in_place"))
    return out(back)


@query
def questions_loaded(spark, sf):
    """Questions among comments, blank lines, retired ones and ones of low confidence."""
    i = F.col("item_id")
    evidence = F.array(F.struct(F.concat(F.lit(" D"), i.cast("string")).alias("doc_id"), F.lit("P1 ").alias("section")))
    record = F.struct(
        F.concat(F.lit("Q"), i.cast("string")).alias("id"), F.col("text").alias("question"), F.lit("single_hop").alias("category"), evidence.alias("required_evidence"),
        F.struct(F.when(F.pmod(i, F.lit(4)) == 0, "low").when(F.pmod(i, F.lit(4)) == 1, "high").alias("confidence")).alias("provenance"), (F.pmod(i, F.lit(7)) == 0).alias("retired"),
    )
    lines = C.table(spark, sf, "benchmark").select(F.explode(F.array(F.lit("// a comment"), F.to_json(record), F.lit("  "))).alias("value"))
    path = _folder(spark, "questions")
    lines.write.text(path)
    back = readers.questions(spark, path)
    return out(back.select("id", F.md5("question").alias("digest"), F.array_join("required", ",").alias("required"), F.size("helpful").alias("helpful"), "confidence"))


@query
def registry_loaded(spark, sf):
    """The catalogue as CSV, validated, with the commencement of each document."""
    i = F.col("doc_id").cast("int")
    date = lambda n: F.date_format(F.date_add(F.to_date(F.lit("2024-01-01")), F.pmod(i, F.lit(n))), "yyyy-MM-dd")
    key = F.col("doc_id").cast("string")
    rows = C.table(spark, sf, "documents").select(
        key.alias("doc_id"), F.concat(F.lit(' A "quoted", title of '), "source").alias("title"), F.concat(F.lit("https://x.org/"), key).alias("url"),
        F.when(F.pmod(i, F.lit(3)) == 0, date(90)).otherwise("").alias("commencement_date"), F.when(F.pmod(i, F.lit(5)) != 0, date(60)).otherwise("").alias("effective_date"),
    )
    path = _folder(spark, "registry")
    rows.write.option("header", True).option("escape", '"').csv(path)
    back = readers.registry(spark, path)
    return out(back.select("doc_id", "title", "url").join(readers.commencements(back), "doc_id"))


@query
def file_manifest(spark, sf):
    """Files of up to 100 ids each: size and sha-256 of every one."""
    path = _folder(spark, "files")
    ids = C.table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 100).alias("bucket"), "doc_id")
    ids.repartition("bucket").sortWithinPartitions("bucket", "doc_id").select("bucket", F.col("doc_id").cast("string").alias("value")).write.partitionBy("bucket").text(path)
    found = readers.manifest(spark, f"{path}/bucket=*")
    return out(found.select(F.regexp_extract("path", "bucket=([0-9]+)", 1).cast("long").alias("bucket"), "bytes", "sha256"))


@query
def cached_vectors(spark, sf):
    """A cache that has half of the keys is asked for all: the others are computed and kept, the first stay as they were."""
    path = _folder(spark, "cache")
    d = C.table(spark, sf, "documents").select("doc_id", F.md5("text").alias("key"))
    compute = lambda tag: lambda new: new.select("key", F.concat(F.lit(tag), F.substring("key", 1, 6)).alias("value"))
    readers.cached(spark, path, d.where(F.col("key") < "8"), "key", compute("first "))
    return out(readers.cached(spark, path, d, "key", compute("second ")))


@query
def report_texts(spark, sf):
    """A small aggregate as a Markdown table and as a JSON report."""
    rows = C.table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), (F.sum("n_chars") / F.count(F.lit(1))).alias("mean")).orderBy("lang")
    return spark.createDataFrame([("markdown", writers.markdown(rows)), ("json", writers.report(rows.select("lang", "n")))], "kind string, body string")


@query
def redacted_export(spark, sf):
    """The export's citations without their excerpts, with a reason for some."""
    found = C.with_evidence(C.lexical(spark, sf), spark, sf).join(C.chunks(spark, sf).select("idx", "text"), "idx")
    each = F.struct("rank", "evidence_id", F.substring("text", 1, 40).alias("excerpt"))
    records = found.groupBy("query_id").agg(F.array_sort(F.collect_list(each)).alias("citations"))
    reasons = C.questions(spark, sf).where("query_id % 3 = 0").select("query_id", F.concat(F.lit("asked for "), F.col("query_id").cast("string")).alias("reason"))
    return out(writers.redact(records, reasons).select("query_id", "reason", F.to_json("citations").alias("citations")))


@query
def pages_read(spark, sf):
    """Pages as files of their own, read whole."""
    path = _folder(spark, "pages")
    C.table(spark, sf, "pages").select(F.coalesce("html", F.lit("")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    back = readers.html_pages(spark, path, ".txt")
    whole = F.regexp_replace("html", r"\n\z", "")  # the writer ends each record with a line
    return out(back.groupBy(F.md5(whole).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("files")))


@query
def reports_found(spark, sf):
    """Reports among JSON files, some of which are of another kind."""
    path = _folder(spark, "reports")
    each = F.transform(F.array_sort(F.collect_list("query_id")), lambda q: F.struct(q.alias("id")))
    rows = C.questions(spark, sf).groupBy(F.pmod("query_id", F.lit(6)).alias("system")).agg(each.alias("q"))
    kinds = rows.select("system", F.when(F.col("system") != 2, F.concat(F.lit("system "), F.col("system").cast("string"))).alias("retriever"), F.when(F.col("system") != 4, F.col("q")).alias("per_question"))
    kinds.write.option("maxRecordsPerFile", 1).json(path)
    return out(readers.reports(spark, path).select("system", "retriever", F.size("per_question").alias("questions")))


@query
def streamed_bm25(spark, sf):
    """BM25 over postings that arrived as a stream of the documents' files."""
    path, schema = f"{sf}/documents.parque[t]", C.table(spark, sf, "documents").schema  # a pattern, as the table may be a file or a folder
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path).select(F.col("doc_id").alias("idx"), "text")
    to = _folder(spark, "stream")
    postings.postings_stream(stream, f"{to}/posted", f"{to}/checkpoint").awaitTermination()
    return Q._found(postings.bm25(postings.arrived(spark, f"{to}/posted"), C.questions(spark, sf), 10))


def all_sql() -> dict[str, str]:
    return {
        "chunks_round_trip": "SELECT doc_id || '::P' AS chunk_id, doc_id || '::P' AS evidence_id, md5(text) AS digest, source AS title, lang AS code, doc_id % 5 AS place, length(text) AS chars FROM documents",
        "numbered_lines": BASE + "x AS (SELECT 1) SELECT evidence_id, true AS in_place FROM secs",
        "questions_loaded": "SELECT 'Q' || item_id AS id, md5(text) AS digest, 'D' || item_id || '::P1' AS required, 0::BIGINT AS helpful, 'high' AS confidence FROM benchmark WHERE item_id % 4 <> 0 AND item_id % 7 <> 0",
        "registry_loaded": """SELECT doc_id::VARCHAR AS doc_id, 'A "quoted", title of ' || source AS title, 'https://x.org/' || doc_id AS url,
          CASE WHEN doc_id % 3 = 0 THEN DATE '2024-01-01' + (doc_id % 90)::INTEGER WHEN doc_id % 5 <> 0 THEN DATE '2024-01-01' + (doc_id % 60)::INTEGER END AS commenced FROM documents""",
        "streamed_bm25": catalogue_sql()["bm25_topk"],
        "pages_read": "SELECT md5(coalesce(html, '')) AS digest, count(*) AS n, count(*) AS files FROM pages GROUP BY 1",
        "reports_found": "SELECT item_id % 6 AS system, 'system ' || item_id % 6 AS retriever, count(*) AS questions FROM benchmark WHERE item_id % 6 NOT IN (2, 4) GROUP BY item_id % 6",
        "file_manifest": "SELECT doc_id // 100 AS bucket, strlen(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id)) + 1 AS bytes, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id) || chr(10)) AS sha256 FROM documents GROUP BY 1",
        "cached_vectors": "SELECT doc_id, md5(text) AS key, CASE WHEN md5(text) < '8' THEN 'first ' ELSE 'second ' END || substr(md5(text), 1, 6) AS value FROM documents",
        "report_texts": """WITH g AS (SELECT lang, count(*) AS n, sum(n_chars) / count(*) AS mean FROM documents GROUP BY lang)
          SELECT 'markdown' AS kind, '| lang | n | mean |' || chr(10) || '|---|---|---|' || string_agg(chr(10) || '| ' || coalesce(lang, '') || ' | ' || n || ' | ' || printf('%.3f', mean) || ' |', '' ORDER BY lang) AS body FROM g
          UNION ALL SELECT 'json', '[' || string_agg('{"lang": "' || lang || '", "n": ' || n || '}', ', ' ORDER BY lang) || ']' FROM g""",
        "redacted_export": BASE + """x AS (SELECT 1) SELECT query_id, CASE WHEN query_id % 3 = 0 THEN 'asked for ' || query_id END AS reason,
          '[' || string_agg('{"rank":' || rank || ',"evidence_id":"' || evidence_id || '"}', ',' ORDER BY rank) || ']' AS citations FROM lex10 JOIN chunks USING (idx) GROUP BY query_id""",
    }
