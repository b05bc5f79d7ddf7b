"""The tables that the registered queries start from.

Sections are the lines of a document. Retrieval units (chunks) are whole documents, whose evidence is known by the md5 of the
text, so that copies of a text are one piece of evidence. The questions are the passages of `benchmark`; what a
passage requires are the texts that contain it. What many queries need (weights, rankings, labels) is a shared part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import retrieval, substring
from . import parts
from .parts import part


#: Ways to refer to an article: a range, plainly, in a law outside, to itself, in another instrument, in this one, in the companion, in a chapter, by an alias.
REFERENCES = (
    "see Articles ({n}) to ({m})", "as directed in Article ({n})", "under Article ({n}) of the Central Bank Law", "within this Article ({n})", "under Article ({n}) of the Other Code",
    "under Article ({n}) of this Regulation", "under Article ({n}) of the Standards", "under Article ({n}) of Chapter II", "under Article ({n}) of the Financial Regulations",
)


#: Documents that go by names of their own where references are resolved.
NAMED = {"4": "INS-FIN-001", "5": "INS-FIN-002", "13": "INS-TAK-013"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buckets(spark: SparkSession, sf_dir: str) -> int:
    return parts.buckets_of(spark, sf_dir, ("documents",))


def sections(spark, sf_dir) -> DataFrame:
    """doc_id (string), ord, section, evidence_id, text, title, source."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("n", "text"))
    section = F.concat(F.lit("P"), (F.col("n") + 1).cast("string"))
    key = F.col("doc_id").cast("string")
    return d.select(key.alias("doc_id"), (F.col("n") + 1).alias("ord"), section.alias("section"), F.concat_ws("::", key, section).alias("evidence_id"), "text", F.col("source").alias("title"), "source")


def chunks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.md5("text").alias("evidence_id"), "text", "source")


def questions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def containing(spark, sf_dir) -> DataFrame:
    return part(spark, sf_dir, "containing", _containing)


def _containing(spark, sf_dir) -> DataFrame:
    """query_id, idx: the documents that contain a passage as it stands.

    Candidates come from an equi-join on the passage's longest inner token (the first and the last may be cut words),
    or, for passages of under three tokens, from an index of grams; then the text is looked at. An empty passage is in no document.
    """
    tokens = text.tokenize(F.col("query"))
    inner = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 2, F.lit(0)))
    longest = F.element_at(F.array_sort(F.transform(inner, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), 1)["t"]
    keyed = questions(spark, sf_dir).withColumn("key", F.when(F.size(inner) > 0, longest))
    docs = chunks(spark, sf_dir).select("idx", "text")
    holds = F.col("text").contains(F.col("query"))
    # ids meet first, so that a text is read once, however many of its tokens are asked for
    tokens_of = docs.select("idx", F.explode(F.array_distinct(text.tokenize(F.col("text")))).alias("key"))
    near = tokens_of.join(keyed.where("key is not null").select("query_id", "key"), "key").select("query_id", "idx")
    found = near.join(docs, "idx").join(keyed.select("query_id", "query"), "query_id").where(holds).select("query_id", "idx")
    short = keyed.where("key is null and query <> ''").select("query_id", "query")
    if short.take(1):
        listed = substring.gram_index(docs, "idx")
        near = substring.candidates(listed, substring.gram_counts(listed), short.select("query_id", F.col("query").alias("term")), "query_id", "idx")
        found = found.unionByName(near.join(docs, "idx").join(short, "query_id").where(holds).select("query_id", "idx"))
    return found.distinct()


def grams(spark, sf_dir) -> DataFrame:
    """gram, evidence_id of the sections, bucketed by gram."""
    return part(spark, sf_dir, "grams", lambda s, d: substring.gram_index(sections(s, d), "evidence_id").repartition(buckets(s, d), "gram"), ("documents",), by="gram")


def gram_counts(spark, sf_dir) -> DataFrame:
    return part(spark, sf_dir, "gram_counts", lambda s, d: substring.gram_counts(grams(s, d)), ("documents",))


def labels(spark, sf_dir) -> DataFrame:
    """query_id, evidence_id, gain: 2 for required texts, 1 for the text of the next document (helpful)."""
    c = chunks(spark, sf_dir).select("idx", "evidence_id")
    inside = containing(spark, sf_dir)
    required = inside.join(c, "idx").select("query_id", "evidence_id", F.lit(2).alias("gain"))
    helpful = inside.select("query_id", (F.col("idx") + 1).alias("idx")).join(c, "idx").select("query_id", "evidence_id", F.lit(1).alias("gain"))
    return required.unionByName(helpful).groupBy("query_id", "evidence_id").agg(F.max("gain").alias("gain"))


def categorised(spark, sf_dir) -> DataFrame:
    """query_id, query, category by the number of containing documents."""
    n = containing(spark, sf_dir).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("n").isNull(), "unanswerable").when(F.col("n") == 1, "single_hop").otherwise("cross_document")
    return questions(spark, sf_dir).join(n, "query_id", "left").select("query_id", "query", kind.alias("category"))


def posted(spark, sf_dir) -> DataFrame:
    """idx, dl, term, tf of all postings, bucketed by chunk."""
    return part(spark, sf_dir, "posted", lambda s, d: retrieval.posted_with_lengths(chunks(s, d), buckets(s, d)), ("documents",), by="idx")


def corpus_size(spark, sf_dir) -> DataFrame:
    return part(spark, sf_dir, "size", lambda s, d: retrieval.corpus_size(posted(s, d)).coalesce(1), ("documents",))


def term_statistics(spark, sf_dir) -> DataFrame:
    return part(spark, sf_dir, "terms", lambda s, d: retrieval.statistics_of(posted(s, d), corpus_size(s, d)), ("documents",))


def search(spark, sf_dir):
    """BM25 over the kept postings, as a ranking system of any questions."""
    return lambda asked, k: retrieval.bm25_of(posted(spark, sf_dir), term_statistics(spark, sf_dir), corpus_size(spark, sf_dir), chunks(spark, sf_dir), asked, k)


def lexical(spark, sf_dir, k=10) -> DataFrame:
    """A ranking is a prefix of any deeper one, so one of DEPTH is kept."""
    if k > retrieval.DEPTH:
        return search(spark, sf_dir)(questions(spark, sf_dir), k)
    return part(spark, sf_dir, "lexical", lambda s, d: search(s, d)(questions(s, d), retrieval.DEPTH)).where(F.col("rank") <= k)


def dense(spark, sf_dir, k=10) -> DataFrame:
    if k > retrieval.DEPTH:
        return retrieval.hashed_dense(chunks(spark, sf_dir), questions(spark, sf_dir), k, posted=posted(spark, sf_dir))
    return part(spark, sf_dir, "dense", lambda s, d: retrieval.hashed_dense(chunks(s, d), questions(s, d), retrieval.DEPTH, posted=posted(s, d))).where(F.col("rank") <= k)


def fused(spark, sf_dir, k=10) -> DataFrame:
    return retrieval.fuse([lexical(spark, sf_dir, 100), dense(spark, sf_dir, 100)], k)


def with_evidence(found: DataFrame, spark, sf_dir) -> DataFrame:
    return found.join(chunks(spark, sf_dir).select("idx", "evidence_id"), "idx")


def referring(spark, sf_dir) -> DataFrame:
    """Sections whose texts are made to refer to others: the tables' own prose has no references.

    Section n of a document is Article n, and each refers to an article in one of REFERENCES; the first is a range. Documents
    2k and 2k + 1 are a regulation and its standards. Some go by NAMED: what aliases lead to, and a document whose aliases lead to the counterpart.
    """
    s = sections(spark, sf_dir)
    doc = F.col("doc_id").cast("long")
    n = F.pmod(doc + F.col("ord"), F.lit(7)) + 1
    form = F.element_at(F.array(*map(F.lit, REFERENCES)), (F.pmod(doc + F.col("ord") * 3, F.lit(len(REFERENCES))) + 1).cast("int"))
    body = F.replace(F.replace(form, F.lit("{n}"), n.cast("string")), F.lit("{m}"), (n + 2).cast("string"))
    title = F.concat(F.lit("Topic "), F.floor(doc / 2).cast("string"), F.when(F.pmod(doc, F.lit(2)) == 0, " Regulation").otherwise(" Standards"))
    name = F.coalesce(*(F.when(F.col("doc_id") == old, new) for old, new in NAMED.items()), F.col("doc_id"))
    return s.select(name.alias("doc_id"), F.concat(F.lit("Article "), F.col("ord").cast("string")).alias("section"), "ord", F.concat(body, F.lit(", "), F.col("text")).alias("text"), title.alias("doc_title"))


def commencements(spark, sf_dir) -> DataFrame:
    """doc_id, commenced: dates derived from the id, every eleventh unknown."""
    d = table(spark, sf_dir, "documents")
    date = F.date_add(F.to_date(F.lit("2024-01-01")), F.pmod("doc_id", F.lit(60)).cast("int"))
    return d.select("doc_id", F.when(F.pmod("doc_id", F.lit(11)) != 0, date).alias("commenced"))


def first_place(found: DataFrame) -> DataFrame:
    return found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("r = 1").drop("r")
