"""Postings kept up to date from a stream of documents, and rankings over what has arrived (an extension: the batch operators don't need it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import retrieval


def postings_stream(documents: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """documents (idx, text), a stream, -> the postings of each batch, with their chunks' lengths, appended under its own folder of out.

    A batch that is run again overwrites its own folder, so every document is posted once.
    """

    def write(batch: DataFrame, number: int) -> None:
        retrieval.posted_with_lengths(batch.select("idx", "text")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrived(spark: SparkSession, out: str) -> DataFrame:
    """idx, dl, term, tf of all batches that are whole."""
    return spark.read.parquet(out).select("idx", "dl", "term", "tf")


def bm25(posted: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """BM25 over the postings that have arrived: numbers of chunks, lengths and idf are those of now."""
    size = retrieval.corpus_size(posted)
    chunks = posted.select("idx").distinct()
    return retrieval.bm25_of(posted, retrieval.statistics_of(posted, size), size, chunks, questions, k)
