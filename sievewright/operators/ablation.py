"""Ablations: several settings of an index in one plan, with the setting as a part of every key.

Chunks of all settings are cut from one reading of the texts, weighed, ranked and scored side by side. What BM25 takes
from the whole corpus (number of chunks, mean length, mean idf) is taken of each setting's. Chunks are several times their texts, and their
postings more, so neither is dealt or written: chunks are made twice, once to count in and once to be scored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources import scratch
from . import metrics, scored
from .retrieval import ASKED, EPSILON, K1, B, posted_with_lengths, query_terms


def frequencies(chunks: DataFrame, key: str = "setting", told: dict[str, Column] | None = None) -> DataFrame:
    """chunks (key, idx, text) -> key, term, df, dl and the counts `told`; in a key's row of a null term df counts its chunks, dl their tokens, and each of `told` the chunks for which it holds."""
    told = told or {}
    tokens = chunks.select(key, text.tokenize(F.coalesce("text", F.lit(""))).alias("t"), *(c.alias(n) for n, c in told.items()))
    terms = F.array_append(F.array_distinct("t"), F.lit(None).cast("string"))
    each = tokens.select(key, F.size("t").alias("dl"), *told, F.explode(terms).alias("term"))
    whole = F.col("term").isNull()
    counts = (F.count_if(whole & F.col(n)).alias(n) for n in told)
    return each.groupBy(key, "term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(whole, F.col("dl"))).alias("dl"), *counts)


class Weights(NamedTuple):
    """BM25's weights by group and term."""

    idf: np.ndarray
    avgdl: np.ndarray

    def __call__(self, grp, term, tf, dl):
        return self.idf[grp, term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / self.avgdl[grp]))


def keyed_bm25(chunks: DataFrame, questions: DataFrame, k: int, key: str = "setting", counted: DataFrame | None = None) -> DataFrame:
    """chunks (key, idx long, text) -> key, query_id, idx, score, rank: the top k of each question in each setting.

    As retrieval.bm25, with unmatched chunks in the order of idx behind the others. Settings are few: a row for each is sent to every task.
    `counted` are the frequencies of chunks, where they are written already.
    """
    counted = scratch.written(frequencies(chunks, key), "frequencies") if counted is None else counted
    size = F.broadcast(counted.where("term is null").select(key, F.col("df").alias("chunks"), (F.col("dl") / F.col("df")).alias("avgdl")))
    df = counted.where("term is not null").join(size, key)
    raw = df.select(key, "term", (F.log(F.col("chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = F.broadcast(raw.groupBy(key).agg(F.avg("raw").alias("mean")))
    idf = raw.join(mean, key).select(key, "term", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    asked = scratch.written(query_terms(questions).join(idf, "term"), "asked")
    if asked.limit(ASKED + 1).count() <= ASKED:
        numbers, named = scored.numbered(asked.select("term"), "number"), scored.numbered(asked.select("query_id"), "question")
        groups = scored.numbered(size.select(key), "grp")
        terms = [r.term for r in numbers.orderBy("number").collect()]
        weights = np.zeros((max(1, groups.count()), max(1, len(terms))))
        for r in asked.select(key, "term", "idf").distinct().join(numbers, "term").join(groups, key).select("grp", "number", "idf").collect():
            weights[r.grp, r.number] = r.idf
        avgdl = np.ones(len(weights))
        for r in size.join(groups, key).select("grp", "avgdl").collect():
            avgdl[r.grp] = r.avgdl or 1
        told = query_terms(questions).join(F.broadcast(numbers), "term").join(F.broadcast(named), "query_id").select("question", F.col("number").alias("term"), F.col("n").alias("weight"))
        tokens = chunks.join(F.broadcast(groups), key).select("grp", "idx", text.tokenize(F.coalesce("text", F.lit(""))).alias("tokens"))
        found = scratch.written(scored.best_of_tokens(tokens, terms, Weights(weights, avgdl), told, k, len(weights)).join(F.broadcast(groups), "grp"), "found")
        sums = found.join(F.broadcast(named), "question").select(key, "query_id", "idx", "score")
        first = found.where("question is null").select(key, "idx")
    else:
        posted = posted_with_lengths(chunks, int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
        weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        hits = posted.join(asked, [key, "term"]).join(size, key)
        sums = hits.groupBy(key, "query_id", "idx").agg(F.sum(F.col("n") * weight).alias("score"))
        first = chunks.select(key, "idx")
    order = Window.partitionBy(key, "query_id").orderBy(F.desc(F.round("score", 9)), "idx")
    best = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")
    best = scratch.written(best, "best")
    # the first k unmatched chunks that a question can need are among the first k of the setting
    head = first.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("idx"))).where(F.col("n") <= k).drop("n")
    spare = questions.where(F.size(text.tokenize(F.col("query"))) > 0).select("query_id").crossJoin(F.broadcast(head))  # k rows a setting
    spare = spare.join(best.select(key, "query_id", "idx"), [key, "query_id", "idx"], "left_anti").select(key, "query_id", "idx", F.lit(0.0).alias("score"))
    return best.unionByName(spare).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def keyed_scores(results: DataFrame, labels: DataFrame, questions: DataFrame, settings: DataFrame, ks=(1, 3, 5, 10), key: str = "setting") -> DataFrame:
    """results (key, query_id, evidence_id, rank) -> key, query_id, k and the metrics, for every question in every setting (a row each in `settings`)."""
    both = F.struct(key, "query_id")
    every = F.broadcast(settings.select(key))
    each = lambda rows: rows.crossJoin(every).withColumn("query_id", both).drop(key)
    scores = metrics.score(results.withColumn("query_id", both).drop(key), each(labels), each(questions.select("query_id")), ks)
    return scores.select(f"query_id.{key}", F.col("query_id.query_id").alias("query_id"), "k", *metrics.METRICS)


def keyed_means(scores: DataFrame, questions: DataFrame, k: int = 10, key: str = "setting") -> DataFrame:
    """key, n, recall, full_recall, mrr at k over answerable questions (query_id, category)."""
    asked = questions.where("category <> 'unanswerable'").select("query_id")
    chosen = scores.where(F.col("k") == k).join(asked, "query_id")
    return chosen.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *(F.avg(m).alias(m) for m in ("recall", "full_recall", "mrr")))
