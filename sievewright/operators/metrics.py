"""Ranking metrics over retrieved and labelled evidence, and their aggregates.

A ranked table is cut at k rows first and its repeats are dropped after that, so repeats spend the budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut_then_distinct(results: DataFrame, k: int | None) -> DataFrame:
    """results (query_id, evidence_id, rank) -> the same with place: 1.. among the distinct evidence of the first k rows."""
    top = results if k is None else results.where(F.col("rank") <= k)
    first = top.groupBy("query_id", "evidence_id").agg(F.min("rank").alias("rank"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def score(results: DataFrame, labels: DataFrame, questions: DataFrame, ks=(1, 3, 5, 10)) -> DataFrame:
    """query_id, k, recall, precision, full_recall, ndcg, mrr for every question, all cuts in one pass.

    labels (query_id, evidence_id, gain): gain 2 is required, 1 is helpful. Without required evidence recall and
    full recall are 1 and mrr 0. mrr looks at all rows of results.
    """
    whole = 2**31 - 1  # the cut that keeps all rows
    labelled = labels.groupBy("query_id", "evidence_id").agg(F.max("gain").alias("gain"))
    wanted = labelled.groupBy("query_id").agg(F.count_if(F.col("gain") == 2).alias("required"), F.sort_array(F.collect_list("gain"), asc=False).alias("gains"))
    cuts = F.explode(F.array(*map(F.lit, sorted({*ks, whole}))))
    first = results.select("query_id", "evidence_id", "rank", cuts.alias("k")).where(F.col("rank") <= F.col("k")).groupBy("query_id", "k", "evidence_id").agg(F.min("rank").alias("rank"))
    placed = first.join(labelled, ["query_id", "evidence_id"], "left").withColumn("place", F.row_number().over(Window.partitionBy("query_id", "k").orderBy("rank")))
    gain = F.coalesce("gain", F.lit(0)) / F.log2(F.col("place") + 1.0)
    hit = F.col("gain") == 2
    per = placed.groupBy("query_id", "k").agg(F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("n"), F.sum(gain).alias("dcg"), F.min(F.when(hit, F.col("place"))).alias("first"))
    # one row a question, its cuts in a map
    packed = per.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("hits", "n", "dcg", "first")))).alias("cuts"))
    rows = questions.select("query_id").join(wanted, "query_id", "left").join(packed, "query_id", "left")
    rows = rows.select("*", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    at, whole_cut = F.try_element_at("cuts", F.col("k")), F.try_element_at("cuts", F.lit(whole))
    required, hits, n = F.coalesce("required", F.lit(0)), F.coalesce(at["hits"], F.lit(0)), F.coalesce(at["n"], F.lit(0))
    ideal = F.aggregate(F.transform(F.slice(F.coalesce("gains", F.array().cast("array<int>")), F.lit(1), F.col("k")), lambda g, i: g / F.log2(i + 2.0)), F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        "query_id", "k",
        F.when(required == 0, 1.0).otherwise(hits / required).alias("recall"),
        F.when(n == 0, 0.0).otherwise(hits / n).alias("precision"),
        F.when(required == 0, 1.0).otherwise((hits == required).cast("double")).alias("full_recall"),
        F.when(ideal == 0, 0.0).otherwise(F.coalesce(at["dcg"], F.lit(0.0)) / ideal).alias("ndcg"),
        F.coalesce(1.0 / whole_cut["first"], F.lit(0.0)).alias("mrr"),
    )


METRICS = ("recall", "precision", "full_recall", "ndcg", "mrr")


def by_category(scores: DataFrame, questions: DataFrame) -> DataFrame:
    """category, k, n and the mean of each metric; the row of category `all` is the mean over all questions."""
    joined = scores.join(questions.select("query_id", "category"), "query_id")
    means = [F.avg(m).alias(m) for m in METRICS]
    each = joined.groupBy("category", "k").agg(F.count(F.lit(1)).alias("n"), *means)
    total = joined.groupBy(F.lit("all").alias("category"), "k").agg(F.count(F.lit(1)).alias("n"), *means)
    return each.unionByName(total)


def answerable_means(scores: DataFrame, questions: DataFrame) -> DataFrame:
    """k, n, metric means over answerable questions, and noise: mean precision over the unanswerable ones."""
    joined = scores.join(questions.select("query_id", "category"), "query_id")
    ok = F.col("category") != "unanswerable"
    means = [F.coalesce(F.avg(F.when(ok, F.col(m))), F.lit(0.0)).alias(m) for m in METRICS]
    noise = F.coalesce(F.avg(F.when(~ok, F.col("precision"))), F.lit(0.0)).alias("noise")
    return joined.groupBy("k").agg(F.count_if(ok).alias("n"), *means, noise)


def abstention_correct(required: DataFrame, answered: DataFrame) -> DataFrame:
    """query_id, correct: no evidence required and not answered, or both."""
    return required.join(answered, "query_id").select("query_id", ((F.col("n_required") == 0) != F.col("answered")).alias("correct"))


def score_spread(top: DataFrame) -> DataFrame:
    """top (answerable, score) -> answerable, n, low, middle, high."""
    return top.groupBy("answerable").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.median("score").alias("middle"), F.max("score").alias("high"))


def worst(top: DataFrame, n: int = 5) -> DataFrame:
    """The unanswerable questions of the highest scores."""
    return top.where("not answerable").orderBy(F.desc("score"), "key").limit(n)


def moved(a: DataFrame, b: DataFrame, key: str = "query_id", value: str = "value") -> DataFrame:
    """key, before, after of every question whose value changed."""
    pair = a.select(key, F.col(value).alias("before")).join(b.select(key, F.col(value).alias("after")), key)
    return pair.where("before <> after")


def before_after(a: DataFrame, b: DataFrame, questions: DataFrame, key: str = "query_id", value: str = "value") -> DataFrame:
    """category, n, before, after: means by category. questions (key, category)."""
    pair = a.select(key, F.col(value).alias("before")).join(b.select(key, F.col(value).alias("after")), key).join(questions.select(key, "category"), key)
    return pair.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg("before").alias("before"), F.avg("after").alias("after"))


def completeness(required: DataFrame, found: DataFrame) -> DataFrame:
    """required, found (query_id, evidence_id) -> outcome, n: questions whose required sections were all found, in part or not at all."""
    wanted = required.select("query_id", "evidence_id").distinct()
    met = wanted.join(found.select("query_id", "evidence_id").distinct().withColumn("met", F.lit(1)), ["query_id", "evidence_id"], "left")
    per = met.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"), F.count("met").alias("met"))
    outcome = F.when(F.col("met") == F.col("wanted"), "complete").when(F.col("met") > 0, "partial").otherwise("total_miss")
    return per.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def discordant(a: DataFrame, b: DataFrame, key: str = "query_id", value: str = "value") -> DataFrame:
    """improved, worsened, unchanged between two tables of (key, value)."""
    pair = a.select(key, F.col(value).alias("before")).join(b.select(key, F.col(value).alias("after")), key)
    return pair.agg(F.count_if(F.col("after") > F.col("before")).alias("improved"), F.count_if(F.col("after") < F.col("before")).alias("worsened"), F.count_if(F.col("after") == F.col("before")).alias("unchanged"))
