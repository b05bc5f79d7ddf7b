"""Resampling statistics: bootstrap intervals, paired comparison, AUC, abstention curve, interaction, medians."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch

ROUNDS, AUC_ROUNDS = 10_000, 4_000


#: Draws that a row of the plan stands for before they become rows themselves.
DRAWS = 4_096


def placed(values: DataFrame) -> DataFrame:
    """values (key, value) as a table (place from 0 in the order of keys, value)."""
    upto = running(values.select("key", F.col("value").cast("double").alias("value"), F.lit(1).alias("one")), "key", "one")
    return scratch.written(upto.select((F.col("upto_one") - 1).alias("place"), "value"), "placed")


def drawn(table: DataFrame, seed: str, rounds: int) -> DataFrame:
    """A placed table -> (round from 1, value): in each round as many rows as the table has, drawn with replacement.

    The draw of a round is md5 of seed, round and number: the same in any engine. Rounds are dealt over tasks in pieces of DRAWS, and
    a draw finds its value by a join on the place, for which Spark sends the table to every task where it is small.
    """
    spark = table.sparkSession
    n = table.count()
    pieces = -(-n // DRAWS)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rounds * n // 2_000_000)
    piece = spark.range(0, rounds * pieces, 1, tasks).select((F.floor(F.col("id") / max(pieces, 1)) + 1).alias("round"), (F.pmod("id", F.lit(max(pieces, 1))) * DRAWS).alias("before"))
    each = piece.select("round", F.explode(F.sequence(F.col("before") + 1, F.least(F.col("before") + DRAWS, F.lit(n)))).alias("i"))
    text = F.concat_ws(":", F.lit(seed), F.col("round").cast("string"), F.col("i").cast("string"))
    place = F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(max(n, 1)))
    return each.select("round", place.alias("place")).join(table, "place").select("round", "value")


def interval(column: str, rounds: int) -> tuple[Column, Column]:
    """Aggregates of one value a round: the ends of the middle 95 %. As many values as there are rounds are sorted, whatever the table's size."""
    at = lambda i: F.get(F.sort_array(F.collect_list(column)), i)
    return at(int(0.025 * rounds)), at(int(0.975 * rounds) - 1)


def bootstrap_means(values: DataFrame, seed: str, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """values (key, value) -> (round, mean) of the resampled values, and the placed values."""
    table = placed(values)
    return drawn(table, seed, rounds).groupBy("round").agg(F.avg("value").alias("mean")), table


def bootstrap(values: DataFrame, seed: str, rounds: int = ROUNDS) -> DataFrame:
    """values (key, value) -> n, mean, low, high: the 95 % interval of the mean over resampled questions; nulls where there is no value."""
    means, table = bootstrap_means(values, seed, rounds)
    low, high = interval("mean", rounds)
    whole = table.agg(F.nullif(F.count(F.lit(1)), F.lit(0)).cast("int").alias("n"), F.avg("value").alias("mean"))
    return whole.crossJoin(F.broadcast(means.agg(low.alias("low"), high.alias("high"))))  # one row each


def paired(a: DataFrame, b: DataFrame, seed: str, rounds: int = ROUNDS) -> DataFrame:
    """a, b (key, value) -> n, mean, low, high of b - a over the common keys, and whether they differ."""
    gap = a.select("key", F.col("value").alias("a")).join(b.select("key", F.col("value").alias("b")), "key").select("key", (F.col("b") - F.col("a")).alias("value"))
    out = bootstrap(gap, seed, rounds)
    return out.withColumn("differs", F.when((F.col("low") <= 0) & (F.col("high") >= 0), "no").otherwise("yes"))


def replay(values: DataFrame, seed: str, rounds: int = 10_000) -> DataFrame:
    """As bootstrap, with the Mersenne Twister seeded by a text: for comparing with intervals recorded elsewhere."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("key")["value"].tolist()
        n, rng = len(v), random.Random(seed)
        import statistics

        means = sorted(statistics.fmean(v[rng.randrange(n)] for _ in range(n)) for _ in range(rounds))
        return pd.DataFrame({"n": [n], "mean": [statistics.fmean(v)], "low": [means[int(0.025 * rounds)]], "high": [means[int(0.975 * rounds) - 1]]})

    return values.groupBy(F.lit(1)).applyInPandas(run, "n long, mean double, low double, high double")


def running(rows: DataFrame, by: str, *counts: str) -> DataFrame:
    """rows (by, distinct and never null; counts) with the sums of the counts up to each row as upto_<count>.

    Rows are dealt into ranges and summed within each, so no task holds them all; the ranges' own sums, a row each, are added
    by the driver. Without a shared folder, where ranges can't be kept, it is one window.
    """
    spark = rows.sparkSession
    if scratch.root(spark) is None:
        order = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
        return rows.select("*", *(F.sum(c).over(order).alias(f"upto_{c}") for c in counts))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = scratch.written(rows.repartitionByRange(n, by).withColumn("range", F.spark_partition_id()), "ranged")
    totals = sorted(map(tuple, ranged.groupBy("range").agg(*(F.sum(c) for c in counts)).collect()))
    within = Window.partitionBy("range").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged
    for i, c in enumerate(counts, 1):
        before, starts = 0, []
        for row in totals:
            starts += [F.lit(row[0]), F.lit(before).cast("long")]
            before += row[i] or 0
        start = F.element_at(F.create_map(*starts), F.col("range")) if starts else F.lit(0).cast("long")
        out = out.withColumn(f"upto_{c}", start + F.sum(c).over(within))
    return out.drop("range")


def auc(scores: DataFrame) -> DataFrame:
    """scores (positive boolean, score) -> n_positive, n_negative, auc: of each score the negatives below it, and half of those at it."""
    counts = scores.groupBy("score").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n"))
    p, n = F.coalesce(F.sum("p"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))
    wins = F.sum(F.col("p") * (F.col("upto_n") - F.col("n") / 2.0))
    return running(counts, "score", "n").agg(p.alias("n_positive"), n.alias("n_negative"), F.when((p > 0) & (n > 0), wins / (p * n)).alias("auc"))


def bootstrap_aucs(scores: DataFrame, seed: str, rounds: int = AUC_ROUNDS) -> DataFrame:
    """scores (key, positive, score) -> (round, auc), each class resampled on its own.

    In a round each distinct score counts how often it was drawn on either side; its positives win against the negatives below it
    and half of those at it, so no pairs are made.
    """
    sides = {flag: placed(scores.where(F.col("positive") == flag).select("key", F.col("score").alias("value"))) for flag in (True, False)}
    n = {flag: table.count() for flag, table in sides.items()}
    each = None
    for flag, tag in ((True, "p"), (False, "u")):
        one = drawn(sides[flag], f"{seed}:{tag}", rounds).select("round", "value", F.lit(int(flag)).alias("p"), F.lit(int(not flag)).alias("u"))
        each = one if each is None else each.unionByName(one)
    counts = each.groupBy("round", "value").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    below = F.sum("u").over(Window.partitionBy("round").orderBy("value")) - F.col("u")
    wins = counts.select("round", (F.col("p") * (below + F.col("u") / 2.0)).alias("wins"))
    return wins.groupBy("round").agg((F.sum("wins") / float(max(n[True] * n[False], 1))).alias("auc")).where(F.lit(n[True] > 0 and n[False] > 0))


def auc_bootstrap(scores: DataFrame, seed: str, rounds: int = AUC_ROUNDS) -> DataFrame:
    """low, high of the AUC; each class is resampled on its own. scores (key, positive, score)."""
    low, high = interval("auc", rounds)
    return bootstrap_aucs(scores, seed, rounds).agg(low.alias("low"), high.alias("high"))


def abstention_curve(top: DataFrame) -> DataFrame:
    """top (answerable, score) -> threshold, declined_ok, declined_wrong: questions at or below each rounded score.

    A running count over the scores takes the place of a join of thresholds with questions.
    """
    counts = top.select(F.col("score").alias("at"), F.lit(0).alias("point"), F.when(F.col("answerable"), 0).otherwise(1).alias("u"), F.when(F.col("answerable"), 1).otherwise(0).alias("a"))
    points = top.select(F.round("score", 2).alias("at"), F.lit(1).alias("point"), F.lit(0).alias("u"), F.lit(0).alias("a"))
    each = counts.unionByName(points).groupBy("at").agg(F.max("point").alias("point"), F.sum("u").alias("u"), F.sum("a").alias("a"))
    return running(each, "at", "u", "a").where("point = 1").select(F.col("at").alias("threshold"), F.col("upto_u").alias("declined_ok"), F.col("upto_a").alias("declined_wrong"))


def upper_median(rows: DataFrame, column: str, name: str = "median") -> DataFrame:
    """One row: sorted[n // 2] of a column without its nulls, from a histogram of its values."""
    histogram = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto = running(histogram, "v", "n")
    total = histogram.agg(F.sum("n").alias("total"))
    return upto.crossJoin(F.broadcast(total)).where(F.col("upto_n") > F.floor(F.col("total") / 2)).agg(F.min("v").alias(name))


COMBINED = ("relevance", "scope", "sum", "min")


def combined(scores: DataFrame) -> DataFrame:
    """scores (relevance, scope, others) -> others, strategy, score: each way to put the two together."""
    relevance, scope = F.col("relevance"), F.col("scope")
    ways = {"relevance": relevance, "scope": scope, "sum": relevance + scope, "min": F.least(relevance, scope)}
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("strategy"), value.alias("score")) for name, value in ways.items())))
    others = [c for c in scores.columns if c not in ("relevance", "scope")]
    return scores.select(*others, each.alias("w")).select(*others, "w.strategy", "w.score")


def spread(runs: DataFrame, value: str = "value") -> DataFrame:
    """runs (config, value) -> low, high, spread over the configurations."""
    return runs.agg(F.min(value).alias("low"), F.max(value).alias("high"), (F.max(value) - F.min(value)).alias("spread"))


def interaction(cells: DataFrame, value: str = "value") -> DataFrame:
    """cells (first boolean, second boolean, value), four rows -> effects of each, of both, and what both add to their sum."""
    at = lambda a, b: F.max(F.when((F.col("first") == a) & (F.col("second") == b), F.col(value)))
    base = at(False, False)
    a, b, both = at(True, False) - base, at(False, True) - base, at(True, True) - base
    return cells.agg(base.alias("base"), a.alias("first_effect"), b.alias("second_effect"), both.alias("both_effect"), (both - (a + b)).alias("interaction"))
