"""Commencement: what was in force on a date, three-valued, and how far results show what was not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_force(commenced: Column, as_of: Column) -> Column:
    """True, false, or null where the date is unknown; the day itself counts."""
    return commenced <= as_of


def judged(results: DataFrame, commencements: DataFrame, as_of: str) -> DataFrame:
    """results (query_id, doc_id, rank) with in_force; documents that aren't registered are unknown."""
    known = results.join(commencements.select("doc_id", "commenced"), "doc_id", "left")
    return known.withColumn("in_force", in_force(F.col("commenced"), F.to_date(F.lit(as_of))))


def exposure(results: DataFrame, commencements: DataFrame, as_of: str) -> DataFrame:
    """query_id, premature (repeats count), unknown, clean, first_premature_rank (0 if none)."""
    rows = judged(results, commencements, as_of)
    early = ~F.col("in_force")
    return rows.groupBy("query_id").agg(
        F.count_if(early).alias("premature"), F.count_if(F.col("in_force").isNull()).alias("unknown"),
        (F.count_if(early) == 0).alias("clean"), F.coalesce(F.min(F.when(early, F.col("rank"))), F.lit(0)).alias("first_premature_rank"),
    )


def exposure_summary(per_question: DataFrame, questions: DataFrame) -> DataFrame:
    """category, n, affected, at_rank_1."""
    joined = per_question.join(questions.select("query_id", "category"), "query_id")
    return joined.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("premature") > 0).alias("affected"), F.count_if(F.col("first_premature_rank") == 1).alias("at_rank_1"))


def labelling_eligible(commencement: Column, as_of: str) -> Column:
    """'false' only for a date after as_of; blank or unreadable dates are eligible."""
    return F.when(F.coalesce(F.try_to_date(commencement), F.to_date(F.lit(as_of))) > F.to_date(F.lit(as_of)), "false").otherwise("true")
