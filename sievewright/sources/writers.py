"""Sinks: JSON lines, JSON reports, Markdown tables, the public export."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def report(rows: DataFrame, most: int = 100_000) -> str:
    """A small aggregate as JSON text; raises beyond `most` rows."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError("a report is for aggregates")
    return json.dumps([r.asDict(recursive=True) for r in found], ensure_ascii=False, default=str)


def markdown(rows: DataFrame, digits: int = 3, most: int = 1_000) -> str:
    """A small aggregate as a Markdown table."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError("a table is for aggregates")
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(v) for v in r) + " |" for r in found)])


def demo(questions: DataFrame, labels: DataFrame, found: DataFrame, decline_at: float = 5.0) -> DataFrame:
    """One record a question: required and found evidence, complete, would_decline, and its citations as JSON."""
    need = labels.groupBy("query_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("required"))
    got = found.groupBy("query_id").agg(F.collect_set("evidence_id").alias("found"), F.max("score").alias("top"), F.to_json(F.array_sort(F.collect_list(F.struct("rank", "evidence_id", "excerpt", "score")))).alias("citations"))
    rows = questions.join(need, "query_id", "left").join(got, "query_id", "left")
    none = F.array().cast("array<string>")
    hit = F.array_intersect(F.coalesce("required", none), F.coalesce("found", none))
    return rows.select("query_id", "query", F.coalesce("required", none).alias("required"), F.array_sort(hit).alias("found"), (F.size(hit) == F.size(F.coalesce("required", none))).alias("complete"), F.coalesce(F.col("top") <= decline_at, F.lit(True)).alias("would_decline"), "citations")


def redact(records: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """records (query_id, citations array of structs) without excerpts, with the labeller's reason where there is one."""
    bare = records.withColumn("citations", F.transform("citations", lambda c: c.dropFields("excerpt")))
    out = bare if reasons is None else bare.join(reasons, "query_id", "left")
    if "excerpt" in out.schema.simpleString():
        raise ValueError("an excerpt is left")
    return out
