"""Mixing sources to target weights by entropy balancing.

Document rates r minimise the token-weighted relative entropy to "every document once" while each source's
rated tokens meet its target. The convex dual has one multiplier a source, r = exp(multiplier), and is solved by
Newton steps; each step is a distributed sum over the profile (documents counted by source and size). The rates
are then rounded to whole copies: every document gets the whole part, and the remainders are settled from the
largest size down, so that a source misses its target by about its smallest document. Which of equally long
documents get the extra copy is decided by a hash of the id, so reruns agree.

Null text has size 0, empty sources take nothing, null sources are a source of their own, last in order. Rows of one id
are rows, and which of them get the extra copy is decided by a hash of the text; an empty table gives an empty one. Only doc_id, text and
source are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
WORD = r"[^\x20\x09-\x0D]+"
STEPS = 100


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, key: the source, never null, and tie: the text's hash, which orders rows of one id."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), key.alias("key"), size.alias("size"), F.xxhash64("text").alias("tie"))


def placed(by_source: DataFrame) -> DataFrame:
    """The number of each source, from 0, by code point, null last; sources may be many (hosts), so no task holds all."""
    spark = by_source.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("source").asc_nulls_last()
    ranged = by_source.repartitionByRange(n, order).withColumn("range", F.spark_partition_id())
    ranged, _ = materialise(ranged, "ranged")
    # one row a range
    sizes = sorted((r["range"], r.n) for r in ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, []
    for r, size in sizes:
        starts += [F.lit(r), F.lit(before).cast("long")]
        before += size
    start = F.element_at(F.create_map(*starts), F.col("range")) if starts else F.lit(0).cast("long")
    within = F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1
    return ranged.withColumn("place", start + within).drop("range")


def targets(profile: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """profile (key, source, size, n) -> key, source_size, target; one row a source.

    Weights repeat along the sources in code point order. What a source can't take up to cap times its size goes
    to the others by weight, again and again; that ends at one level for all sources below their caps.
    """
    by_source = profile.groupBy("key").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    by_source = placed(by_source)
    place = F.col("place")
    shares = F.array(*map(F.lit, map(float, weights)))
    table, _ = materialise(by_source.withColumn("w", F.element_at(shares, (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))).withColumn("most", F.col("source_size") * cap), "sources")
    total = float(table.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        over = F.col("w") * level > F.col("most")
        row = table.agg(F.sum(F.when(over, F.col("most")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("w"))), F.count_if(over)).first()
        if row[2] == full or not row[1]:
            break
        full, level = row[2], (total - row[0]) / row[1]
    return table.select("key", "source_size", F.least("most", F.col("w") * level).alias("target"))


def balance(profile: DataFrame, goals: DataFrame, steps: int = STEPS, close: float = 1e-12) -> DataFrame:
    """Newton steps on the dual: goals with each source's rate exp(multiplier)."""
    spark = profile.sparkSession
    state, path = materialise(goals.withColumn("multiplier", F.lit(0.0)), "dual")
    for _ in range(steps):
        mass = profile.join(state.select("key", "multiplier"), "key").groupBy("key").agg(F.sum(F.col("n") * F.col("size") * F.exp("multiplier")).alias("mass"))
        gap = F.col("target") - F.col("mass")
        # gradient gap, curvature mass
        step = F.when((F.col("mass") > 0) & (F.col("target") > 0), gap / F.col("mass")).otherwise(0.0)
        moved, new = materialise(state.join(mass, "key").select("key", "source_size", "target", (F.col("multiplier") + step).alias("multiplier"), step.alias("step")), "dual")
        worst = moved.agg(F.max(F.abs("step"))).first()[0] or 0.0
        discard(spark, path)
        state, path = moved.drop("step"), new
        if worst <= close:
            break
    else:
        raise RuntimeError("the dual did not settle")
    return state.select("key", "source_size", "target", F.when(F.col("target") > 0, F.exp("multiplier")).otherwise(0.0).alias("rate"))


def _settle(pdf):
    """Extra copies of each size of one source: the remainders' words, given from the largest size down."""
    pdf = pdf.sort_values("size", ascending=False)
    owed, out = 0.0, []
    for size, n, part in zip(pdf["size"], pdf["n"], pdf["part"]):
        extra = 0
        if size:
            owed += part * n * size
            extra = min(max(int(owed / size + 0.5), 0), int(n)) if part > 0 else 0
            owed -= extra * size
        out.append(extra)
    pdf["extra"] = out
    return pdf[["key", "size", "whole", "extra"]]


def mix(docs: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, size, source_size, target, taken, copies.

    taken is copies times size; no document is copied more than cap (rounded down) times. Repeated rows are rows.
    """
    rows, _ = materialise(sizes(docs), "sizes")
    profile, _ = materialise(rows.groupBy("key", "size").agg(F.first("source").alias("source"), F.count(F.lit(1)).alias("n")), "profile")
    rates = balance(profile, targets(profile, weights, cap))
    rate = F.round(F.least("rate", F.lit(float(cap))), 12)
    rated = rates.withColumn("whole", F.floor(rate)).withColumn("part", rate - F.floor(rate))
    # a source's sizes are few, whatever the number of its documents
    plan = profile.join(rated, "key").select("key", "size", "n", "whole", "part").groupBy("key").applyInPandas(_settle, "key string, size long, whole long, extra long")
    # the rank of a document among its equals, in two steps: no partition holds a whole group, of which chunks are a 65,536th
    mark = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    marked = rows.select("doc_id", "key", "size", "tie", mark.alias("mark"), F.substring(mark, 1, 4).alias("chunk"))
    chunks = marked.groupBy("key", "size", "chunk").agg(F.count(F.lit(1)).alias("n"))
    chunks = chunks.withColumn("before", F.sum("n").over(Window.partitionBy("key", "size").orderBy("chunk")) - F.col("n")).drop("n")
    ranked = marked.withColumn("place", F.row_number().over(Window.partitionBy("key", "size", "chunk").orderBy("mark", "tie"))).join(chunks, ["key", "size", "chunk"])
    out = ranked.join(plan, ["key", "size"]).join(rates.select("key", "source_size", "target"), "key")
    copies = F.col("whole") + F.when(F.col("before") + F.col("place") <= F.col("extra"), 1).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))
