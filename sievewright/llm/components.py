"""Connected components by alternating large and small stars; every round is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: More rounds than any graph needs in practice (they grow as the logarithm of the longest path, squared).
ROUNDS = 60


def _star(edges: DataFrame) -> DataFrame:
    """edges (a, b), a > b, one round of both stars."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    small = large.groupBy("a").agg(F.min("b").alias("m"))
    joined = large.join(small, "a")
    return joined.select("a", F.col("m").alias("b")).unionByName(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long), any direction, loops and repeats allowed -> (node, root): root is the least node reachable.

    Nodes without an edge to another node are left out. No path, component or hub is gathered anywhere: hubs are
    reduced by partial minima and met by joins that can be split.
    """
    spark = edges.sparkSession
    now, path = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(ROUNDS):
        after, new_path = materialise(_star(now), "edges")
        found = after.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
        discard(spark, path)
        now, path = after, new_path
        if tuple(found) == state:
            break
        state = tuple(found)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
