"""Exact best inner products of many queries against many vectors, as a product of blocks.

Both sides are packed into blocks of numbers where they are read. Vector blocks are dealt into groups of about GROUP numbers; a copy of
every query block goes to every group, so that a task holds the vectors of one group and lets the query blocks pass by, a block
at a time. Each (query, group) keeps its k best. Nothing is collected or broadcast, and the plan is the same for one query and for
millions: what is shuffled is the vectors once and the queries once a group, and groups are as large as a task's memory allows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch

#: Numbers (of 8 bytes) of a packed block, of the vectors that a task holds at a time, and of a product looked at at once.
PACK, GROUP, PRODUCT = 250_000, 8_000_000, 4_000_000

Dense = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]
_PACKED = "ids binary, data binary, n long, dims int"


def of_arrays(key: str, column: str) -> Dense:
    """Batches (key long, column array of numbers, all of one length) as ids and a matrix."""

    def dense(batch):
        numbers = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(float)
        return batch.column(key).to_numpy(), numbers.reshape(batch.num_rows, -1)

    return dense


def _packed(dense: Dense, pack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, matrix = dense(batch)
            step = max(1, pack // max(1, matrix.shape[1]))
            for at in range(0, len(ids), step):
                i, m = np.ascontiguousarray(ids[at : at + step], np.int64), np.ascontiguousarray(matrix[at : at + step], float)
                columns = ((i.tobytes(), pa.binary()), (m.tobytes(), pa.binary()), (len(i), pa.int64()), (m.shape[1], pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in columns], names=["ids", "data", "n", "dims"])

    return run


def packed(rows: DataFrame, dense: Dense, pack: int = PACK) -> DataFrame:
    """rows as blocks: ids, data (both binary), n rows, dims."""
    return scratch.written(rows.mapInArrow(_packed(dense, pack), _PACKED), "packed")


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores as rounded to 9 digits, ties to the smaller id."""
    # a score that is rounded up may pass one that is not, so a little more than the k best are looked at
    near = np.flatnonzero(scores >= np.partition(scores, -k)[-k] - 1e-8) if len(scores) > k else np.arange(len(scores))
    return near[np.lexsort((ids[near], -np.round(scores[near], 9)))[:k]]


def _products(k: int, product: int):
    def blocks(batches):
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("grp", "query", "ids", "data"))):
                grp, query, ids, data = row
                ids = np.frombuffer(ids, np.int64)
                yield grp, query, ids, np.frombuffer(data, float).reshape(len(ids), -1)

    def run(batches):
        now, held = None, []
        for grp, query, ids, matrix in blocks(batches):
            if grp != now:
                now, held = grp, []
            if not query:
                held.append((ids, matrix))
                continue
            found: list[list] = [[] for _ in ids]
            for vector_ids, vectors in held:
                step = max(1, product // max(1, len(vector_ids)))
                for at in range(0, len(ids), step):
                    for i, scores in enumerate(matrix[at : at + step] @ vectors.T, at):
                        best = _best(vector_ids, scores, k)
                        found[i].append((vector_ids[best], scores[best]))
            out: list[list] = [[], [], []]
            for query_id, parts in zip(ids, found):
                if parts:
                    vector_ids, scores = (np.concatenate(x) for x in zip(*parts))
                    best = _best(vector_ids, scores, k)
                    for c, v in zip(out, (np.full(len(best), query_id), vector_ids[best], scores[best])):
                        c.append(v)
            columns = [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, (np.int64, np.int64, float))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "idx", "score"])

    return run


def best_products(vectors: DataFrame, queries: DataFrame, k: int, group: int = GROUP, product: int = PRODUCT) -> DataFrame:
    """Packed vectors and packed queries -> query_id, idx, score: for each query the k best of every group, its k best of all among them."""
    spark = vectors.sparkSession
    numbers = vectors.agg(F.sum(F.col("n") * F.col("dims"))).first()[0] or 0
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-numbers // group)) if numbers > PACK else 1
    resident = vectors.select(F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int").alias("grp"), F.lit(False).alias("query"), "ids", "data")
    passing = queries.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(True).alias("query"), "ids", "data")
    dealt = resident.unionByName(passing).repartition("grp").sortWithinPartitions("grp", "query")
    return dealt.mapInArrow(_products(k, product), "query_id long, idx long, score double")
