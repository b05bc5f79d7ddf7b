"""Approximate nearest neighbours: a forest of random-projection trees, searched best first, reranked exactly.

Trees are fitted on a bounded sample (SAMPLE to twice as many vectors, taken by hash) and kept as arrays, so they are
small whatever the table's size; every vector is then filed in a leaf of every tree. A search puts the roots of all
trees in one priority queue ordered by the summed squared margins of the planes crossed, and takes leaves off it until
the leaves taken hold enough vectors. How many are enough is measured, not set: CALIBRATE queries are answered by brute
force, and the budget is what finds RECALL of their true neighbours (vectors without any structure need a large part of
the table, clustered ones little). The candidates of the leaves taken are reranked by Euclidean distance in double
precision on the original vectors.

Leaves next to each other in a tree make a cell. Vectors are sent to their cell of each tree, queries only to the cells
in which their search takes leaves, and both meet there by an equi-join, so the work follows the budget. Both sides are
packed into blocks of bounded size; a crowded cell has several, dealt by hash. Each pair of blocks returns the k + 1 best
of each query among the leaves that it takes.

Equal vectors are one class: only its k + 1 smallest ids can be among k neighbours, so a vector that a third of the rows
share is filed k + 1 times. Queries are classed in the same way.

Null, empty, zero and non-finite vectors take no part, nor do rows of null id, nor vectors of another length than the most
common one. Ties go to the smaller id. Rows of one id are rows of their own, and never each other's neighbour. An empty
table gives an empty one. Only vec_id and embedding are read, so other columns can't clash.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_sample, materialise

TREES, LEAF, SAMPLE, SEED = 4, 24, 16_384, 7
#: Queries answered by brute force to set the budget, the share of their neighbours it must find, and the least budget.
CALIBRATE, RECALL, VISIT = 64, 0.96, 500
#: Leaves in a cell; vectors and queries in a block, about.
CELL, BLOCK, QUERY_BLOCK = 32, 2_048, 256
K = 10


class Forest:
    """Trees as arrays: hyperplane, offset and children of each node; a leaf has its number in place of children."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1] if sample.size else 0
        self.trees = [self._grow(sample, leaf, rng) for _ in range(trees)]

    def _grow(self, sample: np.ndarray, leaf: int, rng):
        planes, offsets, children, leaves = [], [], [], 0
        root = -1
        todo = [(np.arange(len(sample)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            at = None
            if len(rows) > leaf:
                for _ in range(5):
                    a, b = sample[rng.choice(rows, 2, replace=False)]
                    plane = a - b
                    norm = np.linalg.norm(plane)
                    if norm == 0:
                        continue
                    plane = plane / norm
                    project = sample[rows] @ plane
                    offset = float(np.median(project))
                    right = project > offset
                    if 0 < right.sum() < len(rows):
                        at = len(planes)
                        planes.append(plane)
                        offsets.append(offset)
                        children.append([0, 0])
                        todo += [(rows[~right], at, 0), (rows[right], at, 1)]
                        break
            if at is None:
                at = -1 - leaves
                leaves += 1
            if parent < 0:
                root = at
            else:
                children[parent][side] = at
        return root, np.array(planes).reshape(-1, self.dim), np.array(offsets), np.array(children, int).reshape(-1, 2), leaves

    @property
    def leaves(self) -> list[int]:
        """Leaves of each tree; those of a subtree are numbered in a row."""
        return [tree[4] for tree in self.trees]

    @property
    def cells(self) -> np.ndarray:
        """The number of the first cell of each tree, and of all cells at the end."""
        return np.cumsum([0] + [-(-n // CELL) for n in self.leaves])

    def file(self, vectors: np.ndarray, tree: int) -> np.ndarray:
        """The leaf of each vector."""
        root, planes, offsets, children, _ = self.trees[tree]
        at = np.full(len(vectors), root)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            right = np.einsum("ij,ij->i", vectors[inner], planes[node]) > offsets[node]
            at[inner] = children[node, right.astype(int)]
        return -1 - at

    def search(self, vector: np.ndarray, sizes: list[np.ndarray], enough: float) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue until the leaves hold `enough` vectors."""
        project = [planes @ vector - offsets for _, planes, offsets, _, _ in self.trees]
        queue = [(0.0, t, tree[0]) for t, tree in enumerate(self.trees)]
        heapq.heapify(queue)
        found, held = [], 0
        while queue and held < enough:
            crossed, t, at = heapq.heappop(queue)
            while at >= 0:
                margin = project[t][at]
                right = int(margin > 0)
                heapq.heappush(queue, (crossed + margin * margin, t, int(self.trees[t][3][at, 1 - right])))
                at = int(self.trees[t][3][at, right])
            found.append((t, -1 - at))
            held += sizes[t][-1 - at]
        return found


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, v) of vectors that take part."""
    v = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~F.coalesce(bad, F.lit(True))).where(F.exists("v", lambda x: x != 0))


def _matrix(column) -> np.ndarray:
    """Double precision of an array column; all rows have one length."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(column), -1)


_FILED = "vec_id long, {v}, cell int, part int, leaf int"
_BLOCKS = "cell int, ids binary, leaves binary, v binary"
_WANTED = "cell int, query long, q binary, leaves binary"
_QUERIES = "cell int, queries binary, q binary, wanted binary"
_FOUND = "query long, vec_id long, score double"


def _count(forest):
    """Vectors in each leaf, numbered through all trees."""

    def count(batches):
        f = forest.value
        total = [np.zeros(n, np.int64) for n in f.leaves]
        for batch in batches:
            m = _matrix(batch.column("v"))
            for t, held in enumerate(total):
                held += np.bincount(f.file(m, t), minlength=len(held))
        every = np.concatenate(total)
        some = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(every[some])], names=["leaf", "n"])

    return count


def _mixed(ids: np.ndarray) -> np.ndarray:
    """Numbers of 31 bits that tell nothing of the order of ids."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


def _file(forest, blocks):
    """A row for each vector and tree: the cell, the leaf in it, and which of the cell's blocks takes it."""

    def run(batches):
        f, parts = forest.value, blocks.value
        for batch in batches:
            m, ids = _matrix(batch.column("v")), batch.column("vec_id").to_numpy()
            for t, first in enumerate(f.cells[:-1]):
                leaf = f.file(m, t)
                cell = first + leaf // CELL
                part = _mixed(ids) % parts[cell]
                new = (pa.array(x.astype(np.int32)) for x in (cell, part, leaf % CELL))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), *new], names=["vec_id", "v", "cell", "part", "leaf"])

    return run


def _groups(batches, size: int, *columns: str):
    """Of rows sorted by cell and part, (cell, rows of the named columns) of the same cell and part, at most size."""
    held, last = [], None
    for batch in batches:
        keys = np.stack([batch.column("cell").to_numpy(), batch.column("part").to_numpy()], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(keys)]):
            if a == b:
                continue
            key = tuple(keys[a])
            if last is not None and key != last and held:
                yield last[0], pa.Table.from_batches(held)
                held = []
            last = key
            for at in range(a, b, size):
                held.append(batch.select(columns).slice(at, min(size, b - at)))
                if sum(map(len, held)) >= size:
                    yield last[0], pa.Table.from_batches(held)
                    held = []
    if held:
        yield last[0], pa.Table.from_batches(held)


def _pack_vectors(batches):
    for cell, rows in _groups(batches, BLOCK, "vec_id", "leaf", "v"):
        rows = rows.combine_chunks()
        data = (rows["vec_id"].to_numpy().astype("<i8"), rows["leaf"].to_numpy().astype("u1"), rows["v"].chunk(0).flatten().to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in data)], names=["cell", "ids", "leaves", "v"])


def _pack_queries(batches):
    for cell, rows in _groups(batches, QUERY_BLOCK, "query", "q", "leaves"):
        data = (rows["query"].to_numpy().astype("<i8").tobytes(), *(b"".join(rows[c].to_pylist()) for c in ("q", "leaves")))
        yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), *(pa.array([x], pa.binary()) for x in data)], names=["cell", "queries", "q", "wanted"])


def _search(forest, sizes, enough: float):
    """A row for each query and cell in which its search takes leaves, with these as bits."""

    def run(batches):
        f, held = forest.value, sizes.value
        for batch in batches:
            m, ids = _matrix(batch.column("v")), batch.column("query").to_pylist()
            out: list[list] = [[], [], [], []]
            for query, v in zip(ids, m):
                taken = np.zeros((f.cells[-1], CELL), bool)
                for t, leaf in f.search(v, held, enough):
                    taken[f.cells[t] + leaf // CELL, leaf % CELL] = True
                cells = np.flatnonzero(taken.any(axis=1))
                bits = np.packbits(taken[cells], axis=1)
                for c, new in zip(out, (cells.tolist(), [query] * len(cells), [v.astype("<f8").tobytes()] * len(cells), [x.tobytes() for x in bits])):
                    c.extend(new)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["cell", "query", "q", "leaves"])

    return run


def _nearest(x: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the k + 1 nearest, ties to the smaller id."""
    score = np.sqrt(np.square(v - x).sum(axis=1))
    if len(ids) > k + 1:
        near = np.flatnonzero(score <= np.partition(score, k)[k])
        ids, score = ids[near], score[near]
    best = np.lexsort((ids, score))[: k + 1]
    return ids[best], score[best]


def _found(query: list, near: list) -> pa.RecordBatch:
    n = [len(ids) for ids, _ in near]
    columns = (np.repeat(np.array(query, np.int64), n), *(np.concatenate(c) if c else np.zeros(0) for c in zip(*near))) if near else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "vec_id", "score"])


def _rerank(k: int, dim: int, kind: str):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                raw = {c: batch.column(c)[i].as_py() for c in ("ids", "leaves", "v", "queries", "q", "wanted")}
                ids, leaves = np.frombuffer(raw["ids"], "<i8"), np.frombuffer(raw["leaves"], "u1")
                v = np.frombuffer(raw["v"], kind).reshape(-1, dim).astype(float)
                queries, q = np.frombuffer(raw["queries"], "<i8"), np.frombuffer(raw["q"], "<f8").reshape(-1, dim)
                wanted = np.unpackbits(np.frombuffer(raw["wanted"], "u1").reshape(len(q), -1), axis=1).view(bool)
                near = []
                for x, taken in zip(q, wanted):
                    at = np.flatnonzero(taken[leaves])
                    near.append(_nearest(x, v[at], ids[at], k))
                yield _found(queries, near)

    return run


def _brute(asked, k: int):
    def run(batches):
        for batch in batches:
            v, ids = _matrix(batch.column("v")), batch.column("vec_id").to_numpy()
            yield _found([query for query, _ in asked.value], [_nearest(x, v, ids, k) for _, x in asked.value])

    return run


def _best(near: DataFrame, k: int) -> DataFrame:
    """The k + 1 nearest of each query; trees may find a vector more than once."""
    once = near.groupBy("query", "vec_id").agg(F.min("score").alias("score"))
    return once.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("n") <= k + 1).drop("n")


def _budget(forest: Forest, sizes, kept: DataFrame, classes: DataFrame, k: int, recall: float) -> float:
    """Vectors that leaves must hold to find the share `recall` of the neighbours of some queries, known from brute force."""
    some = hash_sample(classes, CALIBRATE, "query").limit(2 * CALIBRATE).collect()
    asked = {r.query: np.array(r.v, float) for r in some}
    shared = kept.sparkSession.sparkContext.broadcast(list(asked.items()))
    truth = _best(kept.mapInArrow(_brute(shared, k), _FOUND), k).join(kept, "vec_id").orderBy("query", "score", "vec_id").select("query", "vec_id", "v").collect()
    near: dict[int, list] = {}
    for r in truth:
        if r["query"] != r.vec_id:
            near.setdefault(r["query"], []).append(np.array(r.v, float))
    held_at = []
    for query, found in near.items():
        homes = np.stack([forest.file(np.array(found[:k]), t) for t in range(len(forest.trees))], axis=1)
        held, missing = 0, np.ones(len(homes), bool)
        for t, leaf in forest.search(asked[query], sizes, np.inf):
            held += int(sizes[t][leaf])
            new = missing & (homes[:, t] == leaf)
            held_at += [held] * int(new.sum())
            missing &= ~new
            if not missing.any():
                break
    return float(np.quantile(held_at, recall)) if held_at else np.inf


def neighbours(vectors: DataFrame, every: int = 100, k: int = K, trees: int = TREES, visit: float = VISIT, recall: float = RECALL) -> DataFrame:
    """vectors (vec_id, embedding) -> query_id, rank, vec_id, score for queries, the rows whose vec_id `every` divides."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == common.d)
    kind = "<f4" if rows.schema["v"].dataType.elementType.typeName() == "float" else "<f8"
    if kind == "<f8":
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    # the k + 1 smallest ids of each distinct vector
    order = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    kept, _ = materialise(rows.withColumn("n", order).where(F.col("n") <= k + 1).drop("n"), "vectors")
    sample = [r.v for r in sorted(hash_sample(kept, SAMPLE, "vec_id").limit(2 * SAMPLE).collect(), key=lambda r: (r.vec_id, r.v))]
    forest = Forest(np.array(sample, float), trees)
    shared = spark.sparkContext.broadcast(forest)
    # leaves and cells are as many as the sample allows
    counts = np.zeros(sum(forest.leaves), np.int64)
    for r in kept.select("v").mapInArrow(_count(shared), "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        counts[r.leaf] = r.n
    sizes = np.split(counts, np.cumsum(forest.leaves)[:-1])
    in_cells = np.concatenate([np.add.reduceat(held, np.arange(0, len(held), CELL)) for held in sizes])
    blocks = spark.sparkContext.broadcast(np.maximum(1, -(-in_cells // BLOCK)))
    filed = kept.mapInArrow(_file(shared, blocks), _FILED.format(v=f"v {rows.schema['v'].dataType.simpleString()}"))
    packed = filed.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(_pack_vectors, _BLOCKS)

    # a query for each distinct vector among the query rows
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    classes, _ = materialise(asked.groupBy("v").agg(F.min("vec_id").alias("query")), "queries")
    enough = max(float(visit), _budget(forest, sizes, kept, classes, k, recall))
    wanted, _ = materialise(classes.mapInArrow(_search(shared, spark.sparkContext.broadcast(sizes), enough), _WANTED), "wanted")
    crowd = wanted.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("parts"))
    dealt = wanted.join(crowd, "cell").withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int")).drop("parts")
    grouped = dealt.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(_pack_queries, _QUERIES)
    met = packed.hint("merge").join(grouped, "cell").select("ids", "leaves", "v", "queries", "q", "wanted")
    best, _ = materialise(_best(met.mapInArrow(_rerank(k, common.d, kind), _FOUND), k), "nearest")
    of_class = asked.join(classes, "v").select("query", F.col("vec_id").alias("query_id"))
    found = of_class.join(best, "query").where("query_id <> vec_id")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
