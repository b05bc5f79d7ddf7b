"""Merkle manifest of a dataset: a tree for each language, a tree over their roots, and a proof for every row.

Digests are lower-case hex text; a node is the sha256 of its children's digests one after another. Leaves of a language ascend
by doc_id (nulls first; rows of one id by their digest, so that reruns agree), ARITY nodes in a row have one parent, and
a language's levels end with one node, its subroot. Subroots in order of language (null first, else by bytes) make the upper tree.

Leaves are numbered in ranges and dealt into aligned blocks of ARITY ** LEVELS, which may lie in any task. Trees rise a block a
round: blocks' roots are the leaves of the next round, a table BLOCK times smaller, until each language has one node. Proofs come
down the same rounds, each block being sent one row, the proof of its own root. Within a block the leaves are walked through as in
fractal tree traversal: of each level the run of nodes on the present leaf's way is kept (the existing subtree) while the
run after it grows by one leaf a step (the desired subtree), so that a step costs a bounded number of hashes and memory is
that of a few runs on top of the block's digests.

Null fields have a mark of their own in a leaf; texts of any length are hashed where they are read and go no further; repeated rows
are leaves of their own; an empty table gives an empty one; of extra columns nothing is read, whatever their names. A null
doc_id is never tampered with.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialise

ARITY, LEVELS = 8, 3
BLOCK = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One of so many ids, by checksum, is tampered with in the drill.
DRILL = 3


def parent(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


class Growing:
    """A run of nodes of a level, built from leaves as they come; of each lower level the last unfinished run is stacked."""

    def __init__(self, level: int):
        self.stack: list[list[str]] = [[] for _ in range(level + 1)]

    def absorb(self, leaf: str) -> None:
        self.stack[0].append(leaf)
        for below, above in zip(self.stack, self.stack[1:]):
            if len(below) < ARITY:
                return
            above.append(parent(below))
            below.clear()

    def finish(self) -> list[str]:
        """The run; a last node may have fewer children."""
        for below, above in zip(self.stack, self.stack[1:]):
            if below:
                above.append(parent(below))
                below.clear()
        return self.stack[-1]


def block_root(leaves: list[str], levels: int) -> str:
    run = Growing(levels)
    for leaf in leaves:
        run.absorb(leaf)
    (root,) = run.finish()
    return root


def paths(leaves: list[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """For each leaf in order: of each level from below, the siblings before and after the node on its way, as joined digests."""
    spans = [ARITY ** (i + 1) for i in range(levels)]  # leaves under a run of the level
    existing, desired = [], [Growing(i) for i in range(levels)]
    for i, span in enumerate(spans):
        first = Growing(i)
        for leaf in leaves[:span]:
            first.absorb(leaf)
        existing.append(first.finish())
    sides = [("", "")] * levels
    for at in range(len(leaves)):
        for i, span in enumerate(spans):
            if at and at % span == 0:
                existing[i], desired[i] = desired[i].finish(), Growing(i)
            if at + span < len(leaves):
                desired[i].absorb(leaves[at + span])
            if at % (span // ARITY) == 0:
                place = at * ARITY // span % ARITY
                sides[i] = "".join(existing[i][:place]), "".join(existing[i][place + 1 :])
        yield sides


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        node = sha256(f"{before}{node}{after}".encode()).hexdigest()
    return node


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*(field(fields[f]) for f in FIELDS)), 256)


def positions(rows: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, str]:
    """rows with `pos`, each one's place (from 0) in its group by the order, which must be total; and the path it reads.

    Rows are dealt into ranges, so that a group of any size is numbered by many tasks; what goes from range to range is a count for each group."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order).withColumn("at", F.monotonically_increasing_id())
    ranged, path = materialise(ranged, "ranged")
    task = F.shiftright("at", 33)
    counts = ranged.groupBy(task.alias("task"), *group).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*group).orderBy("task")) - F.col("n")
    counts = counts.select("task", *(F.col(g).alias(f"of_{g}") for g in group), (before - F.col("first")).alias("shift"))
    same = task == F.col("task")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"of_{g}"))
    return ranged.join(counts, same).withColumn("pos", F.col("at") + F.col("shift")).select(*rows.columns, "pos"), path


def _blocks(batches, *columns: str):
    """The blocks of rows sorted by grp, block and pos: lists of tuples (grp, block, pos, levels, the columns)."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("grp", "block", "pos", "levels", *columns))):
            if row[:2] != key and rows:
                yield rows
                rows = []
            key = row[:2]
            rows.append(row)
    if rows:
        yield rows


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")


def _leveled(nodes: DataFrame, done: int) -> DataFrame:
    """nodes (grp, pos, depth, node) with the block of each and how many levels this round adds to it."""
    left = F.least(F.greatest(F.col("depth") - done, F.lit(0)), F.lit(LEVELS))
    return nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long")).withColumn("levels", left.cast("int"))


def _roots(batches):
    for rows in _blocks(batches, "depth", "node"):
        grp, block, _, levels, depth, _ = rows[0]
        root = bytes.fromhex(block_root([r[-1].hex() for r in rows], levels))
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((grp, pa.string()), (block, pa.int64()), (depth, pa.int32()), (root, pa.binary()))], names=["grp", "pos", "depth", "node"])


def rise(leaves: DataFrame) -> tuple[list[DataFrame], list[str]]:
    """leaves (grp, pos, node) -> the nodes (grp, pos, depth, node) of each round, the first's being leaves and the last's a root for each group."""
    depth = F.when(F.col("n") == 1, 0).otherwise(F.length(F.conv((F.col("n") - 1).cast("string"), 10, ARITY))).cast("int")
    depths = leaves.groupBy(F.col("grp").alias("of_grp")).agg(F.count(F.lit(1)).alias("n")).select("of_grp", depth.alias("depth"))
    nodes, path = materialise(leaves.join(depths, F.col("grp").eqNullSafe(F.col("of_grp"))).select("grp", "pos", "depth", "node"), "nodes")
    rounds, made = [nodes], [path]
    for done in range(0, nodes.agg(F.max("depth")).first()[0] or 0, LEVELS):
        nodes, path = materialise(_dealt(_leveled(rounds[-1], done)).mapInArrow(_roots, "grp string, pos long, depth int, node binary"), "nodes")
        rounds.append(nodes)
        made.append(path)
    return rounds, made


def _encoded(path: list[tuple[str, str]]) -> str:
    return "".join(f"{before}|{after};" for before, after in path)


def _decoded(path: str) -> list[tuple[str, str]]:
    return [tuple(x.split("|")) for x in path.split(";")[:-1]]


def _carried(batches):
    """For each node of a block, its path within the block before that of the block."""
    for (*_, above, _), *rows in _blocks(batches, "proof", "node"):
        found = paths([r[-1].hex() for r in rows], rows[0][3])
        proofs = [_encoded(p) + above for p in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array(proofs)], names=["grp", "pos", "proof"])


def with_proofs(nodes: DataFrame, proofs: DataFrame, done: int) -> DataFrame:
    """Blocks of nodes, each after a row (of position -1) with the proof of its root; proofs (grp, pos, proof) by the blocks' numbers."""
    heads = proofs.select("grp", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "proof")
    return _dealt(_leveled(nodes, done).unionByName(heads, allowMissingColumns=True))


def descend(rounds: list[DataFrame], proofs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The proofs (grp, pos, proof) of the nodes of the second round, from those of the last round's."""
    made = []
    for i in range(len(rounds) - 2, 0, -1):
        proofs, path = materialise(with_proofs(rounds[i], proofs, i * LEVELS).mapInArrow(_carried, "grp string, pos long, proof string"), "proofs")
        made.append(path)
    return proofs, made


def _rows(batches):
    """What each row shows: its proof, and the root that its tampered or original leaf folds to."""
    for (*_, above, _, _, _), *rows in _blocks(batches, "proof", "node", "doc_id", "altered"):
        upper, subroot, root = above[:-128], above[-128:-64], above[-64:]
        steps, siblings = _decoded(upper), upper.replace("|", "").replace(";", "")
        leaves, out = [r[-3].hex() for r in rows], []
        for row, leaf, path in zip(rows, leaves, paths(leaves, rows[0][3])):
            proof = sha256(("".join(before + after for before, after in path) + siblings).encode()).hexdigest()
            folded = fold(fold(row[-1].hex() if row[-1] is not None else leaf, path), steps)
            out.append((row[-2], leaf, subroot, root, proof, folded, folded == root))
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


MANIFEST = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def manifest(docs: DataFrame, drill: int | None = DRILL) -> DataFrame:
    """docs (doc_id, source, lang, n_chars, text) -> a row each: leaf, subroot of its language, root, proof and its check.

    In the drill, rows whose id's checksum the number divides are checked with their text's A-Z lower-cased; None checks all rows as they are."""
    fields = {f: F.col(f) for f in FIELDS}
    leaf = leaf_digest(fields)
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(drill)) == 0 if drill else F.lit(False)
    altered = F.when(hit, F.unhex(leaf_digest(fields | {"text": lowered(F.col("text"))})))
    # the number of a row parts rows that are alike in all else
    rows = docs.select(F.col("lang").cast("string").alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(leaf).alias("node"), altered.alias("altered"), F.monotonically_increasing_id().alias("copy"))
    rows, first = materialise(rows, "leaves")
    placed, ranged = positions(rows, ["grp"], ["doc_id", "node", "copy"])
    spark = docs.sparkSession
    rounds, made = rise(placed.select("grp", "pos", "node"))
    subroots = rounds[-1].select("grp", F.col("node").alias("subroot"))
    ordered, upper = positions(subroots, [], ["grp"])
    top, more = rise(ordered.select(F.lit("").alias("grp"), "pos", F.col("subroot").alias("node")))
    root = top[-1].select(F.lower(F.hex("node")).alias("root"))
    heads = top[-1].select("grp", "pos", F.lit("").alias("proof"))
    if len(top) > 1:
        heads, gone = descend(top, heads)
        more += gone
        heads, path = materialise(with_proofs(top[0], heads, 0).mapInArrow(_carried, "grp string, pos long, proof string"), "proofs")
        more.append(path)
    # one row a language, each with the one root
    tops = ordered.join(heads.select("pos", "proof"), "pos").crossJoin(F.broadcast(root))
    proofs = tops.select("grp", F.lit(0).cast("long").alias("pos"), F.concat("proof", F.lower(F.hex("subroot")), "root").alias("proof"))
    proofs, path = materialise(proofs, "proofs")
    carried, gone = descend(rounds, proofs)
    leaves = placed.join(rounds[0].groupBy(F.col("grp").alias("of_grp")).agg(F.first("depth").alias("depth")), F.col("grp").eqNullSafe(F.col("of_grp"))).drop("of_grp", "copy")
    out, _ = materialise(with_proofs(leaves, carried, 0).mapInArrow(_rows, MANIFEST), "manifest")
    discard(spark, first, ranged, upper, path, *made, *more, *gone)
    return out


#: Levels that the SQL unrolls: ARITY to the power of these is the most leaves of a language, and languages.
SQL_LEVELS, SQL_UPPER = 7, 3


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of an ASCII string in DuckDB SQL, bit by bit."""
    byte = "list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: xor(v >> 1, (v & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)), lambda c, b: {byte}), 4294967295)"


def _rising_sql(name: str, levels: int) -> str:
    """CTEs name0 (grp, pos, node) to name<levels>, and the runs of each level."""
    out = ""
    for k in range(levels):
        out += f""",
    {name}_runs{k} AS (SELECT grp, pos // {ARITY} AS pos, list(node ORDER BY pos) AS nodes, max(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {name}{k}) GROUP BY grp, pos // {ARITY}),
    {name}{k + 1} AS (SELECT grp, pos, CASE WHEN n = 1 THEN nodes[1] ELSE sha256(array_to_string(nodes, '')) END AS node FROM {name}_runs{k})"""
    return out


def _folding_sql(name: str, levels: int, start: str, others: str) -> str:
    """CTEs that fold rows of `start` (grp, pos, proof, folded, others) through the levels of a tree."""
    out, last = "", start
    for k in range(levels):
        place = f"(p.pos // {ARITY**k} % {ARITY})"
        out += f""",
    {name}_met{k} AS (SELECT p.*, n, array_to_string(nodes[1:{place}], '') AS before, array_to_string(nodes[{place} + 2:], '') AS after
      FROM {last} p JOIN {name}_runs{k} r ON r.grp IS NOT DISTINCT FROM p.grp AND r.pos = p.pos // {ARITY ** (k + 1)}),
    {name}_up{k} AS (SELECT {others}, grp, pos, proof || before || after AS proof, CASE WHEN n = 1 THEN folded ELSE sha256(before || folded || after) END AS folded FROM {name}_met{k})"""
        last = f"{name}_up{k}"
    return out


def manifest_sql() -> str:
    """The query in DuckDB SQL, with the levels written out one by one."""
    value = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"
    leaf = lambda text: f"sha256({' || '.join(value(text if f == 'text' else f) for f in FIELDS)})"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH hashed AS (
      SELECT doc_id, lang AS grp, {leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc32_sql('doc_id::VARCHAR')} % {DRILL} = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS altered FROM documents),
    placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed),
    low0 AS (SELECT grp, pos, leaf AS node FROM placed){_rising_sql('low', SQL_LEVELS)},
    subroots AS (SELECT grp AS lang, node AS subroot, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS place FROM low{SQL_LEVELS}),
    top0 AS (SELECT '' AS grp, place AS pos, subroot AS node FROM subroots){_rising_sql('top', SQL_UPPER)},
    begun AS (SELECT doc_id, leaf, grp, pos, '' AS proof, altered AS folded FROM placed){_folding_sql('low', SQL_LEVELS, 'begun', 'doc_id, leaf')},
    half AS (SELECT doc_id, leaf, subroot, '' AS grp, place AS pos, proof, folded FROM low_up{SQL_LEVELS - 1} JOIN subroots ON lang IS NOT DISTINCT FROM grp){_folding_sql('top', SQL_UPPER, 'half', 'doc_id, leaf, subroot')}
    SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = node AS verified FROM top_up{SQL_UPPER - 1} CROSS JOIN (SELECT node FROM top{SQL_UPPER}) r"""
