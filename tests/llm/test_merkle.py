"""The Merkle manifest against a plain tree and its SQL."""

import hashlib
import random
import zlib

import duckdb
import pyarrow as pa
import pytest

from sievewright.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n = row
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text))


def tree(leaves):
    """The root, and for each leaf the levels' siblings (before, after)."""
    ways, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for i, p in enumerate(at):
            run = runs[p // 8]
            ways[i].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
            at[i] = p // 8
        level = [h(r) for r in runs]
    return level[0], ways


def plain(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        ordered = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = ordered, *tree([leaf(r) for r in ordered])
    root, above = tree([trees[x][1] for x in langs])
    out = []
    for lang, upper in zip(langs, above):
        ordered, subroot, ways = trees[lang]
        for r, way in zip(ordered, ways):
            path = [*way, *upper]
            node = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                node = leaf((r[0], r[1].translate({c: c + 32 for c in range(65, 91)}), *r[2:]))
            for before, after in path:
                node = h([before, node, after])
            out.append((r[0], leaf(r), subroot, root, h(b + a for b, a in path), node, node == root))
    return sorted(out, key=repr)


def rows_of(seed, sizes, nulls=True):
    rng = random.Random(seed)
    out = []
    for lang, n in sizes.items():
        for i in range(n):
            text = rng.choice(["Abc É", "lower", "X" * rng.randint(1, 40)]) + str(rng.random())
            out.append((len(out), text, lang, rng.choice(["a", None, "é"]), rng.randint(0, 9)))
    if nulls and out:
        out += [(None, None, None, None, None), (None, "T", "en", "s", 1), (out[0][0], "Other", *out[0][2:]), out[0], out[0], (10**6, "", "en", "", 0), (10**6 + 1, "Z" * 200_000, "en", "a", 5)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("n", [1, 2, 8, 9, 63, 64, 65, 511, 512, 513, 1_100])
def test_paths_of_a_block_fold_to_its_root(n):
    leaves = [h([str(i)]) for i in range(min(n, merkle.BLOCK))]
    levels = 0
    while 8**levels < len(leaves):
        levels += 1
    root, ways = tree(leaves)
    assert merkle.block_root(leaves, levels) == root
    assert [list(p) for p in merkle.paths(leaves, levels)] == ways
    assert all(merkle.fold(x, w) == root for x, w in zip(leaves, ways))


def test_memory_of_a_walk_is_a_few_runs():
    grown = merkle.Growing(2)
    for i in range(512):
        grown.absorb(h([str(i)]))
        assert sum(map(len, grown.stack)) <= 8 * 3
    assert len(grown.finish()) == 8


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 2, None: 1}, {"en": 70, "de": 8, None: 9, "": 1}, {"en": 1_200, "fr": 513, "é": 512}, {f"l{i}": 1 + i % 3 for i in range(80)}])
def test_manifest_against_a_plain_tree(spark, sizes):
    rows = rows_of(len(sizes), sizes)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"{DOCS}, leaf string, POS long").repartition(5)
    got = sorted(map(tuple, merkle.manifest(df).select(NAMES).collect()), key=repr)
    assert got == plain(rows)


def test_manifest_against_sql(spark):
    rows = rows_of(4, {"en": 600, "de": 30, None: 3, "fr": 1})
    con = duckdb.connect()
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
    con.register("documents", pa.table({n.split()[0]: pa.array(c, k) for n, c, k in zip(DOCS.split(", "), zip(*rows), kinds)}))
    assert sorted(con.sql(merkle.manifest_sql()).fetchall(), key=repr) == plain(rows)


def test_without_a_drill_all_rows_are_verified(spark):
    rows = rows_of(5, {"en": 100, "de": 10})
    got = merkle.manifest(spark.createDataFrame(rows, DOCS), drill=None)
    assert got.where("not verified").count() == 0 and got.count() == len(rows)


def test_a_change_is_found_by_the_row_alone(spark):
    rows = rows_of(6, {"en": 100}, nulls=False)
    tampered = [r for r in merkle.manifest(spark.createDataFrame(rows, DOCS)).collect() if not r.verified]
    ids = {r[0]: r for r in rows}
    assert {r.doc_id for r in tampered} == {i for i, r in ids.items() if zlib.crc32(str(i).encode()) % 3 == 0 and r[1] != r[1].translate({c: c + 32 for c in range(65, 91)})}


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
