"""SimHash near-dedup: fingerprints of word shingles, linked through a byte-position inverted index.

A fingerprint is eight positional bytes: tokens (position, byte), of which there are 2,048. Two fingerprints of at most two
differing bits differ in at most two bytes, so the guaranteed minimum is six shared tokens of eight. Tokens are ordered
by how many fingerprints hold them, rarest first, so that bytes which a third of the corpus shares come last. Of two
fingerprints that share six of eight tokens, the six rarest of each have at least four in common; the index therefore
lists a fingerprint under every four of its six rarest tokens, which is where four posting lists meet. Pairs of one list
are tallied by the positional bytes they share, kept from six up, and verified bit by bit. (Posting lists of single bytes
hold a 256th of the corpus at best, and their pairs grow with its square: 1.2e8 pairs for the three rarest bytes on
0.5 GB, 4e11 on 30 GB.) Only different fingerprints are indexed; equal ones are one class.

A list of more than LIST fingerprints (a large cloud of near copies) isn't paired. Its members are linked
exactly through their one-bit neighbours instead: two fingerprints differ in at most two bits just if they have a
common value among themselves and their one-bit neighbours, and at most 65 fingerprints have any one such value.

Null or empty text has fingerprint zero and is linked like any other.

`jaccard_components` joins texts whose sets of shingles have a Jaccard similarity of at least a bound, exactly. Two texts at
0.8 lie some ten bits apart, where byte positions guarantee nothing, so the same inverted index with count filtering is
kept over shingles. Shingles are ordered by how many texts of a sample hold them (the order changes the work, not the
result), then by hash; the sample is a share of the texts, so that what more than CROWD texts hold is known at any size; of a set of n, the first n - ceil(bound * n) + TALLY are listed, and two sets within the bound
share at least TALLY of these (or all that they must share, if that is fewer). Pairs of one list are tallied, kept from the
guaranteed minimum up, and verified on the whole sets: candidates that hang together are one group, to which each set goes
once, whatever the number of its pairs. Of groups that weigh over MEET, each set first meets one partner; of their other pairs
only those of different components are verified, as pairs.

Lists of more than CROWD sets (many near copies of one text, or a phrase that stands everywhere) aren't tallied. Two sets of n
and m shingles within the bound have bound / (1 + bound) * (n + m) in common, none of them before the first one that they share; so
at its place i in a set, the partner has at most (n - i) * (1 + bound) / bound - n shingles. That leaves a set in few of
its crowded lists, and in none where no other set of a fitting size can be reached: a phrase that a third of the corpus shares
is late in the order, and what is early in a set is its own. What is left first meets in groups of about MEET of the same
list, which joins nearly all that belong together; then the sets outside a list's largest component meet all others of the list, in
blocks: a set goes once to a block, where the sets' common shingles are counted by a product of matrices, and what leaves a block are
its components' stars. Pairs within a component can't change it, so nothing is lost.
"""

from __future__ import annotations

from itertools import accumulate, combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, hash_sample, is_empty, materialise
from .components import connected_components

WORDS = 3
SEED = 42
BITS = 2
LIST = 32
#: Shingle width and Jaccard similarity of near copies, and the shared listed shingles that a pair is kept for.
NEAR_WORDS, NEAR, TALLY = 5, 0.8, 4
#: Documents that the order of shingles is learned from (one of SHARE, at least SAMPLE, to twice as many), and shingles that it names.
SAMPLE, SHARE, COMMON = 8_192, 8, 500_000
#: Bits of the filter that texts pass before their sets are packed; more members let more texts pass, a join drops these.
FILTER = 1 << 25
#: A longer list isn't tallied: MEETINGS of a member's crowded lists deal it into groups of about MEET, and blocks hold about MEET members
#: a side (a set of more than HEAVY shingles counts for several).
CROWD, MEET, MEETINGS, HEAVY = 64, 128, 4, 4_096
#: Fingerprints of a text in `near_components`, the positional bytes that two of one place share, and the bits that they differ in at most:
#: those that meet, and all of them on average.
NEAR_MARKS, NEAR_MET, RADIUS, SPREAD = 3, 3, 14, 21
#: Columns of the matrices that common shingles are counted by at a time, and members unpacked at a time.
COLUMNS, ROWS = 8_192, 256


def shingle_hashes(text: str | None, words: int = WORDS, seed: int = SEED) -> list[int]:
    """XXH64 of each word shingle, A-Z lower-cased, words parted by ASCII white space."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return []
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return [digest(joined, seed)]
    starts = list(accumulate((len(p) + 1 for p in parts), initial=0))
    return [digest(joined[a : b - 1], seed) for a, b in zip(starts, starts[words:])]


def fingerprint(hashes: list[int] | np.ndarray) -> int:
    """Signed 64 bits; a bit is 1 if set in over half of the hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(np.asarray(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view("<i8")[0])


def _fingerprints(words: int, seed: int):
    def run(batches):
        for batch in batches:
            marks = [fingerprint(shingle_hashes(t.as_py(), words, seed)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(marks, pa.int64())], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(words, seed), "doc_id long, fp long")


def shared_bytes(a: str, b: str) -> Column:
    """How many positional bytes two longs share: a byte's differing bits are folded into its lowest."""
    x = F.col(a).bitwiseXOR(F.col(b))
    for n in (4, 2, 1):
        x = x.bitwiseOR(F.shiftrightunsigned(x, n))
    return 8 - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))


#: Positional bytes of a fingerprint, those two within BITS share at least, and the tokens indexed and met of these.
BYTES, SHARED = 8, 8 - BITS
MET = 4
PREFIX = BYTES - SHARED + MET


def positional_bytes(fp: str = "fp") -> Column:
    """The tokens of a fingerprint: position * 256 + byte."""
    return F.array(*((F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255)) + 256 * i).cast("int") for i in range(BYTES)))


def index_keys(marks: DataFrame) -> tuple[Column, Column]:
    """The ranks of a fingerprint's tokens, rarest first, and the keys of its lists from these: every MET of its PREFIX rarest tokens, as ranks of 11 bits each."""
    counts = {r.token: r.n for r in marks.select(F.explode(positional_bytes()).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranks = [0] * (256 * BYTES)
    for rank, token in enumerate(sorted(range(256 * BYTES), key=lambda t: (counts.get(t, 0), t))):
        ranks[token] = rank
    rank_of = F.expr(f"array({', '.join(map(str, ranks))})")
    rarest = F.array_sort(F.transform(positional_bytes(), lambda t: F.get(rank_of, t).cast("long")))

    def key(places: tuple[int, ...]) -> Column:
        out = F.lit(0).cast("long")
        for i in places:
            out = F.shiftleft(out, 11).bitwiseOR(F.get(F.col("rarest"), i))
        return out

    return rarest, F.array(*(key(c) for c in combinations(range(PREFIX), MET)))


def links(marks: DataFrame, most: int = LIST) -> DataFrame:
    """marks (fp long, distinct) -> (a, b) links that join just the fingerprints of at most two differing bits.

    Links of crowded lists are stars of a whole neighbourhood, so that components, not pairs, are complete.
    """
    rarest, keys = index_keys(marks)
    postings = marks.select("fp", rarest.alias("rarest")).select("fp", F.explode(keys).alias("list"))
    sizes = postings.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    listed, _ = materialise(postings.join(sizes, "list"), "postings")
    short = listed.where(F.col("n") <= most)
    pairs = short.select("list", F.col("fp").alias("a")).join(short.select("list", F.col("fp").alias("b")), "list").where("a < b")
    verified = pairs.where(shared_bytes("a", "b") >= SHARED).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS).select("a", "b")
    crowded = listed.where(F.col("n") > most).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    near = crowded.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    stars = near.groupBy("value").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1).select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b")
    return verified.unionByName(stars).distinct()


def simhash_components(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """docs (doc_id long, text string) -> doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Repeated rows come out as often as they came in. Null ids take part; they are a component's id only if it has no other.
    """
    marks, _ = materialise(fingerprints(docs, words, seed), "simhash")
    classes = marks.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots, _ = materialise(connected_components(links(classes.select("fp"))), "roots")
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marks.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _shingle_set(text: str | None, words: int, seed: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words, seed), np.uint64))


def _counted(words: int, seed: int):
    def run(batches):
        for batch in batches:
            sets = [_shingle_set(t.as_py(), words, seed) for t in batch.column("text")]
            value, n = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], names=["h", "n"])

    return run


def common_shingles(docs: DataFrame, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of shingles that at least three texts of a sample hold, in order, and how many do."""
    total = docs.count()
    sample = hash_sample(docs, max(SAMPLE, total // SHARE), "doc_id", total=total).select("text")
    counts = sample.mapInArrow(_counted(words, seed), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 2")
    counts, path = materialise(counts, "counts")
    # the least count that leaves COMMON shingles; there are no more counts than texts of the sample, and few of them
    named, least = 0, None
    for row in counts.groupBy("n").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("n")).toLocalIterator():
        if named + row.c > COMMON:
            break
        named, least = named + row.c, row.n
    found = counts.where(F.lit(False) if least is None else F.col("n") >= least).toArrow()
    discard(docs.sparkSession, path)
    names = found.column("h").to_numpy().view(np.uint64)
    order = np.argsort(names)
    return names[order], found.column("n").to_numpy()[order]


def _sets(words: int, seed: int, least: float, common):
    """doc_id, text -> doc_id, a digest of the set in two longs, its size, and the shingles it is listed under."""

    def run(batches):
        names, counts = common.value
        for batch in batches:
            new: list[list] = [[], [], [], []]
            for t in batch.column("text"):
                s = _shingle_set(t.as_py(), words, seed)
                digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")
                n = len(s)
                listed = s
                if n and len(names):
                    at = np.minimum(np.searchsorted(names, s), len(names) - 1)
                    # stable, so that equal counts stay in the order of hashes
                    listed = s[np.argsort(np.where(names[at] == s, counts[at], 0), kind="stable")]
                for c, v in zip(new, (digest[0], digest[1], n, listed[: n - ceil(least * n - 1e-9) + TALLY].view(np.int64))):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(new, kinds))], names=["doc_id", "d0", "d1", "size", "listed"])

    return run


def _place() -> Column:
    """The bit of an id in the filter."""
    return F.xxhash64("id").bitwiseAND(F.lit(FILTER - 1))


def id_filter(ids: DataFrame) -> np.ndarray:
    """ids (id) -> FILTER bits, as bytes; a set bit may also be another id's. Its size doesn't depend on the number of ids."""
    octets = ids.select(_place().alias("at")).groupBy(F.shiftright("at", 3).alias("octet")).agg(F.bit_or(F.expr("shiftleft(1, int(at & 7))")).alias("bits")).toArrow()
    bits = np.zeros(FILTER // 8, np.uint8)
    bits[octets.column("octet").to_numpy()] = octets.column("bits").to_numpy()
    return bits


def _packed(words: int, seed: int, wanted):
    """id, text, at -> id and packed set of those that pass the filter."""

    def run(batches):
        bits = wanted.value
        for batch in batches:
            at = batch.column("at").to_numpy()
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            sets = [_shingle_set(t.as_py(), words, seed).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return run


def _verified(least: float):
    def run(batches):
        for batch in batches:
            kept = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                s, o = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(s, o, assume_unique=True))
                kept.append(both >= least * (len(s) + len(o) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return run


def _sizes_allow(least: float) -> Column:
    return F.least("size_a", "size_b") >= F.lit(least) * F.greatest("size_a", "size_b") - F.lit(1e-9)


def _sides(rows: DataFrame, *shared: str) -> tuple[DataFrame, DataFrame]:
    others = [c for c in rows.columns if c not in shared]
    return tuple(rows.select(*shared, *(F.col(c).alias(x if c == "id" else f"{c}_{x}") for c in others)) for x in "ab")


def postings(sets: DataFrame, crowd: int = CROWD) -> tuple[DataFrame, DataFrame, list[str]]:
    """sets (id, size, listed) of distinct sets -> rows (h, id, size, place, n) of lists of two to `crowd` sets, and of longer ones; the tables they read.

    The first have a column `long`, too: how many longer lists the set is in.
    """
    each = sets.select("id", "size", F.posexplode("listed").alias("place", "h"))
    counts = each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts, counted = materialise(counts, "counts")  # alone, so that its shuffle is gone when the next begins
    shared, path = materialise(each.join(counts, "h"), "shared")
    discard(sets.sparkSession, counted)
    crowded, other = materialise(shared.where(F.col("n") > crowd), "crowded")
    longs = crowded.groupBy("id").agg(F.count(F.lit(1)).alias("long"))
    return shared.where(F.col("n") <= crowd).join(longs, "id", "left").withColumn("long", F.coalesce("long", F.lit(0))), crowded, [path, other]


def tallied(short: DataFrame, least: float) -> DataFrame:
    """(a, b) of sets that share enough listed shingles, those in longer lists counted as if shared."""
    a, b = _sides(short.select("h", "id", "size", "long"), "h")
    pairs = a.join(b, "h").where("a < b").where(_sizes_allow(least))
    tally = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(F.least("long_a", "long_b")).alias("long"), F.min(F.greatest("size_a", "size_b")).alias("size"))
    return tally.where(F.col("n") + F.col("long") >= F.least(F.lit(TALLY), F.ceil(F.lit(least) * F.col("size") - F.lit(1e-9)))).select("a", "b")


def reaching(crowded: DataFrame, least: float) -> DataFrame:
    """The rows of longer lists at which a set can share its first shingle with another of the list, by both sizes and places."""
    reach = (F.col("size") - F.col("place")) * ((1 + least) / least) - F.col("size") + 1e-9
    rows = crowded.withColumn("reach", reach).where(F.col("reach") >= F.col("size") * least - 1e-9)
    # a list has few distinct sizes, whatever the number of its sets
    sizes = rows.groupBy("h", "size").agg(F.max("reach").alias("reach"), F.count(F.lit(1)).alias("c"))
    others = sizes.select("h", F.col("size").alias("m"), F.col("reach").alias("reach_m"))
    fits = F.col("m").between(F.col("size") * least - 1e-9, F.col("reach")) & (F.col("reach_m") >= F.col("size")) & ((F.col("m") != F.col("size")) | (F.col("c") > 1))
    partners = sizes.join(others, "h").where(fits).groupBy("h", "size").agg(F.min("m").alias("m"))
    return rows.join(partners, ["h", "size"]).where(F.col("reach") >= F.col("m")).select("h", "id", "size", "n")


def _weight() -> Column:
    return 1 + F.floor(F.col("size") / HEAVY)


def _dealt(count: Column, meet: int, salt: int) -> Column:
    """A member's block of so many that each weighs about `meet`."""
    return F.pmod(F.xxhash64(F.lit(salt), "h", "id"), F.ceil(count / meet).cast("long"))


#: Sides of a member in a block: met by the others, or met by all.
LEFT, RIGHT, BOTH = 0, 1, 2


def meetings(rows: DataFrame, meet: int = MEET) -> DataFrame:
    """Blocks (h, p, q, id, side, root) of members of one list that meet each other."""
    order = Window.partitionBy("id").orderBy("n", F.xxhash64("h"))
    some = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= MEETINGS)
    weights = rows.groupBy("h").agg(F.sum(_weight()).alias("w"))
    return some.join(weights, "h").select("h", _dealt(F.col("w"), meet, 0).alias("p"), F.lit(0).cast("long").alias("q"), "id", F.lit(BOTH).alias("side"), F.col("id").alias("root"))


def apart(rows: DataFrame, roots: DataFrame, meet: int = MEET) -> DataFrame:
    """Blocks (h, p, q, id, side, root) in which members outside a list's largest component meet all of the list."""
    rooted, _ = materialise(rows.join(roots.withColumnRenamed("node", "id"), "id", "left").select("h", "id", "size", F.coalesce("root", "id").alias("root")), "rooted")
    sizes = rooted.groupBy("h", "root").agg(F.count(F.lit(1)).alias("c"), F.sum(_weight()).alias("w"))
    split = sizes.groupBy("h").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.max_by("w", F.struct("c", "root")).alias("main_w"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    split, _ = materialise(split.select("h", "main", "w", (F.col("w") - F.col("main_w")).alias("left_w")), "split")
    every = rooted.join(split, "h")
    counts = lambda c: F.sequence(F.lit(0).cast("long"), F.ceil(F.col(c) / meet).cast("long") - 1)
    p, q = _dealt(F.col("left_w"), meet, 1), _dealt(F.col("w"), meet, 2)
    left = every.where("root <> main").select("h", p.alias("p"), F.explode(counts("w")).alias("q"), "id", F.lit(LEFT).alias("side"), "root")
    right = every.select("h", F.explode(counts("left_w")).alias("p"), q.alias("q"), "id", F.lit(RIGHT).alias("side"), "root")
    return left.unionByName(right)


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of the left sets has in common with each of the right ones."""
    sides = []
    for sets in (left, right):
        sides.append((np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
    names = np.intersect1d(sides[0][0], sides[1][0])
    counts = np.zeros((len(left), len(right)), np.int64)
    places = []
    for values, owner in sides:
        at = np.minimum(np.searchsorted(names, values), max(len(names) - 1, 0))
        kept = names[at] == values if len(names) else np.zeros(len(values), bool)
        order = np.argsort(at[kept], kind="stable")
        places.append((at[kept][order], owner[kept][order]))
    for start in range(0, len(names), COLUMNS):
        parts = []
        for (at, owner), n in zip(places, counts.shape):
            a, b = np.searchsorted(at, (start, start + COLUMNS))
            m = np.zeros((n, min(COLUMNS, len(names) - start)), np.float32)
            m[owner[a:b], at[a:b] - start] = 1
            parts.append(m)
        counts += (parts[0] @ parts[1].T).astype(np.int64)
    return counts


def stars(left: np.ndarray, right: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Links (least member, other member) of the components that near pairs of a block make: no more than it has members."""
    ids = np.unique(np.concatenate([left, right]))
    a, b = np.searchsorted(ids, left), np.searchsorted(ids, right)
    linked = np.zeros((len(ids), len(ids)), bool)
    linked[np.ix_(a, b)] |= near
    linked |= linked.T
    label = np.arange(len(ids))
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], len(ids)).min(axis=1, initial=len(ids)))
        least = least[least]
        if (least == label).all():
            break
        label = least
    others = np.flatnonzero(label != np.arange(len(ids)))
    return np.stack([ids[label[others]], ids[others]], axis=1)


def _block_links(least: float):
    names = ("h", "p", "q", "side", "id", "root", "shingles")

    def judged(rows):
        left, right = ([r for r in rows if r[3] != other] for other in (RIGHT, LEFT))
        if not left or not right:
            return None
        sets = [[np.frombuffer(r[6], np.uint64) for r in side] for side in (left, right)]
        sizes = [np.array([len(x) for x in side]) for side in sets]
        ids, roots = ([np.array([r[i] for r in side], np.int64) for side in (left, right)] for i in (4, 5))
        both = common_counts(*sets)
        near = (both >= least * (sizes[0][:, None] + sizes[1][None, :] - both) - 1e-9) & (roots[0][:, None] != roots[1][None, :])
        links = stars(ids[0], ids[1], near)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    def run(batches):
        key, rows = None, []
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if row[:3] != key and rows:
                    if (out := judged(rows)) is not None:
                        yield out
                    rows = []
                key = row[:3]
                rows.append(row)
        if rows and (out := judged(rows)) is not None:
            yield out

    return run


def groups(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """pairs (a, b) of candidates and sizes (id, size) -> id, h, w: the group of candidates that hang together, and its weight."""
    grouped = connected_components(pairs).select(F.col("node").alias("id"), F.col("root").alias("h")).join(sizes, "id")
    return grouped.select("id", "h").join(grouped.groupBy("h").agg(F.sum(_weight()).alias("w")), "h")


def crossing(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that known components (node, root) don't join."""
    each = pairs
    for x in "ab":
        each = each.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")), x, "left")
    return each.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _closed(docs: DataFrame, marks: DataFrame, classes: DataFrame, pairs: DataFrame, rows: DataFrame, spent: list[str], words: int, least: float, seed: int, meet: int) -> DataFrame:
    """doc_id, component_id by the pairs (a, b) and the members of one list (h, id, size, n) in `rows` that the exact check leaves; `spent` are tables that go then."""
    spark = docs.sparkSession
    grouped, grouping = materialise(groups(pairs, marks.select(F.col("doc_id").alias("id"), "size")), "groups")
    # what a member meets, so that each step moves the sets that it needs only
    uses = [grouped.select("id", (F.col("w") <= meet).alias("small"), (F.col("w") > meet).alias("large"), F.lit(False).alias("listed"))]
    uses.append(rows.select("id", F.lit(False).alias("small"), F.lit(False).alias("large"), F.lit(True).alias("listed")))
    wanted = uses[0].unionByName(uses[1]).groupBy("id").agg(*(F.bool_or(c).alias(c) for c in ("small", "large", "listed")))
    wanted, other = materialise(wanted, "wanted")
    passed = spark.sparkContext.broadcast(id_filter(wanted))
    texts = docs.select(F.col("doc_id").alias("id"), "text").withColumn("at", _place())
    sets, held = materialise(texts.mapInArrow(_packed(words, seed, passed), "id long, shingles binary").join(wanted, "id"), "members")
    discard(spark, other)

    def met(blocks: DataFrame, used: str) -> DataFrame:
        dealt = blocks.join(sets.where(used).select("id", "shingles"), "id").repartition("h", "p", "q").sortWithinPartitions("h", "p", "q")
        return materialise(dealt.mapInArrow(_block_links(least), "a long, b long"), "links")[0]

    def verified(some: DataFrame) -> DataFrame:
        sides = [sets.where("large").select(F.col("id").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab"]
        both = some.join(sides[1], "b").join(sides[0], "a")
        return materialise(both.select("a", "b", "set_a", "set_b").mapInArrow(_verified(least), "a long, b long"), "links")[0]

    small = grouped.where(F.col("w") <= meet).select("h", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), "id", F.lit(BOTH).alias("side"), F.col("id").alias("root"))
    large, others = materialise(pairs.join(grouped.where(F.col("w") > meet).select(F.col("id").alias("a")), "a", "left_semi"), "large")
    left, lists = not is_empty(large), not is_empty(rows)
    links = met(small, "small")
    if lists:
        links = links.unionByName(met(meetings(rows, meet), "listed"))
    if left:
        links = links.unionByName(verified(large.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")))
    roots, _ = materialise(connected_components(links), "roots")
    # what is joined already needs no more pairs
    if left:
        links = links.unionByName(verified(crossing(large, roots)))
    if lists:
        links = links.unionByName(met(apart(rows, roots, meet), "listed"))
    discard(spark, held, grouping, others, *spent)
    if left or lists:
        roots, _ = materialise(connected_components(links), "roots")
    # the root of a component is its least class, and a class is its least doc_id
    named = classes.join(roots.withColumnRenamed("node", "id"), "id", "left").select("d0", "d1", F.coalesce("root", "id").alias("component_id"))
    return marks.select("doc_id", "d0", "d1").join(named, ["d0", "d1"]).select("doc_id", "component_id")


def jaccard_components(docs: DataFrame, words: int = NEAR_WORDS, least: float = NEAR, seed: int = SEED, crowd: int = CROWD, meet: int = MEET) -> DataFrame:
    """docs (doc_id long, unique and never null, text string) -> doc_id, component_id (smallest doc_id reachable).

    Texts are linked if the Jaccard similarity of their sets of word shingles is at least `least`; empty sets are equal.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    common = spark.sparkContext.broadcast(common_shingles(docs, words, seed))
    marks, _ = materialise(docs.mapInArrow(_sets(words, seed, least, common), "doc_id long, d0 long, d1 long, size int, listed array<long>"), "sets")
    classes, _ = materialise(marks.groupBy("d0", "d1").agg(F.min("doc_id").alias("id")), "classes")
    short, crowded, listed = postings(marks.join(classes.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").withColumnRenamed("doc_id", "id"), crowd)

    # tables go as soon as nothing reads them
    rows, reached = materialise(reaching(crowded, least), "reaching")
    pairs, candidates = materialise(tallied(short, least), "candidates")
    discard(spark, *listed)
    return _closed(docs, marks, classes, pairs, rows, [candidates, reached], words, least, seed, meet)


def _mixed(hashes: np.ndarray, n: int) -> np.ndarray:
    """The n-th fingerprint's hashes of the same shingles; the first are the shingles' own."""
    if not n:
        return hashes
    x = hashes + np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _near_marks(words: int, seed: int, marks: int):
    """doc_id, text -> doc_id, a digest of the set in two longs, its size, and its fingerprints."""

    def run(batches):
        for batch in batches:
            new: list[list] = [[], [], [], []]
            for t in batch.column("text"):
                s = _shingle_set(t.as_py(), words, seed)
                digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")
                for c, v in zip(new, (digest[0], digest[1], len(s), [fingerprint(_mixed(s, n)) for n in range(marks)])):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(new, kinds))], names=["doc_id", "d0", "d1", "size", "fps"])

    return run


def _near_lists(fp: str, n: int) -> Column:
    """The lists of the n-th fingerprint: every NEAR_MET of its positional bytes; the lowest three bits are the last one's place."""

    def key(number: int, places: tuple[int, ...]) -> Column:
        out = F.lit(number).cast("long")
        for i in places:
            out = F.shiftleft(out, 8).bitwiseOR(F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255)))
        return F.shiftleft(out, 3).bitwiseOR(F.lit(places[-1]))

    every = list(combinations(range(BYTES), NEAR_MET))
    return F.array(*(key(n * len(every) + i, places) for i, places in enumerate(every)))


def near_pairs(listed: DataFrame) -> DataFrame:
    """listed (list, id, fp) -> (a, b) of one list within RADIUS bits; of the lists that two share only the first gives them."""
    a, b = (listed.select("list", F.col("id").alias(x), F.col("fp").alias(f"fp_{x}")) for x in "ab")
    x = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    apart = x
    for n in (4, 2, 1):
        apart = apart.bitwiseOR(F.shiftrightunsigned(apart, n))
    last = F.col("list").bitwiseAND(F.lit(7)).cast("int")
    upto = F.get(F.array(*(F.lit(0x0101010101010101 >> 8 * (BYTES - 1 - i)).cast("long") for i in range(BYTES))), last)
    return a.join(b, "list").where("a < b").where(F.bit_count(x) <= RADIUS).where(F.bit_count(apart.bitwiseAND(upto)) == last + 1 - NEAR_MET).select("a", "b")


def near_components(docs: DataFrame, words: int = NEAR_WORDS, least: float = NEAR, seed: int = SEED, marks: int = NEAR_MARKS, crowd: int = CROWD, meet: int = MEET) -> DataFrame:
    """docs (doc_id long, unique and never null, text string) -> doc_id, component_id (smallest doc_id reachable).

    Texts are linked if SimHash brings them together and the Jaccard similarity of their sets of word shingles is at least
    `least`; empty sets are equal. They come together where NEAR_MET positional bytes of one of their fingerprints are the same.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    found, _ = materialise(docs.mapInArrow(_near_marks(words, seed, marks), "doc_id long, d0 long, d1 long, size int, fps array<long>"), "marks")
    classes, _ = materialise(found.groupBy("d0", "d1").agg(F.min("doc_id").alias("id")), "classes")
    kinds, other = materialise(found.join(classes.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "size", "fps"), "kinds")
    spent, short, crowded = [other], None, None
    for n in range(marks):
        each = kinds.select("id", F.get("fps", F.lit(n)).alias("fp")).select("id", "fp", F.explode(_near_lists("fp", n)).alias("list"))
        sized = each.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("list"))).where("n > 1")
        listed, path = materialise(sized, "listed")
        pairs, candidates = materialise(near_pairs(listed.where(F.col("n") <= crowd)), "pairs")
        rows = listed.where(F.col("n") > crowd).select(F.col("list").alias("h"), "id", "n")
        short, crowded = (one if every is None else every.unionByName(one) for every, one in ((short, pairs), (crowded, rows)))
        spent += [path, candidates]
    rows, path = materialise(crowded.join(kinds.select("id", "size"), "id").select("h", "id", "size", "n"), "crowded")
    sides = [kinds.select(F.col("id").alias(x), F.col("size").alias(f"size_{x}"), F.col("fps").alias(f"fps_{x}")) for x in "ab"]
    bits = F.aggregate(F.zip_with("fps_a", "fps_b", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, x: a + x)
    both = short.distinct().join(sides[0], "a").join(sides[1], "b").where(_sizes_allow(least)).where(bits <= SPREAD * marks)
    pairs, candidates = materialise(both.select("a", "b"), "candidates")
    discard(spark, *spent)
    return _closed(docs, found, classes, pairs, rows, [candidates, path], words, least, seed, meet)
