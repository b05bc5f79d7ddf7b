"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each word shingle is hashed once; the hash's top bits name one of BINS bins, and a bin keeps its least hash. An
empty bin borrows from another: it tries a fixed random sequence of bins (PROBES of them unrolled, after that all filled
bins in an order drawn for the empty bin) and takes the first filled one, independently for each empty bin, which is
optimal densification. The low 8 bits of each bin are packed, and likeness corrects for their chance agreement.

Null text counts as empty. A text without words has the empty fingerprint: it is like other such texts (1) and
unlike all others (0); a text of fewer words than a shingle is one shingle. Equal texts have equal fingerprints. Repeated
rows are rows; only rows that are alike in id and text both, of whatever number, share a bucket that isn't parted. An
empty table gives an empty one, and only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import math
import random
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
BINS = 128
PROBES = 6
SPLIT = r"[\x20\x09-\x0D]+"
_TOP = 56  # of 63 bits, so that 7 are left
#: Multipliers (odd) and offsets of the probes' hash functions.
_RNG = random.Random(20)
_PROBES = [(_RNG.randrange(1 << 16) | 1, _RNG.randrange(1 << 16)) for _ in range(PROBES)]


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(text: Column, words: int = WORDS) -> Column:
    """Non-negative 63-bit hashes of the word shingles of a text."""

    def of(parts: Column) -> Column:
        few = F.when(F.size(parts) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.concat_ws(" ", parts))))
        many = let(
            F.transform(parts, lambda w: F.xxhash64(w)),
            lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(words)))),
        )
        return F.when(F.size(parts) < words, few).otherwise(many)

    raw = let(F.filter(F.split(text, SPLIT), lambda w: w != ""), of)
    return F.transform(raw, lambda h: h.bitwiseAND(F.lit((1 << 63) - 1)))


def _bin(h: Column) -> Column:
    return F.shiftright(h, _TOP).cast("int")


def fingerprint(text: Column, words: int = WORDS) -> Column:
    """array<bigint> of BINS / 8 packed longs; empty for a text without words."""

    def leasts(ordered: Column) -> Column:
        return F.filter(ordered, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(ordered, i - 1))))

    def filled(least: Column, half: int) -> Column:
        one = lambda h: F.when(F.shiftright(h, _TOP + 6) == half, F.call_function("shiftleft", F.lit(1).cast("long"), _bin(h).bitwiseAND(F.lit(63)))).otherwise(F.lit(0).cast("long"))
        return F.aggregate(least, F.lit(0).cast("long"), lambda a, h: a.bitwiseOR(one(h)))

    def dense(least: Column, low: Column, high: Column) -> Column:
        def at(b: Column) -> Column:
            """The 8 bits of bin b, null if it is empty: its place among the filled bins comes from counting bits."""
            word = F.when(b < 64, low).otherwise(high)
            bit = b.bitwiseAND(F.lit(63))
            below = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), bit))
            place = F.bit_count(word.bitwiseAND(below)) + F.when(b < 64, 0).otherwise(F.bit_count(low))
            there = F.call_function("shiftrightunsigned", word, bit).bitwiseAND(F.lit(1)) == 1
            return F.when(there, F.get(least, place).bitwiseAND(F.lit(255)))

        def probe(b: Column, t: int) -> Column:
            m, c = _PROBES[t]
            return F.shiftright(((b + 1) * m + c).bitwiseAND(F.lit(0xFFFF)), 9).cast("int")

        def last(b: Column) -> Column:
            drawn = F.transform(least, lambda h: F.shiftleft(F.shiftrightunsigned(F.xxhash64(b, _bin(h)), 9), 8).bitwiseOR(h.bitwiseAND(F.lit(255))))
            return F.array_min(drawn).bitwiseAND(F.lit(255))

        return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(at(b), *(at(probe(b, t)) for t in range(PROBES)), last(b)))

    def pack(v: Column) -> Column:
        def word(k: Column) -> Column:
            out = F.get(v, k * 8)
            for j in range(1, 8):
                out = F.shiftleft(out, 8).bitwiseOR(F.get(v, k * 8 + j))
            return out

        return F.transform(F.sequence(F.lit(0), F.lit(BINS // 8 - 1)), word)

    def whole(least: Column) -> Column:
        packed = let(filled(least, 0), lambda low: let(filled(least, 1), lambda high: let(dense(least, low, high), pack)))
        return F.when(F.size(least) > 0, packed).otherwise(F.array().cast("array<bigint>"))

    return let(let(F.sort_array(shingles(text, words)), leasts), whole)


def same_bytes(a: Column, b: Column) -> Column:
    """How many of the eight bytes of two longs are equal: a byte's bits are folded into its lowest."""
    x = a.bitwiseXOR(b)
    for n in (4, 2, 1):
        x = x.bitwiseOR(F.shiftrightunsigned(x, n))
    return 8 - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets of two fingerprints."""
    hits = F.aggregate(F.zip_with(a, b, same_bytes), F.lit(0), lambda n, x: n + x)
    chance = 1.0 / 256
    value = F.greatest(F.lit(0.0), (hits / F.lit(float(BINS)) - chance) / (1 - chance))
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(both, value).when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(0.0)


def as_text(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


#: A key's bucket is parted into at most 2**PARTS.
PARTS = 12
_LEAST = -(1 << 63)


def _buckets(rows: DataFrame, n: int) -> Column:
    """The number of a row's bucket, from 0 for the largest keys: n buckets of about as many rows, and more for crowded keys.

    Bounds are looked up in two steps, so a row meets about twice the root of n of them. A key that stands at several bounds
    has a bucket of its own, parted by the hash of the text, as that is the order of its rows.
    """
    at = [i / n for i in range(1, n)]
    found = (rows.agg(F.percentile_approx("key", at, 10_000)).first()[0] if n > 1 else None) or []
    crowded = {k: min(PARTS, (c - 1).bit_length()) for k, c in Counter(found).items() if c > 1}
    bounds = sorted({*found, *(k - 1 for k in crowded if k > _LEAST)}, reverse=True)
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    array = lambda xs: f"array({', '.join(f'{x}L' if x > -(1 << 63) else 'bigint(-9223372036854775808)' for x in xs)})"
    coarse = F.expr(f"size(filter({array([g[0] for g in groups])}, b -> b >= key))")
    fine = F.expr(f"array({', '.join(array(g) for g in groups)})")
    inside = lambda c: F.when(c == 0, 0).otherwise((c - 1) * step + F.size(F.filter(F.get(fine, c - 1), lambda b: b >= F.col("key"))))
    bucket = F.shiftleft(let(coarse, inside).cast("long"), PARTS)
    if not crowded:
        return bucket
    bits = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, b in crowded.items() for x in (k, b))), F.col("key")), F.lit(0))
    rising = F.call_function("shiftrightunsigned", F.col("tie").bitwiseXOR(F.lit(_LEAST)), F.lit(64) - bits)
    return bucket + F.when(bits > 0, F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1 - rising).otherwise(0)


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, text, mark and next_text, next_mark: those of the next row in descending doc_id.

    After the last comes the first. Null ids are smallest, rows of one id are in the order of a hash of the text.
    The order is dealt into buckets by bounds of the ids; each bucket gets the first row of the next one as a guest.
    """
    spark = docs.sparkSession
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(1 << 63))).cast("long").alias("key"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.withColumn("bucket", _buckets(rows, n).cast("long"))
    heads = rows.groupBy("bucket").agg(F.max_by("text", F.struct("key", "tie")).alias("text"))
    # one row for each bucket, and no text in the ordered part
    used = [r.bucket for r in rows.select("bucket").distinct().orderBy("bucket").collect()]
    before = {b: used[i - 1] for i, b in enumerate(used)}
    place = F.expr(f"element_at(map({', '.join(f'{b}L, {p}L' for b, p in before.items())}), bucket)") if before else F.col("bucket")
    guests = heads.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("tie"), place.alias("bucket"), F.lit(True).alias("guest"))
    everyone = rows.withColumn("guest", F.lit(False)).unionByName(guests).withColumn("mark", fingerprint(F.col("text")))
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("key"), F.desc("tie"))
    led = everyone.withColumn("next_text", F.lead("text").over(order)).withColumn("next_mark", F.lead("mark").over(order))
    return led.where("not guest").select("doc_id", "text", "mark", "next_text", "next_mark")


def fingerprints_with_edits(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many of the next document's.
    """
    led = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), F.col("n_chars").cast("int") - half), F.col("next_text").substr(F.lit(1), half))
    out = led.select("doc_id", "n_chars", "mark", "next_mark", edited.alias("edited"))
    out = out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "mark", fingerprint(F.col("edited")).alias("edited_mark"), "next_mark")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("mark")).alias("fingerprint"), as_text(F.col("edited_mark")).alias("edited_fingerprint"),
        likeness(F.col("mark"), F.col("edited_mark")).alias("near_edited"), likeness(F.col("mark"), F.col("next_mark")).alias("near_next"),
    )
