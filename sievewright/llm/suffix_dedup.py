"""Suffix-array dedup over a run-length index.

A byte is removed when a string of `least` bytes that covers it also starts at any other place, in the same
document or another. The corpus is not indexed as one text. Each such string holds one anchor, the gram of
`GRAM` bytes with the smallest hash in it, so equal strings meet under equal anchors:

1. every anchor gives a row of its gram's hash and the hash of its whole surroundings (no text);
2. grams seen once can't repeat; surroundings seen twice repeat in full;
3. for grams with several kinds of surroundings, one of each kind is dealt by gram to run-length indexes
   (`run_index`) of bounded size, along which matching statistics are streamed and long matches marked;
4. a gram of more than `hot` kinds is first parted by longer cores, then into single strings, which are only
   counted; so no group of unbounded size is gathered.

Surroundings are taken as equal if two hashes of 64 bits are, that of the gram and that of the whole (their bytes, at most
352, aren't compared); everything else goes by bytes or digests of 128 bits.

Null text counts as empty; a document shorter than `least` loses nothing; the order of rows, repeated rows
and other columns don't matter (rows are told apart by an id of their own).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, materialise
from .run_index import RunIndex

LEAST = 200
#: Bytes of an anchor's gram, for a `least` of 200; shorter strings take a quarter of theirs.
GRAM = 48
#: Kinds of surroundings of a gram above which its group is parted further.
HOT = 1024
#: Bytes of surroundings in one run-length index.
INDEX_BYTES = 1_000_000
#: Bytes hashed at once.
PIECE = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Roller:
    """Polynomial hashes of substrings of up to `size` bytes, modulo 2**64, mixed at the end."""

    def __init__(self, size: int):
        self.up, self.down = _powers(_BASE, size + 1), _powers(_UNBASE, size + 1)

    def load(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.sums[1:])

    def grams(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return self.mix((self.sums[width:] - self.sums[:-width]) * self.down[:n])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    @staticmethod
    def mix(h: np.ndarray) -> np.ndarray:
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
        return h


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` values in a row, in time that doesn't depend on width."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def _pieces(offsets: np.ndarray, least: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (row, start, end) of about PIECE bytes; a longer document comes in parts, alone, overlapping by least - 1."""
    held, size = [], 0
    for row in range(len(offsets) - 1):
        start, end = int(offsets[row]), int(offsets[row + 1])
        if end - start < least:
            continue
        if held and size + end - start > PIECE:
            yield held
            held, size = [], 0
        if end - start > PIECE:
            while start + least <= end:
                yield [(row, start, min(end, start + PIECE))]
                start += PIECE - least + 1
            continue
        held.append((row, start, end))
        size += end - start
    if held:
        yield held


def anchors(data: np.ndarray, offsets: np.ndarray, least: int, gram: int):
    """Yields arrays (row, position in the row, gram hash, hash of the surroundings) of every anchor, each once."""
    reach = least - gram
    roll = _Roller(PIECE + 4 * least)
    last_row, last_at = -1, -1
    for group in _pieces(offsets, least):
        rows, starts, ends = (np.array(x) for x in zip(*group))
        row = int(rows[0])
        # the surroundings of the anchors of a part reach into the parts beside it
        left = min(reach, int(starts[0] - offsets[row])) if len(group) == 1 else 0
        right = min(reach, int(offsets[row + 1] - ends[0])) if len(group) == 1 else 0
        if len(group) == 1:
            text = data[starts[0] - left : ends[0] + right]
            begins, bounds = np.array([left]), np.array([0, len(text)])
        else:
            text = np.concatenate([data[a:b] for _, a, b in group])
            bounds = np.concatenate(([0], np.cumsum(ends - starts)))
            begins = bounds[:-1]
        found = _anchors_of(text, rows, starts - offsets[rows], begins, ends - starts, bounds[:-1], bounds[1:], roll, least, gram)
        if row == last_row and len(found[1]) and found[1][0] == last_at:
            found = tuple(x[1:] for x in found)
        if len(found[1]):
            last_row, last_at = int(found[0][-1]), int(found[1][-1])
        yield found


def _anchors_of(text, rows, offset_in_row, begins, sizes, first, last, roll, least, gram):
    width, reach, low = least - gram + 1, least - gram, np.uint64((1 << 20) - 1)
    roll.load(text)
    g = roll.grams(gram)
    key = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    least_at = (_window_minimum(key, width) & low).astype(np.int64)
    # windows that stay inside a part
    fit = np.zeros(len(least_at) + 1, np.int64)
    np.add.at(fit, begins, 1)
    np.add.at(fit, begins + sizes - least + 1, -1)
    at = least_at[np.cumsum(fit[:-1]) > 0]
    at = at[np.concatenate(([True], at[1:] != at[:-1]))]
    part = np.searchsorted(begins, at, "right") - 1
    start = np.maximum(at - reach, first[part])
    end = np.minimum(at + least, last[part])
    around = roll.spans(start, end)
    return rows[part], offset_in_row[part] + at - begins[part], g[at].view(np.int64), (around ^ (at - start).astype(np.uint64)).view(np.int64)


def _column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    array = batch.column(name)
    if pa.types.is_large_string(array.type):
        width = np.int64
    else:
        array, width = array.cast(pa.string()), np.int32
    if array.null_count:
        array = array.fill_null("")
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, width)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def _scan(least: int, gram: int):
    def scan(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = _column(batch, "text")
            rid = batch.column("rid").to_numpy(zero_copy_only=False)
            size = np.diff(offsets)
            for row, at, gram_hash, around in anchors(data, offsets, least, gram):
                start = np.maximum(at - (least - gram), 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[row]), pa.array(at.astype(np.int32)), pa.array(gram_hash), pa.array(around), pa.array(start.astype(np.int32)), pa.array(np.minimum(at + least, size[row]).astype(np.int32))],
                    names=["rid", "at", "gram", "around", "start", "end"],
                )

    return scan


def _cut(batches):
    """The surroundings of mixed anchors, out of the texts."""
    for batch in batches:
        data, offsets = _column(batch, "text")
        rid, places = batch.column("rid").to_pylist(), batch.column("places")
        out: list[list] = [[] for _ in range(6)]
        held = 0
        for i in range(batch.num_rows):
            base = int(offsets[i])
            for p in places[i].as_py() or ():
                for column, value in zip(out, (p["gram"], rid[i], p["start"], p["lead"], data[base + p["start"] : base + p["end"]].tobytes(), p["hot"])):
                    column.append(value)
                held += p["end"] - p["start"]
                if held > 4_000_000:
                    yield _cut_batch(out)
                    out, held = [[] for _ in range(6)], 0
        if out[0]:
            yield _cut_batch(out)


def _cut_batch(out):
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.binary()), pa.array(out[5], pa.bool_())], names=["gram", "rid", "start", "lead", "piece", "hot"])


def _index(least: int):
    """Over rows sorted by gram: run-length indexes of whole groups, about INDEX_BYTES in each."""

    def index(batches):
        ready: dict[int, dict[int, bytes]] = {}
        size, last = 0, None
        for batch in batches:
            for gram, rid, start, piece in zip(*(batch.column(c).to_pylist() for c in ("gram", "rid", "start", "piece"))):
                if gram != last and size > INDEX_BYTES:
                    yield _marks(ready, least)
                    ready, size = {}, 0
                last = gram
                held = ready.setdefault(rid, {})
                if len(held.get(start, b"")) < len(piece):
                    held[start] = piece
                    size += len(piece)
        if ready:
            yield _marks(ready, least)

    return index


def _regions(pieces: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
    """Pieces of one document by start, put together where they overlap or touch; each byte comes once."""
    at, held = -1, b""
    for start in sorted(pieces):
        piece = pieces[start]
        if held and start <= at + len(held):
            held += piece[at + len(held) - start :]
        else:
            if held:
                yield at, held
            at, held = start, piece
    yield at, held


def _marks(ready: dict[int, dict[int, bytes]], least: int) -> pa.RecordBatch:
    places: dict[bytes, list[tuple[int, int]]] = {}
    for rid, pieces in ready.items():
        for start, region in _regions(pieces):
            places.setdefault(region, []).append((rid, start))
    rid, begin, end = [], [], []
    for (region, at), spans in zip(places.items(), RunIndex(list(places)).long_matches(least)):
        for a, b in [(0, len(region))] if len(at) > 1 else spans:
            for r, s in at:
                rid.append(r), begin.append(s + a), end.append(s + b)
    return pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(begin, pa.int32()), pa.array(end, pa.int32())], names=["rid", "start", "end"])


def _digest(x: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)


#: Windows in one part of a hot group at the first cut.
PART = 16


def _parts(least: int, gram: int):
    """Hot surroundings, parted by how far a string starts before its gram, PART distances at a time.

    core: digest of what all strings of the part share; whole: digest of the part itself.
    """
    reach = least - gram

    def parts(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for rid, start, lead, piece in zip(*(batch.column(c).to_pylist() for c in ("rid", "start", "lead", "piece"))):
                for near in range(0, reach + 1, PART):
                    far = min(near + PART - 1, reach)
                    first, last = max(lead - far, 0), min(lead - near, len(piece) - least)
                    if first > last:
                        continue
                    whole = piece[first : last + least]
                    core = _digest(b"%d " % near + piece[lead - near : lead - far + least])
                    for column, value in zip(out, (core, _digest(b"%d " % (lead - first) + whole), rid, start + first, whole)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["core", "whole", "rid", "start", "piece"])

    return parts


def _strings(least: int):
    """Every string of `least` bytes of a part, as a digest of 128 bits."""

    def strings(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for rid, start, piece in zip(*(batch.column(c).to_pylist() for c in ("rid", "start", "piece"))):
                for a in range(len(piece) - least + 1):
                    out[0].append(hashlib.blake2b(piece[a : a + least], digest_size=16).digest())
                    out[1].append(rid)
                    out[2].append(start + a)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32())], names=["string", "rid", "start"])

    return strings


def repeated_spans(docs: DataFrame, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """Rows (rid, start, end): byte spans of docs (rid long, text string) that lie in repeated strings; they may overlap."""
    spark = docs.sparkSession
    gram = max(1, GRAM * least // LEAST)
    one = F.count(F.lit(1)).alias("n")
    scan = docs.mapInArrow(_scan(least, gram), "rid long, at int, gram long, around long, start int, end int").select("rid", "at", "gram", "around", "start", "end")
    # counts are tables of their own, so that the joins below meet plain exchanges and a crowded key can be split
    seen = scan.groupBy("gram").agg(one, F.min("around").alias("low"), F.max("around").alias("high")).where("n > 1")
    seen, seen_path = materialise(seen.select("gram", (F.col("low") == F.col("high")).alias("alike")), "grams")
    found, _ = materialise(scan.join(seen.hint("shuffle_hash"), "gram"), "anchors")
    discard(spark, seen_path)
    # surroundings seen twice lie in repeats; of each kind of surroundings one place goes on
    mixed = found.where("not alike")
    kinds, kinds_path = materialise(mixed.groupBy("gram", "around").agg(one, F.min(F.struct("rid", "at")).alias("first")), "kinds")
    crowd, _ = materialise(kinds.groupBy("gram").agg((F.count(F.lit(1)) > hot).alias("hot")), "crowd")
    placed = mixed.join(kinds.hint("shuffle_hash"), ["gram", "around"])
    first = (F.col("rid") == F.col("first.rid")) & (F.col("at") == F.col("first.at"))
    places, _ = materialise(placed.select("rid", "at", "gram", "start", "end", (F.col("n") > 1).alias("alike"), first.alias("first")), "places")
    discard(spark, kinds_path)
    sent = places.where("first").join(crowd.hint("shuffle_hash"), "gram").groupBy("rid").agg(F.collect_list(F.struct("gram", "start", "end", (F.col("at") - F.col("start")).alias("lead"), "hot")).alias("places"))
    pieces, pieces_path = materialise(docs.join(sent.hint("shuffle_hash"), "rid").select("rid", "text", "places").mapInArrow(_cut, "gram long, rid long, start int, lead int, piece binary, hot boolean"), "pieces")
    whole = found.where("alike").select("rid", "start", "end").unionByName(places.where("alike").select("rid", "start", "end"))
    cool = pieces.where("not hot").select("gram", "rid", "start", "piece")
    indexed = cool.repartition("gram").sortWithinPartitions("gram").mapInArrow(_index(least), "rid long, start int, end int")
    parts = pieces.where("hot").select("rid", "start", "lead", "piece").mapInArrow(_parts(least, gram), "core long, whole long, rid long, start int, piece binary").dropDuplicates(["core", "whole", "rid", "start"])
    # as above: parts seen twice lie in repeats, and one place of each kind goes on where a core has several kinds
    kinds = parts.groupBy("core", "whole").agg(one, F.min(F.struct("rid", "start")).alias("first"))
    kinds, core_path = materialise(kinds, "cores")
    cores = kinds.groupBy("core").agg(F.sum("n").alias("places"), F.count(F.lit(1)).alias("kinds")).where("places > 1")
    parted = parts.join(kinds.join(cores, "core").select("core", "whole", "n", "kinds", "first"), ["core", "whole"])
    whole_parts = parted.where("n > 1").select("rid", "start", (F.col("start") + F.length("piece")).cast("int").alias("end"))
    alone = parted.where((F.col("kinds") > 1) & (F.col("rid") == F.col("first.rid")) & (F.col("start") == F.col("first.start")))
    strings = alone.select("rid", "start", "piece").mapInArrow(_strings(least), "string binary, rid long, start int").distinct()
    often = strings.groupBy("string").agg(one).where("n > 1").select("string")
    counted = strings.join(often, "string", "left_semi").select("rid", "start", (F.col("start") + least).cast("int").alias("end"))
    marked, _ = materialise(indexed.unionByName(whole_parts).unionByName(counted), "marked")
    discard(spark, pieces_path, core_path)
    return whole.unionByName(marked)


def _merge(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


#: Columns of the result.
NEW = (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), ("kept_text", "string"))


def _apply(spans: str, prefix: str):
    def run(batches):
        for batch in batches:
            data, offsets = _column(batch, "text")
            marked, sizes = batch.column(spans), np.diff(offsets)
            removed, runs, digests, kept_texts = [], [], [], []
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                packed = marked[i].values
                cut = _merge((x >> 32, x & 0xFFFFFFFF) for x in packed.to_pylist()) if packed is not None and len(packed) else []
                kept, at = [], 0
                for a, b in cut:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                rest = b"".join(kept)
                removed.append(len(text) - len(rest))
                runs.append(len(cut))
                digests.append(hashlib.sha256(rest).hexdigest())
                kept_texts.append(rest.decode("utf-8", "ignore"))
            new = (pa.array(sizes), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string()), pa.array(kept_texts, pa.string()))
            old = [n for n in batch.schema.names if n not in ("text", spans)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in old), *new], names=[*old, *(prefix + n for n, _ in NEW)])

    return run


def suffix_dedup(docs: DataFrame, least: int = LEAST, hot: int = HOT, rid: str = "rid", prefix: str = "") -> DataFrame:
    """docs (rid long and unique, text string, others) -> rid, others, n_bytes, n_removed, n_spans, kept_sha256, kept_text.

    kept_text is the remaining bytes decoded, without characters that a cut has split. The names of the new columns start
    with prefix; they replace columns of docs of the same names. See `free_prefix`.
    """
    spans = repeated_spans(docs.select(F.col(rid).alias("rid"), "text"), least, hot).groupBy(F.col("rid").alias(rid))
    marked = free_name(docs, "spans")
    spans = spans.agg(F.collect_set((F.shiftleft(F.col("start").cast("long"), 32)) + F.col("end")).alias(marked))
    new = {(prefix + name).lower() for name, _ in NEW}
    others = [c for c in docs.columns if c.lower() not in (rid.lower(), "text") and c.lower() not in new]
    schema = docs.select(rid, *others).schema
    for name, kind in NEW:
        schema = schema.add(prefix + name, kind)
    return docs.select(rid, *others, "text").join(spans.hint("shuffle_hash"), rid, "left").mapInArrow(_apply(marked, prefix), schema)


def free_prefix(docs: DataFrame) -> str:
    """A prefix that keeps the new columns apart from those of docs."""
    prefix, taken = "", {c.lower() for c in docs.columns}
    while any(prefix + name in taken for name, _ in NEW):
        prefix += "_"
    return prefix
