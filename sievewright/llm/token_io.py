"""Token-id output: documents as zstandard frames of id arrays under one shared dictionary.

File format. A corpus is a Parquet folder that Spark's own committer writes (so that a lost executor or a task
run twice leaves no half file); each row holds one block of up to BLOCK_BYTES of ids:

    magic b"SVTK1\\0", then little-endian: u32 length of the dictionary's sha-256 (32) and the digest itself,
    u32 documents, u64 ids of this shard before the block,
    per document: i64 doc_id, u8 1 if the id is null, u64 end of its frame from the start of the frames, u32 ids,
    then the frames, one for each document: zstandard over the ids as little-endian u32.

The row also names shard, block, first and last id, so that one document is found by a pushed-down range filter,
the block's offset index and the unpacking of a single frame. The dictionary is a row of its own folder.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hash_sample, held

MAGIC = b"SVTK1\0"
BLOCK_BYTES = 4_000_000
#: Bounded sample that the dictionary is trained on, and the dictionary's size.
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES = 512, 65_536, 65_536
LEVEL = 3
KEPT_WORDS, LONGEST_WORD = 1_000_000, 64
_ENTRY = struct.Struct("<qBQI")
_HEAD = struct.Struct("<II")


# The normaliser and pre-tokenizer of files that texts are cut for here; all others go through the library whole.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}


def cut_is_known(path: str) -> bool:
    """Whether a tokenizer file has the words that WordEncoder cuts texts into."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return spec.get("normalizer") == NORMALIZER and spec.get("pre_tokenizer") == PRE_TOKENIZER and not spec.get("post_processor") and all(t["content"].startswith("<|") for t in spec.get("added_tokens", ()))


def _word_pattern() -> re.Pattern:
    """The tokenizer's words, for lower-case text of characters up to U+017F."""
    marks = {"L": "", "N": "", "W": ""}
    for c in map(chr, range(0x180)):
        kind = "W" if c.isspace() and not "\x1c" <= c <= "\x1f" else unicodedata.category(c)[0]
        if kind in marks:
            marks[kind] += re.escape(c)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{marks['L']}]+|[{marks['N']}]|[^{marks['W'] + marks['L'] + marks['N']}]+")


def _byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level models: itself if it is printable, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordEncoder:
    """Ids of whole texts by a lower-casing tokenizer whose words never cross white space; each word is encoded once.

    Texts of characters up to U+017F are cut into the tokenizer's own words. Any other text, and text that may hold a
    special token, is cut at ASCII white space only and those pieces go through the whole tokenizer. Texts for a tokenizer of
    other words go through it as a whole.
    """

    _ODD = re.compile("[^\x00-\u012f\u0131-\u017f]")

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = cut_is_known(path)
        self.words = _word_pattern()
        self.shown = _byte_characters()
        self.kept: dict[str, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}
        self.end = np.array([end_id], "<u4").tobytes()

    def _learn(self, missing: list[str]) -> None:
        """Encode words that stand alone: the library's byte-level pre-tokenizer and model, without the rest."""
        tokenize, kept, shown = self.tokenizer.model.tokenize, self.kept, self.shown
        for w in missing:
            seen = w if w.isascii() and w.isprintable() else "".join(map(shown.__getitem__, w.encode()))
            kept[w] = np.array([t.id for t in tokenize(seen)], "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        words, kept = self.words.findall(text.lower()), self.kept
        missing = [w for w in set(words) if w not in kept]
        if missing:
            if len(kept) > KEPT_WORDS:
                kept.clear()
                missing = list(set(words))
            self._learn(missing)
        out = b"".join(map(kept.__getitem__, words))
        for w in missing:
            if len(w) > LONGEST_WORD:
                del kept[w]
        return out

    def _other(self, text: str) -> bytes:
        words, kept = text.encode().split(), self.pieces
        missing = [w for w in set(words) if w not in kept]
        if missing:
            if len(kept) > KEPT_WORDS // 4:
                kept.clear()
                missing = list(set(words))
            found = self.tokenizer.encode_batch([w.decode() for w in missing], add_special_tokens=False)
            kept.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(missing, found))
        out = b"".join(map(kept.__getitem__, words))
        for w in missing:
            if len(w) > LONGEST_WORD:
                del kept[w]
        return out

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if not self.known:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + self.end
        return (self._other(text) if "<|" in text or self._ODD.search(text) else self._plain(text)) + self.end


def encoder(path: str, end_id: int) -> WordEncoder:
    return held(("words", path, end_id), lambda: WordEncoder(path, end_id))


def train_dictionary(docs: DataFrame, path: str, end_id: int) -> bytes:
    """A zstandard dictionary trained on the id arrays of a bounded sample of the shorter documents."""
    sample = hash_sample(docs, SAMPLE_DOCS, "doc_id").where(F.octet_length("text") <= SAMPLE_BYTES).select("text").limit(2 * SAMPLE_DOCS).collect()
    arrays = [encoder(path, end_id).encode(t) for t in sorted(r.text for r in sample)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, arrays).as_bytes() if len(arrays) >= 8 else b""
    except zstandard.ZstdError:  # too little to learn from
        return b""


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def pack(entries: list[tuple[int | None, int, bytes]], dict_sha: bytes, before: int) -> bytes:
    """entries: (doc_id, ids, frame) in order."""
    out = [MAGIC, _HEAD.pack(32, len(entries)), dict_sha, struct.pack("<Q", before)]
    end = 0
    for doc_id, n, frame in entries:
        end += len(frame)
        out.append(_ENTRY.pack(doc_id or 0, doc_id is None, end, n))
    return b"".join([*out, *(frame for *_, frame in entries)])


def unpack(block: bytes, dict_sha: bytes) -> tuple[int, list[tuple[int | None, int, int, int]]]:
    """Ids of the shard before the block, and (doc_id, ids, start, end of the frame in the block) of each document."""
    if block[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token block")
    size, n = _HEAD.unpack_from(block, len(MAGIC))
    at = len(MAGIC) + _HEAD.size
    if block[at : at + size] != dict_sha:
        raise ValueError("the block was written with another dictionary")
    at += size
    (before,) = struct.unpack_from("<Q", block, at)
    at += 8
    frames = at + n * _ENTRY.size
    out, start = [], frames
    for i in range(n):
        doc_id, null, end, ids = _ENTRY.unpack_from(block, at + i * _ENTRY.size)
        out.append((None if null else doc_id, ids, start, frames + end))
        start = frames + end
    return before, out


def _write(path: str, end_id: int, raw_dict: bytes):
    dict_sha = hashlib.sha256(raw_dict).digest()

    def write(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encode = encoder(path, end_id).encode
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw_dict)).compress
        held: list = []
        size = block = before = start = 0

        def flush():
            ids = [e[0] for e in held]
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((shard, pa.int32()), (block, pa.int32()), (ids[0], pa.int64()), (ids[-1], pa.int64()), (before - start, pa.int64()), (pack(held, dict_sha, start), pa.binary()))],
                names=["shard", "block", "first_id", "last_id", "n_ids", "data"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                raw = encode(text.as_py())
                held.append((doc_id, len(raw) // 4, compress(raw)))
                before += len(raw) // 4
                size += len(raw)
                if size >= BLOCK_BYTES:
                    yield flush()
                    held, size, block, start = [], 0, block + 1, before
        if held:
            yield flush()

    return write


BLOCKS = "shard int, block int, first_id long, last_id long, n_ids long, data binary"


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int, partitions: int | None = None) -> bytes:
    """Encode docs (doc_id, text) in ascending doc_id order into the folder out; returns the dictionary.

    Null text counts as empty; rows of the same id follow each other by the hash of their text; null ids come first.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    raw_dict = train_dictionary(docs, tokenizer, end_id)
    spark.createDataFrame([(bytearray(raw_dict), hashlib.sha256(raw_dict).hexdigest())], "dictionary binary, sha256 string").coalesce(1).write.parquet(f"{out}/dictionary")
    keyed = docs.withColumn("tie", F.xxhash64("text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    dealt.select("doc_id", "text").mapInArrow(_write(tokenizer, end_id, raw_dict), BLOCKS).write.parquet(f"{out}/blocks")
    return raw_dict


def read_dictionary(spark: SparkSession, out: str) -> bytes:
    row = spark.read.parquet(f"{out}/dictionary").first()
    if hashlib.sha256(row.dictionary).hexdigest() != row.sha256:
        raise ValueError("the dictionary doesn't match its hash")
    return bytes(row.dictionary)


def read_tokens(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids, from the files."""
    raw_dict = read_dictionary(spark, out)
    dict_sha = hashlib.sha256(raw_dict).digest()
    blocks = spark.read.schema(BLOCKS).parquet(f"{out}/blocks")
    # one row for each shard, of which there are as many as partitions were written
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    shards = shards.select("shard", (F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")).alias("shard_start"))

    def read(batches):
        unzip = zstandard.ZstdDecompressor(dict_data=_dictionary(raw_dict)).decompress
        for batch in batches:
            for shard_start, data in zip(batch.column("shard_start").to_pylist(), batch.column("data")):
                block = data.as_py()
                before, entries = unpack(block, dict_sha)
                at, cols = shard_start + before, [[], [], [], [], []]
                for doc_id, n, a, b in entries:
                    raw = unzip(block[a:b])
                    if len(raw) != 4 * n:
                        raise ValueError("a frame doesn't hold the ids that its index names")
                    for c, v in zip(cols, (doc_id, at, n, zlib.crc32(raw), np.frombuffer(raw, "<u4").astype(np.int64) if with_ids else None)):
                        c.append(v)
                    at += n
                arrays = [pa.array(c, pa.int64()) for c in cols[:4]]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(cols[4], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return blocks.select("shard", "data").join(shards.hint("broadcast"), "shard").select("shard_start", "data").mapInArrow(read, schema)


def read_document(spark: SparkSession, out: str, doc_id: int) -> list[int] | None:
    """The ids of one document: a range filter on the blocks, the offset index, one frame."""
    raw_dict = read_dictionary(spark, out)
    blocks = spark.read.schema(BLOCKS).parquet(f"{out}/blocks").where((F.coalesce("first_id", F.lit(-(1 << 63))) <= doc_id) & (F.col("last_id") >= doc_id))
    for r in blocks.orderBy("shard", "block").select("data").toLocalIterator():
        block = bytes(r.data)
        for found, n, a, b in unpack(block, hashlib.sha256(raw_dict).digest())[1]:
            if found == doc_id:
                raw = zstandard.ZstdDecompressor(dict_data=_dictionary(raw_dict)).decompress(block[a:b], max_output_size=4 * n)
                return np.frombuffer(raw, "<u4").tolist()
    return None
