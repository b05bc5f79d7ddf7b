"""SentencePiece encoding and decoding with an Aho-Corasick automaton and one pass over the positions.

The automaton holds all pieces. At each position its output links name the pieces that end there, and each
relaxes the best way to that position:

- unigram models: the sum of the scores, plain Viterbi;
- BPE models, whose scores are merge ranks and not log-probabilities: a piece can follow the best way to its
  start only if merging the two neighbours by rank gives just these two pieces again. Exactly one way to each
  position is left, the one the model's merges give, so ids equal those of the sentencepiece library. (Summed
  ranks would give other ids.)

Text is cut before blanks and around new lines where no piece of the model crosses, and each cut piece of text is
encoded once while it is kept: those met again outlive those met once. Characters outside the vocabulary become byte pieces. Null text counts as empty. The model writes a blank
as U+2581, so a text that holds this character itself decodes to one with a blank in its place, and `decodes` is false.
Of ways of equal score the one with the longest last piece wins. Repeated rows are rows, an empty table gives an empty
one, other columns stay, and columns of the names that are written are replaced.
"""

from __future__ import annotations

import re
import zlib
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from .common import held

BLANK = "▁"
KEPT, LONGEST = 400_000, 64
BPE, UNIGRAM = 2, 1


class PieceModel:
    """Pieces, scores and flags read from a model file."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.kind = model.trainer_spec.model_type
        self.pieces = [p.piece for p in model.pieces]
        self.scores = [p.score for p in model.pieces]
        types = [p.type for p in model.pieces]
        kinds = type(model.pieces[0])
        self.unknown = types.index(kinds.UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, types)) if t == kinds.BYTE}
        self.normal = {p: i for i, (p, t) in enumerate(zip(self.pieces, types)) if t in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.control = {i for i, t in enumerate(types) if t == kinds.CONTROL}
        self.prefix = model.normalizer_spec.add_dummy_prefix
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not self.bytes:
            raise ValueError("only models of identity normalisation with byte pieces are supported")
        if self.kind not in (BPE, UNIGRAM):
            raise ValueError("only BPE and unigram models are supported")
        self.version = sentencepiece.__version__


class PieceEncoder:
    def __init__(self, path: str):
        self.model = m = PieceModel(path)
        self.automaton = ahocorasick.Automaton()
        for piece, i in m.normal.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.floor = min(m.scores) - 10.0
        self.by_byte = {i: b for b, i in m.bytes.items()}
        inside = any(BLANK in p.lstrip(BLANK) for p in m.normal)
        lines = any("\n" in p for p in m.normal)
        # where to cut: nowhere that a piece may cross
        self.cut = re.compile(r"\n| *[^ \n]+| +" if not inside and not lines else r"(?s:.+)")
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def _merged(self, text: str) -> list[str]:
        """Merge neighbours by rank, the leftmost of equals first; text is short."""
        parts = list(text)
        scores, ids = self.model.scores, self.model.normal
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                j = ids.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or scores[j] > best):
                    best, at = scores[j], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _follows(self, left: int, right: int) -> bool:
        """Whether merging gives these two pieces again; left is negative where right begins a stretch."""
        pieces = self.model.pieces
        wanted = [pieces[left], pieces[right]] if left >= 0 else [pieces[right]]
        ok = self._merged("".join(wanted)) == wanted
        if len(self.pairs) >= KEPT:
            self.pairs.clear()
        self.pairs[left * len(pieces) + right] = ok
        return ok

    def _run(self, text: str) -> list[int]:
        """Ids of text without blanks (they are BLANK by now): one pass over the ends that the automaton reports."""
        ways = self._summed(text) if self.model.kind == UNIGRAM else self._ranked(text)
        pieces = self.model.pieces
        out: list[int] = []
        end = len(text)
        while end:
            i = ways[end]
            if i < 0:
                out.extend(self.model.bytes[b] for b in reversed(text[end - 1].encode()))
                end -= 1
            else:
                out.append(i)
                end -= len(pieces[i])
        out.reverse()
        return out

    def _ranked(self, text: str) -> list:
        """The last piece of the one way to each position, -1 for a character outside the vocabulary and for the start."""
        n, normal = len(text), self.model.normal
        pairs, count = self.pairs, len(self.model.pieces)
        last: list = [None] * (n + 1)
        last[0], at = -1, 0

        def settle(start: int, stop: int) -> None:
            for p in range(start, stop):
                if last[p] is None and text[p - 1] not in normal:
                    last[p] = -1

        for stop, (size, i) in self.automaton.iter(text):
            end = stop + 1
            if end > at:
                if last[at] is None or stop > at:
                    settle(at, end)
                at = end
            elif last[end] is not None:
                continue
            before = last[end - size]
            if before is None:
                continue
            ok = pairs.get(before * count + i)
            if ok is None:
                ok = self._follows(before, i)
            if ok:
                last[end] = i
        settle(at, n + 1)
        return last

    def _summed(self, text: str) -> list:
        """The last piece of the way of the best sum to each position, -1 for a character outside the vocabulary."""
        n, normal = len(text), self.model.normal
        scores, floor = self.model.scores, self.floor
        last: list = [None] * (n + 1)
        best: list = [None] * (n + 1)
        best[0] = 0.0
        ends: list[list] = [[] for _ in range(n + 1)]
        for stop, found in self.automaton.iter(text):
            ends[stop + 1].append(found)
        for end in range(1, n + 1):
            for size, i in ends[end]:
                before = best[end - size]
                if before is not None and (best[end] is None or before + scores[i] > best[end]):
                    best[end], last[end] = before + scores[i], i
            if text[end - 1] not in normal:
                before = best[end - 1]
                if before is not None and (best[end] is None or before + floor > best[end]):
                    best[end], last[end] = before + floor, -1
        return last

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids as little-endian u32."""
        if not text:
            return b""
        kept, older, out = self.kept, self.older, []
        text = text.replace(BLANK, " ")  # the model can't tell them apart
        for part in self.cut.findall(" " + text if self.model.prefix else text):
            ids = kept.get(part)
            if ids is None:
                ids = older.get(part) or array("I", self._run(part.replace(" ", BLANK))).tobytes()
                if len(part) <= LONGEST:
                    if len(kept) >= KEPT // 2:
                        self.kept, self.older = kept, older = {}, kept
                    kept[part] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids) -> str:
        m, out = self.model, []
        raw, texts = self.by_byte, self._texts()
        for i in ids:
            out.append(bytes((raw[i],)) if i in raw else texts[i])
        text = b"".join(out).decode("utf-8", "replace")
        return text[1:] if m.prefix and text.startswith(" ") else text

    def _texts(self) -> list[bytes]:
        if not hasattr(self, "texts"):
            m = self.model
            self.texts = [b"" if i in m.control else p.replace(BLANK, " ").encode() for i, p in enumerate(m.pieces)]
            for i, b in self.by_byte.items():
                self.texts[i] = bytes((b,))
        return self.texts

    def decode_bytes(self, data: bytes) -> str:
        texts = self._texts()
        text = b"".join(map(texts.__getitem__, memoryview(data).cast("I"))).decode("utf-8", "replace")
        return text[1:] if self.model.prefix and text.startswith(" ") else text


def encoder(path: str) -> PieceEncoder:
    return held(("pieces", path), lambda: PieceEncoder(path))


def encode(docs: DataFrame, path: str, with_ids: bool = False, text: str = "text") -> DataFrame:
    """docs with a text column -> its other columns, n_pieces, ids_crc32, decodes (the ids give the text back), and ids if asked for.

    Columns of these names, whatever their case, are replaced."""
    new = {text.lower(), "n_pieces", "ids_crc32", "decodes", "ids"}
    others = [c for c in docs.columns if c.lower() not in new]
    schema = docs.select(*others).schema.add("n_pieces", "long").add("ids_crc32", "long").add("decodes", "boolean")
    schema = schema.add("ids", ArrayType(IntegerType())) if with_ids else schema

    def run(batches):
        e = encoder(path)
        for batch in batches:
            made: list[list] = [[], [], [], []]
            for t in batch.column(text):
                t = t.as_py() or ""
                raw = e.encode_bytes(t)
                for c, v in zip(made, (len(raw) // 4, zlib.crc32(raw), e.decode_bytes(raw) == t, np.frombuffer(raw, "<i4") if with_ids else None)):
                    c.append(v)
            arrays = [*(batch.column(c) for c in others), pa.array(made[0], pa.int64()), pa.array(made[1], pa.int64()), pa.array(made[2], pa.bool_())]
            names = [*others, "n_pieces", "ids_crc32", "decodes"]
            if with_ids:
                arrays.append(pa.array(made[3], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(*others, text).mapInArrow(run, schema)


def decode(ids: DataFrame, path: str) -> DataFrame:
    """A table with an ids column -> its other columns and text."""
    others = [c for c in ids.columns if c.lower() not in ("ids", "text")]

    def run(batches):
        e = encoder(path)
        for batch in batches:
            texts = [e.decode(x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(texts, pa.string())], names=[*others, "text"])

    return ids.select(*others, "ids").mapInArrow(run, ids.select(*others).schema.add("text", "string"))
