"""Token counts: byte-pair merges applied to ragged arrays of pre-tokens, a rank at a time in every sequence.

The pre-tokens of a group of texts that this worker hasn't counted yet lie one after another in one array of symbol ids. In a
round, the rank of each neighbouring pair is looked up, each sequence's lowest rank is found by a segmented minimum, and all
places of a sequence that have it are merged at the same time (of overlapping ones, every other from the left). A sequence
without a known pair is done, and what is left of it are its tokens. That is the order of the merges if a merge never
makes a pair of a lower rank than its own, which files that training wrote fulfil; else (`together` is false) a round
merges only the leftmost place of a sequence, which is the order of any file.

Pre-tokens of over LONGEST symbols, where rounds would be many, are counted by the library's own model, as are tokenizer files
of other models; a `.model` file goes through sentencepiece. Texts for the known words (see token_io) are cut here; what these can't
be cut from exactly, and other files, go through the library's normaliser and pre-tokenizer.

A null text has no byte and no token. Very long texts are cut at white space into slices, which no token crosses. Each row
is counted alone: repeated rows come out repeated, an empty table gives an empty one, and columns of the names that are
written are replaced.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import held
from .token_io import WordEncoder, _byte_characters, _word_pattern, cut_is_known

#: Tokens that a row may have without being over the limit.
LIMIT = 2_048
#: Symbols of a pre-token that the arrays take; characters of a group of texts and of a slice; pre-tokens kept by a worker, and their length.
LONGEST, GROUP, KEPT, KEPT_LENGTH = 4_096, 1_000_000, 1_000_000, 64
NONE = np.iinfo(np.int32).max
_BLANK = re.compile("[\x20\x09-\x0d]")


class Merges:
    """The merges of a byte-pair model as sorted arrays."""

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, to = (np.array(x, np.int64).reshape(-1) for x in ([vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], [vocab[a + b] for a, b in pairs]))
        keys, last = left << 32 | right, np.arange(len(pairs))[::-1]
        self.keys, at = np.unique(keys[::-1], return_index=True)
        self.rank, self.to = last[at].astype(np.int32), to[last[at]]
        # a merge of rank r may make pairs of the ranks that its product takes part in
        n = max(vocab.values(), default=0) + 1
        made, used = np.full(n, -1), np.full(n, NONE, np.int64)
        np.maximum.at(made, self.to, self.rank)
        for side in (self.keys >> 32, self.keys & 0xFFFFFFFF):
            np.minimum.at(used, side, self.rank)
        self.together = bool((made < used).all())
        shown = _byte_characters()
        #: Symbols of the bytes inside a pre-token and at its end.
        self.inner, self.final = (np.array([vocab[c + end] for c in shown], np.int64) for end in ("", suffix))
        self.byte_of = np.zeros(0x200, np.uint8)
        self.byte_of[[ord(c) for c in shown]] = np.arange(256)

    def _ranks(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each symbol, the rank of the pair with the next one and what it becomes."""
        pairs = ids[:-1] << 32 | ids[1:]
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        rank = np.where(self.keys[at] == pairs, self.rank[at], NONE)
        return np.append(rank, NONE), np.append(self.to[at], 0)

    def surviving(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Symbols left of each sequence of bytes; data holds the sequences one after another."""
        counts = lengths.astype(np.int64)
        if not len(self.keys):
            return counts
        ids = self.inner[data]
        ends = np.cumsum(lengths)
        some = lengths > 0
        ids[ends[some] - 1] = self.final[data[ends[some] - 1]]
        of = np.repeat(np.arange(len(lengths)), lengths)
        going = np.repeat(lengths > 1, lengths)
        ids, of = ids[going], of[going]
        while len(ids):
            rank, to = self._ranks(ids)
            ends = np.append(of[1:] != of[:-1], True)
            rank[ends] = NONE
            starts = np.flatnonzero(np.append(True, ends[:-1]))
            sizes = np.diff(np.append(starts, len(ids)))
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            hit = (rank == least) & (least != NONE)
            place = np.arange(len(ids))
            if not self.together:
                first = np.minimum.reduceat(np.where(hit, place, len(ids)), starts)
                hit &= place == np.repeat(first, sizes)
            elif (hit[1:] & hit[:-1]).any():
                before = np.maximum.accumulate(np.where(hit, -1, place))
                hit &= (place - before) % 2 == 1
            counts -= np.bincount(of[hit], minlength=len(counts))
            ids[hit] = to[hit]
            kept = least != NONE
            kept[np.flatnonzero(hit) + 1] = False
            ids, of = ids[kept], of[kept]
        return counts


def arrays_apply(spec: dict) -> bool:
    """Whether a tokenizer file is byte-level byte-pair merging without the options that the arrays don't know."""
    model, cut = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    steps = cut.get("pretokenizers") or [cut]
    plain = not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"))
    whole = all(c + end in model.get("vocab", {}) for c in _byte_characters() for end in {"", model.get("end_of_word_suffix") or ""})
    exact = all(not (t.get("normalized") or t.get("single_word") or t.get("lstrip") or t.get("rstrip")) for t in spec.get("added_tokens", ()))
    spaced = any(s.get("add_prefix_space") for s in steps)
    return model.get("type") == "BPE" and steps[-1].get("type") == "ByteLevel" and plain and whole and exact and not spaced


class TokenCounter:
    """Tokens of texts by a tokenizer file, as its library counts them without special tokens added."""

    _ODD = WordEncoder._ODD

    def __init__(self, path: str):
        self.kept: dict[str, int] = {}
        self.merges = None
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.whole = lambda texts: [len(x.ids) for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if arrays_apply(spec):
            self.merges = Merges(spec["model"])
            self.words = _word_pattern() if cut_is_known(path) else None
            special = [re.escape(t["content"]) for t in spec.get("added_tokens", ())]
            self.special = re.compile("|".join(sorted(special, key=len, reverse=True))) if special else None
            self.odd: dict[bytes, list[str]] = {}

    def _shown(self, text: str) -> list[str]:
        """Pre-tokens by the library's own normaliser and pre-tokenizer, as the characters that stand for their bytes."""
        t = self.tokenizer
        text = t.normalizer.normalize_str(text) if t.normalizer else text
        return [w for w, _ in t.pre_tokenizer.pre_tokenize_str(text)] if text else []

    def _bytes_shown(self, text: str) -> list[bytes]:
        return [self.merges.byte_of[np.frombuffer(w.encode("utf-32-le"), "<u4")].tobytes() for w in self._shown(text)]

    def _cut(self, text: str) -> tuple[list, int]:
        """The pre-tokens of a text and how many special tokens stand between them."""
        found = 0
        if self.special is not None and "<|" in text:
            parts = self.special.split(text)
            found = len(parts) - 1
        else:
            parts = [text]
        out: list = []
        for part in parts:
            if self.words is None:
                out += self._bytes_shown(part)
            elif self._ODD.search(part):
                for piece in part.encode("utf-8", "surrogatepass").split():
                    if piece not in self.odd:
                        if len(self.odd) > KEPT // 8:
                            self.odd.clear()
                        cut = self._bytes_shown(piece.decode())
                        if len(piece) > KEPT_LENGTH:
                            out += cut
                            continue
                        self.odd[piece] = cut
                    out += self.odd[piece]
            else:
                out += self.words.findall(part.lower())
        return out, found

    def _learn(self, missing: list) -> None:
        raw = [w.encode() if isinstance(w, str) else w for w in missing]
        long = [i for i, w in enumerate(raw) if len(w) > LONGEST]
        for i in long:
            self.kept[missing[i]] = len(self.tokenizer.model.tokenize("".join(map(_byte_characters().__getitem__, raw[i]))))
            raw[i] = b""
        lengths = np.array([len(w) for w in raw], np.int64)
        counts = self.merges.surviving(np.frombuffer(b"".join(raw), np.uint8), lengths)
        long = set(long)
        self.kept.update((w, n) for i, (w, n) in enumerate(zip(missing, counts.tolist())) if i not in long)

    def _slices(self, text: str):
        """A text in slices of about GROUP characters that begin and end at ASCII white space."""
        at = 0
        while len(text) - at > GROUP and self.words is not None:
            end = _BLANK.search(text, at + GROUP)
            if end is None:
                break
            yield text[at : end.start()]
            at = end.start()
        yield text[at:]

    def _group(self, texts: list[str]) -> list[int]:
        cuts = [self._cut(t) for t in texts]
        kept = self.kept
        missing = list(set().union(*(words for words, _ in cuts)) - kept.keys())
        if len(kept) > KEPT and missing:
            kept.clear()
            missing = list(set().union(*(words for words, _ in cuts)))
        if missing:
            self._learn(missing)
        out = [sum(map(kept.__getitem__, words)) + special for words, special in cuts]
        for w in missing:
            if len(w) > KEPT_LENGTH:
                del kept[w]
        return out

    def counts(self, texts: list[str | None]) -> list[int]:
        if self.merges is None:
            return self.whole([t or "" for t in texts])
        out, group, size = [0] * len(texts), [], 0

        def settle():
            for (i, _), n in zip(group, self._group([t for _, t in group])):
                out[i] += n

        for i, text in enumerate(texts):
            for part in self._slices(text or ""):
                group.append((i, part))
                size += len(part)
                if size >= GROUP:
                    settle()
                    group, size = [], 0
        settle()
        return out


def counter(path: str) -> TokenCounter:
    return held(("counts", path), lambda: TokenCounter(path))


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """docs with a text column -> its other columns, n_bytes (UTF-8), n_tokens, and over_limit (more than `limit` tokens)."""
    new = ("n_bytes", "n_tokens", "over_limit")
    others = [c for c in docs.columns if c.lower() not in new and c != text]
    schema = docs.select(*others).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches):
        count = counter(path).counts
        for batch in batches:
            texts = batch.column(text)
            n = pa.array(count(texts.to_pylist()), pa.int64())
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), size, n, pc.greater(n, limit)], names=[*others, *new])

    return docs.select(*others, text).mapInArrow(run, schema)
