"""Language ID by cross-parsing: suffix automata of labelled text, and the language of fewest phrases wins.

A text is parsed against the training text of each language into the longest phrases that occur there. The number of
phrases, times the logarithm of the training text's size, is the cross-parsing entropy; the language of the least is
predicted. Training texts are running text, and phrases run over white space (a run of it counts as one blank).

All automata lie in one hash table of (state, character) -> state, and the stretches of many texts step through it side
by side. A text is parsed in stretches of STRETCH characters, so that a long one takes no more steps than others; a
phrase that a stretch's end cuts counts twice, for every language alike.

Null text, and text without a letter, is `und` with score 0, as is every text where nothing was learned. Of equal
languages the first in code point order wins. Rows come out as often as they came in, an empty table gives an empty one,
and other columns stay; columns of the two names that are written are replaced.
"""

from __future__ import annotations

from math import log2

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held

#: Bounded training sample: distinct texts of a language, their characters together, all languages' characters together, and the
#: characters that each language has at any rate, however many there are.
SAMPLE_DOCS, SAMPLE_CHARS, ALL_CHARS, LEAST_CHARS = 300, 30_000, 1_920_000, 500
STRETCH = 2_048
#: Characters parsed at once, and rows.
GROUP, ROWS = 2_000_000, 2_000
_LETTER = regex.compile(r"\p{L}")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class SuffixAutomaton:
    """All substrings of a text; state 0 is the start."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new


class CrossParser:
    """Counts the phrases of texts against the training text of each language."""

    def __init__(self, training: dict[str, str]):
        self.langs = sorted(training)
        self.cost = np.array([log2(len(training[x]) + 1) for x in self.langs])
        characters = sorted({c for t in training.values() for c in t})
        self.symbol = np.zeros(0x110000, np.int32)  # 0 is a character that no language has
        self.symbol[[ord(c) for c in characters]] = np.arange(1, len(characters) + 1)
        self.size = len(characters) + 1
        # one automaton at a time, as numbers
        edges, bases = [np.zeros((0, 2), np.int64)], [0]
        for x in self.langs:
            steps, base = SuffixAutomaton(training[x]).next, bases[-1]
            flat = np.fromiter((v for state, step in enumerate(steps) for c, to in step.items() for v in ((base + state) * self.size + int(self.symbol[ord(c)]), base + to)), np.int64)
            edges.append(flat.reshape(-1, 2))
            bases.append(base + len(steps))
        self.roots = np.array(bases[:-1], np.int64)
        keys, to = np.concatenate(edges).T
        self._file(keys, to)
        every = np.arange(self.size)
        self.first = np.stack([self._step(root, every) for root in self.roots]) if self.langs else np.zeros((0, self.size), np.int64)

    def _file(self, keys: np.ndarray, values: np.ndarray) -> None:
        """A hash table with open addressing; each round files the first of all keys that want the same slot."""
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        slots = self._slot(keys)
        while len(keys):
            free = self.keys[slots] < 0
            taken, which = np.unique(slots[free], return_index=True)
            which = np.flatnonzero(free)[which]
            self.keys[taken], self.values[taken] = keys[which], values[which]
            left = np.ones(len(keys), bool)
            left[which] = False
            keys, values, slots = keys[left], values[left], (slots[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states after a symbol; -1 where there is none."""
        keys = state * self.size + symbol
        shape, keys = keys.shape, keys.ravel()
        slots = self._slot(keys)
        seen, to = self.keys[slots], self.values[slots]
        missed = seen != keys
        to[missed] = -1
        at = np.flatnonzero(missed & (seen >= 0))
        while at.size:
            slots[at] = near = (slots[at] + 1) & (len(self.keys) - 1)
            seen = self.keys[near]
            hit = seen == keys[at]
            to[at[hit]] = self.values[near[hit]]
            at = at[~hit & (seen >= 0)]
        return to.reshape(shape)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text (columns) for each language (rows)."""
        out = np.zeros((len(self.langs), len(texts)), np.int64)
        group, size = [], 0
        for n, text in enumerate(texts):
            for at in range(0, len(text), STRETCH):
                group.append((n, text[at : at + STRETCH]))
                size += len(group[-1][1])
                if size >= GROUP:
                    self._group(group, out)
                    group, size = [], 0
        if group:
            self._group(group, out)
        return out

    def _group(self, group: list[tuple[int, str]], out: np.ndarray) -> None:
        group.sort(key=lambda x: -len(x[1]))  # longest first, so that those that go on are always the first ones
        lengths = np.array([len(t) for _, t in group])
        codes = self.symbol[np.frombuffer("".join(t for _, t in group).encode("utf-32-le", "surrogatepass"), "<u4")]
        starts = np.cumsum(lengths) - lengths
        state = np.repeat(self.roots[:, None], len(group), axis=1)
        counts = np.zeros(state.shape, np.int64)
        roots = self.roots[:, None]
        going = len(group)
        for i in range(lengths[0]):
            while lengths[going - 1] <= i:
                going -= 1
            symbol = codes[starts[:going] + i]
            now = state[:, :going]
            to = self._step(now, symbol[None, :])
            ended = to < 0
            inside = now != roots
            # the phrase ends before the symbol and a new one starts with it; a symbol unknown to a language is a phrase
            again = self.first[:, symbol]
            unknown = again < 0
            counts[:, :going] += ended & inside
            counts[:, :going] += ended & unknown
            state[:, :going] = np.where(ended, np.where(unknown, roots, again), to)
        counts += state != roots
        np.add.at(out, (slice(None), np.array([n for n, _ in group])), counts)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """For each text the language, and by how large a part it costs less than the next."""
        found, score = ["und"] * len(texts), [0.0] * len(texts)
        asked = [i for i, t in enumerate(texts) if t is not None and _LETTER.search(t)] if self.langs else []
        plain = [f" {' '.join(texts[i].split())} " for i in asked]
        costs = self.phrases(plain) * self.cost[:, None]
        for n, i in enumerate(asked):
            best = int(costs[:, n].argmin())
            rest = np.delete(costs[:, n], best).min() if len(self.langs) > 1 else costs[best, n] + len(plain[n])
            found[i], score[i] = self.langs[best], float(1.0 - costs[best, n] / rest)
        return found, score


def _parser(training: dict[str, str]) -> CrossParser:
    """One parser in each worker process for the same training texts."""
    return held(("langid", *sorted(training.items())), lambda: CrossParser(training))


def learn(docs: DataFrame, docs_per_lang: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS, all_chars: int = ALL_CHARS) -> dict[str, str]:
    """Training text by language, from a sample of docs (text, lang) that is bounded for each language.

    Of each language, the distinct texts with the smallest hashes are taken, whatever their length or number of copies,
    and reruns agree. All give the same number of characters, out of their middle. Every label is learned: where there are so many that
    `chars` of each would be more than all_chars together, each has fewer (LEAST_CHARS at least).
    """
    rows = docs.where("lang is not null").where(F.trim("text") != "")
    keyed = rows.withColumn("key", F.xxhash64("text"))
    order = Window.partitionBy("lang").orderBy("key")
    first = keyed.select("lang", "key").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= docs_per_lang)
    found = first.groupBy("lang").agg(F.max("key").alias("key"), F.max("n").alias("n")).collect()
    if not found:
        return {}
    chars = min(chars, max(LEAST_CHARS, all_chars // len(found)))
    bounds = {r.lang: (r.key, max(1, chars // r.n)) for r in found}
    of = lambda i: F.element_at(F.create_map(*(F.lit(x) for lang, b in bounds.items() for x in (lang, b[i]))), F.col("lang"))
    length, part = F.char_length("text"), of(1).cast("int")
    middle = F.col("text").substr(F.greatest(F.lit(1), F.floor((length - part) / 2).cast("int") + 1), part)
    taken = keyed.where(F.col("key") <= of(0)).select("lang", "key", middle.alias("part")).groupBy("lang", "key").agg(F.min("part").alias("part"))
    texts: dict[str, list[str]] = {}
    for r in sorted(taken.collect(), key=lambda r: (r.lang, r.key)):
        texts.setdefault(r.lang, []).extend(r.part.split())
    return {lang: f" {' '.join(words)} " for lang, words in texts.items() if words}


def predict(docs: DataFrame, training: dict[str, str], pred: str = "lang_pred", score: str = "score", text: str = "text") -> DataFrame:
    """docs with a text column and any others -> the same rows with the language and its score (0 to 1)."""
    others = [c for c in docs.columns if c.lower() not in (pred.lower(), score.lower())]
    schema = docs.select(*others).schema.add(pred, "string").add(score, "double")
    shared = docs.sparkSession.sparkContext.broadcast(training)

    def run(batches):
        parser = _parser(shared.value)
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            langs, scores = parser.predict(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*others, pred, score])

    return docs.select(*others).mapInArrow(run, schema)
