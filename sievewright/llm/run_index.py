"""Run-length index of a bounded text: a run-compressed Burrows-Wheeler transform with samples at run ends.

A position whose suffix stands inside a run needs no sample: the suffix before it in the order carries the
same preceding symbol, so its match is the match of the text position one to the left, shortened by one
symbol. Only the two ends of each run hold a match length. Matching statistics are streamed left to right
from these samples.

The order of the suffixes is needed to build the index only. What stays are the symbol and length of each run, the samples
at their ends, and the places of the segments.
"""

from __future__ import annotations

import numpy as np

#: Places of an index: a sort key holds a place and two ranks of so many bits.
PLACE_BITS = 21
MOST = (1 << PLACE_BITS) - 1


class RunIndex:
    """Index of several byte strings; matches never run over the end of one."""

    def __init__(self, segments: list[bytes]):
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        self.starts = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        self.lengths = lengths
        n = int((lengths + 1).sum())
        if n > MOST:
            raise ValueError(f"an index holds at most {MOST} symbols")
        data = np.frombuffer(b"".join(segments), np.uint8)
        dense = np.zeros(256, np.int64)
        used = np.unique(data)
        dense[used] = np.arange(1, len(used) + 1)
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[self.starts + lengths] = False
        text[inside] = dense[data]
        self.text, self.n, self.ends = text, n, self.starts + lengths
        self.dense = dense
        #: symbols packed into the first sort key
        self.first = 2 * PLACE_BITS // max(1, int(len(used)).bit_length())
        self._sort()
        self._compress()
        del self.order, self.levels, self.text

    def _sort(self) -> None:
        """Doubling; a key carries its place, so keys are sorted and not their order. The end of a segment is unlike any other."""
        n, first = self.n, self.first
        bits = 2 * PLACE_BITS // first
        padded = np.concatenate((self.text, np.zeros(first, np.int64)))
        key = np.zeros(n, np.int64)
        for i in range(first):
            key <<= bits
            key |= padded[i : i + n]
        at = np.arange(n, dtype=np.int64)
        last = self.ends[np.searchsorted(self.ends, at)]
        unlike = at + first > last  # the key reaches the end of its segment
        self.levels: list[tuple[int, np.ndarray]] = []
        width = first
        while True:
            key <<= PLACE_BITS
            key |= at
            key.sort()
            order = key & MOST
            new = np.empty(n, bool)
            new[0] = True
            key >>= PLACE_BITS
            np.not_equal(key[1:], key[:-1], out=new[1:])
            new |= unlike[order]
            rank = np.empty(n, np.int64)
            number = np.cumsum(new) - 1
            rank[order] = number
            self.levels.append((width, rank.astype(np.int32)))
            if number[-1] == n - 1:
                break
            key = rank << PLACE_BITS
            key[: max(n - width, 0)] |= rank[width:] if width < n else 0
            width *= 2
        self.order = order

    def _compress(self) -> None:
        before = self.text[self.order - 1]
        before[self.order == 0] = 0
        # what stands before a segment is unlike anything else, too
        change = (before[1:] != before[:-1]) | (before[1:] == 0)
        head = np.concatenate(([True], change))
        self.head_rows = np.flatnonzero(head)
        self.tail_rows = np.flatnonzero(np.concatenate((change, [True])))
        self.run_symbols = before[self.head_rows].astype(np.uint8 if before.max(initial=0) < 256 else np.int16)
        self.run_lengths = np.diff(np.append(self.head_rows, self.n))
        heads = self.head_rows[self.head_rows > 0]
        tails = self.tail_rows[self.tail_rows < self.n - 1]
        self.head_sample = (self.order[heads], self._common(self.order[heads], self.order[heads - 1]))
        self.tail_sample = (self.order[tails], self._common(self.order[tails], self.order[tails + 1]))

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and b."""
        length = np.zeros(len(a), np.int64)
        for width, rank in reversed(self.levels):
            x, y = a + length, b + length
            ok = (x < self.n) & (y < self.n)
            same = np.zeros(len(a), bool)
            same[ok] = rank[x[ok]] == rank[y[ok]]
            length[same] += width
        live = np.ones(len(a), bool)
        for _ in range(self.first - 1):
            x, y = a + length, b + length
            live &= (x < self.n) & (y < self.n)
            live[live] = (self.text[x[live]] == self.text[y[live]]) & (self.text[x[live]] > 0)
            length[live] += 1
        return length

    def count(self, pattern: bytes) -> int:
        """Occurrences of a pattern, by backward search over the runs; the dedup streams statistics instead, the tests hold the index against this."""
        # rows of smaller symbols; every end of a segment is smaller than all of them
        below = np.concatenate(([0], np.cumsum(np.bincount(self.run_symbols, self.run_lengths, 257))))
        low, high = 0, self.n
        for c in reversed(self.dense[np.frombuffer(pattern, np.uint8)].tolist()):
            if not c:
                return 0
            runs = np.flatnonzero(self.run_symbols == c)
            upto = np.concatenate(([0], np.cumsum(self.run_lengths[runs])))
            low, high = (int(below[c] + self._rank(c, row, runs, upto)) for row in (low, high))
            if low >= high:
                return 0
        return high - low

    def _rank(self, c: int, row: int, runs: np.ndarray, upto: np.ndarray) -> int:
        """How often the symbol c stands before the row."""
        if row >= self.n:
            return int(upto[-1])
        run = int(np.searchsorted(self.head_rows, row, "right")) - 1
        inside = row - int(self.head_rows[run]) if self.run_symbols[run] == c else 0
        return int(upto[np.searchsorted(runs, run)]) + inside

    def matching_statistics(self) -> np.ndarray:
        """For each position, the longest match of the text from there with the text from any other position."""
        at = np.arange(self.n, dtype=np.int64)
        best = np.zeros(self.n, np.int64)
        for places, sample in (self.head_sample, self.tail_sample):
            end = np.zeros(self.n, np.int64)
            end[places] = places + sample
            np.maximum(best, np.maximum.accumulate(end) - at, out=best)
        return best

    def long_matches(self, least: int) -> list[list[tuple[int, int]]]:
        """Per segment, the maximal [start, end) covered by strings of `least` bytes that occur elsewhere."""
        long = np.flatnonzero(self.matching_statistics() >= least)
        segment = np.searchsorted(self.starts, long, "right") - 1
        inside = long - self.starts[segment]
        fits = inside + least <= self.lengths[segment]
        found: list[list[tuple[int, int]]] = [[] for _ in range(len(self.starts))]
        for s, i in zip(segment[fits].tolist(), inside[fits].tolist()):
            spans = found[s]
            if spans and spans[-1][1] >= i:
                spans[-1] = (spans[-1][0], i + least)
            else:
                spans.append((i, i + least))
        return found
