"""A compressed full-text index over word numbers: wavelet matrix, backward search, matching statistics.

The text's suffixes are sorted by their first ``depth`` words.  That order's last column is kept in
a wavelet matrix (one bit a symbol and level, with a count for each 64 bits), and backward search
over it finds the interval of all suffixes that begin with a pattern of up to ``depth`` words.
Beside it stand the common prefixes of neighbours (up to ``depth``), from which a match that cannot
be extended falls back to its longest prefix that occurs in more places, and the sorted places.

All queries are run in lockstep: a step extends every lane by one word to the left.
"""

from __future__ import annotations

import numpy as np

WORD = 64


class WaveletMatrix:
    """Bits of a sequence by level, most significant first, with ranks."""

    def __init__(self, symbols: np.ndarray, largest: int) -> None:
        self.levels = max(1, int(largest).bit_length())
        self.bits: list[np.ndarray] = []
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        n = len(symbols)
        for level in range(self.levels - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(bool)
            packed = np.zeros((n // WORD + 1) * 8, np.uint8)
            small = np.packbits(bit, bitorder="little")
            packed[: len(small)] = small
            words = packed.view("<u8")
            counts = np.bitwise_count(words).astype(np.int32)
            self.bits.append(words)
            self.ones.append(np.cumsum(counts, dtype=np.int32) - counts)
            self.zeros.append(n - int(bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where the first ``place`` symbols' share of ``symbol`` ends on the lowest level."""
        for i in range(self.levels):
            word = place >> 6
            below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.ones[i][word] + np.bitwise_count(self.bits[i][word] & below)
            up = ((symbol >> (self.levels - 1 - i)) & 1).astype(bool)
            place = np.where(up, self.zeros[i] + ones, place - ones)
        return place


def sorted_places(text: np.ndarray, depth: int) -> np.ndarray:
    """All places, in the order of their next ``depth`` symbols, equal ones by place; beyond the end stands 0."""
    ranks, reach = text.astype(np.int64), 1
    while reach < depth:
        step = min(reach, depth - reach)
        after = np.zeros_like(ranks)
        after[:-step] = ranks[step:]
        keys = ranks * (int(ranks.max()) + 1) + after
        order = np.argsort(keys, kind="stable")
        ranks[order] = np.concatenate([[0], np.cumsum(np.diff(keys[order]) != 0)])
        reach += step
    return np.argsort(ranks, kind="stable")


class FMIndex:
    """An index of segments, each a run of word numbers from 1 on, for patterns of up to ``depth`` words."""

    def __init__(self, segments: np.ndarray, lengths: np.ndarray, depth: int) -> None:
        """segments: all words end to end; lengths: how many words each segment has."""
        self.depth = depth
        ends = np.cumsum(lengths)
        #: where each segment begins in the text, in which a 0 follows every segment
        self.start = ends - lengths + np.arange(len(lengths))
        text = np.zeros(len(segments) + len(lengths) + depth, np.int64)
        text[np.arange(len(segments)) + np.repeat(np.arange(len(lengths)), lengths)] = segments
        self.rows = n = len(text)
        places = sorted_places(text, depth)
        self.symbols = int(text.max())
        self.matrix = WaveletMatrix(text[places - 1], self.symbols)
        counts = np.bincount(text, minlength=self.symbols + 1)
        every = np.arange(self.symbols + 1)
        self.shift = np.cumsum(counts) - counts - self.matrix.descend(every, np.zeros(len(every), np.int64))
        self.common = self._common(text, places)
        self.before, self.after = self._smaller()
        self.places = places.astype(np.int32 if n < 1 << 31 else np.int64)

    def _common(self, text: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How many symbols, ``depth`` at most, each row shares with the row before it; -1 at both ends."""
        shared = np.zeros(self.rows + 1, np.int8)
        padded = np.concatenate([text, np.zeros(self.depth, np.int64)])
        alike = np.arange(1, self.rows)
        for d in range(self.depth):
            alike = alike[padded[places[alike] + d] == padded[places[alike - 1] + d]]
            shared[alike] = d + 1
        shared[0] = shared[-1] = -1
        return shared

    def _smaller(self) -> tuple[np.ndarray, np.ndarray]:
        """For each row boundary the nearest ones before and after whose common prefix is smaller."""
        n = self.rows + 1
        at = np.arange(n, dtype=np.int32)
        before, after = np.zeros(n, np.int32), np.full(n, n - 1, np.int32)
        for d in range(self.depth + 1):
            of = self.common == d
            if of.any():
                less = self.common < d
                before[of] = np.maximum.accumulate(np.where(less, at, 0))[of]
                after[of] = np.minimum.accumulate(np.where(less, at, n - 1)[::-1])[::-1][of]
        return before, after

    def matching_statistics(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word of streamed segments: how many words from it on occur in the index (``depth`` at most), and their interval of rows.

        Words that the index doesn't have are 0 or beyond its symbols.
        """
        ends = np.cumsum(lengths)
        match, low, high = (np.zeros(len(words), np.int64) for _ in range(3))
        lanes = np.argsort(-lengths, kind="stable")
        lo, hi, size = np.zeros(len(lanes), np.int64), np.full(len(lanes), self.rows, np.int64), np.zeros(len(lanes), np.int64)
        known = (words > 0) & (words <= self.symbols)
        for step in range(int(lengths.max()) if len(lengths) else 0):
            active = int(np.searchsorted(-lengths[lanes], -step, side="left"))
            at = ends[lanes[:active]] - 1 - step
            full = np.flatnonzero(size[:active] == self.depth)
            self._shorten(full, lo, hi, size)
            gone = np.flatnonzero(~known[at])
            lo[gone], hi[gone], size[gone] = 0, self.rows, 0
            waiting = np.flatnonzero(known[at])
            while len(waiting):
                symbol = words[at[waiting]]
                both = self.matrix.descend(np.concatenate([symbol, symbol]), np.concatenate([lo[waiting], hi[waiting]])) + np.tile(self.shift[symbol], 2)
                first, last = both[: len(waiting)], both[len(waiting) :]
                found = first < last
                done = waiting[found]
                lo[done], hi[done] = first[found], last[found]
                size[done] += 1
                waiting = waiting[~found]
                waiting = waiting[size[waiting] > 0]
                self._shorten(waiting, lo, hi, size, by_one=False)
            match[at], low[at], high[at] = size[:active], lo[:active], hi[:active]
        return match, low, high

    def _shorten(self, lanes: np.ndarray, lo: np.ndarray, hi: np.ndarray, size: np.ndarray, by_one: bool = True) -> None:
        """Matches lose words on the right: one, or so many that the interval grows."""
        left, right = self.common[lo[lanes]], self.common[hi[lanes]]
        edge = np.where(left >= right, lo[lanes], hi[lanes])
        depth = np.maximum(self.common[edge], 0)
        if by_one:
            grows = depth == size[lanes] - 1
            size[lanes] -= 1
            lanes, edge = lanes[grows], edge[grows]
        else:
            size[lanes] = depth
        whole = size[lanes] == 0
        lo[lanes], hi[lanes] = np.where(whole, 0, self.before[edge]), np.where(whole, self.rows, self.after[edge])
