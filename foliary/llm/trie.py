"""An n-gram trie in Elias-Fano levels, all numpy over one memory-mapped buffer.

A level holds its nodes' ids in the order of their parents, sorted within a parent.  To make that one
monotone sequence, each parent's children are raised by the last number before them.  The pointers
to each parent's first child are monotone too; both are Elias-Fano coded.  A child is found by
successor search relative to its context: the pointers give the range of the parent's children and
with it the base, and base plus id is looked up in that range by two selects on the upper bits and
bisection of the lower bits.  Each node has one or more values, quantised to a code of one byte.

Questions come by the million: selects are answered in the order of their places, a piece of the
upper bits at a time, so memory beside the mapped levels is bounded.
"""

from __future__ import annotations

import json
import mmap
import os
import tempfile

import numpy as np

PIECE = 8192  # bytes of upper bits
TURN = 1 << 16  # questions answered at a time


def _bits_in_row(values: np.ndarray, width: int) -> np.ndarray:
    """Numbers of ``width`` bits, one behind the other, as bytes."""
    n = len(values)
    if not width or not n:
        return np.zeros(0, np.uint8)
    place = np.arange(n, dtype=np.int64) * width
    word, shift = place >> 6, (place & 63).astype(np.uint64)
    out = np.zeros((n * width >> 6) + 2, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
    over = np.flatnonzero(shift + np.uint64(width) > np.uint64(64))  # at most one for each word
    out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
    return out.view(np.uint8)[: (n * width + 7) >> 3]


class EliasFano:
    """A sorted sequence of numbers; sections are flat arrays."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray) -> None:
        self.n, self.low_bits = n, low_bits
        self.low, self.high, self.zeros = low, high, zeros  # zeros: zeros before each piece of the upper bits
        self.words = np.ndarray((max(0, len(low) - 7),), "<u8", buffer=low, strides=(1,)) if len(low) >= 8 else np.zeros(0, np.uint64)
        self.ones = np.arange(len(zeros), dtype=np.int64) * PIECE * 8 - zeros
        self.buckets = len(high) * 8 - n

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        upper = (values >> np.uint64(low_bits)).astype(np.int64)
        size = n + (int(upper[-1]) if n else 0) + 2
        size += -size % 8
        bits = np.zeros(size, np.uint8)
        bits[upper + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little")
        zeros = np.concatenate([[0], np.cumsum([8 * len(p) - int(np.bitwise_count(p).sum(dtype=np.int64)) for p in (high[a : a + PIECE] for a in range(0, len(high), PIECE))])[:-1]]).astype(np.int64)
        low = _bits_in_row(values & np.uint64((1 << low_bits) - 1), low_bits)
        return cls(n, low_bits, np.concatenate([low, np.zeros(8, np.uint8)]), high, zeros)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th (from 0) zero or one."""
        if not len(k):
            return np.zeros(0, np.int64)
        out = np.empty(len(k), np.int64)
        directory = self.ones if ones else self.zeros
        order = np.argsort(k, kind="stable") if len(k) and (k[1:] < k[:-1]).any() else None
        want = k if order is None else k[order]
        piece = np.searchsorted(directory, want, "right") - 1
        first = np.flatnonzero(np.diff(piece, prepend=-1))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(want)], strict=True):
            p = int(piece[a])
            bits = np.unpackbits(self.high[p * PIECE : (p + 1) * PIECE], bitorder="little")
            out[a:b] = p * PIECE * 8 + np.flatnonzero(bits if ones else bits == 0)[want[a:b] - directory[p]]
        if order is None:
            return out
        back = np.empty(len(k), np.int64)
        back[order] = out
        return back

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        place = i.astype(np.int64) * self.low_bits
        return (self.words[place >> 3] >> (place & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers."""
        i = i.astype(np.int64)
        return (((self._select(i, True) - i).astype(np.uint64)) << np.uint64(self.low_bits)) | self._low(i)

    def successor(self, x: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first number from ``first`` to below ``last`` that is x or more, among those with x's upper bits; and whether it is x."""
        x = x.astype(np.uint64)
        upper = (x >> np.uint64(self.low_bits)).astype(np.int64)
        lower = x & np.uint64((1 << self.low_bits) - 1)
        inside = upper < self.buckets
        upper = np.where(inside, upper, 0)
        begin = np.where(upper > 0, self._select(np.maximum(upper - 1, 0), False) + 1 - upper, 0)
        end = self._select(upper, False) - upper
        a, b = np.maximum(begin, first), np.minimum(end, last)
        b = np.where(inside, np.maximum(a, b), a)
        top = b.copy()
        live = np.flatnonzero(a < b)
        while len(live):
            middle = (a[live] + b[live]) >> 1
            less = self._low(middle) < lower[live]
            a[live[less]] = middle[less] + 1
            b[live[~less]] = middle[~less]
            live = live[a[live] < b[live]]
        hit = a < top
        hit[hit] = self._low(a[hit]) == lower[hit]
        return a, hit

    def sections(self) -> list[np.ndarray]:
        return [self.low, self.high, self.zeros]


class Trie:
    """levels: (ids, pointers, codes, one row for each kind of value); pointers have an entry for each parent, and one more."""

    def __init__(self, levels: list[tuple[EliasFano, EliasFano, np.ndarray]], books: list[np.ndarray]) -> None:
        self.levels, self.books = levels, books

    @classmethod
    def build(cls, levels: list[tuple[np.ndarray, ...]]) -> Trie:
        """levels: parents (indexes into the level above, sorted), ids (sorted within a parent), log values of each kind."""
        made, books, parents_of = [], [], 1
        for parents, ids, *values in levels:
            first = np.searchsorted(parents, np.arange(parents_of + 1))
            last = np.where(first[1:] > first[:-1], ids[np.maximum(first[1:] - 1, 0)].astype(np.int64) if len(ids) else 0, 0)
            base = np.concatenate([[0], np.cumsum(last)]).astype(np.uint64)
            coded = [quantise(v) for v in values]
            made.append((EliasFano.build(base[parents] + ids.astype(np.uint64)), EliasFano.build(first.astype(np.uint64)), np.stack([c for c, _ in coded])))
            books.append(np.stack([b for _, b in coded]))
            parents_of = len(ids)
        return cls(made, books)

    def find(self, level: int, parents: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Index of each child in its level, -1 where there is none (a parent of -1 has none)."""
        seq, pointers, _ = self.levels[level]
        out = np.full(len(ids), -1, np.int64)
        some = np.flatnonzero(parents >= 0)
        if not len(some) or not seq.n:
            return out
        # parents come many times each: their children's range and base are read once
        own = parents[some]
        if (own[1:] >= own[:-1]).all():
            new = np.concatenate([[True], own[1:] != own[:-1]])
            distinct, back = own[new], np.cumsum(new) - 1
        else:
            distinct, back = np.unique(own, return_inverse=True)
        ends = pointers.access(np.concatenate([distinct, distinct + 1])).astype(np.int64)
        first, last = ends[: len(distinct)], ends[len(distinct) :]
        base = np.zeros(len(distinct), np.uint64)
        base[first > 0] = seq.access(first[first > 0] - 1)
        for a in range(0, len(some), TURN):
            of, who = back[a : a + TURN], some[a : a + TURN]
            index, hit = seq.successor(base[of] + ids[who].astype(np.uint64), first[of], last[of])
            out[who[hit]] = index[hit]
        return out

    def codes(self, level: int, index: np.ndarray, kind: int = 0) -> np.ndarray:
        """1 more than the nodes' codes; 0 where the index is -1."""
        held = self.levels[level][2][kind]
        return np.where(index >= 0, held[np.maximum(index, 0)].astype(np.uint16) + 1, 0).astype(np.uint16) if len(held) else np.zeros(len(index), np.uint16)

    def values(self, level: int, index: np.ndarray, kind: int = 0) -> np.ndarray:
        return self.books[level][kind][self.levels[level][2][kind][index]]

    def packed(self) -> bytes:
        head, parts = [], []
        for (ids, pointers, codes), book in zip(self.levels, self.books, strict=True):
            entry = []
            for seq in (ids, pointers):
                entry.append([seq.n, seq.low_bits, *(s.nbytes for s in seq.sections())])
                parts += [s.tobytes() for s in seq.sections()]
            entry.append([*codes.shape, book.shape[1]])
            parts += [codes.tobytes(), book.astype("<f8").tobytes()]
            head.append(entry)
        header = json.dumps(head).encode()
        header += b" " * (-(len(header) + 8) % 8)
        body = [len(header).to_bytes(8, "little"), header]
        for p in parts:
            body.append(p + b"\0" * (-len(p) % 8))
        return b"".join(body)

    @classmethod
    def opened(cls, buffer) -> Trie:
        raw = np.frombuffer(buffer, np.uint8)
        n = int.from_bytes(raw[:8].tobytes(), "little")
        head, at = json.loads(raw[8 : 8 + n].tobytes()), 8 + n

        def take(size: int) -> np.ndarray:
            nonlocal at
            out = raw[at : at + size]
            at += size + (-size % 8)
            return out

        levels, books = [], []
        for entry in head:
            seqs = []
            for count, low_bits, *sizes in entry[:2]:
                low, high, zeros = (take(s) for s in sizes)
                seqs.append(EliasFano(count, low_bits, low, high, zeros.view(np.int64)))
            kinds, nodes, codes = entry[2]
            levels.append((*seqs, take(kinds * nodes).reshape(kinds, nodes)))
            books.append(take(8 * kinds * codes).view("<f8").reshape(kinds, codes))
        return cls(levels, books)

    def mapped(self) -> MappedTrie:
        return MappedTrie(self.packed())


class MappedTrie:
    """A trie whose levels lie in a memory-mapped temporary file that goes when it is closed.

    The file is of the task that made it, nobody else reads it, and it has no name any more once it
    is mapped: a task that runs again on another machine makes its own.
    """

    def __init__(self, data: bytes) -> None:
        fd, path = tempfile.mkstemp(prefix="trie-")
        try:
            os.write(fd, data) if len(data) < 1 << 30 else [os.write(fd, data[i : i + (1 << 30)]) for i in range(0, len(data), 1 << 30)]
            self.map = mmap.mmap(fd, 0, access=mmap.ACCESS_READ)
        finally:
            os.close(fd)
            os.unlink(path)
        self.trie = Trie.opened(self.map)

    def __enter__(self) -> Trie:
        return self.trie

    def __exit__(self, *_) -> None:
        self.trie = None


def quantise(values: np.ndarray, codes: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Codes of equal-width bins, and each bin's mean."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(codes)
    low, high = float(values.min()), float(values.max())
    code = np.zeros(len(values), np.int64) if high <= low else np.minimum(((values - low) / (high - low) * codes).astype(np.int64), codes - 1)
    count = np.bincount(code, minlength=codes)
    book = np.bincount(code, weights=values, minlength=codes) / np.maximum(count, 1)
    return code.astype(np.uint8), book
