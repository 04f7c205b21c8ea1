"""Byte-level BPE: the leftmost least-ranked pair is found by a segment tree over byte positions.

Each piece of a text (a match of the pattern) has a tree whose leaves are its byte positions and
hold rank * size + position of the pair that begins there; the root is then the leftmost pair of
the least rank.  A merge changes three leaves (the pair itself, its right neighbour that dies, its
left neighbour whose pair changes), each by one walk to the root.  Pieces of about one length are
run in lockstep, one numpy row each, so a step costs a few array operations for all of them; of
long pieces, few of which are of one length, each has a tree of plain numbers.

Pieces already met by a task are remembered (a bounded memory, emptied when full).

Defined results: a null text is an empty one, with no ids; every text decodes to its own bytes;
repeated rows get equal ids each; texts and pieces of any length are taken whole; an empty table
gives an empty one; a column called like a result (in any case) gives way to it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm import common as C

NONE = np.iinfo(np.int64).max
LOCKSTEP_CELLS = 1 << 22
#: pieces longer than so many bytes, and no more than so many together, are merged one by one
ALONE_BYTES, ALONE = 256, 16


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Coder(C.PieceMemory):
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.size = max(ranks.values()) + 1
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    values.append(rank)
        self._hash(np.array(keys, np.int64), np.array(values, np.int64))
        self.pairs = dict(zip(keys, values, strict=True))
        tokens = [b""] * self.size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_len = np.array([len(t) for t in tokens], np.int64)
        self.token_start = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        super().__init__()

    # pairs of ids -> id of the merged token, by open addressing
    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(10, int(len(keys) * 4).bit_length())
        self.slot_key, self.slot_value = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int64)
        at = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.slot_key[at[todo]] < 0
            self.slot_key[at[todo[free]]] = keys[todo[free]]  # of several, the last one written stays
            won = self.slot_key[at[todo]] == keys[todo]
            self.slot_value[at[todo[won]]] = values[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) * self.size + b
        at = self._slot(keys)
        got = self.slot_key[at]
        out = np.where(got == keys, self.slot_value[at], NONE)
        todo = np.flatnonzero((got != keys) & (got >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            got = self.slot_key[at[todo]]
            hit = got == keys[todo]
            out[todo[hit]] = self.slot_value[at[todo[hit]]]
            todo = todo[~hit & (got >= 0)]
        return out

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of one length class, end to end, and how many each has; in lockstep."""
        n, lengths = len(pieces), np.array([len(p) for p in pieces])
        size = max(2, 1 << int(lengths.max() - 1).bit_length())
        raw, begin = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(lengths) - lengths
        row = np.repeat(np.arange(n), lengths)
        col = np.arange(len(raw)) - begin[row]
        ids = np.full((n, size + 1), -1, np.int32)
        ids[row, col] = self.of_byte[raw]
        after = np.tile(np.arange(1, size + 2, dtype=np.int32), (n, 1))  # the next live position
        before = np.tile(np.arange(-1, size, dtype=np.int32), (n, 1))
        tree = np.full((n, 2 * size), NONE, np.int64)
        inside = np.flatnonzero(col + 1 < lengths[row])
        r, c = row[inside], col[inside]
        rank = self.pair_rank(ids[r, c], ids[r, c + 1])
        tree[r, size + c] = np.where(rank == NONE, NONE, rank * size + c)
        level = size
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = tree[:, 2 * level : 4 * level].reshape(n, level, 2).min(axis=2)
        cells = tree.reshape(-1)
        live = np.arange(n)

        def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            at = rows * (2 * size)
            node = leaf + size
            cells[at + node] = value
            while size > 1 and len(node) and node[0] > 1:  # all leaves are equally deep
                node = node >> 1
                cells[at + node] = np.minimum(cells[at + 2 * node], cells[at + 2 * node + 1])

        while True:
            root = tree[live, 1]
            going = root != NONE
            live, root = live[going], root[going]
            if not len(live):
                break
            pos, token = root % size, root // size
            gone = after[live, pos]
            then = after[live, gone]
            ids[live, pos] = token
            ids[live, gone] = -1
            after[live, pos] = then
            end = lengths[live]
            put(live, gone.astype(np.int64), np.full(len(live), NONE))
            more = then < end
            value = np.full(len(live), NONE)
            rows = live[more]
            before[rows, then[more]] = pos[more]
            rank = self.pair_rank(token[more], ids[rows, then[more]])
            value[more] = np.where(rank == NONE, NONE, rank * size + pos[more])
            put(live, pos, value)
            prev = before[live, pos]
            has = prev >= 0
            rows, prev = live[has], prev[has].astype(np.int64)
            rank = self.pair_rank(ids[rows, prev], token[has])
            put(rows, prev, np.where(rank == NONE, NONE, rank * size + prev))
        ids = ids[:, :size]
        keep = ids >= 0
        return ids[keep].astype(np.uint32), keep.sum(axis=1)

    def merge_alone(self, piece: bytes) -> np.ndarray:
        """Ids of one piece."""
        n = len(piece)
        size = 1 << max(1, (n - 1).bit_length())
        ids = [int(self.of_byte[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree, pairs, ranks = [NONE] * (2 * size), self.pairs, self.size
        for i in range(n - 1):
            rank = pairs.get(ids[i] * ranks + ids[i + 1])
            if rank is not None:
                tree[size + i] = rank * size + i
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(leaf: int, rank: int | None) -> None:
            node = leaf + size
            tree[node] = NONE if rank is None else rank * size + leaf
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    return
                tree[node] = least
                node >>= 1

        while (root := tree[1]) != NONE:
            pos, token = root % size, root // size
            gone = after[pos]
            then = after[gone]
            ids[pos], ids[gone], after[pos] = token, -1, then
            put(gone, None)
            if then < n:
                before[then] = pos
            put(pos, pairs.get(token * ranks + ids[then]) if then < n else None)
            if (prev := before[pos]) >= 0:
                put(prev, pairs.get(ids[prev] * ranks + token))
        return np.array([x for x in ids if x >= 0], np.uint32)

    def coded(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        by: dict[int, list[bytes]] = {}
        names: list[str] = []
        ids_parts, length_parts = [], []
        groups: dict[int, list[str]] = {}
        whole: list[int] = []
        for piece in pieces:
            raw = piece.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                names.append(piece)
                whole.append(rank)
            else:
                size = (len(raw) - 1).bit_length()
                by.setdefault(size, []).append(raw)
                groups.setdefault(size, []).append(piece)
        ids_parts.append(np.array(whole, np.uint32))
        length_parts.append(np.ones(len(whole), np.int64))
        for size, group in by.items():
            step = max(1, LOCKSTEP_CELLS >> (size + 2))
            for i in range(0, len(group), step):
                some = group[i : i + step]
                if 1 << size > ALONE_BYTES and len(some) <= ALONE:
                    each = [self.merge_alone(p) for p in some]
                    ids, lengths = np.concatenate(each), np.array([len(x) for x in each])
                else:
                    ids, lengths = self.merge(some)
                ids_parts.append(ids)
                length_parts.append(lengths)
            names += groups[size]
        return names, np.concatenate(ids_parts), np.concatenate(length_parts)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        return self.ids_of([self.pattern.findall(t) for t in texts])

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        lengths = self.token_len[ids]
        ends = np.cumsum(lengths)
        total = int(lengths.sum())
        return self.token_bytes[np.repeat(self.token_start[ids] - ends + lengths, lengths) + np.arange(total)].tobytes()


_CODER: dict[str, Coder] = {}


def _coder(key: str, ranks: dict[bytes, int], pattern: str) -> Coder:
    """One coder for each worker process."""
    if key not in _CODER:
        _CODER.clear()
        _CODER[key] = Coder(ranks, pattern)
    return _CODER[key]


def _default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode(docs: DataFrame, ranks_path: str, pattern: str | None = None, text: str = "text", keep: list[str] | None = None, ids: bool = True, digests: bool = False) -> DataFrame:
    """Columns ``keep`` (default: all but clashing ones), n_tokens, and where asked for ids, and the
    hashes of the ids and of the bytes they decode to.

    The ranks are read by the driver and sent to the workers once (a vocabulary is of a fixed size,
    checked to be below 64 MB).
    """
    C.prepare(docs.sparkSession)
    types = {"n_tokens": pa.int64()}
    if ids:
        types["ids"] = pa.list_(pa.int32())
    if digests:
        types |= {"ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    kept = C.Kept(docs, ", ".join(["n_tokens long"] + ["ids array<int>"] * ids + ["ids_sha256 string, decoded_sha256 string"] * digests), keep)
    columns = kept.columns
    ranks = load_ranks(ranks_path)
    if sum(map(len, ranks)) > 64 << 20:
        raise ValueError("the vocabulary is too large to send to every worker")
    pattern = pattern or _default_pattern()
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    key = hashlib.sha256(repr((ranks_path, len(ranks), pattern)).encode()).hexdigest()

    @C.tidy
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(key, shared.value, pattern)
        for batch in C.slices(batches):
            texts = batch.column(batch.schema.get_field_index("body")).cast(pa.string()).fill_null("").to_pylist()
            for a, b in C.text_batches(texts):
                coded = coder.encode(texts[a:b])
                got = {"n_tokens": pa.array([len(x) for x in coded], pa.int64())}
                if ids:
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in coded])]).astype(np.int32)
                    got["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(coded).astype(np.int32)))
                if digests:
                    got["ids_sha256"] = pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in coded])
                    got["decoded_sha256"] = pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in coded])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_pydict(C.passed_on(part, columns) | {c: got[c] for c in types})
        coder.forget()

    return kept.apply(task, body=kept.column(text))


def decode(coded: DataFrame, ranks_path: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """Turns lists of ids back into texts (bytes that are no UTF-8 become the replacement character); null stays null."""
    C.prepare(coded.sparkSession)
    ranks = load_ranks(ranks_path)
    shared = coded.sparkSession.sparkContext.broadcast(ranks)
    key = hashlib.sha256(repr((ranks_path, len(ranks), "")).encode()).hexdigest()
    kept = C.Kept(coded, f"`{into}` string", [c for c in coded.columns if c != ids])
    columns = kept.columns

    @C.tidy
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(key, shared.value, "")
        for batch in C.slices(batches):
            lists = batch.column(batch.schema.get_field_index("coded")).to_pylist()
            texts = [None if x is None else coder.decode(np.array(x, np.int64)).decode(errors="replace") for x in lists]
            yield pa.RecordBatch.from_pydict(C.passed_on(batch, columns) | {into: pa.array(texts, pa.string())})

    return kept.apply(task, coded=kept.column(ids))
