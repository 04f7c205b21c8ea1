"""Language-model scores from an n-gram trie in Elias-Fano levels.

The model interpolates absolute discounting over add-half unigrams, for contexts of 1 to ``order`` - 1
words (and the begin of a document):
  p(w | c) = max(c(cw) - D, 0) / c(c) + D * n(c) / c(c) * p(w | c'),   p1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)),
c' being c without its first word and n(c) the number of distinct words seen after c; after a context
never seen it is p(w | c').  A node of the trie holds, quantised, the discounted part of its n-gram,
the weight n-grams behind it give to shorter ones, and on the first level the unigram's p1.

Nothing of the corpus has to fit in one place.  Documents are read once, into blocks of about
``BLOCK_TOKENS`` words, each with a dictionary of its own; the word streams are files in the shared
folder.  Each block sends its distinct words, then its distinct pairs, then triples, to shards (one
row for each block and shard, pre-counted); a shard counts, builds its part of the trie, memory-maps
it, looks up all that was sent, and answers each block.  A pair's place in its shard's trie is the
context of the triples behind it.  Words are dealt by hash and longer n-grams by their context's; a
context that would fill more than a quarter of a shard is spread over several by its n-grams' last
words (each shard then knows a part of its weight, and a block asks all of them).  The number of
shards follows the texts' bytes, so a shard's task is of about one size (up to ``MOST_SHARDS``).
The tries are written to a table where the caller names one.

Defined results: a null text is an empty one, of the end token alone; without training documents
every token has the probability of an unknown one; repeated rows are counted and scored each; a very
long text makes its block as large as it is; an empty table gives an empty one; columns beside id and
text play no part, whatever their names.  Words are told apart by 128 bits.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm import common as C
from foliary.llm.sstable import filesystem
from foliary.llm.trie import MappedTrie, Trie

FOLD, HELD = 5, 1
ORDER = 3
BLOCK_TOKENS = 2_000_000
SHARD_TOKENS = 4_000_000
TOKEN_BYTES = 6  # of a token, about; tells how many shards there are
MOST_SHARDS = 1 << 20
DISCOUNT = 0.75
WORD_BITS, LEAF_BITS = 38, 32
END, BEGIN, FIRST = 0, 1, 2  # ids; words follow
SPREAD = 4


def pack(x: np.ndarray) -> bytes:
    """Compressed by byte planes, sorted numbers as differences."""
    x = np.ascontiguousarray(x)
    kind = b"p"
    if x.dtype == np.uint64 and len(x) and (x[1:] >= x[:-1]).all():
        kind, x = b"d", np.diff(x, prepend=np.uint64(0))
    planes = x.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes() if len(x) else b""
    return kind + bytes([x.dtype.itemsize]) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes) -> np.ndarray:
    width = data[1]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[2:]), np.uint8)
    x = np.ascontiguousarray(planes.reshape(width, -1).T).view(f"<u{width}").ravel()
    return np.cumsum(x, dtype=np.uint64) if data[:1] == b"d" else x


def pack_ids(x: np.ndarray) -> bytes:
    """Ids that come several times, as places in the list of distinct ones."""
    distinct, place = np.unique(x.astype(np.uint64), return_inverse=True)
    names = pack(distinct)
    return len(names).to_bytes(4, "little") + names + pack(place.astype(np.uint32))


def unpack_ids(data: bytes) -> np.ndarray:
    n = 4 + int.from_bytes(data[:4], "little")
    return unpack(data[4:n])[unpack(data[n:])]


def distinct_words(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, check), sorted, and each one's place among them."""
    names, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    if (checks[first][back] == checks).all():
        return names, checks[first], back
    order = np.lexsort((checks, hashes))
    a, b = hashes[order], checks[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return a[new], b[new], place


def _shards_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _runs(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, first, end) of each run of a sorted array."""
    if len(shard):
        cuts = np.flatnonzero(np.diff(shard)) + 1
        for a, b in zip(np.concatenate([[0], cuts]).tolist(), np.concatenate([cuts, [len(shard)]]).tolist(), strict=True):
            yield int(shard[a]), a, b


def _batch(rows: list[tuple], columns: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(columns.values())], list(columns))


_NAMES = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def _ddl(columns: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{c} {_NAMES[t]}" for c, t in columns.items())


def _columns(integers: str = "", longs: str = "", strings: str = "", binaries: str = "") -> dict[str, pa.DataType]:
    return {c: t for names, t in ((integers, pa.int32()), (longs, pa.int64()), (strings, pa.string()), (binaries, pa.binary())) for c in names.split()}


WORDS = _columns("shard", "block learnt", "path", "keys checks counts")
#: What comes back to blocks; of words: path, a their ranks, b their counts; of longer n-grams:
#: a codes, b weights of contexts, c places and d counts of those in the trie, e unigram codes, books.
ANSWERS = _columns("shard level", "block distinct seen tokens learnt", "path", "a b c d e books trie")
ASKED = _columns("shard", "block", "", "contexts lengths words counts totals")


def _write_blocks(folder: str, block_tokens: int, shards: int):
    """Writes blocks; for each block and shard a row: where the block is, and its distinct words there with their training counts.

    learnt: the block's training documents, in its first row only.
    """

    @C.tidy
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        scanner = C.spaces_scanner()
        number = TaskContext.get().partitionId() << 24
        ids: list = []
        held: list = []
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        sizes: list[np.ndarray] = []
        tokens = 0

        def close() -> pa.RecordBatch:
            nonlocal number, ids, held, parts, sizes, tokens
            size, out = np.concatenate(sizes), np.array(held, bool)
            words, checks, stream = distinct_words(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)))
            counts = np.bincount(stream[np.repeat(~out, size)], minlength=len(words)).astype(np.uint32)
            name = f"block-{number}-{uuid.uuid4().hex}.bin"
            head = json.dumps({"ids": ids, "held": [int(h) for h in held]}).encode()
            sections = [zstandard.ZstdCompressor(level=1).compress(head), pack(size.astype(np.uint32)), pack(stream.astype(np.uint32))]
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(f"{root}/{name}.tmp") as f:
                f.write(np.array([len(s) for s in sections], "<u8").tobytes() + b"".join(sections))
            fs.move(f"{root}/{name}.tmp", f"{root}/{name}")
            runs = list(_runs(_shards_of(words, shards))) or [(0, 0, 0)]  # or: a block of empty texts
            rows = [(s, number, 0 if i else int((~out).sum()), f"{folder}/{name}", pack(words[a:b]), pack(checks[a:b]), pack(counts[a:b])) for i, (s, a, b) in enumerate(runs)]
            number += 1
            ids, held, parts, sizes, tokens = [], [], [], [], 0
            return _batch(rows, WORDS)

        for batch in C.slices(batches):
            texts = C.texts_of(batch, "text")
            doc, out = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for a, b in C.sub_batches(texts):
                raw, at = C.joined(texts[a:b])
                starts, ends, hashes = scanner.scan(raw)
                ids += doc[a:b]
                held += out[a:b]
                parts.append((hashes, scanner.check(raw, starts, ends)))
                sizes.append(np.diff(np.searchsorted(starts, at)))
                tokens += len(hashes) + b - a
                if tokens >= block_tokens:
                    yield close()
        if ids:
            yield close()

    return task


class Block:
    """A block's file; words are numbers of its dictionary, in the order of their hashes."""

    def __init__(self, path: str) -> None:
        fs, name = filesystem(path)
        with fs.open_input_file(name) as f:
            data = f.read()
        n = np.frombuffer(data[:24], "<u8").astype(np.int64)
        at = 24 + np.concatenate([[0], np.cumsum(n)])
        head = json.loads(zstandard.ZstdDecompressor().decompress(data[at[0] : at[1]]))
        self.ids, self.held = head["ids"], np.array(head["held"], bool)
        self.sizes, self.stream = unpack(data[at[1] : at[2]]).astype(np.int64), unpack(data[at[2] : at[3]])
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes + 1)  # of each token
        self.first = np.concatenate([[0], np.cumsum(self.sizes + 1)[:-1]])  # each document's first token

    def tokens(self) -> np.ndarray:
        """All tokens in order, as numbers (0: end, word i: i + 2)."""
        out = np.full(len(self.doc), END, np.int32)
        word = np.ones(len(out), bool)
        word[np.cumsum(self.sizes + 1) - 1] = False
        out[word] = self.stream.astype(np.int32) + FIRST
        return out


def _by(column: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows sorted by a column, those of one value at a time."""
    now, rows = None, []
    for batch in C.slices(batches):
        for row in batch.to_pylist():
            if rows and row[column] != now:
                yield now, rows
                rows = []
            now = row[column]
            rows.append(row)
    if rows:
        yield now, rows


def _wide(x: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where they fit."""
    return x.astype(np.uint32 if not len(x) or x.max() < 1 << 32 else np.uint64)


@C.tidy
def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks within the shard and counts for its words, block by block."""
    for shard, rows in _by("shard", batches):
        keys, checks, counts = ([unpack(r[c]) for r in rows] for c in ("keys", "checks", "counts"))
        words, _, back = distinct_words(np.concatenate(keys).astype(np.uint64), np.concatenate(checks).astype(np.uint64))
        total = np.bincount(back, weights=np.concatenate(counts).astype(np.float64), minlength=len(words)).astype(np.uint64)
        at = 0
        for r, k in zip(rows, keys, strict=True):
            rank = back[at : at + len(k)]
            at += len(k)
            yield _batch([(shard, 1, r["block"], len(words), int((total > 0).sum()), int(total.sum()), r["learnt"], r["path"], pack(rank.astype(np.uint64)), pack(_wide(total[rank])), None, None, None, None, None)], ANSWERS)


class Model:
    """What all tasks know: the shards' first ids, and the training counts in all."""

    def __init__(self, offset: np.ndarray, shards: int, tokens: int, seen: int, documents: int) -> None:
        self.offset, self.shards, self.documents = offset, shards, documents
        self.total = tokens + documents
        self.unit = self.total + 0.5 * (seen + (documents > 0) + 1)

    def p1(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.5) / self.unit

    def parts(self, count: np.ndarray) -> np.ndarray:
        """Over how many shards a context of that count goes."""
        return np.clip(np.ceil(count * (SPREAD * self.shards / max(1, self.total))), 1, self.shards).astype(np.int64)

    def home(self, ids: np.ndarray) -> np.ndarray:
        return _shards_of(C.mix64(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), self.shards)


class Asked:
    """A block's distinct n-grams of one length, in the order of shard, context and word, as they are sent and answered.

    Contexts and words are numbers in the order of their ids.  shard, context, word, counts: of each
    entry; of_token: each token's entry (-1: none, as its context isn't in training); asked_shard,
    asked_context, lengths: which shard is asked about which context, and with how many entries.
    """

    def __init__(self, context: np.ndarray, context_id: np.ndarray, context_count: np.ndarray, word: np.ndarray, word_id: np.ndarray, learnt: np.ndarray, model: Model) -> None:
        contexts, words = max(1, len(context_id)), len(word_id)
        asking = np.flatnonzero(context >= 0)
        c, w = context[asking].astype(np.int64), word[asking]
        used = np.zeros(len(context_id), bool)
        used[c] = True
        used = np.flatnonzero(used)
        parts, home = model.parts(context_count), model.home(context_id)
        wide = np.flatnonzero((parts > 1)[c]) if (parts[used] > 1).any() else used[:0]
        if model.shards * contexts * words < 1 << 63:
            # (shard, context, word) as one number
            first = (home * contexts + np.arange(len(home))) * words
            whole = first[c]
            whole += w
            if len(wide):
                at = (home[c[wide]] + word_id[w[wide]] % parts[c[wide]]) % model.shards
                whole[wide] = (at * contexts + c[wide]) * words + w[wide]
            entries, back = np.unique(whole, return_inverse=True)
            del whole
            rest = entries // words
            self.word = entries - rest * words
            self.shard = rest // contexts
            self.context = rest - self.shard * contexts
        else:  # a block of very many words: the same order by three keys
            at = home[c]
            at[wide] = (at[wide] + word_id[w[wide]] % parts[c[wide]]) % model.shards
            order = np.lexsort((w, c, at))
            x, y, z = at[order], c[order], w[order]
            new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])])
            back = np.empty(len(order), np.int64)
            back[order] = np.cumsum(new) - 1
            self.shard, self.context, self.word = x[new], y[new], z[new]
        self.counts = np.bincount(back[learnt[asking]], minlength=len(self.word)).astype(np.uint32)
        self.of_token = np.full(len(context), -1, np.int32)
        self.of_token[asking] = back
        more = np.repeat(used, parts[used])
        turn = np.arange(len(more)) - np.repeat(np.cumsum(parts[used]) - parts[used], parts[used])
        place = (home[more] + turn) % model.shards if len(more) else more
        order = np.lexsort((more, place))
        self.asked_shard, self.asked_context = place[order], more[order]
        asked = self.asked_shard * contexts + self.asked_context
        held = self.shard * contexts + self.context  # sorted
        edge = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else np.zeros(0, np.int64)
        self.lengths = np.zeros(len(asked), np.int64)
        self.lengths[np.searchsorted(asked, held[edge])] = np.diff(np.append(edge, len(held)))
        self.word_id, self.context_id, self.total = word_id, context_id, context_count

    def rows(self, block: int) -> Iterator[tuple]:
        ends = np.concatenate([[0], np.cumsum(self.lengths)])
        for s, a, b in _runs(self.asked_shard):
            x, y, of = ends[a], ends[b], self.asked_context[a:b]
            yield s, block, pack(self.context_id[of].astype(np.uint64)), pack(self.lengths[a:b].astype(np.uint32)), pack_ids(self.word_id[self.word[x:y]]), pack(self.counts[x:y]), pack(_wide(self.total[of]))


class Walk:
    """A block's tokens with what is known of them after some levels: probability, and context of the next level."""

    def __init__(self, rows: list[dict], model: Model) -> None:
        words = sorted((r for r in rows if r["level"] == 1), key=lambda r: r["shard"])
        self.rows, self.model, self.block = rows, model, Block(words[0]["path"])
        ids = [unpack(r["a"]).astype(np.int64) + model.offset[r["shard"]] + FIRST for r in words]
        counts = [unpack(r["b"]).astype(np.int64) for r in words]
        self.word_id, self.count = np.concatenate([[END, BEGIN], *ids]), np.concatenate([[model.documents] * 2, *counts])
        self.word = self.block.tokens()
        self.learnt = ~self.block.held[self.block.doc]
        self.context = np.concatenate([np.full(1, BEGIN, np.int32), self.word[:-1]])
        self.context[self.block.first] = BEGIN
        self.context[self.count[self.context] == 0] = -1
        self.context_id, self.context_count = self.word_id, self.count
        self.p = np.zeros(0)

    def ask(self) -> Asked:
        return Asked(self.context, self.context_id, self.context_count, self.word, self.word_id, self.learnt, self.model)

    def take(self, level: int) -> None:
        """Goes on by the shards' answers of one level."""
        asked = self.ask()
        answers = sorted((r for r in self.rows if r["level"] == level), key=lambda r: r["shard"])
        part = np.zeros(len(asked.word))
        # a context's weight is the sum over its shards; one that none of them knows has all its weight on shorter ones
        of_context = np.zeros(len(self.context_id))
        unigram = np.zeros(len(self.context_id))
        entry = at = 0
        for r in answers:
            code, weight = unpack(r["a"]), unpack(r["b"])
            books = np.frombuffer(r["books"], "<f4").reshape(-1, 256)
            book = np.concatenate([np.zeros((len(books), 1)), 10.0**books], axis=1)  # code 0: nothing
            part[entry : entry + len(code)] = book[0][code]
            of = asked.asked_context[at : at + len(weight)]
            of_context[of] += book[1][weight]
            if level == 2:
                unigram[of] = np.maximum(unigram[of], book[2][unpack(r["e"])])
            entry, at = entry + len(code), at + len(weight)
        if level == 2:
            p1 = self.model.p1(np.where(np.arange(len(self.count)) == END, self.count, 0).astype(np.float64))
            told = unigram > 0
            told[[END, BEGIN]] = False
            p1[told] = unigram[told]
            self.p = p1[self.word]
        of_context[of_context == 0] = 1.0
        some = np.flatnonzero(asked.of_token >= 0)
        entries = asked.of_token[some]
        self.p[some] = part[entries] + of_context[asked.context][entries] * self.p[some]
        if any(r["c"] for r in answers):
            leaf, count = np.full(len(asked.word), -1, np.int64), np.zeros(len(asked.word), np.int64)
            entry = 0
            for r in answers:
                code = unpack(r["a"])
                held = entry + np.flatnonzero(code)
                leaf[held], count[held] = unpack(r["c"]).astype(np.int64), unpack(r["d"]).astype(np.int64)
                entry += len(code)
            self.context = np.concatenate([np.full(1, -1, np.int32), asked.of_token[:-1]])
            self.context[self.block.first] = -1
            known = np.flatnonzero(self.context >= 0)
            self.context[known[leaf[self.context[known]] < 0]] = -1
            self.context_id, self.context_count = (asked.shard << LEAF_BITS) | np.maximum(leaf, 0), count


def shard_trie(contexts: np.ndarray, totals: np.ndarray, keys: np.ndarray, counts: np.ndarray, discount: float, unit: float | None) -> Trie:
    """Trie of a shard's training n-grams.

    contexts: ids, sorted, and how often each occurs in training; keys: (number of the context, id of
    the word), sorted, with their counts.  The upper level has log10 of the weight that a context's
    n-grams here leave to shorter ones (and of its unigram's probability, where ``unit`` is given),
    the lower one log10 of the discounted parts.
    """
    seen = counts > 0
    keys, counts = keys[seen], counts[seen].astype(np.float64)
    held, first, back = np.unique(keys >> np.uint64(WORD_BITS), return_index=True, return_inverse=True)
    held = held.astype(np.int64)
    total = np.maximum(totals[held], 1).astype(np.float64)
    follow = np.diff(np.append(first, len(keys)))
    upper = [np.log10(discount * follow / total)]
    if unit is not None:
        upper.append(np.log10((totals[held] + 0.5) / unit))
    part = np.log10(np.maximum(counts - discount, 1e-9) / total[back])
    return Trie.build([(np.zeros(len(held), np.int64), contexts[held], *upper), (back, keys & np.uint64((1 << WORD_BITS) - 1), part)])


def _answer(level: int, last: bool, discount: float, unit: float, keep: bool):
    """Answers to all blocks that ask a shard; and, to be kept, the shard's trie."""

    @C.tidy
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by("shard", batches):
            yield from answers(shard, rows)
            C.release()

    def answers(shard: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        asked = [unpack(r["contexts"]).astype(np.uint64) for r in rows]
        contexts, place = np.unique(np.concatenate(asked), return_inverse=True)
        totals = np.zeros(len(contexts), np.int64)
        totals[place] = np.concatenate([unpack(r["totals"]) for r in rows])  # every block says the same
        lengths = np.concatenate([unpack(r["lengths"]) for r in rows]).astype(np.int64)
        keys = (np.repeat(place.astype(np.uint64), lengths) << np.uint64(WORD_BITS)) | np.concatenate([unpack_ids(r["words"]) for r in rows])
        counts = np.concatenate([unpack(r["counts"]) for r in rows]).astype(np.float64)
        of_row = np.concatenate([[0], np.cumsum([len(a) for a in asked])])
        of_entry = np.concatenate([[0], np.cumsum(lengths)])[of_row]
        numbers = [r["block"] for r in rows]
        rows.clear()
        del asked, lengths
        keys, back = np.unique(keys, return_inverse=True)
        counts = np.bincount(back, weights=counts, minlength=len(keys))
        built = shard_trie(contexts, totals, keys, counts, discount, unit if level == 2 else None).packed()
        if keep:
            yield _batch([(shard, level, *[None] * 12, built)], ANSWERS)
        with MappedTrie(built) as trie:
            node = trie.find(0, np.zeros(len(contexts), np.int64), contexts)
            leaf = trie.find(1, node[(keys >> np.uint64(WORD_BITS)).astype(np.int64)], keys & np.uint64((1 << WORD_BITS) - 1))
            code, weight = trie.codes(1, leaf), trie.codes(0, node)
            unigram = trie.codes(0, node, 1) if level == 2 else None
            books = np.concatenate([trie.books[1], trie.books[0]]).astype("<f4").tobytes()
        for block, a, b, x, y in zip(numbers, of_row[:-1], of_row[1:], of_entry[:-1], of_entry[1:], strict=True):
            entries, mine = back[x:y], place[a:b]
            held = entries[leaf[entries] >= 0]
            more = (None, None) if last else (pack(leaf[held].astype(np.uint64)), pack(_wide(counts[held])))
            yield _batch([(shard, level, block, *[None] * 5, pack(code[entries]), pack(weight[mine]), *more, pack(unigram[mine]) if level == 2 else None, books, None)], ANSWERS)

    return task


def _ask(level: int, model):
    @C.tidy
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _by("block", batches):
            walk = Walk(rows, model.value)
            for done in range(2, level):
                walk.take(done)
            for row in walk.ask().rows(block):
                yield _batch([row], ASKED)

    return task


def _score(order: int, model):
    @C.tidy
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by("block", batches):
            walk = Walk(rows, model.value)
            for level in range(2, order + 1):
                walk.take(level)
            block, count = walk.block, walk.count[walk.word].astype(np.float64)
            p1 = model.value.p1(count)
            p = walk.p if len(walk.p) else p1
            n = len(block.sizes)
            sums = [np.bincount(block.doc, weights=x, minlength=n) for x in (np.log10(p1), np.log10(np.minimum(p, 1.0)), (count > 0).astype(np.float64))]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(block.ids, pa.int64()), "held_out": pa.array(block.held), "n_tokens": pa.array(block.sizes + 1), "n_known": pa.array(sums[2].astype(np.int64)), "train_tokens": pa.array(np.full(n, model.value.total), pa.int64()), "base_score": pa.array(sums[0]), "score": pa.array(sums[1])})

    return task


def score_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", fold: int = FOLD, held: int = HELD, order: int = ORDER, discount: float = DISCOUNT, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, tries: str | None = None) -> DataFrame:
    """Learns from the documents outside the held-out fold, scores all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    tries: where to write the shards' tries as a Parquet table (level, shard, trie), if they are wanted.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    own = C.Kept(docs, "unused int")
    text_of_id = F.coalesce(own.column(doc_id).cast("string"), F.lit(""))
    marked = own.df.select(own.column(doc_id).cast("long").alias("doc_id"), own.column(text).alias("text"), (F.crc32(text_of_id.cast("binary")) % fold == held).alias("held"))
    size = marked.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    shards = max(1, min(math.ceil(size / (shard_tokens * TOKEN_BYTES)), MOST_SHARDS))
    dealt = lambda rows: rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "block")
    folder = C.own_folder(spark, "lm-blocks")
    found = C.cut(dealt(marked.mapInArrow(_write_blocks(folder, block_tokens, shards), _ddl(WORDS))).mapInArrow(_count_words, _ddl(ANSWERS)), large=True)
    stats = found.groupBy("shard").agg(*(F.first(c).alias(c) for c in ("distinct", "seen", "tokens")), F.sum("learnt").alias("learnt")).toArrow()  # a row for each shard, at most MOST_SHARDS
    sizes = np.zeros(shards, np.int64)
    sizes[stats.column("shard").to_numpy()] = stats.column("distinct").to_numpy()
    if int(sizes.sum()) + FIRST >= 1 << WORD_BITS:
        raise ValueError("more words than ids")
    tokens, seen, learnt = (int(stats.column(c).to_numpy().sum()) for c in ("tokens", "seen", "learnt"))
    model = spark.sparkContext.broadcast(Model(np.cumsum(sizes) - sizes, shards, tokens, seen, learnt))
    # blocks are numbered within the partitions they were made in: laid out so, two have a task
    most = F.max(F.col("block").bitwiseAND((1 << 24) - 1)), F.max(F.shiftright("block", 24))
    read = found.agg(F.countDistinct("block").alias("n"), *(F.coalesce(m, F.lit(0)).alias(c) for m, c in zip(most, ("each", "parts"), strict=True))).first()
    each, blocks = read["each"] + 1, (read["each"] + 1) * (read["parts"] + 1)
    place = ((F.shiftright("block", 24) * each + F.col("block").bitwiseAND((1 << 24) - 1)) / 2).cast("int")
    even = blocks <= 2 * read["n"] + 8
    by_block = lambda rows: (rows.where("block is not null").repartitionById(blocks // 2 + 1, place) if even else rows.where("block is not null").repartition(max(1, read["n"]), "block")).sortWithinPartitions("block", "level", "shard")
    for level in range(2, order + 1):
        # no name for what lies between, so that its shuffle files go when the answers are there
        found = found.unionByName(C.cut(dealt(by_block(found.drop("trie")).mapInArrow(_ask(level, model), _ddl(ASKED))).mapInArrow(_answer(level, level == order, discount, model.value.unit, tries is not None), _ddl(ANSWERS)), large=True))
    if tries is not None:
        found.where("trie is not null").select("level", "shard", "trie").write.parquet(tries)
    return by_block(found.drop("trie")).mapInArrow(_score(order, model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(log10_sum: float, tokens: int) -> float:
    return math.pow(10, -log10_sum / tokens)
