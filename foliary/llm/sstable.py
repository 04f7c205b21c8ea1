"""Token ids in sorted-string tables.

Each shard file holds documents in the order of their key (the id, as nine bytes that sort as ids
do, nulls first), in blocks.  Within a block a key is stored as the length it shares with the one
before it and the rest; a block is compressed as a whole.  After the blocks come a sparse index
(first key and place of each block), a Bloom filter of all keys, and a footer that tells where
those are.  A lookup asks the filter, finds the block by binary search in the index, and reads
one block.

Documents are encoded where they lie, dealt out once by ranges of the key, sorted and written.  The
ranges hold about equal bytes (histogram sort's cuts), and a file is one task;
a file is written under a name of the attempt's own and then moved, so a task that is run again
after a lost executor leaves one whole file.  Files lie in a folder all executors see.

Defined results: a null text is an empty one and has the end id alone; rows with one id are all
kept, next to each other, in the order of a hash of their texts (equal rows lie in one file); null
ids come first; a very long text makes its file as large as it is; an empty table gives no file;
columns beside id and text play no part, whatever their names.
"""

from __future__ import annotations

import json
import math
import os
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm import common as C
from foliary.llm.sharding import as_keys, row_keys, splitters

MAGIC = b"FOLISST1"
BLOCK_BYTES = 64 << 10
SHARD_BYTES = 64 << 20
BITS_PER_KEY, PROBES = 10, 7
END_ID = 1
MOST_SHARDS = 1 << 16
PLAIN = np.uint64(0xD1342543DE82EF95)


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" * 9 if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key[:1] == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(k.ljust(16, b"\0")[:16] for k in keys), np.uint64).reshape(-1, 2)
    with np.errstate(over="ignore"):
        h = C.mix64(raw[:, 0] + C.mix64(raw[:, 1]))
        g = C.mix64(h + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        return (h[:, None] + g[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)


class Writer:
    """One shard file; entries must come in key order."""

    def __init__(self, out, width: int) -> None:
        self.out, self.width, self.at = out, width, 0
        self.block, self.block_size, self.last, self.first = [], 0, b"", b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.ids = 0
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, value: bytes) -> None:
        if key < self.last:
            raise ValueError("keys out of order")
        if not self.block:
            self.first, self.last = key, b""
        shared = len(os.path.commonprefix([key, self.last]))
        entry = struct.pack("<BBI", shared, len(key) - shared, len(value)) + key[shared:] + value
        self.block.append(entry)
        self.block_size += len(entry)
        self.last = key
        self.keys.append(key)
        self.ids += len(value) // self.width
        if self.block_size >= BLOCK_BYTES:
            self._flush()

    def _write(self, data: bytes) -> tuple[int, int]:
        place = (self.at, len(data))
        self.out.write(data)
        self.at += len(data)
        return place

    def _flush(self) -> None:
        if self.block:
            self.index.append((self.first, *self._write(self.pack.compress(b"".join(self.block)))))
            self.block, self.block_size = [], 0

    def close(self) -> None:
        self._flush()
        index = self._write(b"".join(struct.pack("<B", len(k)) + k + struct.pack("<QQ", a, n) for k, a, n in self.index))
        bits = max(64, len(self.keys) * BITS_PER_KEY)
        sieve = np.zeros(bits, bool)
        if self.keys:
            sieve[_probes(self.keys, bits).ravel().astype(np.int64)] = True
        bloom = self._write(np.packbits(sieve).tobytes())
        footer = json.dumps({"index": index, "bloom": bloom, "bits": bits, "width": self.width, "docs": len(self.keys), "ids": self.ids}).encode()
        self.out.write(footer + struct.pack("<I", len(footer)) + MAGIC)
        self.out.close()


class Reader:
    """Scans or looks up one shard file."""

    def __init__(self, uri: str) -> None:
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"{uri} is no whole shard")
        n = struct.unpack("<I", tail[:4])[0]
        self.footer = json.loads(self.file.read_at(n, size - 12 - n))
        self.type = {2: np.dtype("<u2"), 4: np.dtype("<u4")}[self.footer["width"]]
        a, n = self.footer["index"]
        raw, at, self.index = self.file.read_at(n, a), 0, []
        while at < len(raw):
            k = raw[at]
            self.index.append((raw[at + 1 : at + 1 + k], *struct.unpack_from("<QQ", raw, at + 1 + k)))
            at += 17 + k
        self.unpack = zstandard.ZstdDecompressor()

    def _block(self, n: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, a, size = self.index[n]
        raw, at, last = self.unpack.decompress(self.file.read_at(size, a)), 0, b""
        while at < len(raw):
            shared, rest, length = struct.unpack_from("<BBI", raw, at)
            at += 6
            last = last[:shared] + raw[at : at + rest]
            yield last, np.frombuffer(raw, self.type, length // self.type.itemsize, at + rest)
            at += rest + length

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for n in range(len(self.index)):
            yield from self._block(n)

    def may_hold(self, key: bytes) -> bool:
        a, n = self.footer["bloom"]
        sieve = np.unpackbits(np.frombuffer(self.file.read_at(n, a), np.uint8))
        return bool(sieve[_probes([key], self.footer["bits"])[0].astype(np.int64)].all())

    def get(self, key: bytes) -> list[np.ndarray]:
        """All values under the key."""
        if not self.index or not self.may_hold(key):
            return []
        # a run of one key may begin in the block before the first that begins with it
        n = max(0, bisect_right([k for k, *_ in self.index], key) - 1)
        while n > 0 and self.index[n][0] == key:
            n -= 1
        out = []
        while n < len(self.index) and self.index[n][0] <= key:
            out += [v for k, v in self._block(n) if k == key]
            n += 1
        return out

    def close(self) -> None:
        self.file.close()


class Matches(C.PieceMemory):
    """Ids of pieces by the tokenizer itself.

    Many pieces go to it as one text, with a mark between them that has one id of its own; a piece
    that holds the mark goes alone.
    """

    MARK = "\x01"
    JOINT = 256

    def __init__(self, spec: str, limit: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        mark = self.ids(self.MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        super().__init__(limit)

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def coded(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        joint = [p for p in pieces if self.mark is not None and self.MARK not in p]
        alone = [p for p in pieces if self.mark is None or self.MARK in p]
        texts = [f" {self.MARK} ".join(joint[i : i + self.JOINT]) + f" {self.MARK}" for i in range(0, len(joint), self.JOINT)]
        parts = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate([*parts, np.zeros(0, np.uint32)])
        marks = np.flatnonzero(ids == self.mark) if joint else np.zeros(0, np.int64)
        lengths = np.diff(marks, prepend=-1) - 1
        if len(lengths) != len(joint):
            raise ValueError("the tokenizer gives the mark's id to other text")
        single = [np.array(self.ids(x), np.uint32) for x in alone]
        return joint + alone, np.concatenate([ids[ids != self.mark] if joint else ids, *single]), np.concatenate([lengths, np.array([len(x) for x in single], np.int64)])


class WordCoder(C.PieceMemory):
    """Ids of pieces between ASCII white space, by a tokenizer that drops white space.

    No match of such a tokenizer's pattern reaches over white space, so a text's ids are those of its
    pieces in turn.  A piece of Latin letters, signs and digits is the pattern's matches in it, in
    small letters; each distinct match, and each other piece, goes to the tokenizer once.
    Pieces are known by two 64-bit hashes; ASCII capitals count as small letters (the tokenizer
    lowers them), but not in texts with combining marks, where lowering first could compose other
    letters.  Texts in which two pieces share one hash but not the other go to the tokenizer whole.
    """

    def __init__(self, spec: str, limit: int = 1_000_000, matches: int = 300_000) -> None:
        self.matches = Matches(spec, matches)
        self.lowered, self.plain = C.spaces_scanner(), C.spaces_scanner(lowered=False)
        if self.matches.ids("A b") != self.matches.ids("a b"):
            self.lowered = self.plain
        self.split = self._pattern(json.loads(spec)) if self.lowered is not self.plain else None
        super().__init__(limit)

    @staticmethod
    def _pattern(spec: dict):
        """The pattern whose matches are encoded one by one, where the tokenizer is of that kind."""
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if len(steps) == 2 and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and "Regex" in steps[0]["pattern"]:
            return regex.compile(steps[0]["pattern"]["Regex"])
        return None

    def forget(self) -> None:
        super().forget()
        self.hashes, self.checks, self.codes = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)  # known pieces, sorted by hash

    def split_and_code(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' ids end to end, and how many each has."""
        find = self.split.findall if self.split else None
        each = [find(p.lower()) if find and (p.isascii() or max(p) < "\u0250") else [p] for p in pieces]
        codes = self.matches.codes_of([m for x in each for m in x])
        ids, bound = self.matches.flat_ids(codes, np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64))
        return ids, np.diff(bound)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text (UTF-8)."""
        raw, at = C.joined(texts)
        marks = bool(((raw == 0xCC) | (raw == 0xCD)).any())
        scanner = self.plain if marks else self.lowered
        starts, ends, hashes = scanner.scan(raw)
        checks = scanner.check(raw, starts, ends)
        if scanner is self.plain and self.lowered is not self.plain:
            hashes, checks = C.mix64(hashes ^ PLAIN), C.mix64(checks ^ PLAIN)  # capitals told apart: names of their own
        of_text = np.searchsorted(starts, at)
        names, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(names) + self.count > self.limit and self.count:
            self.forget()
        place = np.searchsorted(self.hashes, names)
        known = place < len(self.hashes)
        known[known] = self.hashes[place[known]] == names[known]
        codes = np.full(len(names), -1, np.int64)
        codes[known] = self.codes[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            data = scanner.lower[raw].tobytes()
            pieces = [data[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            codes[new] = self.append(*self.split_and_code(pieces)) + np.arange(len(new))
            both = np.concatenate([self.hashes, names[new]])
            order = np.argsort(both, kind="stable")  # two sorted runs: one merge
            self.hashes, self.checks, self.codes = both[order], np.concatenate([self.checks, checks[first[new]]])[order], np.concatenate([self.codes, codes[new]])[order]
        out = self.laid(codes[back], of_text)
        wrong = np.flatnonzero(self.checks[np.searchsorted(self.hashes, names)][back] != checks)
        for t in np.unique(np.searchsorted(of_text, wrong, "right") - 1).tolist():
            out[t] = np.array(self.matches.ids(texts[t].decode()), np.uint32)
        return out


_CODERS: dict[int, WordCoder] = {}


def _coder(spec: str) -> WordCoder:
    key = zlib.crc32(spec.encode())
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = WordCoder(spec)
    return _CODERS[key]


def write_tables(docs: DataFrame, tokenizer_path: str, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes all documents' ids (each with the end id behind) to shards in ascending order of ``doc_id``.

    Returns one row per shard: shard, path, docs, ids, in a table of the shared folder.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    folder = folder or C.own_folder(spark, "sstables")
    with open(tokenizer_path) as f:
        spec = f.read()
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_str(spec).get_vocab_size() <= 1 << 16 else 4
    # narrow rows: the id orders, a hash of the text where one id has several, and the bytes to be dealt out evenly
    marks = {"h": F.coalesce(F.col("id"), F.lit(-(1 << 63))), "d": F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), "r": F.lit(0).cast("long")}
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    own = C.Kept(docs, "unused int")
    given = own.df.select(own.column(doc_id).cast("long").alias("id"), own.column(text).alias("text"))
    keyed = C.stored(given.select(*(v.alias(k) for k, v in marks.items()), size.alias("size")), "keys")
    total = keyed.agg(F.sum("size").alias("size")).first()["size"] or 0
    shards = max(1, min(math.ceil(total / shard_bytes), MOST_SHARDS))
    cuts = as_keys(splitters(keyed, total, shards, 0.25 * total / shards) if shards > 1 else [])
    spec_shared = spark.sparkContext.broadcast(spec)
    wide = np.uint16 if width == 2 else np.uint32
    bounds = spark.sparkContext.broadcast(cuts)

    @C.tidy
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(spec_shared.value)
        for batch in C.slices(batches):
            texts = C.texts_of(batch, "text")
            for a, b in C.sub_batches(texts, 4 << 20):
                part = batch.slice(a, b - a)
                shard = np.searchsorted(bounds.value, row_keys(part), "right").astype(np.int32)
                values = [np.append(x, np.uint32(end_id)).astype(wide).tobytes() for x in coder.encode(texts[a:b])]
                yield pa.RecordBatch.from_pydict({"shard": pa.array(shard), "id": part.column(0), "d": part.column(part.schema.get_field_index("d")), "value": pa.array(values, pa.binary())})

    @C.tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        writer, now, temp, done = None, None, "", []

        def close() -> None:
            final = f"{root}/shard-{now:06d}.sst"
            writer.close()
            fs.move(temp, final)
            done.append((now, f"{folder}/shard-{now:06d}.sst", len(writer.keys), writer.ids))

        for batch in C.slices(batches):
            for shard, doc, value in zip(*(batch.column(c).to_pylist() for c in ("shard", "id", "value")), strict=True):
                if shard != now:
                    if writer:
                        close()
                    fs.create_dir(root, recursive=True)
                    temp = f"{root}/part-{uuid.uuid4().hex}.tmp"
                    writer, now = Writer(fs.open_output_stream(temp), width), shard
                writer.add(key_of(doc), value)
        if writer:
            close()
        names = ["shard", "path", "docs", "ids"]
        types = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names)

    coded = given.select("id", "text", *(v.alias(k) for k, v in marks.items())).mapInArrow(encode, "shard int, id long, d long, value binary")
    dealt = coded.repartitionById(shards, "shard").sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "d", "value")
    return C.cut(dealt.mapInArrow(write, "shard int, path string, docs long, ids long"))


def read_tables(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Documents of all shards, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    rows = manifest.select("shard", "path", "ids").collect()  # a row for each file, at most MOST_SHARDS
    start, placed = 0, []
    for r in sorted(rows, key=lambda r: r["shard"]):
        placed.append((r["path"], start))
        start += r["ids"]
    if not placed:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    @C.tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in C.slices(batches):
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader, rows = Reader(path), []
                for key, ids in reader.scan():
                    rows.append((id_of(key), at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names)
                        rows = []
                reader.close()
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names)

    files = spark.createDataFrame(placed, "path string, at long").repartition(len(placed))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
