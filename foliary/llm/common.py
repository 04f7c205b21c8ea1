"""What the operators of this folder share: shared-folder handling and vectorised text scanning.

Texts reach Python as Arrow batches.  They are laid end to end in one byte buffer with 0xFF
between documents (a byte UTF-8 never holds), and everything after that is numpy on whole
buffers; only rare matches are looked at one by one.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SEPARATOR = 0xFF
SUB_BATCH_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_ROWS = "1000"
MANY, MOST_HOT = 1024, 1 << 15


def prepare(spark: SparkSession) -> None:
    """Lets Arrow batches between the JVM and Python hold fewer rows than Spark's default.

    Texts are long, and both sides hold a batch in memory for each running task; a session that
    sets a size of its own keeps it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor and the driver see, as the session names it.

    ``spark.checkpoint.dir`` decides; only where it is unset on one machine (as in tests) a
    temporary folder is made and set for the session.  On a cluster that would be a folder which no
    other machine sees, so there it has to be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="foliary-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def own_folder(spark: SparkSession, name: str) -> str:
    """A fresh path for one run below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, large: bool = False) -> DataFrame:
    """Cuts lineage through the shared folder, so that a lost executor costs no recomputation.

    What lies before the cut isn't needed any more; Spark drops its shuffle files once the driver
    has collected the objects that stand for them, which is asked for here.  The last job's own are
    held until another has run: where they are ``large``, a tiny one does.
    """
    spark = df.sparkSession
    prepare(spark)
    shared_folder(spark)
    out = df.checkpoint(eager=True)
    del df
    if large:
        spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of what has been written, see ``cut``."""
    spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, size: str, rows: int) -> DataFrame:
    """left and right on ``key``, where right has one row a key, with the number (``size``) of its rows in left.

    Keys of very many rows are spread over several tasks by a hash of ``by``.  As left has about
    ``rows`` rows, no more than MOST_HOT keys can be that large: that many are broadcast at most.
    """
    limit = max(MANY, rows // MOST_HOT)
    parts = F.ceil(F.col(size) / limit).cast("int")
    hot = right.where(F.col(size) > limit).select(key, parts.alias("parts"))
    spread = left.join(F.broadcast(hot), key, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(by), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    copied = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(parts - 1, F.lit(0)))))
    return spread.join(copied, [key, "part"]).drop("part")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: fixed for all that read them, column by column."""
    path = own_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str | Column, mod: int) -> Column:
    """True where crc32(doc_id as text) mod ``mod`` is 1; a null id counts as empty text."""
    text = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % mod == 1


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes per row; null is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    return col.cast(pa.string()).cast(pa.binary()).fill_null(b"").to_pylist()


def release() -> None:
    """Gives memory that a task has freed back to the system; a worker lives on for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library that has no such call
        pass


def tidy(task):
    """A task over batches that releases memory when it ends."""

    @functools.wraps(task)
    def run(*args):
        try:
            yield from task(*args)
        finally:
            release()

    return run


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, so that a task holds few texts as Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def sub_batches(texts: list[bytes], limit: int = SUB_BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, each of one row at least; texts are never cut."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole 64-bit word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


KEEP = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


class WordScanner:
    """Finds words (runs of bytes of a class) and their 64-bit hashes in a whole buffer.

    A word's hash is a sum over its 8-byte parts, each mixed with its number first, so no
    arrangement of equal parts cancels out; ``check`` gives a second one, made with other constants.
    Where identity of words decides a result, both have to agree (128 bits) or bytes are compared.
    ASCII capitals count as small letters, unless ``lowered`` is false.
    """

    FIRST = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407)
    SECOND = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)

    def __init__(self, word_byte: np.ndarray, lowered: bool = True) -> None:
        lower = np.arange(256, dtype=np.uint8)
        if lowered:
            lower[65:91] += 32
        self.lower = lower
        self.is_word = word_byte[lower] & (np.arange(256) != SEPARATOR)

    def bounds(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.zeros(len(raw) + 2, np.int8)
        mask[1:-1] = self.is_word[raw]
        edge = np.diff(mask)
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def _parts(self, raw: np.ndarray) -> np.ndarray:
        """The eight bytes from each place of the buffer on, in small letters."""
        low = np.zeros(len(raw) + 8, np.uint8)
        np.take(self.lower, raw, out=low[: len(raw)])
        return np.ndarray((len(raw) + 1,), "<u8", buffer=low, strides=(1,))

    @staticmethod
    def _mixed(parts: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: tuple[int, int, int]) -> np.ndarray:
        one, step, size = (np.uint64(k) for k in keys)
        length = ends - starts
        with np.errstate(over="ignore"):
            out = mix64((parts[starts] & KEEP[np.minimum(length, 8)]) ^ one)
            long = np.flatnonzero(length > 8)
            if len(long):
                more = (length[long] - 1) // 8  # parts beyond the first
                turn = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1
                at = np.repeat(starts[long], more) + 8 * turn
                rest = np.minimum(np.repeat(ends[long], more) - at, 8)
                each = mix64(mix64((parts[at] & KEEP[rest]) ^ one) + turn.astype(np.uint64) * step)
                run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
                edge = np.concatenate([[0], np.cumsum(more)])
                out[long] += run[edge[1:]] - run[edge[:-1]]
            return mix64(out + length.astype(np.uint64) * size)

    def scan(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends (exclusive) and hashes of all words."""
        starts, ends = self.bounds(raw)
        return starts, ends, self._mixed(self._parts(raw), starts, ends, self.FIRST)

    def check(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The words' second hashes."""
        return self._mixed(self._parts(raw), starts, ends, self.SECOND)


def spaces_scanner(lowered: bool = True) -> WordScanner:
    """Words ``[^\\x20\\x09-\\x0D]+``."""
    word = np.ones(256, bool)
    word[[0x20, 9, 10, 11, 12, 13]] = False
    return WordScanner(word, lowered)


def letters_scanner() -> WordScanner:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``: digits, small letters and all beyond ASCII."""
    word = np.zeros(256, bool)
    word[0x30:0x3A] = word[0x61:0x7B] = True
    word[0x80:] = True
    return WordScanner(word)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with separators, and each text's start in it (one more: the end)."""
    raw = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return raw, np.concatenate([[0], np.cumsum(sizes + 1)])


GRAM = np.uint64(0xC2B2AE3D27D4EB4F)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words (len - k + 1 of them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[:n].copy()
        for j in range(1, k):
            out = out * GRAM + words[j : j + n]
        return mix64(out + np.uint64(k))


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def passed_on(batch: pa.RecordBatch, columns: list[str]) -> dict[str, pa.Array]:
    return {c: batch.column(batch.schema.get_field_index(c)) for c in columns}


class Kept:
    """Columns of a table that go through an operator beside its results.

    Inside, all columns have names of their own (c0, c1, ...), so that whatever a caller's columns
    are called (dots, reserved names, one name twice) none is lost or confused.  Only a column that
    is called like a result, in any case, is left out.
    """

    def __init__(self, df: DataFrame, results: str, keep: list[str] | None = None) -> None:
        """results: their names and types, as DDL; keep: names of columns (default: all)."""
        self.given = df.columns
        self.results = StructType.fromDDL(results)
        taken = {f.name.lower() for f in self.results}
        places = range(len(self.given)) if keep is None else [self.place(c) for c in keep]
        self.places = [i for i in places if self.given[i].lower() not in taken]
        self.df = df.toDF(*(f"c{i}" for i in range(len(self.given))))
        self.columns = [f"c{i}" for i in self.places]
        self.schema = StructType([*(self.df.schema[c] for c in self.columns), *self.results])

    def place(self, name: str) -> int:
        """The column of just that name, or else of that name in another case."""
        if name in self.given:
            return self.given.index(name)
        return [c.lower() for c in self.given].index(name.lower())

    def column(self, name: str) -> Column:
        return F.col(f"c{self.place(name)}")

    def select(self, **more: Column) -> DataFrame:
        """The kept columns, and others beside them."""
        return self.df.select(*self.columns, *(v.alias(k) for k, v in more.items()))

    def named(self, out: DataFrame) -> DataFrame:
        """The kept columns and all results, under their names."""
        return out.toDF(*(self.given[i] for i in self.places), *self.results.names)

    def apply(self, task, **more: Column) -> DataFrame:
        """Runs ``task`` over batches of ``select(**more)``; it returns the kept columns and the results."""
        return self.named(self.select(**more).mapInArrow(task, self.schema))


class PieceMemory:
    """Ids of pieces of text already met, in flat arrays; emptied when it holds ``limit`` pieces.

    Pieces are known by their text, or by whatever names ``coded`` gives them.
    """

    def __init__(self, limit: int = 250_000) -> None:
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.start, self.length, self.flat = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self.count = self.used = 0

    def coded(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The pieces in an order of one's own, their ids end to end, and how many ids each has."""
        raise NotImplementedError

    def append(self, ids: np.ndarray, lengths: np.ndarray) -> int:
        """Keeps the ids of new pieces; the number of the first."""
        n = self.count
        while n + len(lengths) > len(self.start):
            self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.length[n : n + len(lengths)] = lengths
        self.start[n : n + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.flat[self.used : self.used + len(ids)] = ids
        self.count, self.used = n + len(lengths), self.used + len(ids)
        return n

    def learn(self, pieces: list[str]) -> None:
        names, ids, lengths = self.coded(pieces)
        n = self.append(ids, lengths)
        self.known.update(zip(names, range(n, n + len(lengths)), strict=True))

    def ids_of(self, each: list[list[str]]) -> list[np.ndarray]:
        """Ids of texts that are given as lists of pieces."""
        pieces = [p for x in each for p in x]
        codes = self.codes_of(pieces)
        return self.laid(codes, np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64))

    def codes_of(self, pieces: list[str]) -> np.ndarray:
        """The known pieces' numbers; new ones are learnt."""
        new = set(pieces).difference(self.known)
        if len(new) + len(self.known) > self.limit and self.known:
            self.forget()
            new = set(pieces)
        if new:
            self.learn(list(new))
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def flat_ids(self, codes: np.ndarray, of_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts end to end, and their bounds; text t has the known pieces ``codes[of_text[t] : of_text[t + 1]]``."""
        lengths = self.length[codes]
        ends = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.start[codes] - ends + lengths, lengths) + np.arange(int(lengths.sum()))]
        return ids, np.concatenate([[0], ends])[of_text]

    def laid(self, codes: np.ndarray, of_text: np.ndarray) -> list[np.ndarray]:
        ids, bound = self.flat_ids(codes, of_text)
        return [ids[a:b] for a, b in zip(bound[:-1], bound[1:], strict=True)]


def text_batches(texts: list[str], limit: int = SUB_BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` characters, each of one row at least."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)
