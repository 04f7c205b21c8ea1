"""Substring dedup: words of repeated passages go, found by matching statistics over FM-indexes of shards.

A window is ``span`` consecutive words of one document.  A window whose word sequence starts
earlier too (in a document of a smaller id, or before in the same one) is a repeat; words that
repeats cover are removed.

1. Every document is cut into segments: runs of windows that have their least k-gram hash at the
   same place.  Equal windows have the same least k-gram, so whatever may be equal has one key.
   Segments of keys that very many distinct segments share (a common line in ever new surroundings)
   are cut into single windows, whose key is a hash of the whole window.
2. Segments meet by key in one shuffle, without their words.  Of segments equal in all words the
   earliest stands for all; the others are repeats.  Copies within a batch are told before the shuffle,
   so a key has at most one of them for each batch.  A segment whose key nobody shares has no repeats.
3. The words of the rest go to shards by key.  A shard puts the segments that stand for others in an
   FM-index (``fmindex``), streams them past it by backward search, and reports the windows
   whose matching statistic reaches ``span`` and whose interval has an earlier place.
4. The reported intervals meet their documents, whose remaining words are joined.

Words are compared as bytes in a shard; two segments are equal where 128 bits of hashes over their words are.

Defined results: a null id counts as the least; rows that share an id are ordered by a hash of
their texts, and rows of one id and text are one document, each with the same answer; null or
wordless texts have no words; texts of fewer than ``span`` words lose none; texts of any length are taken
whole; an empty table gives an empty one; a column called like a result gives way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliary.llm import common as C
from foliary.llm.fmindex import FMIndex

SPAN = 20
K = 5
BLOCK_WORDS = 1 << 20
#: a key is hot from so many segments on, and of so many in all at most one is
HOT, HOT_SHARE = 4096, 1 << 20
#: segments of one key in a batch that make it a candidate for a hot one
HOT_IN_BATCH = 8
FIRST_ID = -(1 << 63)

RESULT = "n_words long, n_removed long, kept_sha256 string, kept_text string, removed array<struct<first_word:long,last_word:long>>"
SEGMENT = "key long, content long, doc long, mark long, start int, n int, copy boolean"
CUT = "doc long, mark long, start int, n int"

SCANNER = C.spaces_scanner(lowered=False)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def least_grams(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes the place of the least, the first of equal ones."""
    runs = np.lib.stride_tricks.sliding_window_view(grams, width)
    step = max(1, (1 << 22) // width)
    return np.concatenate([runs[i : i + step].argmin(1) + np.arange(i, min(i + step, len(runs))) for i in range(0, len(runs), step)])


def powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps)


class Segments:
    """The segments of some texts: arrays of text number, first word, number of windows, key and content."""

    def __init__(self, texts: list[bytes], span: int, hot: np.ndarray) -> None:
        raw, edges = C.joined(texts)
        starts, ends, words = SCANNER.scan(raw)
        text = np.searchsorted(edges, starts, side="right") - 1
        first_word = np.searchsorted(starts, edges)
        window = np.flatnonzero(text[: len(text) - span + 1] == text[span - 1 :]) if len(text) >= span else np.zeros(0, np.int64)
        if not len(window):
            self.text = self.start = self.n = np.zeros(0, np.int64)
            self.key = self.content = np.zeros(0, np.uint64)
            return
        others = SCANNER.check(raw, starts, ends)
        k = min(K, span)
        grams = C.gram_hashes(others, k)
        least = least_grams(grams, span - k + 1)[window]
        begins = np.flatnonzero(np.concatenate([[True], np.diff(least) != 0]))
        n = np.diff(np.concatenate([begins, [len(window)]]))
        at, key = window[begins], grams[least[begins]]
        if len(hot):
            cut = np.isin(key, hot)
            single = np.repeat(at[cut], n[cut]) + run_numbers(n[cut])
            whole = C.gram_hashes(others, span)
            at, n, key = np.concatenate([at[~cut], single]), np.concatenate([n[~cut], np.ones(len(single), np.int64)]), np.concatenate([key[~cut], C.mix64(whole[single])])
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(BASE, len(words)))])
            self.content = C.mix64((total[at + n + span - 1] - total[at]) * powers(BASE_INVERSE, len(words))[at] + n.astype(np.uint64))
        self.text, self.n, self.key = text[at], n, key
        self.start = at - first_word[self.text]


def run_numbers(n: np.ndarray) -> np.ndarray:
    """0 .. n[0] - 1, 0 .. n[1] - 1 and so on."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n)


def batches_of(batches: Iterator[pa.RecordBatch], span: int, hot: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, Segments]]:
    """Ids, marks and segments of about eight million bytes of texts at a time."""
    for batch in batches:
        texts = C.texts_of(batch)
        doc, mark = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("doc", "mark"))
        for a, b in C.sub_batches(texts, 8 << 20):
            yield doc[a:b], mark[a:b], Segments(texts[a:b], span, hot)


def hot_keys(docs: DataFrame, span: int, hot_from: int) -> np.ndarray:
    """Keys that many distinct segments have; HOT_SHARE of them at most."""

    @C.tidy
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = 0
        for _, _, found in batches_of(batches, span, np.zeros(0, np.uint64)):
            segments += len(found.key)
            distinct = np.unique(np.stack([found.key, found.content]), axis=1) if len(found.key) else np.zeros((2, 0), np.uint64)
            keys, n = np.unique(distinct[0], return_counts=True)
            often = n >= HOT_IN_BATCH
            yield pa.RecordBatch.from_pydict({"key": C.as_signed(keys[often]), "n": n[often]})
        yield pa.RecordBatch.from_pydict({"key": pa.array([None], pa.int64()), "n": [segments]})

    counts = docs.mapInArrow(task, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    top = counts.where((F.col("n") >= hot_from) | F.col("key").isNull()).orderBy(F.col("n").desc()).limit(HOT_SHARE + 1).toArrow()
    key, n = top.column("key"), top.column("n").to_numpy()
    total = int(n.max()) if len(n) else 0  # no key has more segments than there are
    often = (n >= max(hot_from, total // HOT_SHARE)) & key.is_valid().to_numpy(zero_copy_only=False)
    return np.sort(key.fill_null(0).to_numpy()[often].astype(np.int64).view(np.uint64))


def segments(docs: DataFrame, span: int, hot: np.ndarray) -> DataFrame:
    """SEGMENT rows of all documents; those that a batch knows to be copies say so, under keys of their own."""

    @C.tidy
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, mark, found in batches_of(batches, span, hot):
            rank = np.unique(np.stack([doc, mark]), axis=1, return_inverse=True)[1].reshape(-1)[found.text] if len(doc) else found.text
            order = np.lexsort((found.start, rank, found.content, found.key))
            key, content, rank, start = found.key[order], found.content[order], rank[order], found.start[order]
            same = np.zeros(len(order), bool)
            same[1:] = (key[1:] == key[:-1]) & (content[1:] == content[:-1])
            twin = same.copy()
            twin[1:] &= (rank[1:] == rank[:-1]) & (start[1:] == start[:-1])
            key = np.where(same, C.mix64(start.astype(np.uint64) + content), key)
            use = np.flatnonzero(~twin)
            text = found.text[order][use]
            yield pa.RecordBatch.from_pydict(
                {
                    "key": C.as_signed(key[use]),
                    "content": C.as_signed(content[use]),
                    "doc": doc[text],
                    "mark": mark[text],
                    "start": start[use].astype(np.int32),
                    "n": found.n[order][use].astype(np.int32),
                    "copy": same[use],
                }
            )

    return docs.mapInArrow(task, SEGMENT)


def met(found: DataFrame, partitions: int) -> DataFrame:
    """Segments that repeat another (``copy``) or stand for all of their content under a key with more than one segment."""
    by_key = found.repartition(partitions, "key")
    content = Window.partitionBy("key", "content").orderBy("doc", "mark", "start")
    ranked = by_key.withColumn("place", F.rank().over(content)).withColumn("row", F.row_number().over(content)).withColumn("sharing", F.count("*").over(Window.partitionBy("key")))
    later = F.col("copy") | (F.col("place") > 1)
    return ranked.where(later | ((F.col("row") == 1) & (F.col("sharing") > 1))).select("key", "doc", "mark", "start", "n", later.alias("copy"))


def with_words(docs: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """The words of the wanted segments; rows of one document that come together give them once."""
    lists = wanted.groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "n", "key")).alias("wanted"))

    @C.tidy
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in C.slices(batches, 200):
            out: dict[str, list] = {c: [] for c in ("key", "doc", "mark", "start", "n", "words")}
            for doc, mark, text, parts in zip(*(batch.column(i).to_pylist() for i in (0, 1)), C.texts_of(batch), batch.column(batch.schema.get_field_index("wanted")).to_pylist(), strict=True):
                if (doc, mark) == last:
                    continue
                last = doc, mark
                words = text.split()
                for p in parts:
                    for c, v in (("key", p["key"]), ("doc", doc), ("mark", mark), ("start", p["start"]), ("n", p["n"]), ("words", b" ".join(words[p["start"] : p["start"] + p["n"] + span - 1]))):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(out[c], pa.int64()) for c in ("key", "doc", "mark")), *(pa.array(out[c], pa.int32()) for c in ("start", "n")), pa.array(out["words"], pa.binary())], names=list(out))

    return docs.join(lists, ["doc", "mark"]).select("doc", "mark", "text", "wanted").mapInArrow(task, "key long, doc long, mark long, start int, n int, words binary")


def numbered(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 1 on for the words of segments, equal for equal words, and how many each segment has."""
    lists = [w.split() for w in words]
    flat = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
    return flat.indices.to_numpy().astype(np.int64) + 1, np.fromiter(map(len, lists), np.int64, len(lists))


def repeats_in_shard(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, words: list[bytes], span: int) -> Iterator[tuple[int, int, int]]:
    """Runs of repeated windows: number of the segment, the run's first window in it, and how many windows it has."""
    order = np.lexsort((start, mark, doc))
    flat, lengths = numbered([words[i] for i in order])
    index = FMIndex(flat, lengths, span)
    match, low, _ = index.matching_statistics(flat, lengths)
    own = np.arange(len(flat)) + np.repeat(np.arange(len(lengths)), lengths)
    repeat = (match >= span) & (index.places[low] < own)
    segment = np.repeat(np.arange(len(lengths)), lengths)
    edge = np.ones(len(flat), bool)
    edge[1:] = (repeat[1:] != repeat[:-1]) | (segment[1:] != segment[:-1])
    begins = np.flatnonzero(edge)
    n = np.diff(np.concatenate([begins, [len(flat)]]))
    offset = begins - (np.cumsum(lengths) - lengths)[segment[begins]]
    for i in np.flatnonzero(repeat[begins]):
        yield int(order[segment[begins[i]]]), int(offset[i]), int(n[i])


def matched(shards: DataFrame, span: int, block_words: int) -> DataFrame:
    """CUT rows of the windows that start earlier in their shard; ``shards`` comes sorted by key, a shard takes whole keys until it has ``block_words`` words."""

    def shard(tables: list[pa.Table]) -> pa.RecordBatch:
        rows = pa.concat_tables(tables)
        doc, mark, start, n = (rows.column(c).to_numpy() for c in ("doc", "mark", "start", "n"))
        once = np.unique(np.stack([doc, mark, start.astype(np.int64), n.astype(np.int64), rows.column("key").to_numpy()]), axis=1, return_index=True)[1]
        doc, mark, start = doc[once], mark[once], start[once]
        found = np.array(list(repeats_in_shard(doc, mark, start, rows.column("words").take(once).to_pylist(), span)), np.int64).reshape(-1, 3)
        return pa.RecordBatch.from_pydict({"doc": doc[found[:, 0]], "mark": mark[found[:, 0]], "start": (start[found[:, 0]] + found[:, 1]).astype(np.int32), "n": found[:, 2].astype(np.int32)})

    @C.tidy
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            weight = np.concatenate([[0], np.cumsum(batch.column(batch.schema.get_field_index("n")).to_numpy().astype(np.int64) + span - 1)])
            at = 0
            for edge in np.flatnonzero(np.concatenate([[key[0] != last], key[1:] != key[:-1]])).tolist():
                if size + weight[edge] - weight[at] >= block_words:
                    yield shard([*held, pa.Table.from_batches([batch.slice(at, edge - at)])])
                    held, size, at = [], 0, edge
            held.append(pa.Table.from_batches([batch.slice(at)]))
            size, last = size + int(weight[-1] - weight[at]), key[-1]
        if held:
            yield shard(held)

    return shards.mapInArrow(task, CUT)


def kept_words(docs: DataFrame, table: C.Kept, cuts: DataFrame, span: int, texts: bool) -> DataFrame:
    lists = cuts.groupBy("doc", "mark").agg(F.collect_set(F.struct("start", "n")).alias("cuts"))
    columns, results = table.columns, table.results.names

    @C.tidy
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            rows: list[tuple] = []
            for text, of in zip(C.texts_of(batch), batch.column(batch.schema.get_field_index("cuts")).to_pylist(), strict=True):
                words = text.split()
                total, runs = len(words), []
                if of:
                    gone = np.zeros(total + 1, np.int64)
                    start = np.array([c["start"] for c in of])
                    np.add.at(gone, start, 1)
                    np.add.at(gone, start + np.array([c["n"] for c in of]) + span - 1, -1)
                    gone = np.cumsum(gone)[:-1] > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    runs = [{"first_word": int(a), "last_word": int(b) - 1} for a, b in edges.reshape(-1, 2)]
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                left = b" ".join(words)
                rows.append((total, total - len(words), hashlib.sha256(left).hexdigest(), left.decode() if texts else None, runs if texts else None))
            cells = zip(*rows, strict=True) if rows else [[]] * len(results)
            yield pa.RecordBatch.from_pydict(C.passed_on(batch, columns) | {c: pa.array(list(v), t) for c, v, t in zip(results, cells, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64())]))), strict=True)})

    return table.named(docs.join(lists, ["doc", "mark"], "left").mapInArrow(task, table.schema))


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", span: int = SPAN, keep: list[str] | None = None, texts: bool = True, hot_from: int = HOT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The kept columns of every row, and RESULT: its words, how many of them went, the rest and its hash, and the runs that went.

    Without ``texts`` the last two stay null.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    table = C.Kept(docs, RESULT, keep)
    body = table.column(text).cast("string")
    ident = {"doc": F.coalesce(table.column(id).cast("long"), F.lit(FIRST_ID)), "mark": F.xxhash64(F.coalesce(body, F.lit("")))}
    plain = table.df.select(*(c.alias(n) for n, c in ident.items()), body.alias("text"))
    hot = hot_keys(plain, span, hot_from)
    found = segments(plain, span, hot)
    together = C.stored(met(found, C.shuffle_partitions(spark)), "repeats-met")
    C.drop_shuffles(spark)
    wanted = together.where("not copy")
    size = wanted.agg(F.sum(F.col("n").cast("long") + span - 1)).first()[0] or 0
    parts = max(C.shuffle_partitions(spark), -(-size // block_words))
    shards = with_words(plain, wanted, span).repartition(parts, "key").sortWithinPartitions("key")
    cuts = C.stored(matched(shards, span, block_words), "repeats-cuts")
    C.drop_shuffles(spark)
    every = cuts.unionByName(together.where("copy").select("doc", "mark", "start", "n"))
    return kept_words(table.df.select(*table.columns, *(c.alias(n) for n, c in ident.items()), body.alias("text")), table, every, span, texts)
