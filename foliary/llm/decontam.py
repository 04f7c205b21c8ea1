"""Benchmark decontamination by winnowing.

Of each window of ``w`` consecutive k-gram hashes the least is kept, on the benchmark's side and
on the documents' side alike.  With k + w - 1 = ``span`` words, two texts that share ``span``
consecutive words keep a common fingerprint inside the shared passage, so joining fingerprints
finds every such passage; each meeting is then extended word by word to both sides and confirmed
on the words themselves.  Items shorter than ``span`` words form one window each, looked up by
the hash of all their words.

Where the benchmark's text is at most ``broadcast_bytes`` (measured first) its fingerprints go to
every task and no document is shuffled.  Beyond it, the windows of both sides are joined by a shuffle, by
fingerprint and 128 bits of their words, and hits that touch are put together; texts stay where they
are.  Both ways give equal results.

Defined results: null or wordless texts have no words and no hits; null or wordless items no
windows; repeated rows get the same answer each; items repeated under one id count once; texts of
any length are taken whole; an empty table gives an empty one, an empty benchmark no hits; a
column called like a result (in any case) gives way to it.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from foliary.llm import common as C

SPAN = 10
K = 5
BROADCAST_BYTES = 8 << 20
SIEVE_BITS = 26

RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<first_word:long,last_word:long,start:long,end:long>>"


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions that are the least (every one, on ties) of some window of w grams."""
    n = len(grams)
    if n == 0:
        return np.zeros(0, np.int64)
    if n <= w:
        return np.flatnonzero(grams == grams.min())
    least = grams[: n - w + 1].copy()
    for j in range(1, w):
        np.minimum(least, grams[j : n - w + 1 + j], out=least)
    padded = np.zeros(n + w - 1, np.uint64)
    padded[w - 1 : n] = least  # window i begins at i; gram p lies in windows p-w+1 .. p
    top = padded[:n].copy()
    for j in range(1, w):
        np.maximum(top, padded[j : j + n], out=top)
    return np.flatnonzero((grams == top))


@dataclass
class Item:
    item: str
    hashes: np.ndarray
    words: list[bytes]


def scan_items(rows: list[tuple[str, bytes]], scanner: C.WordScanner) -> list[Item]:
    out = []
    for item, text in rows:
        raw = np.frombuffer(text, np.uint8)
        starts, ends, hashes = scanner.scan(raw)
        low = scanner.lower[raw].tobytes()
        if len(starts):
            out.append(Item(item, hashes, [low[s:e] for s, e in zip(starts, ends, strict=True)]))
    return out


class ItemIndex:
    """Fingerprints of all items: sorted hashes, and where each stands."""

    BITS = 20

    def __init__(self, items: list[Item], span: int, k: int) -> None:
        self.items, self.span, self.k, self.w = items, span, k, span - k + 1
        keys: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, it in enumerate(items):
            n = len(it.hashes)
            if n < span:
                self.short[n][int(C.gram_hashes(it.hashes, n)[0])].append(i)
            else:
                grams = C.gram_hashes(it.hashes, k)
                for p in winnow(grams, self.w):
                    keys[int(grams[p])].append((i, int(p)))
        self.keys = keys
        self.sieve = self._sieve(keys)
        self.short_sieve = {m: self._sieve(x) for m, x in self.short.items()}
        self.short = {m: dict(x) for m, x in self.short.items()}
        self.keys = dict(keys)

    def _sieve(self, keys) -> np.ndarray:
        sieve = np.zeros(1 << self.BITS, bool)
        if keys:
            sieve[np.fromiter(keys, np.uint64, len(keys)) >> np.uint64(64 - self.BITS)] = True
        return sieve

    def sifted(self, grams: np.ndarray, sieve: np.ndarray) -> np.ndarray:
        return sieve[grams >> np.uint64(64 - self.BITS)]


def runs_of(doc: np.ndarray, words, index: ItemIndex, seeds: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], set[str]]:
    """Extends seeds (word, item, word of item) to whole shared runs; confirms them on the words."""
    runs, found, done = [], set(), {}
    span = index.span
    for p, i, q in seeds:
        item = index.items[i]
        diagonal = (i, p - q)
        if done.get(diagonal, -1) >= p:
            continue
        left = min(p, q)
        back = doc[p - left : p][::-1] != item.hashes[q - left : q][::-1]
        back = int(back.argmax()) if back.any() else left
        right = min(len(doc) - p, len(item.hashes) - q)
        on = doc[p : p + right] != item.hashes[q : q + right]
        on = int(on.argmax()) if on.any() else right
        first, last = p - back, p + on
        done[diagonal] = max(last - 1, p)
        if last - first >= span:
            same = _equal_runs(words(first, last), item.words[q - back : q + on], span)
            runs += [(first + a, first + b) for a, b in same]
            if same:
                found.add(item.item)
    return runs, found


def _equal_runs(a: list[bytes], b: list[bytes], span: int) -> list[tuple[int, int]]:
    """Runs of at least ``span`` equal words; all of it, unless two words share their hash."""
    if a == b:
        return [(0, len(a))]
    edges = [-1, *(i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), len(a)]
    return [(x + 1, y) for x, y in zip(edges[:-1], edges[1:], strict=True) if y - x - 1 >= span]


def find_hits(texts: list[bytes], scanner: C.WordScanner, index: ItemIndex) -> Iterator[tuple[int, list[tuple[int, int, int, int]], set[str], int]]:
    """Per text: words, merged hit runs (words and bytes), items with an occurring window, words hit."""
    raw, at = C.joined(texts)
    starts, ends, hashes = scanner.scan(raw)
    first = np.searchsorted(starts, at)
    doc_of = np.repeat(np.arange(len(texts)), np.diff(first))
    grams = C.gram_hashes(hashes, index.k)
    seeds: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    if len(grams):
        # grams over a border only add kept places, and what they meet is confirmed within one text
        kept = winnow(grams, index.w)
        kept = kept[index.sifted(grams[kept], index.sieve)]
        for p in kept:
            for i, q in index.keys.get(int(grams[p]), ()):
                d = int(doc_of[p])
                seeds[d].append((int(p - first[d]), i, q))
    shorts: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for m, keys in index.short.items():
        grams = C.gram_hashes(hashes, m)
        for p in np.flatnonzero(index.sifted(grams, index.short_sieve[m])):
            if doc_of[p] == doc_of[p + m - 1]:
                for i in keys.get(int(grams[p]), ()):
                    shorts[int(doc_of[p])].append((int(p - first[doc_of[p]]), m, i))
    low = None
    for d in range(len(texts)):
        n = int(first[d + 1] - first[d])
        if d not in seeds and d not in shorts:
            yield n, [], set(), 0
            continue
        if low is None:
            low = scanner.lower[raw].tobytes()
        s, e = starts[first[d] : first[d + 1]], ends[first[d] : first[d + 1]]
        words = lambda a, b, s=s, e=e: [low[s[j] : e[j]] for j in range(a, b)]
        runs, found = runs_of(hashes[first[d] : first[d + 1]], words, index, sorted(seeds.get(d, ())))
        for p, m, i in shorts.get(d, ()):
            if words(p, p + m) == index.items[i].words:
                runs.append((p, p + m))
                found.add(index.items[i].item)
        whole = merged([(a, b, int(s[a] - at[d]), int(e[b - 1] - at[d])) for a, b in runs])
        yield n, whole, found, sum(b - a for a, b, _, _ in whole)


def digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


_INDEX: dict[str, ItemIndex] = {}


def _index_of(key: str, rows, span: int, k: int) -> ItemIndex:
    """The index, built once in each worker."""
    if key not in _INDEX:
        _INDEX.clear()
        _INDEX[key] = ItemIndex(scan_items(rows, C.letters_scanner()), span, k)
    return _INDEX[key]


def _answers(texts: list[bytes], scanner: C.WordScanner, index: ItemIndex) -> dict[str, list]:
    out: dict[str, list] = {c: [] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")}
    for a, b in C.sub_batches(texts):
        for n, runs, found, hit in find_hits(texts[a:b], scanner, index):
            out["n_words"].append(n)
            out["n_hit"].append(hit)
            out["n_items"].append(len(found))
            out["items_sha256"].append(digest(found))
            out["contaminated"].append(hit > 0)
            out["spans"].append([{"first_word": x, "last_word": y, "start": s, "end": e} for x, y, s, e in runs])
    return out


_SPANS = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
_TYPES = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_(), "spans": _SPANS}


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, span: int = SPAN, k: int = K, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hits of benchmark passages in every document.

    Returns the columns ``keep`` (default: all, but those called like a result) and n_words,
    n_hit, n_items, items_sha256, contaminated and spans (merged runs of hit words, by word number
    and by byte of the UTF-8 text; ends exclusive).
    """
    C.prepare(docs.sparkSession)
    spark = docs.sparkSession
    kept = C.Kept(docs, RESULT, keep)
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("words")).where("item is not null and words is not null")
    size = items.agg(F.sum(F.octet_length("words") + F.octet_length("item") + 16).alias("b")).first()["b"] or 0
    if size <= broadcast_bytes:
        rows = [(r["item"], r["words"].encode()) for r in items.collect()]
        return _by_broadcast(spark, kept, rows, text, span, k)
    return _by_shuffle(kept, items, text, span, k)


def _by_broadcast(spark: SparkSession, kept: C.Kept, rows: list[tuple[str, bytes]], text: str, span: int, k: int) -> DataFrame:
    shared = spark.sparkContext.broadcast(rows)
    key = hashlib.sha256(repr((rows, span, k)).encode()).hexdigest()
    columns = kept.columns

    @C.tidy
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, index = C.letters_scanner(), _index_of(key, shared.value, span, k)
        for batch in C.slices(batches):
            found = _answers(C.texts_of(batch, "body"), scanner, index)
            yield pa.RecordBatch.from_pydict(C.passed_on(batch, columns) | {c: pa.array(found[c], t) for c, t in _TYPES.items()})

    return kept.apply(task, body=kept.column(text))


def _by_shuffle(kept: C.Kept, items: DataFrame, text: str, span: int, k: int) -> DataFrame:
    """Windows of both sides meet in a join by fingerprint and words; no text is moved, and no pair of document and item is formed.

    Of the documents' windows only those go into the join that may meet one (a bit sieve of fixed
    size, whatever the number of items, goes to every task).  The items' side has each window once,
    with a name for the set of items it occurs in, so a fingerprint that all items share is one row
    there; windows of very many documents are spread over tasks.  Documents that met the same sets
    of items share one digest of them.  What one document met is one row, at most five times as
    large as its words; the items of one digest are sorted in one place, by their ids alone.
    """
    spark = items.sparkSession
    rows = C.cut(kept.select(body=kept.column(text), row=F.monotonically_increasing_id()))
    name = F.struct("n", "fp", "window", "check")
    of_items = items.select("item", F.col("words").alias("body")).distinct().mapInArrow(_windows(span, k, None, None), f"item string, {WINDOW}")
    of_items = C.stored(of_items.select("item", name.alias("name")).distinct(), "decontam-items")
    windows = C.stored(of_items.groupBy("name").agg(*_set_name("item")).select("name", F.struct("x", "y", "size").alias("set")), "decontam-windows")
    sizes = sorted(r["n"] for r in windows.select("name.n").where(F.col("n") < span).distinct().collect())  # less than span of them
    sieve = spark.sparkContext.broadcast(_sieve_of(windows.select("name.fp").unionAll(windows.select("name.window"))))
    asked = rows.select("row", "body").mapInArrow(_windows(span, k, sizes, sieve), f"row long, {WINDOW}")
    asked = C.stored(asked.select("row", name.alias("name"), F.struct("first_word", "last_word", "start", "end").alias("run")), "decontam-asked")
    met = windows.join(asked.groupBy("name").agg(F.count("*").alias("copies")), "name")
    hits = C.spread_join(asked, met, "name", "row", "copies", asked.count())
    found = hits.groupBy(F.col("row").alias("at")).agg(F.collect_set("run").alias("runs"), F.sort_array(F.collect_set("set")).alias("sets"))
    found = C.stored(found.withColumn("sets_name", F.struct(F.xxhash64("sets").alias("x"), F.xxhash64(F.lit(1), "sets").alias("y"))), "decontam-found")
    told = C.spread_join(found.drop("sets"), _digests(found, windows, of_items), "sets_name", "at", "documents", found.count())

    columns = kept.columns

    @C.tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = C.letters_scanner()
        for batch in C.slices(batches):
            sizes = []
            texts = C.texts_of(batch, "body")
            for a, b in C.sub_batches(texts):
                raw, at = C.joined(texts[a:b])
                sizes.append(np.diff(np.searchsorted(scanner.bounds(raw)[0], at)))
            yield pa.RecordBatch.from_pydict(C.passed_on(batch, [*columns, "row"]) | {"words": pa.array(np.concatenate(sizes) if sizes else [], pa.int64())})

    whole = rows.mapInArrow(count, StructType([*(rows.schema[c] for c in (*columns, "row")), StructField("words", LongType())]))
    joined = whole.join(told, F.col("row") == F.col("at"), "left").select(*columns, "words", "n_items", "items_sha256", "runs")

    @C.tidy
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = digest(set())
        for batch in C.slices(batches):
            out: dict[str, list] = {c: [] for c in _TYPES}
            n = len(columns)
            for words, n_items, items_digest, runs in zip(*(batch.column(i).to_pylist() for i in range(n, n + 4)), strict=True):
                spans = merged([(r["first_word"], r["last_word"], r["start"], r["end"]) for r in runs or ()])
                values = (words, sum(b - a for a, b, _, _ in spans), n_items or 0, items_digest or nothing, bool(spans), [dict(zip(("first_word", "last_word", "start", "end"), s, strict=True)) for s in spans])
                for c, v in zip(_TYPES, values, strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(C.passed_on(batch, columns) | {c: pa.array(out[c], t) for c, t in _TYPES.items()})

    return kept.named(joined.mapInArrow(merge, kept.schema))


def _set_name(column: str) -> list[Column]:
    """Sums by which sets of distinct values are told apart: 128 bits and the size; no set is ever gathered for it."""
    return [F.bit_xor(F.xxhash64(column)).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), column)).alias("y"), F.count("*").alias("size")]


def _digests(found: DataFrame, windows: DataFrame, of_items: DataFrame) -> DataFrame:
    """sets_name, documents, n_items, items_sha256 of each distinct combination of sets that documents met.

    A set's items are those of any one of its windows; the items of large sets are spread over tasks.
    """
    combined = found.groupBy("sets_name").agg(F.first("sets").alias("sets"), F.count("*").alias("documents"))
    one = windows.groupBy("set").agg(F.min("name").alias("name")).withColumn("size", F.col("set.size"))
    members = C.spread_join(of_items, one, "name", "item", "size", of_items.count()).select("set", "item")
    parts = F.ceil(F.col("set.size") / C.MANY).cast("int")
    asked = combined.select("sets_name", F.explode("sets").alias("set")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    pairs = asked.join(members.withColumn("part", F.pmod(F.xxhash64("item"), parts).cast("int")), ["set", "part"])
    listed = pairs.groupBy("sets_name").agg(F.sort_array(F.collect_set("item")).alias("items"))
    listed = listed.select("sets_name", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))
    return combined.select("sets_name", "documents").join(listed, "sets_name")


def merged(runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Runs (first word, end, first byte, end) that touch or overlap, as one each."""
    out: list[tuple[int, int, int, int]] = []
    for a, b, s, e in sorted(runs):
        if out and a <= out[-1][1]:
            c, d, t, f = out[-1]
            out[-1] = (c, max(d, b), t, max(f, e))
        else:
            out.append((a, b, s, e))
    return out


def _sieve_of(prints: DataFrame) -> np.ndarray:
    """A bit for each fingerprint: at most 2^SIEVE_BITS of them, in 2^(SIEVE_BITS - 6) rows."""
    place = F.shiftrightunsigned("fp", 64 - SIEVE_BITS)
    bits = prints.select(F.shiftrightunsigned(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(fp, {64 - SIEVE_BITS}) & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << (SIEVE_BITS - 6), np.int64)
    table = bits.toArrow()
    out[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return out.view(np.uint64)


WINDOW = "n int, fp long, window long, check long, first_word long, last_word long, start long, end long"


def _windows(span: int, k: int, sizes: list[int] | None, sieve):
    """Windows of texts (key, body): fingerprint, 128 bits of all their words, and where they are.

    Of ``span`` words the fingerprint is the least k-gram hash, of short items the hash of all words.
    sizes: how many words short items have, for documents; for items none, as each has its own.
    """
    integers, longs = ["n"], ["fp", "window", "check", "first_word", "last_word", "start", "end"]

    def of_text(scanner: C.WordScanner, body: bytes) -> Iterator[list[np.ndarray]]:
        raw = np.frombuffer(body, np.uint8)
        starts, ends, hashes = scanner.scan(raw)
        many = len(hashes)
        lengths = [n for n in ([min(many, span)] if sizes is None else [*sizes, span]) if 0 < n <= many]
        checks = scanner.check(raw, starts, ends) if lengths else hashes
        for n in lengths:
            window = fp = C.gram_hashes(hashes, n)
            if n == span:
                grams = C.gram_hashes(hashes, k)
                fp = grams[: len(window)].copy()
                for j in range(1, span - k + 1):
                    np.minimum(fp, grams[j : j + len(window)], out=fp)
            at = np.arange(len(window)) if sieve is None else np.flatnonzero(sifted(fp, sieve.value) & sifted(window, sieve.value))
            if len(at):
                yield [np.full(len(at), n), C.as_signed(fp[at]), C.as_signed(window[at]), C.as_signed(C.gram_hashes(checks, n)[at]), at, at + n, starts[at], ends[at + n - 1]]

    @C.tidy
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = C.letters_scanner()
        for batch in C.slices(batches):
            texts = C.texts_of(batch, "body")
            for a, b in C.sub_batches(texts):
                found = [(i, w) for i in range(a, b) for w in of_text(scanner, texts[i])]
                if found:
                    keys = batch.column(0).take(pa.array(np.repeat([i for i, _ in found], [len(w[0]) for _, w in found])))
                    parts = [np.concatenate([w[c] for _, w in found]) for c in range(8)]
                    yield pa.RecordBatch.from_arrays([keys, pa.array(parts[0], pa.int32()), *(pa.array(x, pa.int64()) for x in parts[1:])], [batch.schema.names[0], *integers, *longs])

    return task


def sifted(prints: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    place = prints >> np.uint64(64 - SIEVE_BITS)
    return ((sieve[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)
