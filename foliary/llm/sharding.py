"""Sharding by histogram sort.

Rows are ordered by a key (a hash of the text, the id, the row's number; so equal texts are
neighbours and no two rows are equal), and cut into shards of near-equal bytes.  The cuts are found
without sorting: candidate boundaries are probed, every partition counts the exact bytes between
probes, and the probes are refined around each wanted cut until its bytes are within the tolerance.
Then each row moves once, to its place.

A cut is put between groups of equal texts where that meets the tolerance; a larger group is split
by ids, and rows that are equal in both by their numbers.  Numbers are held by a table in the shared
folder, so a task that runs again sees the same ones.  Only the cuts between shards are probed for
(a few hundred counts come to the driver in each round); inside, a shard is dealt by a hash to
parts of about ``PART_BYTES`` (larger ones beyond ``MOST_PARTS``), so that one shard isn't one task.

Defined results: a null text has no bytes (size 1, as every row adds 1); a null id orders first;
repeated rows are all placed, and split where the sizes need it; a text longer than a shard's share
makes its shard as large as it is; an empty table gives an empty one; a column called size, shard
or slot (in any case) gives way to the result; all others come back, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from foliary.llm import common as C

SHARDS = 8
TOLERANCE = 0.001
PART_BYTES = 64 << 20
MOST_PARTS = 1 << 16
MOST_PROBES = 1 << 17
WIDTH, TOP = 24, 1 << 192
KEY = ("h", "d", "r")


def row_keys(batch: pa.RecordBatch) -> np.ndarray:
    """24 bytes a row that sort as its numbers (h, d, r) do."""
    flip = np.uint64(1 << 63)
    numbers = np.stack([_long(batch, c).view(np.uint64) ^ flip for c in KEY], axis=1)
    return numbers.astype(">u8").view(f"S{WIDTH}").ravel()


def as_keys(numbers: list[int]) -> np.ndarray:
    return np.array([x.to_bytes(WIDTH, "big") for x in numbers], f"S{WIDTH}")


def _number(key: bytes) -> int:
    return int.from_bytes(key.ljust(WIDTH, b"\0"), "big")


def _long(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64)


def count_between(keyed: DataFrame, probes: list[int]) -> dict[int, tuple[int, int, int]]:
    """bucket -> (bytes, least key, greatest key), bucket i holding keys from probe i-1 up to below probe i."""
    shared = keyed.sparkSession.sparkContext.broadcast(as_keys(probes))

    @C.tidy
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(shared.value) + 1
        size = np.zeros(n, np.int64)
        least: dict[int, bytes] = {}
        most: dict[int, bytes] = {}
        for batch in batches:
            keys = row_keys(batch)
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            bucket = np.searchsorted(shared.value, keys, "right")
            np.add.at(size, bucket, _long(batch, "size")[order])
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            last = np.append(first[1:], len(bucket)) - 1
            for i, a, b in zip(bucket[first].tolist(), first, last, strict=True):
                x, y = keys[a].ljust(WIDTH, b"\0"), keys[b].ljust(WIDTH, b"\0")
                least[i], most[i] = min(least.get(i, x), x), max(most.get(i, y), y)
        held = sorted(least)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(size[held], pa.int64()), pa.array([least[i] for i in held], pa.binary()), pa.array([most[i] for i in held], pa.binary())], ["bucket", "size", "least", "most"])

    found = keyed.select(*KEY, "size").mapInArrow(task, "bucket long, size long, least binary, most binary").groupBy("bucket").agg(F.sum("size").alias("size"), F.min("least").alias("least"), F.max("most").alias("most"))
    return {r["bucket"]: (r["size"], _number(bytes(r["least"])), _number(bytes(r["most"]))) for r in found.collect()}  # a row for each probe


def _spread(lo: int, hi: int, n: int) -> list[int]:
    """Up to n probes above lo and below hi: between values of h, or where there is one of d, or of r."""
    for shift in (128, 64, 0):
        a, b = lo >> shift, (hi - 1) >> shift
        if a != b:
            n = min(n, b - a)
            return [(a + (b - a) * i // n) << shift for i in range(1, n + 1)]
    return []


def splitters(keyed: DataFrame, total: int, parts: int, slack: float) -> list[int]:
    """parts - 1 keys, each within ``slack`` bytes of an equal cut where rows allow it."""
    probes_each = max(3, min(63, MOST_PROBES // max(1, parts)))
    open_: dict[int, tuple[int, int]] = {j: (0, TOP) for j in range(1, parts)}
    found: dict[int, int] = {}
    while open_:
        probes = sorted({p for lo, hi in open_.values() for p in _spread(lo, hi, probes_each)} | {lo for lo, _ in open_.values()} | {hi for _, hi in open_.values() if hi < TOP})
        held = count_between(keyed, probes)
        edges = np.cumsum([held.get(i, (0,))[0] for i in range(len(probes) + 1)])[:-1]  # bytes below each probe
        for j in list(open_):
            target = total * j / parts
            i = int(np.searchsorted(edges, target, "right")) - 1  # the last probe with at most the target below it
            left = (int(edges[i]), probes[i]) if i >= 0 else (0, 0)
            right = (int(edges[i + 1]), probes[i + 1]) if i + 1 < len(probes) else (total, TOP)
            off, place = min((abs(x - target), p) for x, p in (left, right) if p < TOP)
            _, least, most = held.get(i + 1, (0, 0, 0))
            if off <= slack:
                found[j] = place
                del open_[j]
            elif least == most:  # one row
                found[j] = least if target - left[0] <= right[0] - target else most + 1
                del open_[j]
            else:
                open_[j] = (least, most + 1)
    return [found[j] for j in range(1, parts)]


def shard_by_bytes(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shards: int = SHARDS, tolerance: float = TOLERANCE, part_bytes: int = PART_BYTES, keep: list[str] | None = None) -> DataFrame:
    """Adds size (UTF-8 bytes of the text plus 1), shard and slot (0, 1, ... within the shard) to the columns ``keep`` (default: all)."""
    spark = df.sparkSession
    C.prepare(spark)
    kept = C.Kept(df, "size long, shard int, slot long", keep)
    columns = kept.columns
    marks = {"h": F.xxhash64(F.coalesce(kept.column(text), F.lit(""))), "d": F.coalesce(kept.column(doc_id).cast("long"), F.lit(-(1 << 63))), "r": F.monotonically_increasing_id(), "size": F.coalesce(F.octet_length(kept.column(text)), F.lit(0)).cast("long") + 1}
    rows = C.stored(kept.select(**marks), "rows-to-shard")
    total = rows.agg(F.sum("size").alias("s")).first()["s"] or 0
    per_shard = max(1, min(math.ceil(total / shards / part_bytes), MOST_PARTS // shards))
    cuts = splitters(rows, total, shards, tolerance * total / shards) if total else []
    bounds = spark.sparkContext.broadcast(as_keys(cuts))

    def parts_of(batch: pa.RecordBatch) -> np.ndarray:
        shard = np.searchsorted(bounds.value, row_keys(batch), "right")
        mixed = C.mix64(_long(batch, "h").view(np.uint64) ^ C.mix64(_long(batch, "r").view(np.uint64)))
        return (shard * per_shard + (mixed % np.uint64(per_shard)).astype(np.int64)).astype(np.int32)

    @C.tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = np.zeros(shards * per_shard, np.int64)
        for batch in batches:
            each += np.bincount(parts_of(batch), minlength=len(each))
        yield pa.RecordBatch.from_pydict({"part": pa.array(np.flatnonzero(each).astype(np.int32)), "n": pa.array(each[each > 0])})

    each = np.zeros(shards * per_shard, np.int64)
    for r in rows.select(*KEY).mapInArrow(count, "part int, n long").groupBy("part").agg(F.sum("n").alias("n")).collect():  # at most MOST_PARTS rows
        each[r["part"]] = r["n"]
    before = np.cumsum(each) - each
    offset = before - np.repeat(before[::per_shard], per_shard)

    @C.tidy
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts_of(batch))], [*batch.schema.names, "part"])

    @C.tidy
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = -1, 0
        for batch in batches:
            part = batch.column(batch.schema.get_field_index("part")).to_numpy()
            if not len(part):
                continue
            first = np.flatnonzero(np.diff(part, prepend=-2))
            within = np.arange(len(part)) - np.repeat(first, np.diff(np.append(first, len(part))))
            within[part == now] += seen
            now, seen = int(part[-1]), int(within[-1]) + 1
            yield pa.RecordBatch.from_pydict(C.passed_on(batch, columns) | {"size": batch.column(batch.schema.get_field_index("size")), "shard": pa.array((part // per_shard).astype(np.int32)), "slot": pa.array(within + offset[part])})

    dealt = rows.mapInArrow(deal, StructType([*rows.schema, StructField("part", IntegerType())]))
    placed = dealt.repartitionById(shards * per_shard, "part").sortWithinPartitions("part", *KEY)
    return kept.named(placed.mapInArrow(number, kept.schema))
