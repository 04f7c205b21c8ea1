"""Centroid clustering of integer vectors with a partial-distance search.

Each vector's components become floor(64 * x).  The first centroids are the vectors whose hash of
seed and id is least.  Each round assigns every vector to its nearest centroid and replaces each
centroid by the floored mean of its vectors; all arithmetic is on integers, so results don't
depend on how rows are dealt over tasks.

The search takes the dimensions of greatest variance first, eight at a time.  A vector leaves a
centroid as soon as the sum so far is strictly above its best distance; what is left finishes all
dimensions.  As centroids come in ascending order and only a smaller distance replaces the best,
ties go to the smaller number.

A round reads the vectors once and sends one row of sums for each centroid and task; the driver
holds the centroids only.

Defined results: vectors that are null, of another length, or hold a null or non-finite component
are left out; repeated rows are vectors of their own, each with an answer; of rows whose hashes
tie the smaller vector starts first, a null id comes after all others; with fewer vectors than
centroids there are as many centroids as vectors; an empty table gives an empty one; a component
beyond 2^27 after scaling is an error, as its squared distances leave 64 bits; a column called
like a result gives way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.llm import common as C

DIMENSIONS = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
STEP = 8
LARGEST = 1 << 27

RESULT = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
SUMS = "cluster int, n long, inertia long, sums array<long>, squares array<long>"


@dataclass(frozen=True)
class Search:
    """Nearest centroids by partial distances; ``order`` lists the dimensions, widest spread first."""

    centroids: tuple[tuple[int, ...], ...]
    order: tuple[int, ...]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Cluster and squared distance of each row, and how many vector-centroid-dimension terms were summed."""
        centres = np.array(self.centroids, np.int64)[:, list(self.order)]
        rows = np.ascontiguousarray(vectors[:, list(self.order)])
        best = ((rows - centres[0]) ** 2).sum(1)
        cluster = np.zeros(len(rows), np.int32)
        terms = rows.size
        for j in range(1, len(centres)):
            alive, part = np.arange(len(rows)), np.zeros(len(rows), np.int64)
            for d in range(0, rows.shape[1], STEP):
                gap = rows[alive, d : d + STEP] - centres[j, d : d + STEP]
                terms += gap.size
                part += np.einsum("ij,ij->i", gap, gap)
                left = part <= best[alive]
                alive, part = alive[left], part[left]
            closer = part < best[alive]
            best[alive[closer]], cluster[alive[closer]] = part[closer], j
        return cluster, best, terms


def whole(vector: str | Column, dimensions: int = DIMENSIONS) -> Column:
    """The vector's integer components; null where it takes no part."""
    x = (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return F.when((F.size(x) == dimensions) & ~bad, F.transform(x, lambda e: F.floor(e * SCALE)))


def matrix(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index("cells")).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    if flat.size and max(int(flat.max()), -int(flat.min())) > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} after scaling")
    return flat


def moments(vectors: DataFrame, search: Search | None, dimensions: int) -> list:
    """Count, inertia, sums and (without a search, all in cluster 0) squares by cluster, of all tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(search.centroids) if search else 1
        n, inertia, sums, squares = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64), np.zeros((k, dimensions), np.int64)
        for batch in batches:
            v = matrix(batch, dimensions)
            cluster, far, _ = search.nearest(v) if search else (np.zeros(len(v), np.int32), np.zeros(len(v), np.int64), 0)
            for j in np.unique(cluster):
                of = cluster == j
                n[j] += of.sum()
                inertia[j] += far[of].sum()
                sums[j] += v[of].sum(0)
                squares[j] += 0 if search else (v[of] ** 2).sum(0)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(used, pa.int32()), "n": n[used], "inertia": inertia[used], "sums": list(sums[used]), "squares": list(squares[used])})

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    each = vectors.mapInArrow(task, SUMS)
    cells = each.select("cluster", "n", "inertia", F.posexplode(F.arrays_zip("sums", "squares")).alias("i", "z"))
    totals = cells.groupBy("cluster", "i").agg(exact("n").alias("n"), exact("inertia").alias("inertia"), exact("z.sums").alias("total"), exact("z.squares").alias("square"))
    return totals.collect()  # at most centroids * dimensions rows


def first_centroids(vectors: DataFrame, id: Column, k: int, seed: str) -> list[tuple[int, ...]]:
    ranked = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), id.cast("string")), 256).alias("h"), "cells")
    return [tuple(r.cells) for r in ranked.orderBy(F.col("h").asc_nulls_last(), "cells").limit(k).collect()]


def cluster(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: str = "1", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of every vector that takes part, and RESULT: its cluster and squared distance,
    the sums of distances over its cluster and over all, and the hash of its final centroid."""
    C.prepare(vectors.sparkSession)
    table = C.Kept(vectors, RESULT, keep)
    cells = whole(table.column(vector), dimensions)
    part = table.df.select(table.column(id).alias("id"), cells.alias("cells")).where("cells is not null")
    only = part.select("cells")
    middle = first_centroids(part, F.col("id"), centroids, seed)
    if not middle:
        return table.named(table.select().where("false").select("*", *(F.lit(None).cast(f.dataType) for f in table.results)))
    spread = {r.i: int(r.n) * int(r.square) - int(r.total) ** 2 for r in moments(only, None, dimensions)}
    order = tuple(sorted(range(dimensions), key=lambda i: -spread[i]))
    for _ in range(rounds):
        new = [list(c) for c in middle]
        for r in moments(only, Search(tuple(middle), order), dimensions):
            new[r.cluster][r.i] = int(r.total) // int(r.n)
        middle = [tuple(c) for c in new]
    search = Search(tuple(middle), order)
    sums = {r.cluster: int(r.inertia) for r in moments(only, search, dimensions) if r.i == 0}
    inertia = sum(sums.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    columns = table.columns

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, far, _ = search.nearest(matrix(batch, dimensions))
            yield pa.RecordBatch.from_pydict(
                C.passed_on(batch, columns)
                | {
                    "cluster": pa.array(near, pa.int32()),
                    "distance": far,
                    "cluster_inertia": pa.array([sums[j] for j in near.tolist()], pa.int64()),
                    "inertia": pa.array([inertia] * len(near), pa.int64()),
                    "centroid_sha256": pa.array([digests[j] for j in near.tolist()], pa.string()),
                }
            )

    return table.named(table.select(cells=cells).where("cells is not null").mapInArrow(label, table.schema))
