"""Vector arithmetic in double precision: column expressions, and products of a block of queries with batches of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as P

#: scores that one product of queries and rows holds at most
SCORES = 1 << 22


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """1 for equal directions; null where a vector is null, zero, or of another length."""
    size = norm(a) * norm(b)
    return F.when((size > 0) & (F.size(a) == F.size(b)), dot(a, b) / size)


def nearest(rows: DataFrame, vector: str, shown: tuple[str, ...], asked: list[tuple], kind: P.DataType, k: int | None, floor: float | None = None, unit: bool = False, score_name: str = "semantic_score") -> DataFrame:
    """query_id, the shown columns and the cosine of every row that can be among the ``k`` nearest of a query (or of all, without ``k``).

    asked: pairs of a query's id (of type ``kind``) and vector; they go to every task, so they are a block
    of bounded size.  Vectors that are null, zero or of another length take no part.  Rows' vectors
    may be stored as ``unit`` ones.
    """
    spark = rows.sparkSession
    vectors = [np.array(v if v is not None else [], np.float64) for _, v in asked]
    groups: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        if len(v) and float(v @ v) > 0:
            groups.setdefault(len(v), []).append(i)
    out = None
    own = P.StructType([P.StructField("q", P.IntegerType()), *(rows.schema[c] for c in shown), P.StructField(score_name, P.DoubleType())])
    for width, of in groups.items() or {0: []}.items():
        matrix = np.stack([vectors[i] / np.sqrt(float(vectors[i] @ vectors[i])) for i in of]) if of else np.zeros((0, width))
        body = rows.where(F.size(vector) == width).select(*shown, F.col(vector).cast("array<double>").alias("__v"))
        found = body.mapInArrow(_task(spark.sparkContext.broadcast(matrix), len(shown), k, floor, unit, own.names), own)
        names = spark.createDataFrame([(n, asked[i][0]) for n, i in enumerate(of)], P.StructType([P.StructField("q", P.IntegerType()), P.StructField("query_id", kind)]))
        named = found.join(F.broadcast(names), "q").select("query_id", *shown, score_name)
        out = named if out is None else out.unionByName(named)
    return out


def _task(shared, n: int, k: int | None, floor: float | None, unit: bool, names: list[str]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        least = np.full(len(asked), -np.inf if floor is None else floor - 1e-12)
        held: list[tuple[np.ndarray, np.ndarray, pa.RecordBatch]] = []
        best, size = np.full((len(asked), 0), -np.inf), 0
        step = max(1, SCORES // max(1, len(asked)))
        for whole in batches:
            for at in range(0, whole.num_rows if len(asked) else 0, step):
                batch = whole.slice(at, step)
                score = scores(batch.column(n), asked, unit)
                if k is not None:
                    best = np.concatenate([best, np.where(np.isnan(score), -np.inf, score).T], axis=1)
                    if best.shape[1] > k:
                        best = -np.partition(-best, k - 1, axis=1)[:, :k]
                        least = np.maximum(least, best.min(axis=1) - 1e-12)  # ties of the last are decided later
                row, query = np.nonzero(score >= least)
                held.append((query, score[row, query], batch.select(list(range(n))).take(pa.array(row))))
                size += len(row)
                if k is None or size > SCORES:  # what is no longer among the best goes
                    if k is None:
                        yield from results(held, least, names)
                        held = []
                    else:
                        held = [(q[stays], v[stays], rows.filter(pa.array(stays))) for q, v, rows in held for stays in [v >= least[q]]]
                    size = sum(len(q) for q, _, _ in held)
        yield from results(held, least, names)

    return task


def scores(column: pa.Array, asked: np.ndarray, unit: bool) -> np.ndarray:
    """Cosines of a batch's vectors (rows) and the queries (columns); equal vectors have equal ones, NaN where there is none."""
    flat = column.flatten()
    body = flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)
    if unit:
        return body @ asked.T
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.einsum("ij,kj->ik", body, asked) / np.sqrt(np.einsum("ij,ij->i", body, body))[:, None]


def results(held: list[tuple[np.ndarray, np.ndarray, pa.RecordBatch]], least: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    for query, score, rows in held:
        stays = score >= least[query]
        yield pa.RecordBatch.from_arrays([pa.array(query[stays].astype(np.int32)), *rows.filter(pa.array(stays)).columns, pa.array(score[stays])], names)
