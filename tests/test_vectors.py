"""Nearest rows by products of blocks against the column expression."""

import random

import pytest
from pyspark.sql import functions as F

from foliary.functions import vectors as V
from foliary.operators import retrieval as R


def chunks(spark):
    draw = random.Random(7)
    some = lambda n: [draw.gauss(0, 1) for _ in range(n)]
    same = some(6)
    rows = [(i, f"d{i % 4}", i, same if i % 9 == 0 else None if i % 13 == 1 else [0.0] * 6 if i % 13 == 2 else some(5) if i % 13 == 3 else some(6)) for i in range(200)]
    asked = [(1, same), (2, some(6)), (3, some(5)), (4, None), (5, [0.0] * 6), (6, [])]
    return spark.createDataFrame(rows, "chunk_id long, document_id string, sequence_number long, embedding array<float>").repartition(3), spark.createDataFrame(asked, "query_id long, vector array<double>")


@pytest.mark.parametrize("k, floor, scores", [(7, None, 1 << 22), (7, 0.1, 13), (None, None, 50), (3, 0.5, 1)])
def test_nearest_rows(spark, monkeypatch, k, floor, scores):
    body, asked = chunks(spark)
    monkeypatch.setattr(V, "SCORES", scores)
    got = R.semantic_search(asked, body, k, floor)
    every = body.join(asked, F.lit(True)).withColumn("semantic_score", V.cosine(F.col("embedding"), F.col("vector"))).where("semantic_score is not null")
    expected = R.ranked(every if floor is None else every.where(F.col("semantic_score") >= floor), "semantic_score", k)
    shown = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.semantic_score, 12)) for r in df.collect())
    assert shown(got) == shown(expected) and {r[0] for r in shown(got)} <= {1, 2, 3}


def test_queries_that_are_too_many_or_too_large(spark, monkeypatch):
    body, asked = chunks(spark)
    expected = sorted(map(tuple, R.semantic_search(asked, body, 5).select("query_id", "rank", "chunk_id").collect()))
    monkeypatch.setattr(R, "SMALL_BYTES", 10)
    assert sorted(map(tuple, R.semantic_search(asked, body, 5).select("query_id", "rank", "chunk_id").collect())) == expected
