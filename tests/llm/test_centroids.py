"""Centroid clustering against a plain version, and vectors that take no part."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from foliary.llm import centroids as K
from foliary.llm import queries as Q
from foliary.llm.oracles import ORACLES
from tests.helpers import plain, views

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    middle = [v for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(middle))

    for _ in range(rounds):
        of = {}
        for _, v in kept:
            of.setdefault(nearest(v)[1], []).append(v)
        middle = [[sum(x) // len(of[j]) for x in zip(*of[j], strict=True)] if j in of else c for j, c in enumerate(middle)]
    found = [(i, *nearest(v)) for i, v in kept]
    sums = {}
    for _, d, j in found:
        sums[j] = sums.get(j, 0) + d
    return sorted(((i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, middle[j])).encode()).hexdigest()) for i, d, j in found), key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def vectors(n, seed=5):
    draw = random.Random(seed)
    middle = [[draw.gauss(0, 1) for _ in range(64)] for _ in range(7)]
    return [[c + draw.gauss(0, 0.4) for c in draw.choice(middle)] for _ in range(n)]


def test_against_a_plain_version(spark):
    v = vectors(300)
    odd = [None, [], [1.0] * 63, [1.0] * 65, [float("nan"), *[1.0] * 63], [float("inf"), *[1.0] * 63], [None, *[1.0] * 63]]
    rows = [*enumerate(v), *((900 + i, x) for i, x in enumerate(odd)), (7, v[7]), (7, v[8]), (None, v[9]), (-5, [0.0] * 64), (11111, v[3])]
    frame = spark.createDataFrame([(i, x, 0) for i, x in rows], SCHEMA).repartition(5)
    assert got(K.cluster(frame)) == plain_clusters(rows)


def test_few_equal_and_no_vectors(spark):
    v = vectors(5)
    same = [(i, v[0]) for i in range(40)]
    for rows in (list(enumerate(v)), same, [(1, None), (2, [0.5])], []):
        frame = spark.createDataFrame([(i, x, 0) for i, x in rows], SCHEMA)
        assert got(K.cluster(frame)) == plain_clusters(rows)


def test_ties_go_to_the_smaller_number():
    search = K.Search(((2, *[0] * 63), (-2, *[0] * 63), (2, *[0] * 63)), tuple(range(64)))
    near, far, _ = search.nearest(np.array([[0] * 64, [3, *[0] * 63], [-3, *[0] * 63]]))
    assert near.tolist() == [0, 0, 1] and far.tolist() == [4, 1, 1]


def test_far_centroids_are_abandoned_early():
    v = np.floor(64 * np.array(vectors(200))).astype(np.int64)
    order = tuple(np.argsort(-v.var(0)).tolist())
    search = K.Search(tuple(map(tuple, v[:16].tolist())), order)
    near, far, terms = search.nearest(v)
    every = ((v[:, None, :] - v[None, :16, :]) ** 2).sum(2)
    assert near.tolist() == every.argmin(1).tolist() and far.tolist() == every.min(1).tolist()
    assert terms < 0.7 * v.size * 16


def test_columns_that_clash(spark):
    frame = spark.createDataFrame([(i, v, i) for i, v in enumerate(vectors(30))], SCHEMA).select("vec_id", "embedding", F.col("label").alias("Cluster"), F.lit(1).alias("a.b"), F.lit(2).alias("cells"))
    out = K.cluster(frame)
    assert out.columns == ["vec_id", "embedding", "a.b", "cells", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert out.count() == 30


def test_query_against_sql(spark, sf_dir):
    name = "op11_centroid_clusters"
    assert plain(Q.queries()[name](spark, sf_dir).toPandas()) == plain(views(sf_dir).sql(ORACLES[name]).df())
