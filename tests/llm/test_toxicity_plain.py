"""The classifier against a plain version over n-grams as texts, without hashing."""

import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from foliary.llm import toxicity as T
from tests.llm.helpers import sentence


def grams(text):
    plain = " " + re.sub(r"[^0-9a-z\x80-\U0010ffff]", " ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) + " "
    raw = plain.encode()
    return {raw[i : i + n] for n in T.ORDERS for i in range(len(raw) - n + 1)}


def plain_model(texts, labels, smoothing=1.0, penalty=0.1):
    """Log-count ratios by dictionary, weights by plain gradient steps to the optimum, and the border moved as documented."""
    rows = [grams(t) for t in texts]
    n1, n0 = sum(labels), len(labels) - sum(labels)
    ratio = {}
    for g in set().union(*rows):
        p, q = (sum(g in r for r, y in zip(rows, labels, strict=True) if y == k) + smoothing for k in (1, 0))
        r = math.log(p / (n1 + 2 * smoothing)) - math.log(q / (n0 + 2 * smoothing))
        if p + q > 2 * smoothing + 1 and abs(r) >= T.LEAST_RATIO:
            ratio[g] = r
    names = sorted(ratio)
    x = np.array([[ratio[g] if g in r else 0.0 for g in names] for r in rows])
    y = np.array(labels, float)
    each = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    # Newton's steps on the texts' side: the weights are x.T times one number a text
    a, b = np.zeros(len(y)), 0.0
    kernel = x @ x.T
    for _ in range(100):
        z = kernel @ a + b
        s = 1 / (1 + np.exp(-z))
        w = each * s * (1 - s)
        target = z + (each * (y - s)) / w
        inner = kernel + penalty * np.diag(1 / w)
        system = np.block([[inner, np.ones((len(y), 1))], [np.ones((1, len(y))), np.zeros((1, 1))]])
        solved = np.linalg.solve(system, np.concatenate([target, [0.0]]))
        a, b = solved[:-1], solved[-1]
    weights = x.T @ a
    z = x @ weights + b
    clean, foul = np.quantile(z[y == 0], 0.999), np.quantile(z[y == 1], 0.001)
    if clean < foul:
        b -= (clean + foul) / 2
    table = dict(zip(names, weights * np.array([ratio[g] for g in names]), strict=True))
    return lambda text: 1 / (1 + math.exp(-(b + sum(table.get(g, 0.0) for g in grams(text)))))


def corpus():
    draw = random.Random(6)
    foul = ["grubbig", "stinkov", "vilezz"]
    rows = []
    for i in range(120):
        toxic = i % 3 == 0
        words = sentence(draw, draw.randint(4, 14)).split()
        if toxic:
            for w in draw.sample(foul, 2):
                words.insert(draw.randint(0, len(words)), draw.choice([w, w.upper(), w + "!"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_scores_equal_a_plain_version(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = T.train(docs, labels)
    used = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    plain = plain_model([t for t, _ in used], [y for _, y in used])
    got = {r.doc_id: (r.score, r.predicted) for r in T.score(docs, model).collect()}
    for i, text, y in rows:
        assert abs(got[i][0] - plain(text)) < 0.02, (i, got[i], plain(text))
        assert got[i][1] == y == int(plain(text) >= T.THRESHOLD)


def test_long_texts_are_trained_on_whole(spark):
    """What tells a long text lies at its begin, far from its middle."""
    filler = " ".join(f"n{i % 977}" for i in range(80_000))
    rows = [(i, ("zorgblat " if i % 2 else "calm ") + filler, i % 2) for i in range(12)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    model = T.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    asked = docs.where("doc_id < 2").withColumn("text", F.concat("text", F.lit(" end")))
    got = {r.doc_id: r.predicted for r in T.score(asked, model).collect()}
    assert got == {0: 0, 1: 1}
