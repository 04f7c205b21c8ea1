"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams of its small-lettered words (with their borders),
hashed to ``2^bits`` places.  The log-count ratio r of a place is the log of how much more often
toxic than clean texts hold it; a logistic regression is fitted on features scaled by |r| and its
weights times r make one table, by which every whole text is scored.

Training uses at most ``per_class`` labelled texts of each class, the first in the order of a
hash of the id (a documented bound: the sample is what a driver of fixed size can hold).  Their
features are found in tasks, of whole texts, and only these come to the driver, at most ``2^bits``
numbers a text.  Both classes weigh the same, whatever their shares.  Scores are of whole texts.

Defined results: null and empty texts score as a text without features; rows without a label, or
with conflicting ones, are not trained on; where one labelled id has several texts, the least is
trained on; with no row of one class all texts score the share of toxic labels (0 without labels);
repeated rows get equal scores; a score equal to the threshold is predicted 1; an empty table gives
an empty one; a column called like a result (in any case) gives way to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm import common as C

ORDERS = (3, 4, 5)
BITS = 18
PER_CLASS = 2000
LEAST_RATIO = 1.0
THRESHOLD = 0.7
FOLD, HELD = 3, 1


class Features:
    """Distinct hashed n-grams of whole texts."""

    def __init__(self, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> None:
        self.orders, self.bits = orders, bits
        code = np.arange(256, dtype=np.uint32)
        code[65:91] += 32
        plain = [b for b in range(128) if not (48 <= b < 58 or 97 <= (b + 32 if 65 <= b < 91 else b) < 123)]
        code[plain] = 32  # anything that is no letter or digit is one kind of border
        self.code = ((code + np.uint32(1)) * np.uint32(0x9E3779B1)).astype(np.uint32)
        self.stamp = np.full(1 << bits, -1, np.int32)

    def of(self, text: bytes) -> np.ndarray:
        """Places of the text's n-grams, each once."""
        raw = np.frombuffer(b" " + text + b" ", np.uint8)
        codes = self.code[raw]
        parts = []
        with np.errstate(over="ignore"):
            for n in self.orders:
                m = len(raw) - n + 1
                if m <= 0:
                    continue
                h = codes[:m].copy()
                for j in range(1, n):
                    h *= np.uint32(0x01000193)
                    h ^= codes[j : j + m]
                h *= np.uint32(0x85EBCA6B + 2 * n)
                h ^= h >> np.uint32(15)
                h *= np.uint32(0xC2B2AE35)
                parts.append(h >> np.uint32(32 - self.bits))
        if not parts:
            return np.zeros(0, np.int32)
        places = np.concatenate(parts).astype(np.int32)
        order = np.arange(len(places), dtype=np.int32)
        self.stamp[places] = order
        return places[self.stamp[places] == order]


@dataclass
class Model:
    weights: np.ndarray
    intercept: float
    orders: tuple[int, ...]
    bits: int

    def score(self, features: Features, text: bytes) -> float:
        z = self.intercept + float(self.weights[features.of(text)].sum(dtype=np.float64))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]


def fit(texts: list[bytes], labels: np.ndarray, share: float, orders: tuple[int, ...] = ORDERS, bits: int = BITS, **settings) -> Model:
    """A model of texts, see ``fit_features``."""
    features = Features(orders, bits)
    return fit_features([features.of(t) for t in texts], labels, share, orders, bits, **settings)


def fit_features(rows: list[np.ndarray], labels: np.ndarray, share: float, orders: tuple[int, ...] = ORDERS, bits: int = BITS, smoothing: float = 1.0, penalty: float = 0.1, rounds: int = 100, least_ratio: float = LEAST_RATIO) -> Model:
    """rows: the places of each text; share: of toxic rows among all labelled ones, used where one class is missing.

    Places whose log ratio is within ``least_ratio`` of 0 are left out: by far the most, they only
    add noise that grows with a text's length.  Both classes weigh the same.
    """
    size = 1 << bits
    if len(set(labels.tolist())) < 2:
        odds = math.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return Model(np.zeros(size, np.float32), odds, orders, bits)
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    places = np.concatenate(rows)
    rows.clear()
    y = labels.astype(np.float64)
    toxic = np.repeat(labels == 1, np.diff(starts))
    p = np.bincount(places[toxic], minlength=size) + smoothing
    q = np.bincount(places[~toxic], minlength=size) + smoothing
    # a place's share among the texts of its class, so that long texts don't tilt the ratio
    ratio = np.log(p / (y.sum() + 2 * smoothing)) - np.log(q / ((1 - y).sum() + 2 * smoothing))
    ratio[(p + q) <= 2 * smoothing + 1] = 0.0  # one text alone says nothing
    ratio[np.abs(ratio) < least_ratio] = 0.0
    del toxic, p, q
    told = ratio[places] != 0
    starts = np.concatenate([[0], np.cumsum(told)])[starts]
    places = places[told]
    # accelerated gradient on the logistic loss with a quadratic penalty, step by backtracking
    scaled = ratio.astype(np.float32)
    values = scaled[places]
    weight, bias = np.zeros(size, np.float32), 0.0
    each = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    ahead, ahead_bias, momentum, step = weight.copy(), bias, 1.0, 1e-4

    def loss(w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
        z = _sums(values * w[places], starts) + b
        return float((each * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * penalty * float((w * w).sum())), z

    for _ in range(rounds):
        at, z = loss(ahead, ahead_bias)
        slope = each * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y)
        grad = np.bincount(places, weights=np.repeat(slope, np.diff(starts)) * values, minlength=size).astype(np.float32) + penalty * ahead
        grad_bias = float(slope.sum())
        length = float((grad * grad).sum()) + grad_bias**2
        while step > 1e-9:
            new, new_bias = ahead - step * grad, ahead_bias - step * grad_bias
            if loss(new, new_bias)[0] <= at - 0.5 * step * length:
                break
            step /= 2
        following = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + ((momentum - 1) / following) * (new - weight)
        ahead_bias = new_bias + ((momentum - 1) / following) * (new_bias - bias)
        weight, bias, momentum = new, new_bias, following
        step *= 1.3
    z = _sums((weight * scaled)[places], starts) + bias
    clean, foul = np.quantile(z[y == 0], 0.999), np.quantile(z[y == 1], 0.001)
    if clean < foul:  # the classes come apart: the border goes to the middle of the gap
        bias -= float(clean + foul) / 2
    return Model((weight * scaled).astype(np.float32), bias, orders, bits)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", fold: int = FOLD, held: int = HELD, most_chars: int | None = None) -> Model:
    """Learns from labelled rows outside the held-out fold; with ``most_chars``, which a caller may set, from the middle of longer texts."""
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & (F.crc32(F.col(doc_id).cast("string").cast("binary")) % fold != held))
        .groupBy(F.col(doc_id).cast("long").alias("__id")).agg(F.min(F.col(label).cast("int")).alias("__label"), F.max(F.col(label).cast("int")).alias("__most"))
        .where("__label = __most").select("__id", "__label")
    )
    counts = {r["__label"]: r["count"] for r in known.groupBy("__label").count().collect()}
    total = sum(counts.values())
    if not total:
        return fit([], np.zeros(0, int), 0.0)
    parts = [known.where(f"__label = {k}").orderBy(F.xxhash64("__id"), "__id").limit(per_class) for k in (0, 1)]
    sample = parts[0].union(parts[1])  # at most 2 * per_class rows
    own = C.Kept(docs, "unused int")
    C.prepare(docs.sparkSession)
    whole = F.coalesce(own.column(text), F.lit(""))
    if most_chars is not None:
        whole = F.when(F.length(whole) > most_chars, F.substr(whole, ((F.length(whole) - most_chars) / 2).cast("int") + 1, F.lit(most_chars))).otherwise(whole)
    chosen = own.df.select(own.column(doc_id).cast("long").alias("__key"), whole.alias("__text")).join(F.broadcast(sample), F.col("__key") == F.col("__id"))

    @C.tidy
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in C.slices(batches):
            places = [features.of(t).tobytes() for t in C.texts_of(batch, "__text")]
            yield pa.RecordBatch.from_pydict(C.passed_on(batch, ["__id", "__label"]) | {"__places": pa.array(places, pa.binary())})

    one_each = chosen.groupBy("__id", "__label").agg(F.min("__text").alias("__text"))
    found = one_each.mapInArrow(task, "__id long, __label int, __places binary")
    rows = sorted(((r["__id"], r["__label"], np.frombuffer(r["__places"], np.int32)) for r in found.toLocalIterator()), key=lambda r: r[0])
    model = fit_features([r[2] for r in rows], np.array([r[1] for r in rows], int), counts.get(1, 0) / total)
    del rows
    C.release()  # the driver lives on for other work
    return model


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """Columns ``keep`` (default: all) but those called like a result, ``score`` (0 to 1) and ``predicted`` (1 from the threshold on)."""
    C.prepare(docs.sparkSession)
    kept = C.Kept(docs, f"`{score}` double, `{predicted}` int", keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @C.tidy
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        features = Features(model.orders, model.bits)
        for batch in C.slices(batches):
            scores = np.array([model.score(features, t) for t in C.texts_of(batch, "body")], np.float64)
            yield pa.RecordBatch.from_pydict(C.passed_on(batch, kept_columns) | {score: pa.array(scores), predicted: pa.array((scores >= threshold).astype(np.int32))})

    kept_columns = kept.columns
    return kept.apply(task, body=kept.column(text))
