"""Embeddings of texts by an encoder that is given, or by hashing of words where none is."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as P

DIMENSION, BATCH = 384, 32
Encoder = Callable[[list[str]], np.ndarray]


class EmbeddingError(ValueError):
    pass


def hashing_encoder(dimension: int = DIMENSION) -> Encoder:
    """Words and pairs of words, each at a place and with a sign from its hash, weighted by the root of their number."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for row, text in zip(out, texts, strict=True):
            words = re.findall(r"\w+", text.lower())
            for term in [*words, *map(" ".join, zip(words, words[1:], strict=False))] or [text]:
                h = int.from_bytes(hashlib.blake2b(term.encode(), digest_size=8).digest(), "little")
                row[h % dimension] += 1 if h >> 63 else -1
        return np.sign(out) * np.sqrt(np.abs(out))

    return encode


def unit_vectors(texts: list[str], encoder: Encoder, dimension: int, batch: int = BATCH) -> np.ndarray:
    """Vectors of length 1, batch by batch; white space is collapsed first; blank texts, other numbers or lengths of vectors, and vectors without length are errors."""
    plain = [" ".join(t.split()) for t in texts]
    if not all(plain):
        raise EmbeddingError("a text to embed is empty")
    parts = []
    for a in range(0, len(plain), batch):
        got = np.asarray(encoder(plain[a : a + batch]), np.float64)
        if got.ndim != 2 or got.shape != (len(plain[a : a + batch]), dimension):
            raise EmbeddingError(f"the encoder gave vectors of shape {got.shape}, not of {dimension} dimensions for each text")
        parts.append(got)
    out = np.concatenate(parts) if parts else np.zeros((0, dimension))
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    if not np.isfinite(size).all() or (size == 0).any():
        raise EmbeddingError("the encoder gave a vector without length")
    return out / size


def embed(texts: DataFrame, text: str = "text", into: str = "embedding", make_encoder: Callable[[], Encoder] | None = None, dimension: int = DIMENSION, batch: int = BATCH) -> DataFrame:
    """All columns, and each text's unit vector; a blank or null text has none.

    ``make_encoder`` runs once in each task, so a model is loaded there and not sent.
    """
    make = make_encoder or (lambda: hashing_encoder(dimension))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for rows in batches:
            given = rows.column(rows.schema.get_field_index(text)).to_pylist()
            some = [i for i, t in enumerate(given) if t is not None and t.strip()]
            vectors: list = [None] * len(given)
            for i, v in zip(some, unit_vectors([given[i] for i in some], encoder, dimension, batch), strict=True):
                vectors[i] = v
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(vectors, pa.list_(pa.float64()))], [*rows.schema.names, into])

    schema = P.StructType([*texts.schema, P.StructField(into, P.ArrayType(P.DoubleType()))])
    return texts.mapInArrow(task, schema)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    return float(a @ b / math.sqrt(float(a @ a) * float(b @ b)))
