"""Comparison with another engine."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd

WORDS = "the of and to in stone river quiet lantern amber field winter copper meadow harbor signal".split()


def sentence(draw, n):
    """n words with numbers."""
    return " ".join(draw.choice(WORDS) + str(draw.randint(0, 99)) for _ in range(n))


def views(sf_dir):
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db


def plain(frame):
    """Rows as sorted tuples of comparable values, columns by name."""

    def value(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        return float(v) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(value(v) for v in row) for row in frame.itertuples(index=False)), key=repr)
