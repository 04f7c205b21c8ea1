"""Substring dedup against a plain version, and the full-text index against counting."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliary.llm import queries as Q
from foliary.llm import substrings as S
from foliary.llm.fmindex import FMIndex
from foliary.llm.oracles import ORACLES
from tests.helpers import plain, views
from tests.llm.helpers import documents, sentence


def plain_repeats(rows, span):
    """(id, words, removed, hash, text, runs) of each row, by looking at all windows; rows that share an id must be alike."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    seen, gone = set(), {i: set() for i in words}
    for i in sorted(words, key=lambda i: (i is not None, i)):
        w = words[i]
        for p in range(len(w) - span + 1):
            key = tuple(w[p : p + span])
            if key in seen:
                gone[i].update(range(p, p + span))
            seen.add(key)
    out = []
    for i, _ in rows:
        left = " ".join(w for p, w in enumerate(words[i]) if p not in gone[i])
        out.append((i, len(words[i]), len(gone[i]), hashlib.sha256(left.encode()).hexdigest(), left))
    return sorted(out, key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text").collect()), key=repr)


def shared_passages(seed, n, words=4, line=12):
    """Texts over few words, with passages that many of them share in ever new surroundings."""
    draw = random.Random(seed)
    some = lambda k: [draw.choice("abcdefgh"[:words]) for _ in range(k)]
    common = [some(line) for _ in range(3)]
    texts = []
    for i in range(n):
        parts = [some(draw.randint(0, 9)) + (draw.choice(common) if draw.random() < 0.7 else []) for _ in range(draw.randint(0, 5))]
        texts.append(draw.choice((" ", "  ", "\n")).join(w for p in parts for w in p))
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("span", [1, 3, 6])
@pytest.mark.parametrize("hot_from, block_words", [(S.HOT, S.BLOCK_WORDS), (8, 60)])
def test_against_all_windows(spark, monkeypatch, span, hot_from, block_words):
    monkeypatch.setattr(S, "HOT_IN_BATCH", 2)
    rows = shared_passages(span, 90) + [(500, None), (501, ""), (502, "   "), (503, "a " * 400), (504, "é🙂 Äpfel a b " * 30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(S.remove_repeats(frame, span=span, hot_from=hot_from, block_words=block_words)) == plain_repeats(rows, span)


def test_production_span_on_awkward_rows(spark):
    draw = random.Random(8)
    passage = sentence(draw, 60)
    docs = documents(spark, extra=[passage, sentence(draw, 9) + " " + passage, passage + " " + passage, passage[:-1]])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = S.remove_repeats(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "n_words", "n_removed", "kept_sha256", "kept_text", "removed"]
    assert got(out) == plain_repeats(rows, 20)
    whole = out.where(F.col("text") == passage + " " + passage).first()
    assert [tuple(r) for r in whole.removed] == [(0, 119)] and whole.kept_text == ""


def test_rows_that_share_an_id(spark):
    draw = random.Random(4)
    one, two = sentence(draw, 30), sentence(draw, 25)
    rows = [(1, one), (1, one), (1, two + " x"), (2, two), (2, two)]
    out = {(r.doc_id, r.text): r.n_removed for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {(1, one): 0, (1, two + " x"): 0, (2, two): 25}


def test_no_rows_and_columns_that_clash(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(empty).count() == 0
    text = " ".join(map(str, range(30)))
    frame = spark.createDataFrame([(1, text, 1, 2, 3), (2, text, 1, 2, 3)], "doc_id long, text string, N_words int, `a.b` int, mark int")
    out = S.remove_repeats(frame)
    assert out.columns == ["doc_id", "text", "a.b", "mark", "n_words", "n_removed", "kept_sha256", "kept_text", "removed"]
    assert sorted((r.doc_id, r.n_removed, r.mark) for r in out.collect()) == [(1, 0, 3), (2, 30, 3)]


def test_many_copies_of_one_text(spark):
    text = " ".join(f"w{i}" for i in range(50))
    frame = spark.range(0, 3000, 1, 4).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, text).otherwise(F.concat(F.lit(text + " "), F.col("id").cast("string"))).alias("text"))
    out = S.remove_repeats(frame, hot_from=100).agg(F.sum("n_removed").alias("n"), F.sum(F.col("kept_text").contains("w7 ").cast("int")).alias("whole")).first()
    # the first keeps all, 999 copies nothing; of the others each loses the 50 common words and the 51st is its own
    assert (out.n, out.whole) == (999 * 50 + 2000 * 50, 1)


def test_index_against_counting():
    draw = random.Random(1)
    for _ in range(60):
        depth, letters = draw.choice([1, 2, 3, 5, 8]), draw.choice([1, 2, 3, 6])
        some = lambda n, k=letters: [[draw.randint(1, k) for _ in range(draw.randint(1, 12))] for _ in range(n)]  # noqa: B023, E731
        held = some(draw.randint(1, 6))
        asked = [*some(4, letters + 1), *held]
        index = FMIndex(np.array(sum(held, [])), np.array([len(s) for s in held]), depth)
        match, low, high = index.matching_statistics(np.array(sum(asked, [])), np.array([len(s) for s in asked]))
        at = 0
        for q in asked:
            for i in range(len(q)):
                places = {m: [int(index.start[k]) + j for k, s in enumerate(held) for j in range(len(s)) if len(q[i : i + m]) == m and s[j : j + m] == q[i : i + m]] for m in range(1, depth + 1)}
                longest = max([m for m, p in places.items() if p], default=0)
                assert match[at] == longest
                if longest:
                    assert sorted(index.places[low[at] : high[at]].tolist()) == places[longest]
                at += 1


def test_query_against_sql(spark, sf_dir):
    name = "op12_substring_dedup"
    assert plain(Q.queries()[name](spark, sf_dir).toPandas()) == plain(views(sf_dir).sql(ORACLES[name]).df())
