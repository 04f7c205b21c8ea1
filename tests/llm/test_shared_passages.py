"""Benchmark passages that every document and every item hold: the shuffle join against plain code."""

import random

from foliary.llm import common as C
from foliary.llm import decontam
from tests.llm.helpers import sentence
from tests.llm.test_operators import plain_hits

SHARED = "as the following passage of the exam says in so many words"  # 12 words: three windows


def test_windows_that_all_documents_and_items_share(spark, monkeypatch):
    monkeypatch.setattr(C, "MANY", 8)  # joins spread keys of more rows than this
    draw = random.Random(5)
    items = [(f"i{i}", f"{SHARED} {sentence(draw, draw.randint(0, 15))}") for i in range(120)]
    items += [("i1", items[7][1]), ("short", "two words"), ("short too", "Two, words"), ("none", ""), (None, SHARED)]
    texts = [f"{sentence(draw, draw.randint(0, 20))} {SHARED.upper()} {sentence(draw, 9)}" for _ in range(150)]
    texts += [items[3][1] + " and " + items[50][1], "just two words", sentence(draw, 40), items[9][1], items[9][1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    bench = spark.createDataFrame(items, "item_id string, text string")
    expected = {i: e for i, e in enumerate(plain_hits(texts, [x for x in items if x[0] is not None]))}
    columns = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    spans = []
    for limit in (decontam.BROADCAST_BYTES, 0):
        rows = decontam.decontaminate(docs, bench, broadcast_bytes=limit).collect()
        assert {r.doc_id: tuple(r[c] for c in columns) for r in rows} == expected
        spans.append({r.doc_id: r.spans for r in rows})
    assert spans[0] == spans[1]


def test_common_grams_form_no_pairs(spark):
    """A gram that all share, in windows that nobody else has: nothing goes into the join."""
    draw = random.Random(6)
    gram = "a b c d e"
    docs = spark.createDataFrame([(i, f"{sentence(draw, 8)} {gram} {sentence(draw, 8)}") for i in range(100)], "row long, body string")
    bench = spark.createDataFrame([(str(i), f"{sentence(draw, 8)} {gram} {sentence(draw, 8)}") for i in range(100)], "item string, body string")
    of_items = bench.mapInArrow(decontam._windows(10, 5, None, None), f"item string, {decontam.WINDOW}")
    assert of_items.count() == 100 * 12
    sieve = spark.sparkContext.broadcast(decontam._sieve_of(of_items.select("fp").unionAll(of_items.select("window"))))
    assert docs.mapInArrow(decontam._windows(10, 5, [], sieve), f"row long, {decontam.WINDOW}").count() == 0
