"""Rows go by id and text, not by id alone."""

import random

from foliary.llm import neardup
from tests.llm.helpers import sentence


def test_null_ids_and_one_id_with_two_texts(spark):
    draw = random.Random(5)
    a, b, c, d = (sentence(draw, 40) for _ in range(4))
    rows = [(1, a), (None, a), (None, a + " tail"), (None, b), (None, c), (5, a), (5, d), (9, d + " tail"), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text or "") for r in neardup.keep_one(docs).collect()), key=repr)
    assert kept == sorted([(1, a), (None, b), (None, c), (5, d), (None, "")], key=repr)


def test_rows_that_differ_in_other_columns_only(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "b", 2.5), (1, text, "a", 2.5), (1, text, "a", 2.5), (2, None, "x", None), (2, "", "y", 1.0), (None, text + " more", "p", 0.0), (None, text + " more", "q", 0.0)]
    found = set()
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string, score double")
        for n in (1, 3):
            found.add(tuple(sorted((tuple(r) for r in neardup.keep_one(docs.repartition(n)).collect()), key=repr)))
    assert len(found) == 1
    assert sorted(r[0] for r in found.pop() if r[0] is not None) == [1, 2]
