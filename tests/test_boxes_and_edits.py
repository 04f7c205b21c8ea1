"""Boxes, words and edit distances against plain code."""

import random
import re

import pytest
from pyspark.sql import functions as F

from foliary.functions import text as T
from foliary.operators import evaluate as E
from foliary.operators import pii

WORD = "document_id string, page_number int, word_index int, word string, x0 double, y0 double, x1 double, y1 double"


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def test_edit_distance():
    draw = random.Random(2)
    some = lambda n: "".join(draw.choice("abcé🙂") for _ in range(n))
    for _ in range(400):
        a, b = some(draw.randint(0, 90)), some(draw.randint(0, 90))
        assert T.edit_distance(a, b) == plain_edits(a, b)
    assert T.edit_distance("kitten", "sitting") == 3 and T.edit_distance("", "abc") == 3 and T.edit_distance("", "") == 0


def test_edits_of_short_and_long_texts(spark):
    draw = random.Random(3)
    long = "".join(draw.choice("abcdefgh") for _ in range(40_000))
    other = long[:100] + "X" + long[101:30_000] + long[30_007:] + "tail"
    rows = [("kitten", "sitting"), ("", "abc"), (None, "a"), (long, None), (long, long), (long, other), (long[:700], long[1:701])]
    got = [r.d for r in spark.createDataFrame(rows, "a string, b string").select(T.edits(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [3, 3, None, None, 0, 12, 2]


def test_word_boxes_against_all_runs(spark):
    draw = random.Random(5)
    words, asked = [], []
    for d in range(12):
        page = [draw.choice(["a", "B", "b c", "ß", " ", "d", "x\ty"]) for _ in range(30)]
        words += [(f"d{d}", 1, i, w, float(i), float(i % 3), i + 1.0, i % 3 + 1.0) for i, w in enumerate(page)]
        for n in range(6):
            i, k = draw.randint(0, 20), draw.randint(1, 12)
            asked.append((f"{d}-{n}", f"d{d}", 1, "  ".join(page[i : i + k]).upper() if n < 4 else draw.choice(["c d", "b", "", "zz", "C", "ss a"])))
    key = lambda s: " ".join(s.split()).lower().replace("ß", "ss")
    expected = {}
    for i, d, _, text in asked:
        page = [w for w in words if w[0] == d and w[3].strip()]
        runs = ((a, b) for a in range(len(page)) for b in range(a + 1, min(len(page), a + 10) + 1) if key(" ".join(w[3] for w in page[a:b])) == key(text) and key(text))
        if run := next(runs, None):
            part = page[slice(*run)]
            expected[i] = (min(w[4] for w in part), min(w[5] for w in part), max(w[6] for w in part), max(w[7] for w in part))
    got = pii.word_boxes(spark.createDataFrame(words, WORD), spark.createDataFrame(asked, "detection_id string, document_id string, page_number int, matched_text string"))
    assert {r.detection_id: tuple(r)[1:] for r in got.collect()} == expected and len(expected) > 30


BOX = "document_id int, page_number int, box_index int, label string, x0 double, y0 double, x1 double, y1 double"


def boxes(seed, n, label, shift=0.0):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        x, y, w, h = draw.uniform(-50, 200), draw.uniform(-50, 400), draw.choice([1, 5, 20, 60]), draw.choice([0, 1, 2, 4, 4.0001, 8, 30, 100])
        out.append((1, i % 2, i, label, x + shift * draw.random(), y + shift * draw.random(), x + w, y + h))
    return out


@pytest.mark.parametrize("least", [0.5, 0.2, 0.9, 1.0, 0.0])
def test_layout_pairs_are_all_pairs(spark, least):
    truth, predicted = spark.createDataFrame(boxes(1, 150, "Text"), BOX), spark.createDataFrame(boxes(1, 150, "paragraph", 1.5) + boxes(1, 40, "Text"), BOX)
    pairs = {(r.page_number, r.g_box_index, r.p_box_index, round(r.iou, 9)) for r in E.layout_pairs(truth, predicted, least).collect()}

    def iou(a, b):
        w, h = min(a[6], b[6]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[5], b[5])
        both = max(w, 0) * max(h, 0)
        union = (a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - both
        return both / union if union > 0 else 0.0

    every = [(a, b, iou(a, b)) for a in map(tuple, truth.collect()) for b in map(tuple, predicted.collect()) if a[1] == b[1]]
    assert pairs == {(a[1], a[2], b[2], round(x, 9)) for a, b, x in every if x >= least}


def test_layout_pairs_formed_are_near_linear(spark):
    """Twice the boxes on a page twice as high: about twice the pairs that meet."""
    met = []
    for n in (2000, 4000):
        page = spark.createDataFrame([(1, 1, i, "Text", 0.0, i * 10.0, 100.0, i * 10.0 + 8) for i in range(n)], BOX)
        found = E.layout_pairs(page, page)
        assert found.count() == n
        strips = lambda near: F.inline(E._strips(F.col("y0"), F.col("y1"), 2.0, near))
        met.append(page.select(strips(0)).join(page.select(strips(1)), ["kind", "strip"]).count())
    assert met[1] < 2.1 * met[0] and met[1] < 10 * 4000


def test_edits_within_a_share(spark):
    """Whole texts that differ by half of the longer one's length aren't compared; all others get their edits, by numbers of bits."""
    draw = random.Random(7)
    text = lambda n: "".join(draw.choice("ab é🙂") for _ in range(n))
    cases = [(["abcd", "ab", "abc", "", None], "abcd"), ([""], ""), ([], "x"), (["x"], None), ([text(300), text(257), text(513)], text(512))]
    df = spark.createDataFrame(cases, "a array<string>, p string")
    want = [[None if x is None or p is None or (x != p and abs(len(x) - len(p)) >= 0.5 * max(len(x), len(p))) else plain_edits(x, p) for x in xs] for xs, p in cases]
    got = [r[0] for r in df.select(T.edits_within("a", "p", F.lit(0.5))).collect()]
    assert got == want and got[0] == [0, None, 1, None, None]


def test_answers_are_not_compared_in_a_table_of_all_cells(spark):
    """Two texts of 100,000 characters: a table of all cells has 10^10 of them and took longer than a minute."""
    a, b = "ab c" * 25_000, "ab d" * 25_000
    df = spark.createDataFrame([([a], b)], "a array<string>, p string")
    plan = df.select(E.anls(F.col("a"), F.col("p")))
    assert plan.first()[0] == pytest.approx(0.75)
    assert "levenshtein" not in plan._jdf.queryExecution().toString()


def test_words_of_a_page_are_shuffled_once(spark):
    words = spark.createDataFrame([("d", 1, 0, "Ab", 0.0, 0.0, 1.0, 1.0), ("d", 1, 1, "cd", 1.0, 0.0, 2.0, 1.0)], WORD)
    found = spark.createDataFrame([("x", "d", 1, "AB  cd"), ("y", "d", 1, "cd ab")], "detection_id string, document_id string, page_number int, matched_text string")
    out = pii.word_boxes(words, found)
    assert [tuple(r) for r in out.collect()] == [("x", 0.0, 0.0, 2.0, 1.0)]
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert not re.search(r"hashpartitioning\([^)]*token", plan)
