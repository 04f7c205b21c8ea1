import random

import pytest
from pyspark.sql import functions as F

from foliary.operators import evaluate as E


def test_first_hit_at_rank_three(spark):
    ranked = spark.createDataFrame([("q", f"c{i}", "d2" if i == 3 else "d1", i) for i in range(1, 6)], "query_id string, chunk_id string, document_id string, rank int")
    truth = spark.createDataFrame([("q", "c3", "d2"), ("q", "c9", "d2")], "query_id string, chunk_id string, document_id string")
    r = E.retrieval_metrics(ranked, truth, document="document_id").first()
    assert (r.hit_at_1, r.hit_at_3, r.recall_at_3, r.document_hit_at_1, r.document_hit_at_3) == (False, True, 0.5, False, True)
    assert r.reciprocal_rank == pytest.approx(1 / 3)
    s = E.retrieval_summary(E.retrieval_metrics(ranked, truth), cases=2).first()
    assert s.mrr == pytest.approx(1 / 6)


def test_repeated_ids_count_once(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "a", 2), ("q", "b", 3)], "query_id string, chunk_id string, rank int")
    assert {r.chunk_id: r["rank"] for r in E.first_of_each(ranked).collect()} == {"a": 1, "b": 2}


def test_latency(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "v double")
    r = E.latency(df, "v").first()
    assert (r.samples, r.mean, r.median) == (3, 2.0, 2.0) and r.p95 == pytest.approx(2.9)


def test_rank_movement(spark):
    r = E.rank_movement(spark.createDataFrame([(5, 3), (1, 1), (2, 4)], "base_rank int, rank int")).first()
    assert (r.improved, r.unchanged, r.worsened) == (1, 1, 1)


def test_page_labels(spark):
    results = spark.createDataFrame([("q", 1, "c1", "d", "F.pdf", 2, 3), ("q", 2, "c2", "d", "F.pdf", None, None)], "query_id string, rank int, chunk_id string, document_id string, original_filename string, start_page int, end_page int")
    kind = "query_id string, chunk_ids array<string>, documents array<string>, pages array<int>"
    hits = lambda row: [r.relevant for r in E.page_match(spark.createDataFrame([row], kind), results).orderBy("rank").collect()]
    assert hits(("q", [], ["f.PDF"], [3])) == [True, False]
    assert hits(("q", [], ["D"], [])) == [True, True]
    assert hits(("q", ["c2"], ["other"], [9])) == [False, True]


def test_edit_rates(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("", ""), ("", "x"), ("a b c", "a c")], "reference string, other string")
    r = E.text_rates(df).collect()
    assert r[0].cer == pytest.approx(3 / 6) and r[1].cer == 0 and r[2].cer == 1 and r[3].wer == pytest.approx(1 / 3)


def test_answers(spark):
    df = spark.createDataFrame([(["CocaCola"], "Coca Cola"), (["ab"], "cd"), ([""], ""), ([], "x"), (["no", "Yes "], "yes")], "a array<string>, p string")
    got = [r[0] for r in df.select(E.anls(F.col("a"), F.col("p"))).collect()]
    assert got[0] == pytest.approx(8 / 9) and got[1:] == [0.0, 1.0, 0.0, 1.0]
    assert [r[0] for r in df.select(E.exact_match(F.col("a"), F.col("p"))).collect()] == [False, False, True, False, True]


def test_answer_occurrence(spark):
    df = spark.createDataFrame([("42", "It is 42.", True), ("42", "It is 421.", False), ("(a+b)", "f(a+b)c", True), ("", "x", False), ("Straße", "an der strasse", True)], "a string, t string, e boolean")
    assert all(r.e == r.g for r in df.select("e", E.answer_occurs(F.col("a"), F.col("t")).alias("g")).collect())


def test_ground_truth_states(spark):
    chunks = spark.createDataFrame([("c1", "d", "forty two"), ("c2", "d", "it is 42"), ("c3", "d", "other")], "chunk_id string, document_id string, text string")
    q = spark.createDataFrame([("a", "d", ["42", "forty two"]), ("b", "d", ["nine"]), ("c", "x", ["42"]), ("e", "d", [" "])], "question_key string, document_id string, accepted_answers array<string>")
    got = {r.question_key: (r.state, r.relevant_chunks) for r in E.ground_truth(q, chunks).collect()}
    assert got["a"] == ("SCORABLE", ["c1", "c2"]) and [got[k][0] for k in "bce"] == ["ANSWER_NOT_INDEXED", "DOCUMENT_PROCESSING_FAILED", "INVALID_GROUND_TRUTH"]


def test_layout(spark):
    kind = "document_id string, page_number int, box_index int, label string, x0 double, y0 double, x1 double, y1 double"
    truth = spark.createDataFrame([("d", 1, 0, "Text", 0.0, 0.0, 10.0, 10.0), ("d", 1, 1, "Text", 20.0, 0.0, 30.0, 10.0)], kind)
    pred = spark.createDataFrame([("d", 1, 0, "paragraph", 0.0, 0.0, 10.0, 9.0), ("d", 1, 1, "paragraph", 1.0, 0.0, 11.0, 10.0), ("d", 1, 2, "paragraph", 20.0, 0.0, 30.0, 10.0)], kind)
    m = E.layout_match(truth, pred)
    assert {(r.truth_index, r.predicted_index) for r in m.collect()} == {(0, 0), (1, 2)}
    s = E.layout_scores(truth, pred, m).first()
    assert (s.tp, s.fp, s.fn) == (2, 1, 0) and s.f1 == pytest.approx(0.8)


def test_layout_of_many_small_pages(spark):
    """No call of its own for each page; pairs as a plain greedy choice gives them, pages without a document's name too."""
    kind = "document_id string, page_number int, box_index int, label string, x0 double, y0 double, x1 double, y1 double"
    draw = random.Random(5)
    boxes = []
    for d in range(60):
        for i in range(draw.randint(1, 6)):
            x, y = draw.randint(0, 6), draw.randint(0, 3)
            boxes.append((f"d{d % 30}", d // 30, i, draw.choice(["Text", "Table"]), float(x), float(y), x + 6.0, y + 5.0))
    moved = [(*b[:4], b[4] + 0.5, b[5], b[6] + 0.5, b[7]) for b in boxes]
    found = E.layout_match(spark.createDataFrame(boxes, kind), spark.createDataFrame(moved, kind))
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()

    def overlap(a, b):
        both = max(0.0, min(a[6], b[6]) - max(a[4], b[4])) * max(0.0, min(a[7], b[7]) - max(a[5], b[5]))
        return both / (60.0 - both)

    pairs = sorted(((a[:2] + a[3:4], -overlap(a, b), a[2], b[2]) for a in boxes for b in moved if a[:2] == b[:2] and a[3] == b[3] and overlap(a, b) >= 0.5))
    left, right, expected = set(), set(), set()
    for page, share, i, j in pairs:
        if (page, i) not in left and (page, j) not in right:
            left.add((page, i))
            right.add((page, j))
            expected.add((*page, i, j, round(-share, 9)))
    assert {(r.document_id, r.page_number, r.label, r.truth_index, r.predicted_index, round(r.iou, 9)) for r in found.collect()} == expected and len(expected) > 100


def test_gates_and_baseline(spark):
    m = spark.createDataFrame([("x", 0.5, None)], "configuration string, a double, b double")
    assert [r.passed for r in E.gates(m, {"a": 0.5, "b": 0.1}).collect()] == [True, False]
    base = spark.createDataFrame([("x", 0.7)], "configuration string, a double")
    assert E.against_baseline(m, base, ["a"], 0.1).first().regression
    assert not E.against_baseline(m, base, ["a"], 0.3).first().regression


def test_strip_and_review(spark):
    df = spark.createDataFrame([("# Title\n**Bold** and `code` [S1] [S9]", ["S1"])], "t string, l array<string>")
    assert df.select(E.strip_citations(F.col("t"), F.col("l"))).first()[0] == "Title Bold and code [S9]"
    claim = spark.createDataFrame([("Acme total-system Accuracy = 95",), ("accuracy: 95 %",), ("Acme accuracy is 95",)], "value string")
    assert E.claims(claim, "acme").count() == 1
