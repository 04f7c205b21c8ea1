"""Evaluation cases, their faults, and times as texts."""

import datetime

import pytest
from pyspark.sql import functions as F

from foliary.sources import manifests

CASE = "id string, question string, expected_document string, expected_documents array<string>, expected_chunk string, expected_chunks array<string>, expected_page int, expected_pages array<int>, expect_no_evidence boolean"


def test_single_labels_join_their_lists(spark):
    cases = spark.createDataFrame([("a", "q", "x.pdf", ["y.pdf"], "c1", None, 3, [3, 4], False), ("b", "q", "", None, None, ["c2"], None, None, None), ("c", "q", None, [], None, [], 0, [], True)], CASE)
    got = {r.id: (r.expected_documents, r.expected_chunks, r.expected_pages) for r in manifests.normal_cases(cases).collect()}
    assert got == {"a": (["x.pdf", "y.pdf"], ["c1"], [3, 4]), "b": ([], ["c2"], []), "c": ([], [], [])}
    assert manifests.case_faults(cases).count() == 1  # a page of 0


def test_faults_of_cases(spark):
    cases = spark.createDataFrame([("a", " q", "x.pdf", [], None, [], None, [], True), ("a", "", None, [], None, [], 2, [0], False), ("b", None, None, None, None, None, None, None, None)], CASE)
    assert sorted(map(tuple, manifests.case_faults(cases).collect())) == [
        ("a", "a page is below 1"),
        ("a", "an id is used twice"),
        ("a", "it expects no evidence and names some"),
        ("a", "it has no question"),
        ("b", "it has no question"),
    ]
    with pytest.raises(Exception, match="without evidence names documents or chunks: a"):
        manifests.normal_cases(cases).collect()


def test_times_as_texts(spark):
    at = [datetime.datetime(2024, 2, 29, 23, 59, 58), datetime.datetime(2024, 1, 1, 0, 0, 0, 1200)]
    rows = spark.createDataFrame([(x.replace(tzinfo=datetime.UTC),) for x in at], "at timestamp").select(manifests.iso(F.col("at")).alias("t"))
    assert [r.t for r in rows.collect()] == [x.replace(tzinfo=datetime.UTC).isoformat() for x in at]


def test_questions_in_order(spark):
    pair = "array<struct<question_id:string,question:string,answers:array<string>>>"
    m = spark.createDataFrame([("r2", [("1", "c", ["x"])]), ("r1", [("1", "a", []), ("2", "b", [])])], f"evaluation_id string, qa_pairs {pair}")
    assert [r.question for r in manifests.pick_questions(m, 2).collect()] == ["a", "b"]
    assert manifests.pick_questions(m).count() == 3
