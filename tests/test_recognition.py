"""A recognition run against counts made by hand."""

import pytest

from foliary.operators import recognition as R

BOX = "document_id string, page_number int, box_index int, label string, x0 double, y0 double, x1 double, y1 double"
RESPONSE = "document_id string, status string, error string, ocr_available boolean, processing_time_ms double, text string"


@pytest.fixture
def tables(spark):
    manifest = spark.createDataFrame([(d,) for d in "a b c d e f g a".split()], "document_id string")
    texts = spark.createDataFrame([("a", "one two  three"), ("b", "x"), ("c", "y"), ("d", None), ("e", "z"), ("f", "w"), ("g", "")], "document_id string, reference string")
    responses = spark.createDataFrame(
        [
            ("a", "ready", None, True, 10.0, "one tvo three"),
            ("b", "FAILED", None, False, 20.0, ""),
            ("c", "ready", "EncryptedPDFError", True, 30.0, None),
            ("d", "ready", None, True, 40.0, "no truth"),
            ("e", "failed", None, None, None, None),
            ("other", "ready", None, True, 1.0, "not asked for"),
        ],
        RESPONSE,
    )
    truth = spark.createDataFrame([("a", 1, 0, "Text", 0.0, 0.0, 10.0, 10.0), ("a", 1, 1, "Text", 0.0, 20.0, 10.0, 30.0), ("a", 1, 2, "Picture", 0.0, 40.0, 9.0, 49.0), ("b", 1, 0, "Table", 0.0, 0.0, 5.0, 5.0), ("c", 1, 0, "Table", 0.0, 0.0, 5.0, 5.0)], BOX)
    predicted = spark.createDataFrame([("a", 1, 0, "paragraph", 0.0, 0.0, 10.0, 8.0), ("a", 1, 1, "paragraph", 0.0, 0.0, 10.0, 10.0), ("a", 1, 2, None, 0.0, 0.0, 1.0, 1.0), ("c", 1, 0, "table", 0.0, 0.0, 5.0, 5.0)], BOX)
    return manifest, responses, texts, truth, predicted


def test_states_reasons_and_scopes(tables):
    rows = {r.document_id: r for r in R.cases(*tables).collect()}
    assert {d: (r.status, r.reason_code) for d, r in rows.items()} == {
        "a": ("success", None),
        "b": ("failed", "TESSERACT_UNAVAILABLE"),
        "c": ("failed", "ENCRYPTED_PDF"),
        "d": ("skipped", "NO_GROUND_TRUTH"),
        "e": ("failed", "OCR_FAILED"),
        "f": ("failed", "UNEXPECTED_FAILURE"),
        "g": ("skipped", "NO_GROUND_TRUTH"),
    }
    a = rows["a"]
    assert (a.d_cer, a.n_cer, a.d_cer_collapsed, a.n_cer_collapsed, a.d_wer, a.n_wer) == (2, 14, 1, 13, 1, 3)
    assert (a.tp, a.comparable_truth, a.comparable_predicted, a.unsupported_truth, a.unsupported_predicted, a.iou) == (1, 2, 2, 1, 1, 1.0)
    # failed but answered: boxes count; with an error or skipped they don't
    assert (rows["b"].tp, rows["b"].comparable_truth, rows["c"].tp, rows["d"].tp, rows["d"].processing_time_ms) == (0, 1, None, None, None)


def test_report_and_reasons(tables):
    rows = R.cases(*tables)
    r = R.report(rows).first()
    assert (r.processed, r.attempted, r.successful, r.failed, r.skipped, r.success_rate) == (7, 5, 1, 4, 2, 0.2)
    assert (r.samples, r.mean_ms, r.median_ms, r.p95_ms) == (3, 20.0, 20.0, pytest.approx(29.0))
    assert (r.texts, r.micro_cer, r.macro_wer) == (1, pytest.approx(2 / 14), pytest.approx(1 / 3))
    assert (r.layouts, r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) == (3, 1, 1, 2, 0.5, pytest.approx(1 / 3), pytest.approx(0.4))
    assert {x.reason_code: x.n for x in R.reasons(rows).collect()} == {"TESSERACT_UNAVAILABLE": 1, "ENCRYPTED_PDF": 1, "OCR_FAILED": 1, "UNEXPECTED_FAILURE": 1, "NO_GROUND_TRUTH": 2}


def test_without_predictions_or_rows(tables):
    manifest, responses, texts, truth, predicted = tables
    none = R.report(R.cases(manifest, responses, None, truth, predicted.limit(0))).first()
    assert (none.tp, none.precision, none.recall, none.f1, none.mean_matched_iou) == (0, None, 0.0, None, None) and "texts" not in none
    empty = R.report(R.cases(*(t.limit(0) for t in tables))).first()
    assert (empty.processed, empty.success_rate, empty.micro_cer, empty.tp, empty.f1) == (0, None, None, 0, None)


def test_kinds_of_errors(spark):
    from pyspark.sql import functions as F

    kinds = {"CorruptedPDFError": "CORRUPTED_PDF", "EmptyUploadError": "INGESTION_EMPTYUPLOAD", "ValueError": "UNEXPECTED_FAILURE", None: "UNEXPECTED_FAILURE"}
    got = spark.createDataFrame([(k,) for k in kinds], "e string").select("e", R.reason_of(F.col("e")).alias("r")).collect()
    assert {r.e: r.r for r in got} == kinds
