"""Extraction that fails closed, summaries with errors, text rates, and redaction within a row."""

import pytest

from foliary.operators import evaluate as E
from foliary.operators import extract, pii, runs

ITEM = "document_id int, field string, status string, value string, sources array<string>, candidates array<struct<value:string,sources:array<string>>>"


def test_extraction_fails_closed(spark):
    good = [("party", "found", " Acme Ltd ", ["S1", "S1"], []), ("days", "ambiguous", None, ["S1"], [("30", ["S1"]), ("60", ["S2"]), ("30", ["S2"])]), ("city", "not_found", None, ["S1"], [])]
    wrong = {
        1: None,
        2: ("party", "found", "Other Ltd", ["S1"], []),
        3: ("party", "found", "Acme Ltd", [], []),
        4: ("party", "found", "Acme Ltd", ["S3"], []),
        5: ("days", "ambiguous", None, [], [("30", ["S1"]), ("30", ["S2"])]),
        6: ("days", "ambiguous", "30", [], [("30", ["S1"]), ("60", ["S2"])]),
        7: ("city", "not_found", "Rome", [], []),
        8: ("days", "found", "thirty", ["S1"], []),
        9: ("other", "not_found", None, [], []),
        10: ("city", "maybe", None, [], []),
    }
    rows = []
    for d, bad in wrong.items():
        kept = [g for g in good if bad is None or g[0] != bad[0]]
        rows += [(d, *g) for g in kept] + ([(d, *bad)] if bad else [])
    rows += [(11, *g) for g in [*good, good[2]]] + [(12, *g) for g in good[:2]]
    docs = range(1, 14)  # 13 has no response at all
    definitions = [(d, f, k) for d in docs for f, k in (("party", "string"), ("days", "integer"), ("city", "string"))]
    evidence = [(d, s, t) for d in docs for s, t in (("S1", "ACME  ltd gives 30 days."), ("S2", "Later: 60 days, or 30."))]
    out = extract.checked_fields(spark.createDataFrame(rows, ITEM), spark.createDataFrame(definitions, "document_id int, field string, kind string"), spark.createDataFrame(evidence, "document_id int, source_id string, text string"))
    got = {(r.document_id, r.field): (r.status, r.value, r.sources, r.candidates) for r in out.collect()}
    assert len(got) == 3 * len(docs)
    assert got[1, "party"] == ("found", "Acme Ltd", ["S1"], []) and got[1, "days"] == ("ambiguous", None, [], ["30", "60"]) and got[1, "city"] == ("not_found", None, [], [])
    assert {v for (d, _), v in ((k, v[:2]) for k, v in got.items()) if d > 1} == {("not_found", None)}


def test_failed_questions_count_with_nothing(spark):
    rows = [("m", False, 3, 1.0, 1.0, True, 10.0), ("m", True, 0, 1.0, 1.0, True, 9999.0), ("m", False, 0, None, None, None, 30.0)]
    r = runs.method_summary(spark.createDataFrame(rows, "method string, failed boolean, results int, reciprocal_rank double, recall_at_1 double, hit_at_1 boolean, total_ms double"), (1,)).first()
    assert (r.questions, r.errors, r.no_evidence_rate, r.samples, r.mean_ms) == (3, 1, 0.5, 2, 20.0) and r.mrr == pytest.approx(1 / 3) and r.hit_at_1 == pytest.approx(1 / 3)


def test_text_summary(spark):
    pairs = spark.createDataFrame([("kitten sat", "sitting  sat"), ("", ""), ("", "x"), ("ﬁne", "fine")], "reference string, other string")
    r = E.text_summary(pairs).first()
    assert r.texts == 4
    assert r.micro_cer == pytest.approx((4 + 0 + 1 + 2) / 13) and r.macro_cer == pytest.approx((0.4 + 0 + 1 + 2 / 3) / 4)
    assert r.micro_cer_collapsed == pytest.approx((3 + 1) / 14) and r.micro_wer == pytest.approx((1 + 1 + 1) / 3) and r.micro_wer_collapsed == pytest.approx(2 / 3)


def test_redaction_within_a_row(spark):
    texts = spark.createDataFrame([("d", 1, "Write to privacy.test@example.com or +1 (202) 555-0147."), ("d", 2, "nothing"), ("d", 3, None)], "document_id string, page_number int, text string")
    one = {tuple(r) for r in pii.redact_pages(texts).collect()}
    two = {tuple(r) for r in pii.redact_text(texts, pii.detect_pii(texts)).collect()}
    assert {r for r in one if r[1] < 3} == {r for r in two if r[1] < 3} and len(one) == 3
    with pytest.raises(ValueError):
        pii.redact_pages(texts, ("NAME",))


def test_manifest_by_file_name(spark):
    manifest = spark.createDataFrame([("r1", "/a/b/one.pdf"), ("r2", "two.pdf"), ("r3", "C:\\x\\one.pdf")], "source_record_id string, local_pdf_path string")
    stored = spark.createDataFrame([(2, "one.pdf", "ready", True, 4), (1, "one.pdf", "failed", True, 4)], "document_id int, original_filename string, status string, is_indexed boolean, chunk_count int")
    got = {r.source_record_id: (r.document_id, r.reason_code, r.ready) for r in runs.with_reasons(manifest, stored, by_file=True).collect()}
    assert got == {"r1": (1, "NOT_READY", False), "r2": (None, "NOT_INGESTED", False), "r3": (1, "NOT_READY", False)}
