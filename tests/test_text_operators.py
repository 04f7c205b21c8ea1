import hashlib
import re

import pytest
from pyspark.sql import functions as F

from foliary.functions import text as T
from foliary.operators import chunking, compare, context, extract, grounding, pii


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "document_id string, page_number int, text string, ocr boolean")


def elements_of(spark, rows):
    return spark.createDataFrame(rows, "document_id string, page_number int, sequence_order int, element_type string, text string")


def test_headings_close_chunks(spark):
    pages = pages_of(spark, [("d", 1, "", False), ("d", 2, "", False)])
    elements = elements_of(spark, [("d", 1, 0, "heading", "Termination Conditions"), ("d", 1, 1, "paragraph", "Either party may end it."), ("d", 2, 0, "paragraph", "Thirty days apply."), ("d", 2, 1, "heading", "Other"), ("d", 2, 2, "list_item", "- one")])
    out = chunking.chunk_pages(pages, elements).orderBy("sequence_number").collect()
    assert [(r.start_page, r.end_page, r.section_heading, r.content_type) for r in out] == [(1, 2, "Termination Conditions", "text"), (2, 2, "Other", "list")]


def test_lengths_and_overlap(spark):
    text = " ".join(f"Sentence number {i} has words." for i in range(30))
    limits = chunking.Limits(120, 180, 24)
    units = [chunking.Unit(s + ".", 1, None, "text", False) for s in text.split(". ")]
    done = chunking.assemble(units, limits)
    assert all(0 < len(t) <= 180 for t, _ in done)
    assert all(set(a.split()) & set(b.split()) for (a, _), (b, _) in zip(done, done[1:]))


def test_table_is_a_chunk_of_its_own(spark):
    pages = pages_of(spark, [("d", 1, "Text of the page.", True)])
    tables = spark.createDataFrame([("d", 1, 1, ["Product", "Quantity"], [["Laptop", "3"], ["Monitor", "8"]])], "document_id string, page_number int, table_index int, headers array<string>, rows array<array<string>>")
    out = chunking.chunk_pages(pages, None, tables).orderBy("sequence_number").collect()
    assert [r.text for r in out] == ["Text of the page.", "Product | Quantity Laptop | 3 Monitor | 8"]
    assert out[1].content_type == "table" and out[1].contains_ocr
    mark = hashlib.sha256("\n".join([out[1].text, "1", "1", "", "table"]).encode()).hexdigest()
    assert out[1].fingerprint_sha256 == mark


def test_long_run_splits():
    assert chunking.split_long("x" * 5, chunking.Limits(2, 3, 0)) == ["x", "x", "xxx"]
    assert chunking.split_long("x" * 7, chunking.Limits(2, 3, 0, hard_split=True)) == ["xxx", "xxx", "x"]
    assert chunking.split_long("Ab cd. Ef gh", chunking.Limits(5, 8, 0)) == ["Ab cd.", "Ef gh"]


PII = "Email privacy.test@example.com; Phone +1 (202) 555-0147; IBAN GB82 WEST 1234 5698 7654 32; Card 4111 1111 1111 1111; Invoice INV-2026-0043 Qty 3 Price 2400 Date 2026-08-19."


def test_personal_data(spark):
    df = spark.createDataFrame([("d", 1, PII), ("e", 1, PII.replace("32;", "31;").replace("1111;", "1112;")), ("f", 1, "ID 1234-5678-9012 30 days 🙂 a@b.co"), ("g", 1, None)], "document_id string, page_number int, text string")
    found = pii.detect_pii(df)
    d = found.where("document_id = 'd'").orderBy("start_offset").collect()
    assert [r.pii_type for r in d] == list(pii.KINDS)
    assert all(PII[r.start_offset : r.end_offset] == r.matched_text for r in d)
    assert {r.pii_type for r in found.where("document_id = 'e'").collect()} == {"EMAIL", "PHONE_NUMBER"}
    f = found.where("document_id = 'f'").collect()
    assert [(r.start_offset, r.end_offset) for r in f] == [(28, 34)]
    redacted = pii.redact_text(df, found).where("document_id = 'd'").first()
    assert redacted.redactions == 4 and redacted.verified and "example.com" not in redacted.redacted_text
    counts = pii.counts_by_type(found).where("document_id = 'd'").first()
    assert (counts.email, counts.iban) == (1, 1)


def test_personal_data_against_plain_patterns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), "text")
    got = sorted((r.document_id, r.start_offset, r.end_offset) for r in pii.detect_pii(docs, ("EMAIL", "PHONE_NUMBER")).collect())
    expected = []
    for r in docs.collect():
        for kind in ("EMAIL", "PHONE_NUMBER"):
            for m in re.finditer(pii.PATTERNS[kind].removeprefix("(?U)"), r.text):
                if kind == "EMAIL" or 10 <= len(re.sub(r"\D", "", m[0])) <= 15:
                    expected.append((r.document_id, m.start(), m.end()))
    assert got == sorted(expected)


def test_word_boxes(spark):
    words = spark.createDataFrame([("d", 1, i, w, float(i), 0.0, i + 1.0, 1.0) for i, w in enumerate("call +1 (202) 555-0147 now".split())], "document_id string, page_number int, word_index int, word string, x0 double, y0 double, x1 double, y1 double")
    found = spark.createDataFrame([("p", "d", 1, "+1 (202) 555-0147")], "detection_id string, document_id string, page_number int, matched_text string")
    assert tuple(pii.word_boxes(words, found).first())[1:] == (1.0, 0.0, 4.0, 1.0)


def versions(spark, texts):
    return spark.createDataFrame([("p", i, f"c{i}", t, "text") for i, t in enumerate(texts)], "pair_id string, sequence_number int, chunk_id string, text string, content_type string")


def test_version_comparison(spark):
    base = versions(spark, ["Employees must give thirty days of notice.", "The office closes at six in the evening.", "Parking is free for guests."])
    target = versions(spark, ["Employees must give sixty days of notice.", "The office closes at seven in the evening.", "Lunch costs five euros each day."])
    found = compare.changes(compare.blocks(base, "A"), compare.blocks(target, "B"), unchanged=True)
    s = compare.statistics(found).first()
    assert (s.added, s.removed, s.modified, s.unchanged) == (1, 1, 2, 0)
    assert [r.change_id for r in found.orderBy(F.substring("change_id", 2, 9).cast("int")).collect()] == ["C1", "C2", "C3", "C4"]
    assert "Changed from" in compare.fallback_summary(found).first().summary


def test_white_space_is_no_change(spark):
    found = compare.changes(compare.blocks(versions(spark, ["One  two\nthree.", "Same.", "Same."]), "A"), compare.blocks(versions(spark, ["One two three.", "Same."]), "B"), unchanged=True)
    s = compare.statistics(found).first()
    assert (s.unchanged, s.removed) == (2, 1)


def test_table_comparison(spark):
    t = lambda rows: compare.keyed_rows(spark.createDataFrame([("t", i, r) for i, r in enumerate(rows, 1)], "table_id string, row_index int, cells array<string>"))
    base, target = t([["Laptop", "3"], ["Mouse", "1"], ["Mouse", "2"]]), t([["laptop ", "4"], ["Mouse", "1"], ["", "9"]])
    assert {r.row_key: r.change_type for r in compare.row_changes(base, target).collect()} == {"mouse#3": "row_removed", "row-3": "row_added"}
    cells = lambda df: df.select("table_id", "row_key", F.lit("Qty").alias("header"), F.get("cells", F.lit(1)).alias("value"))
    assert [tuple(r)[1:] for r in compare.cell_changes(cells(base), cells(target)).collect()] == [("laptop", "Qty", "3", "4")]
    kind = "pair_id string, table_id string, page_number int, table_index int, headers array<string>, keys array<string>"
    b = spark.createDataFrame([("p", "b1", 1, 1, ["product", "qty"], ["laptop"])], kind)
    assert compare.table_pairs(b, spark.createDataFrame([("p", "t1", 1, 1, ["product", "qty"], ["laptop"]), ("p", "t2", 1, 2, ["name", "city"], ["x"])], kind)).first().target_table == "t1"
    assert compare.table_pairs(b, spark.createDataFrame([("p", "t2", 1, 1, ["name", "city"], ["x"])], kind).limit(1)).count() == 0


def test_metadata(spark):
    df = spark.createDataFrame([("p", None, "A", "x", None, "", None, "k", "k")], "pair_id string, base_title string, target_title string, base_author string, target_author string, base_subject string, target_subject string, base_keywords string, target_keywords string")
    assert {r.field: r.change_type for r in compare.metadata_changes(df).collect()} == {"title": "added", "author": "removed", "subject": "removed"}


def test_context_stops_at_first_misfit(spark):
    rows = [("q", i, f"c{i}", "d", "f.pdf", "x" * n, 1, 1, None) for i, n in ((1, 100), (2, 500), (3, 10))]
    df = spark.createDataFrame(rows, "query_id string, rank int, chunk_id string, document_id string, original_filename string, text string, start_page int, end_page int, section_heading string")
    one = context.pack_context(df, 400).collect()
    assert [r.source_id for r in one] == ["S1"]
    clipped = context.pack_context(df, 200).collect()
    assert len(clipped) == 1 and len(clipped[0].block) == 200
    assert context.context_text(context.pack_context(df, 5000)).first().sources == 3


def test_history(spark):
    m = spark.createDataFrame([("c", i, "user", t) for i, t in enumerate(["first", "second", "x" * 100], 1)], "conversation_id string, sequence_number int, role string, content string")
    assert sorted(r.sequence_number for r in context.stored_history(m, 2, 1000).collect()) == [2, 3]
    assert context.stored_history(m, 3, 50).count() == 0
    lines = context.prompt_history(m, 3, 20).collect()
    assert len(lines) == 1 and len(lines[0].line) == 20 and lines[0].sequence_number == 3


def test_batches_and_evidence(spark):
    items = spark.createDataFrame([("s", i, "y" * n) for i, n in enumerate([40, 40, 40, 200, 5])], "s string, o int, t string")
    out = {r.o: (r.batch, len(r.block)) for r in context.batches(items, "s", "o", "t", 100).collect()}
    assert out == {0: (1, 40), 1: (1, 40), 2: (2, 40), 3: (3, 100), 4: (4, 5)}
    chunks = spark.createDataFrame([("d", 1, "a", "nothing here"), ("d", 2, "b", "price is 5 " + "z" * 50), ("d", 3, "c", "price")], "document_id string, sequence_number int, chunk_id string, text string")
    got = context.evidence(chunks, F.lit("the price"), 30).orderBy("source_id").collect()
    assert [(r.chunk_id, r.source_id) for r in got] == [("b", "E1")]
    got = context.evidence(chunks, F.lit("the price"), 90).orderBy("source_id").collect()
    assert [r.chunk_id for r in got] == ["a", "b", "c"]


def test_citations(spark):
    df = spark.createDataFrame([(1, "Answer [S2], then [S1], again [S2]."), (2, "Nothing."), (3, "[S9]")], "query_id int, answer string")
    src = spark.createDataFrame([(i, s) for i in (1, 2, 3) for s in ("S1", "S2")], "query_id int, source_id string")
    out = {r.query_id: r for r in context.check_citations(df, src).collect()}
    assert out[1].citations == ["S2", "S1"] and out[1].valid and not out[2].valid and out[3].unknown == ["S9"]


def test_grounding(spark):
    sources = spark.createDataFrame([("s", "S1", "The contract ends in May. INV-2026-0043 was paid."), ("s", "S2", "Notice takes thirty days.")], "summary_id string, source_id string, text string")
    say = lambda t: grounding.grounded(spark.createDataFrame([("s", t)], "summary_id string, summary string"), sources).first().grounded
    assert say("The contract ends in May [S1]. Notice takes thirty days [S2].")
    assert not say("The contract ends in June [S1].")
    assert not say("The contract ends in May.")
    assert not say("Notice takes thirty days [S3].")
    assert not say("INV-2026-0043 ends the contract [S1].")
    assert grounding.extractive(sources).count() == 2


def test_extraction(spark):
    rows = [("d", "total", "number", "€ 1,200.50", "The total is 1200.50 euros."), ("d", "id", "integer", "43", "Invoice INV43 only"), ("d", "when", "date", "2026-08-19", "on 2026-08-19"), ("d", "who", "string", "Ann  Lee", "By ann lee."), ("d", "who", "string", "Bob", "By bob."), ("d", "ok", "boolean", "True", "It is enabled."), ("d", "bad", "date", "INV-2026-08-19", "INV-2026-08-19")]
    out = {r.field: (r.status, r.value) for r in extract.outcomes(spark.createDataFrame(rows, "document_id string, field string, kind string, value string, evidence string")).collect()}
    assert out == {"total": ("found", "1200.5"), "id": ("not_found", None), "when": ("found", "2026-08-19"), "who": ("ambiguous", None), "ok": ("found", "true"), "bad": ("not_found", None)}


def test_text_functions(spark):
    df = spark.createDataFrame([("ﬁne  Ａ", "a-b don't a", "x  y z")], "n string, w string, s string")
    r = df.select(T.nfkc("n"), T.words(F.col("w")), T.collapse(F.col("s")), T.sequence_ratio("w", "w")).first()
    assert r[0] == "fine A" and r[1] == ["a-b", "don't", "a"] and r[2] == "x y z" and r[3] == 1.0
    assert spark.range(1).select(T.casefold(F.lit("Straße"))).first()[0] == "strasse"


@pytest.mark.parametrize("bad", [(0, 5, 1), (6, 5, 1), (4, 5, 5)])
def test_limits(bad):
    with pytest.raises(ValueError):
        chunking.Limits(*bad)
