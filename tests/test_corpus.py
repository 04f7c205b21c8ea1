import random
import re

import pytest
from pyspark.sql import functions as F

from foliary.operators import corpus, retrieval as R
from foliary.sources import manifests as M
from foliary.streaming import streams


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 body")
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    files = M.read_files(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[-1] for r in corpus.accepted_files(files).collect()] == ["a.pdf"]
    df = spark.createDataFrame([("A.PDF", "application/pdf"), ("a.txt", "application/pdf"), ("a.pdf", "text/html")], "n string, m string")
    assert [r[0] for r in df.select(corpus.accepted_upload(F.col("n"), F.col("m"))).collect()] == [True, False, False]


def test_new_documents(spark):
    kind = "document_id string, checksum_sha256 string"
    incoming = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "2")], kind)
    assert [r.document_id for r in corpus.new_documents(incoming, spark.createDataFrame([("z", "1")], kind)).collect()] == ["b"]


def test_pages_and_ocr(spark):
    pages = spark.createDataFrame([("d", 1, "A long enough native text here.", False), ("d", 2, " ", True), ("d", 3, None, False)], "document_id string, page_number int, text string, has_image boolean")
    state = corpus.page_state(pages)
    assert [(r.needs_ocr, r.run_ocr) for r in state.orderBy("page_number").collect()] == [(False, False), (True, True), (True, False)]
    ocr = spark.createDataFrame([("d", 2, "Recognised text of a page.", 91.5)], "document_id string, page_number int, ocr_text string, ocr_confidence double")
    merged = corpus.merge_ocr(state, ocr)
    assert {r.page_number: r.extraction_method for r in merged.collect()} == {1: "native", 2: "ocr", 3: "native"}
    s = corpus.document_status(merged).first()
    assert (s.page_count, s.ocr_pages, s.open_pages, s.status) == (3, 1, 1, "failed")
    words = spark.createDataFrame([("d", 1, 0, "a", 90.0), ("d", 1, 1, "b", 95.5), ("d", 1, 2, " ", -1.0)], "document_id string, page_number int, word_index int, word string, confidence double")
    r = corpus.ocr_confidence(words).first()
    assert (r.ocr_text, r.ocr_confidence) == ("a b", 92.75)


def test_blocks(spark):
    rows = [("d", "Big title", 18.0, False), ("d", "- item", 10.0, False), ("d", "Body text of the page.", 10.0, False), ("d", "BOLD CAPITALS", 10.0, False), ("d", "More body.", 10.0, False)]
    out = corpus.classify_blocks(spark.createDataFrame(rows, "document_id string, text string, font_size double, is_bold boolean"))
    assert {r.text: r.element_type for r in out.collect()} == {"Big title": "heading", "- item": "list_item", "Body text of the page.": "paragraph", "BOLD CAPITALS": "heading", "More body.": "paragraph"}
    kind = "document_id string, page_number int, x0 double, y0 double, x1 double, y1 double"
    blocks = spark.createDataFrame([("d", 1, 0.0, 0.0, 1.0, 1.0), ("d", 1, 1.0, 1.0, 2.0, 2.0)], kind)
    assert corpus.outside_tables(blocks, spark.createDataFrame([("d", 1, 0.5, 0.5, 1.0, 1.0)], kind)).count() == 1


def test_index_replacement_and_deletion(spark, tmp_path):
    kind = "document_id string, text string"
    stored = spark.createDataFrame([("a", "1"), ("b", "2")], kind)
    fresh = spark.createDataFrame([("b", "3"), ("c", "4")], kind)
    assert {tuple(r) for r in corpus.replace_index(stored, fresh).collect()} == {("a", "1"), ("b", "3"), ("c", "4")}
    corpus.write_index(stored, str(tmp_path / "i"), 4)
    corpus.write_index(fresh.where("document_id = 'b'"), str(tmp_path / "i"), 4)
    for _ in range(2):  # written again, it is the same
        assert {(r.document_id, r.text) for r in corpus.read_index(spark, str(tmp_path / "i")).collect()} == {("a", "1"), ("b", "3")}
        corpus.write_index(fresh.where("document_id = 'b'"), str(tmp_path / "i"), 4)
    corpus.write_index(fresh.limit(0), str(tmp_path / "i"), 4)
    corpus.write_index(fresh, str(tmp_path / "i"), 4)
    assert {(r.document_id, r.text) for r in corpus.read_index(spark, str(tmp_path / "i")).collect()} == {("a", "1"), ("b", "3"), ("c", "4")}
    with pytest.raises(FileNotFoundError):
        corpus.read_index(spark, str(tmp_path / "nothing"))
    assert [r.document_id for r in corpus.delete_verified(fresh.limit(0), stored, ["text"]).orderBy("document_id").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        corpus.delete_verified(fresh, stored, ["text"])


def test_messages(spark):
    stored = spark.createDataFrame([("c", 3)], "conversation_id string, sequence_number int")
    incoming = spark.createDataFrame([("c", 2, "user", "b"), ("c", 1, "user", "a"), ("n", 1, "assistant", "x"), ("c", 3, "user", "  ")], "conversation_id string, arrival int, role string, content string")
    assert {(r.conversation_id, r.content): r.sequence_number for r in corpus.append_messages(stored, incoming).collect()} == {("c", "a"): 4, ("c", "b"): 5, ("n", "x"): 1}


def test_search_golden(spark):
    chunks = spark.createDataFrame([("c1", "employment", 0, "An employee must give notice of thirty days", "text", [1.0, 0.0]), ("c2", "products", 0, "Invoice INV-2026-0043 for one monitor", "text", [0.0, 1.0])], "chunk_id string, document_id string, sequence_number int, text string, content_type string, embedding array<float>")
    q = spark.createDataFrame([("a", "employee notice", [1.0, 0.1]), ("b", "INV-2026-0043", [0.0, 1.0]), ("c", "giraffe", [1.0, 1.0])], "query_id string, query string, vector array<float>")
    top = {r.query_id: r.chunk_id for r in R.semantic_search(q, chunks, 1).collect()}
    assert top["a"] == "c1"
    assert {r.query_id: r.chunk_id for r in R.keyword_search(q, chunks, k=5).collect()} == {"a": "c1", "b": "c2"}
    assert R.semantic_search(q, chunks, 5, filters=R.Filters(content_types=["table"])).count() == 0
    assert R.semantic_search(q, chunks, 5, filters=R.Filters(document_ids=[])).count() == 0
    documents = spark.createDataFrame([("employment", "ready", True), ("employment", "ready", True), ("products", "ready", None), (None, "ready", True)], "document_id string, status string, is_indexed boolean")
    ready = R.Filters(documents=documents)
    assert {(r.query_id, r.chunk_id) for r in R.semantic_search(q, chunks, 5, filters=ready).collect()} == {("a", "c1"), ("b", "c1"), ("c", "c1")}
    assert {r.query_id: r.chunk_id for r in R.keyword_search(q, chunks, k=5, filters=ready).collect()} == {"a": "c1"}
    assert R.semantic_search(q, chunks, 5, filters=R.Filters(documents=documents.limit(0))).count() == 0
    both = R.hybrid_search(q, chunks, k=5).where("query_id = 'a' and chunk_id = 'c1'").first()
    assert both.hybrid_score == pytest.approx(2 / 61)
    with pytest.raises(R.SearchError):
        R.check_k(51)
    with pytest.raises(R.SearchError):
        R.Filters(start_page=3, end_page=2)


def test_postings_and_hits_are_made_where_a_text_lies(spark, monkeypatch):
    """No word is shuffled, and few queries give the rows that many give."""
    draw = random.Random(6)
    words = ["ab", "cd", "ef", "gh", "ij", "ünd", "x1", "zz"]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 30))) + draw.choice(["", ". AB!", "-cd"]) for _ in range(300)] + [None, "", "--", "ab"]
    chunks = spark.createDataFrame([(i, f"s{i % 3}", i, t) for i, t in enumerate(texts)], "chunk_id long, document_id string, sequence_number long, text string")
    found = R.build_postings(chunks)
    expected = {}
    for i, t in enumerate(texts):
        for at, w in enumerate(re.findall(r"[^\W_]+", (t or "").lower())):
            expected.setdefault((w, i), []).append(at)
    rows = found.collect()
    assert {(r.term, r.chunk_id): r.positions for r in rows} == expected and len(rows) == len(expected)
    assert "Exchange" not in found._jdf.queryExecution().toString()
    q = spark.createDataFrame([("a", "ab CD"), ("b", "ab"), ("c", "ünd x1 zz ab"), ("d", "none"), ("e", "--"), ("f", None), ("g", "ab ab cd")], "query_id string, query string")
    shown = lambda df: sorted((r.query_id, r.rank, r.chunk_id, r.document_id, r.sequence_number, r.keyword_score) for r in df.collect())
    few, postings = R.keyword_search(q, chunks, k=7), shown(R.keyword_search(q, chunks, found, k=7))
    assert "hashpartitioning(query_id" in few._jdf.queryExecution().toString() and "hashpartitioning(query_id#" not in few._jdf.queryExecution().toString().split("MapInArrow")[-1]
    got = shown(few)
    monkeypatch.setattr(R, "SMALL_QUERIES", 0)
    assert got == shown(R.keyword_search(q, chunks, k=7)) == postings and len(got) >= 28


def test_manifest(spark, tmp_path):
    path = tmp_path / "m.jsonl"
    path.write_text('{"evaluation_id":"a","dataset":"d","split":"s","page_count":1,"pages":[{"page_number":1}],"layout_regions":[],"qa_pairs":[{"question_id":"1","question":"q","answers":["x"]}]}\n{"evaluation_id":"a","dataset":"d","split":"s","page_count":2,"pages":[{"page_number":1},{"page_number":1}],"layout_regions":[{"page_number":1,"label":"x","bounding_box":{"x0":1,"y0":1,"x1":1,"y1":2}}],"qa_pairs":[]}\n')
    m = M.read_manifest(spark, str(path))
    assert sorted(r.fault for r in M.manifest_faults(m).collect()) == ["a box has no area", "an id is used twice", "pages are numbered twice"]
    assert M.manifest_counts(m).first().questions == 1
    assert M.pick_questions(m, 5).count() == 1
    M.write_manifest(m, str(tmp_path / "out"))
    assert M.read_manifest(spark, str(tmp_path / "out")).count() == 2
    M.write_csv(spark.createDataFrame([("x", None), ("y", 1.5)], "m string, v double"), str(tmp_path / "csv"))
    assert M.read_metrics(spark, str(tmp_path / "csv"), "m string, v double").where("v is null").count() == 1
    rows = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("c", 4)], "k string, p int")
    assert {r.k for r in M.first_groups(rows, "k", "p", 2).collect()} == {"a", "b"}
    assert [r.value for r in M.markdown_lines(rows.limit(1), ["k"]).orderBy("n").collect()][0] == "| k | p |"
    with pytest.raises(ValueError):
        M.checked_artifact(rows, {"k": "b"})


def test_sources_of_annotations(spark):
    a = spark.createDataFrame([(1, 7, [1.0, 2.0, 3.0, 4.0]), (1, 7, [1.0, 2.0, 0.0, 4.0])], "image_id int, category_id int, bbox array<double>")
    out = M.from_layout_source(a, spark.createDataFrame([(1,), (2,)], "image_id int"), spark.createDataFrame([(7, "Text")], "category_id int, name string")).orderBy("image_id").collect()
    assert out[0].layout_regions[0].bounding_box.x1 == 4.0 and out[1].layout_regions is None


def test_index_stream(spark, tmp_path):
    pages = spark.createDataFrame([("a", 1, "First text.", False), ("b", 1, "Second text.", False)], "document_id string, page_number int, text string, ocr boolean")
    pages.write.parquet(str(tmp_path / "in"))
    source = streams.read_stream(spark, str(tmp_path / "in"), "document_id string, page_number int, text string, ocr boolean")
    streams.index_stream(source, str(tmp_path / "index"), str(tmp_path / "cp"), buckets=2).awaitTermination()
    spark.createDataFrame([("a", 1, "Changed text.", False)], pages.schema).write.mode("append").parquet(str(tmp_path / "in"))
    streams.index_stream(source, str(tmp_path / "index"), str(tmp_path / "cp"), buckets=2).awaitTermination()
    got = {r.document_id: r.text for r in corpus.read_index(spark, str(tmp_path / "index")).collect()}
    assert got == {"a": "Changed text.", "b": "Second text."}


def test_message_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, "user", "b"), (1, 1, "user", "a"), (2, 1, "user", "c"), (2, 2, "user", " ")], "conversation_id long, arrival long, role string, content string")
    rows.write.parquet(str(tmp_path / "in"))
    source = streams.read_stream(spark, str(tmp_path / "in"), rows.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    streams.number_messages(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {r.content: r.sequence_number for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": 1, "b": 2, "c": 1}


def test_messages_sent_again_keep_their_numbers(spark, tmp_path):
    """Three runs over growing input: what was numbered before gets no second number, what is older than the horizon counts as sent again."""
    schema = "conversation_id long, arrival long, message_id string, role string, content string"
    add = lambda *rows: spark.createDataFrame([(c, at, m, "user", t) for c, at, m, t in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        streams.number_messages(streams.read_stream(spark, str(tmp_path / "in"), schema), horizon=100).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.conversation_id, r.sequence_number, r.content) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    add((1, 10, "a", "one"), (1, 20, "b", "two"), (2, 5, "c", "other"))
    assert run() == [(1, 1, "one"), (1, 2, "two"), (2, 1, "other")]
    add((1, 20, "b", "two"), (1, 30, "d", "three"), (1, 10, "a", "one"), (1, 30, "d", "three"), (1, 30, "e", "three"))
    assert run() == [(1, 1, "one"), (1, 2, "two"), (1, 3, "three"), (1, 4, "three"), (2, 1, "other")]
    add((1, 500, "f", "four"), (2, 5, "c", "other"))
    add((1, 10, "a", "one"), (1, 450, "g", "late but within"))
    assert run()[:6] == [(1, 1, "one"), (1, 2, "two"), (1, 3, "three"), (1, 4, "three"), (1, 5, "four"), (1, 6, "late but within")] or run()[4:6] == [(1, 5, "late but within"), (1, 6, "four")]
    assert len(run()) == 7


def test_window_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events*.parquet")
    streams.latency_windows(source).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("w").select("window_start", "event_type", "n").collect()} == {tuple(r) for r in streams.latency_windows(events).select("window_start", "event_type", "n").collect()}
