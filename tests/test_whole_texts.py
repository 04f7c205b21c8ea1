"""Queries over whole texts of any length and script, against plain code."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from foliary.operators import chunking
from foliary.plans import catalog
from tests.helpers import plain, sentence


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    """A data folder of few documents, most of them long or not ASCII, and its texts by id."""
    draw = random.Random(4)
    long, words = sentence(draw, 400), sentence(draw, 150)
    texts = ["Straße über alles", "Strasse  ÜBER\nalles", long, long.replace("stone", "Stöne") + " end", "été 🙂 naïve", "", "", "a_b x", words, words[:500], "The end. Ünd the_x", "¿The? " + words, "x" * 1500]
    folder = str(tmp_path_factory.mktemp("whole"))
    rows = [(i, t, "de" if i % 2 else "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, texts[-1 - i]) for i in range(len(texts))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, dict(enumerate(texts))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def key(s):
    return " ".join(s.lower().replace("ß", "ss").split())


def rows(spark, whole, name):
    return catalog.queries()[name](spark, whole[0]).collect()


def test_error_rates(spark, whole):
    t = whole[1]
    pairs = {i: (t[i], t[i + 1], edits(t[i], t[i + 1])) for i in t if i + 1 in t}
    cer = {i: d / len(a) if a else float(bool(b)) for i, (a, b, d) in pairs.items()}
    assert {r.doc_id: r.cer for r in rows(spark, whole, "levenshtein_cer_all")} == {i: pytest.approx(c, abs=1e-6) for i, c in cer.items()}
    micro = sum(d for *_, d in pairs.values()) / sum(len(a) for a, *_ in pairs.values())
    assert [tuple(r) for r in rows(spark, whole, "micro_macro_cer_all")] == [(len(pairs), pytest.approx(micro, abs=1e-6), pytest.approx(sum(cer.values()) / len(cer), abs=1e-6))]


def test_anls(spark, whole):
    t, expected = whole[1], {}
    for i in t:
        if i + 1 in t:
            a, p = key(t[i]), key(t[i + 1])
            share = edits(a, p) / max(len(a), len(p), 1)
            expected[i] = (pytest.approx(1 - share if share < 0.5 else 0.0, abs=1e-6), a == p)
    assert {r.doc_id: (r.anls, r.exact_match) for r in rows(spark, whole, "anls_all")} == expected
    assert [i for i, (_, same) in expected.items() if same] == [0, 5]


def test_ground_truth(spark, whole):
    expected = {i: "SCORABLE" if re.search(r"(?<!\w)the(?!\w)", key(t)) else "ANSWER_NOT_INDEXED" for i, t in whole[1].items()}
    assert {r.question_key: r.state for r in rows(spark, whole, "ground_truth_all")} == expected


def test_token_overlap(spark, whole):
    t, expected = whole[1], {}
    for i in t:
        x, y = (set(re.findall(r"\w+(?:[-']\w+)?", s.lower().replace("ß", "ss"))) for s in (t[len(t) - 1 - i], t[i]))
        expected[i] = pytest.approx(len(x & y) / min(len(x), len(y)) if x and y else 0.0, abs=1e-6)
    assert {r.doc_id: r.overlap for r in rows(spark, whole, "token_overlap_all")} == expected


def test_single_chunks(spark, whole):
    chunks = [r.document_id for r in rows(spark, whole, "chunk_documents")]
    found = {r.document_id: r.character_count for r in rows(spark, whole, "chunk_single_all")}
    assert set(found) == {d for d in chunks if chunks.count(d) == 1} and len(set(chunks)) > len(found)
    assert found["12"] == 1500  # longer than the 1,100 characters that the twin of chunk_single takes


def test_summaries_of_every_document(spark, whole):
    found = {r.summary_id: r.grounded for r in rows(spark, whole, "grounded_summaries")}
    assert found.keys() == whole[1].keys() and {i for i, good in found.items() if good} == {3, 7, 9}  # 11 has a sentence of its own without a citation


def against_sql(spark, tmp_path_factory, name, texts):
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = plain(catalog.queries()[name](spark, folder).toPandas())
    assert got == plain(db.sql(catalog.oracle_sql()[name]).df())
    return got


def test_fields_of_odd_texts(spark, tmp_path_factory):
    """A longer word behind "of the", tabs, which part no words, and the value's own sign in a text."""
    texts = ["speak of them", "one of there are", "go\tthe way", "is the  end", "the end", "at the", "in\n\nthe\nsea", "a the the b", " \ue000 ", "", None, "breathe x", "so \x0bthe end", "of the\u00a0x"]
    got = against_sql(spark, tmp_path_factory, "field_outcomes", texts)
    assert {r[0] for r in got if r[1] == "found"} == {3.0, 6.0, 7.0}


def test_card_numbers_beside_other_signs(spark, tmp_path_factory):
    """Numbers that stand by further digits, dashes and letters beyond ASCII."""
    card = "4111111111111111"
    texts = [card, f"{card} 12", f"7 {card}", f"12-{card}", f"é{card}", f"{card}ü", f"_{card}", f"{card}x", f"{card} {card} 5500005555555559", "4111 1111 1111 1111", f"{card}1", f"{card}-1 {card}", None, "4111111111111112", f"{card}."]
    got = against_sql(spark, tmp_path_factory, "pii_card_luhn", texts)
    assert {r[0] for r in got} == {0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 8.0, 11.0, 14.0}


def test_chunks_leave_a_task_a_few_units_at_a_time(spark, monkeypatch):
    """Frames of a few units' chunks, not of a whole batch of 10,000; a document across two frames stays whole."""
    pages = spark.createDataFrame([(f"d{i // 3}", i % 3, f"Page {i} has words.") for i in range(1000)], "document_id string, page_number int, text string").withColumn("ocr", F.lit(False)).coalesce(1)
    seen = []
    real = type(pages).mapInPandas

    def caught(self, f, schema):
        frames = [chunk for chunk in f(iter([self.toPandas()]))]
        seen.extend(len(x) for x in frames)
        return real(self, f, schema)

    monkeypatch.setattr(type(pages), "mapInPandas", caught)
    out = chunking.chunk_pages(pages).collect()
    assert max(seen) <= chunking.UNITS and sum(seen) == len(out) == 334
    assert {r.document_id: r.text for r in out}["d7"] == "Page 21 has words. Page 22 has words. Page 23 has words."
