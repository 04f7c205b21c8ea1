"""The stored index against plain code: stems, query syntax, nearness, vectors, fusion, scopes, embeddings."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliary.functions import embedding, english
from foliary.functions import vectors as vectors_module
from foliary.operators import retrieval as R
from foliary.operators import search as S

STEMS = {
    "consigned": "consign", "consistency": "consist", "knitting": "knit", "knightly": "knight", "generously": "generous", "communism": "communism", "arsenal": "arsenal", "hopping": "hop", "hoping": "hope", "agreed": "agre",
    "cries": "cri", "ties": "tie", "gas": "gas", "gaps": "gap", "kiwis": "kiwi", "luxuriated": "luxuri", "happy": "happi", "cry": "cri", "say": "say", "rational": "ration", "conditional": "condit", "relational": "relat",
    "vietnamization": "vietnam", "controlled": "control", "controlling": "control", "effectiveness": "effect", "hopefulness": "hope", "electrical": "electr", "replacement": "replac", "adoption": "adopt", "activate": "activ",
    "probate": "probat", "rate": "rate", "cease": "ceas", "dying": "die", "news": "news", "proceeding": "proceed", "employees": "employe", "notice": "notic", "terminations": "termin", "yes": "yes", "by": "by",
}


@pytest.mark.parametrize("word", sorted(STEMS))
def test_stems(word):
    assert english.stem(word) == STEMS[word]


def test_queries_are_parsed():
    assert english.parse('the notices or "employee notice" -invoices') == [[(False, ["notic"])], [(False, ["employe", "notic"]), (True, ["invoic"])]]
    assert english.parse("INV-2026-0043") == [[(False, ["inv", "2026", "0043"])]]
    assert english.parse("the of") == [] and english.parse("") == [] and english.parse('"open phrase') == [[(False, ["open", "phrase"])]]


def texts():
    draw = random.Random(2)
    words = "notice notices employee employees invoice paid the of pump pumps pumping daily oil".split()
    return [" ".join(draw.choice(words) for _ in range(draw.randint(3, 25))) for _ in range(120)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    draw = np.random.default_rng(1)
    body = texts()
    vectors = draw.normal(size=(len(body), 16))
    rows = [(i, f"d{i % 6}", i, t, None if i % 10 == 9 else [float(x) for x in vectors[i]], "table" if i % 4 == 0 else "text", i % 5 + 1) for i, t in enumerate(body)]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id string, sequence_number long, text string, embedding array<double>, content_type string, start_page int").withColumn("end_page", F.col("start_page"))
    return S.build(chunks, str(tmp_path_factory.mktemp("index") / "i")), body, vectors


def plain_keyword(body, query):
    """{chunk: score} by looking at every text."""
    out = collections.Counter()
    for i, text in enumerate(body):
        lex = english.lexemes(text)
        for group in english.parse(query):
            found = []
            for excluded, terms in group:
                at = [[p + j for j in range(len(terms))] for t, p in lex if t == terms[0] and all((u, p + j) in lex for j, u in enumerate(terms))]
                if bool(at) == excluded:
                    break
                if not excluded:
                    found.append(at)
            else:
                if not found:
                    continue
                marks = sorted({p for at in found for x in at for p in x})
                spans = []
                for a in marks:
                    ends = [b for b in marks if b >= a and all(any(a <= p <= b for x in at for p in x) for at in found)]
                    if ends:
                        spans.append((a, min(ends)))
                least = [s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)]
                out[i] += sum(0.1 / (1 + (b - a) - (sum(a <= m <= b for m in marks) - 1)) for a, b in least)
    return out


QUERIES = {"a": "employee notice", "b": '"pump daily"', "c": "pumping -oil", "d": "invoice or oil paid", "e": "giraffe", "f": '"notice employee" or "oil pumps"', "g": "the"}


def test_keyword(spark, index):
    built, body, _ = index
    queries = spark.createDataFrame(list(QUERIES.items()), "query_id string, query string")
    got = collections.defaultdict(list)
    for r in S.keyword(built, queries, 10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.chunk_id, r.keyword_score))
    for q, text in QUERIES.items():
        expected = sorted(plain_keyword(body, text).items(), key=lambda x: (-round(x[1], 9), f"d{x[0] % 6}", x[0]))[:10]
        assert [i for i, _ in got[q]] == [i for i, _ in expected]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in expected])


def test_semantic_and_hybrid(spark, index):
    built, body, vectors = index
    asked = [(q, text, [float(x) for x in vectors[i] + 0.1]) for i, (q, text) in enumerate(QUERIES.items())]
    queries = spark.createDataFrame([*asked, ("z", "pump", [0.0] * 16)], "query_id string, query string, vector array<double>")
    got = collections.defaultdict(list)
    for r in S.semantic(built, queries, 7, filters=R.Filters(content_types=["text"])).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.chunk_id)
    for q, _, v in asked:
        near = {i: float(vectors[i] @ v / np.linalg.norm(vectors[i]) / np.linalg.norm(v)) for i in range(len(body)) if i % 10 != 9 and i % 4}
        assert got[q] == sorted(near, key=lambda i: -near[i])[:7]
    assert "z" not in got
    both = S.search(built, queries, "hybrid", 5)
    one, two = S.semantic(built, queries, 20), S.keyword(built, queries, 20)
    assert {(r.query_id, r.rank, r.chunk_id) for r in both.collect()} == {(r.query_id, r.rank, r.chunk_id) for r in R.fuse(one, two, 5, 60, 20).collect()}
    again = S.search(built, queries, "semantic", 5, rerank=True).collect()
    assert len(again) == 5 * len(asked) and all(r.rank_delta == r.base_rank - r.rank for r in again)


def test_selected_documents_and_faults(spark, index):
    built, _, vectors = index
    queries = spark.createDataFrame([("a", "notice", [float(x) for x in vectors[3]])], "query_id string, query string, vector array<double>")
    documents = spark.createDataFrame([(f"d{i}", "ready", i != 5, 20) for i in range(6)], "document_id string, status string, is_indexed boolean, chunk_count int")
    got = S.search(built, queries, "semantic", 5, selected=["d1", "d2", "d1"], documents=documents)
    assert {r.document_id for r in got.collect()} <= {"d1", "d2"} and got.count() == 5
    ready = R.Filters(documents=spark.createDataFrame([("d1", "ready", True), ("d2", "failed", True)], "document_id string, status string, is_indexed boolean"))
    for scope in (None, ["d1", "d2"]):
        assert {r.document_id for r in S.search(built, queries, "semantic", 5, filters=ready, selected=scope).collect()} == {"d1"}
    for bad in ({"selected": []}, {"selected": ["d5"], "documents": documents}, {"selected": [f"x{i}" for i in range(21)]}, {"mode": "odd"}, {"k": 51}):
        with pytest.raises(R.SearchError):
            S.search(built, queries, **bad)
    with pytest.raises(R.SearchError):
        S.search(built, queries.withColumn("query", F.lit("  ")))
    chunks = built.table("chunks").where("chunk_id <> 3")
    with pytest.raises(Exception, match="no chunk or query"):
        R.rerank(S.semantic(built, queries, 5), queries, chunks, 5).collect()


def test_embedding(spark):
    rows = spark.createDataFrame([(1, " An  invoice\tfor pumps"), (2, "an invoice for pumps"), (3, "notice of an employee"), (4, " "), (5, None)], "id long, text string")
    got = {r.id: r.embedding for r in embedding.embed(rows, dimension=64).collect()}
    assert got[4] is None and got[5] is None and got[1] == got[2] and np.dot(got[1], got[1]) == pytest.approx(1)
    assert embedding.similarity(np.array(got[1]), np.array(got[3])) < 0.9
    own = embedding.embed(rows.where("id < 4"), make_encoder=lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]), dimension=2, batch=2)
    assert {r.id: round(r.embedding[0] / r.embedding[1]) for r in own.collect()} == {1: 20, 2: 20, 3: 21}
    for bad in (lambda texts: np.zeros((len(texts), 2)), lambda texts: np.ones((len(texts), 3)), lambda texts: np.ones((len(texts) + 1, 2))):
        with pytest.raises(embedding.EmbeddingError):
            embedding.unit_vectors(["a"], bad, 2)
    with pytest.raises(embedding.EmbeddingError):
        embedding.unit_vectors(["a", " "], embedding.hashing_encoder(8), 8)


def found(index, mode, vectors, queries=("notice invoice", "pump or oil -daily", '"the pump"')):
    asked = index.spark.createDataFrame([(i, q, [float(x) for x in vectors[i]]) for i, q in enumerate(queries)], "query_id long, query string, vector array<double>")
    return sorted(tuple(r) for r in S.search(index, asked, mode, 9).select("query_id", "rank", "chunk_id", F.round(f"{mode}_score", 9)).collect())


def test_the_remainder_is_indexed(spark, index, tmp_path):
    """An index extended twice, a batch of it run again, answers as one that was built whole."""
    whole, _, vectors = index
    chunks = whole.table("chunks").drop("batch")
    of = lambda *n: chunks.where(F.col("document_id").isin(*(f"d{i}" for i in n)))
    part = S.build(of(0, 1), str(tmp_path / "i"))
    S.extend(part, of(0, 1, 2, 3), 1)
    again = [sorted(map(tuple, part.table(t).drop("positions", "unit").collect()), key=repr) for t in ("chunks", "postings", "vectors")]
    S.extend(part, of(0, 1, 2, 3), 1)
    assert again == [sorted(map(tuple, part.table(t).drop("positions", "unit").collect()), key=repr) for t in ("chunks", "postings", "vectors")]
    assert S.remainder(part, chunks).select("document_id").distinct().count() == 2
    S.extend(part, chunks, 2)
    assert part.table("chunks").groupBy("batch").agg(F.countDistinct("document_id")).collect() and S.remainder(part, chunks).isEmpty()
    part = S.opened(spark, str(tmp_path / "i"))
    for mode in S.MODES:
        assert found(part, mode, vectors) == found(whole, mode, vectors)


def test_an_extension_that_failed_is_run_again(spark, index, tmp_path):
    whole, _, vectors = index
    chunks = whole.table("chunks").drop("batch")
    part = S.build(chunks.where("document_id in ('d0', 'd1', 'd2')"), str(tmp_path / "i"))
    S._write(part, chunks.where("document_id = 'd3'"), 1)  # a batch that wrote other rows before it was lost
    S.extend(part, chunks, 1)
    for mode in S.MODES:
        assert found(part, mode, vectors) == found(whole, mode, vectors)


@pytest.mark.parametrize("scores", [1, 50, 1 << 22])
def test_small_products_give_the_same(index, monkeypatch, scores):
    built, _, vectors = index
    expected = found(built, "semantic", vectors)
    monkeypatch.setattr(vectors_module, "SCORES", scores)
    assert found(built, "semantic", vectors) == expected
