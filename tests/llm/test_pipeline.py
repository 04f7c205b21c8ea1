"""The pipeline's stages, each against a plain version over what the stage before it kept."""

import os
import re

import duckdb
import pytest
import tiktoken

import corpus_pipeline as P
from foliary.llm import bpe, neardup, toxicity
from foliary.llm import common as C
from foliary.llm import queries as Q
from tests.helpers import plain, views
from tests.llm.helpers import low
from tests.llm.test_operators import plain_hits, plain_spans


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = C.documents(spark, sf_dir), {}
    extra = spark.createDataFrame([(10_001, None, None, None, None), (10_002, "", "en", "x", 0), (None, "secret: abcdefgh12345", "en", "x", 1)], docs.schema)
    docs = docs.unionByName(extra)
    out["input"] = docs.collect()
    for name, stage in P.STAGES:
        path = C.own_folder(spark, f"test-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
        out[name + "-columns"] = docs.columns
    return out


def by_id(rows):
    return {r.doc_id: r for r in rows}


def test_columns_stay(stages):
    for name, _ in P.STAGES[:-1]:
        assert stages[name + "-columns"] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxic_rows_go(spark, sf_dir, stages):
    model = toxicity.train(C.documents(spark, sf_dir), C.documents(spark, sf_dir, "labels"))
    features = toxicity.Features(model.orders, model.bits)
    kept = {r.doc_id for r in stages["input"] if model.score(features, (r.text or "").encode()) < toxicity.THRESHOLD}
    assert {r.doc_id for r in stages["toxicity"]} == kept


def test_one_of_each_group_stays(stages):
    rows = [r for r in stages["toxicity"]]
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(r.text))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    forest = neardup.Forest(len(rows))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                forest.join(i, j)
    least = {}
    for i, r in enumerate(rows):
        k = forest.find(i)
        if r.doc_id is not None:
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    expected = {least.get(forest.find(i), r.doc_id) for i, r in enumerate(rows)}
    assert {r.doc_id for r in stages["near_duplicates"]} == expected


def test_contaminated_rows_go(spark, sf_dir, stages):
    bench = [(str(r.item_id), r.text) for r in C.documents(spark, sf_dir, "benchmark").collect()]
    rows = stages["near_duplicates"]
    clean = {r.doc_id for r, h in zip(rows, plain_hits([r.text or "" for r in rows], bench), strict=True) if not h[-1]}
    assert {r.doc_id for r in stages["decontamination"]} == clean


def test_secrets_are_blotted(stages):
    before, after = by_id(stages["decontamination"]), by_id(stages["secret_scan"])
    assert before.keys() == after.keys()
    for k, r in before.items():
        if not plain_spans(r.text):
            assert after[k].text == r.text
        else:
            assert all(r.text[a:b] not in after[k].text for a, b, _ in plain_spans(r.text))
            assert after[k].n_chars == len(after[k].text)
    assert after[10_001].text is None and "[ASSIGN]" in after[None].text


def test_ids(stages):
    import public_tokenizers

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(Q.tokenizer_file("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = by_id(stages["secret_scan"])
    for r in stages["byte_bpe"]:
        assert list(r.ids) == enc.encode_ordinary(texts[r.doc_id].text or "") and r.n_tokens == len(r.ids)


def test_run(spark, sf_dir):
    assert set(P.run(spark, sf_dir).columns) == {"doc_id", "n_tokens", "ids"}


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_twins(spark, sf_dir, name):
    assert plain(Q.queries()[name](spark, sf_dir).toPandas()) == plain(views(sf_dir).sql(Q.oracle_sql()[name]).df())


def test_every_query_returns_every_row(spark, sf_dir):
    n = {t: duckdb.sql(f"SELECT count(*) FROM '{os.path.join(sf_dir, t)}.parquet'").fetchall()[0][0] for t in ("documents",)}
    for name in ("op1_toxicity", "op3_secret_scan", "op9_token_tables", "op10_histogram_sharding"):
        assert Q.queries()[name](spark, sf_dir).count() == n["documents"]


def staged(spark, docs, sf_dir):
    out = []
    for name, stage in P.STAGES:
        path = C.own_folder(spark, f"test-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_empty_tables(spark, sf_dir, tmp_path):
    for table in ("documents", "labels", "benchmark"):
        C.documents(spark, sf_dir, table).limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
    some = spark.createDataFrame([(1, "one text of it"), (2, None)], "doc_id long, text string")
    assert [x.count() for x in staged(spark, some, str(tmp_path))] == [2] * 5  # nothing is toxic, copied or leaked


def test_awkward_columns_and_long_texts(spark, sf_dir):
    long = " ".join(f"word{i}" for i in range(120_000))
    rows = [(1, "plain words " * 20, "d", 0.5, 1, "r", "s", 240), (2, long, "d", 0.5, 1, "r", "s", len(long)), (3, None, None, None, None, None, None, None), (4, "password: hunter2hunter2", "d", 0.5, 1, "r", "s", 24), (4, "password: hunter2hunter2", "d", 0.5, 1, "r", "s", 24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, __score double, predicted int, __c0 string, spans string, n_chars long")
    *before, coded = staged(spark, docs, sf_dir)
    assert all(x.columns == docs.columns for x in before)
    got = {r.doc_id: r for r in before[-1].collect()}
    assert set(got) == {1, 2, 3, 4} and before[-1].count() == 4 and got[2].text == long
    assert got[4].text == "[ASSIGN]" and got[4].n_chars == 8 and got[4]["a.b"] == "d" and got[4]["__c0"] == "r"
    assert {r.doc_id: r.n_tokens > 100_000 for r in coded.collect()} == {1: False, 2: True, 3: False, 4: False}
