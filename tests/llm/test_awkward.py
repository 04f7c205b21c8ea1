"""Words that cheap hashes confuse, rows that are all alike, and columns with awkward names."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliary.llm import bpe, decontam, lm, neardup, secrets, sharding, sstable, toxicity
from foliary.llm import queries as Q
from tests.llm.helpers import sentence


def complements(n):
    """The two complementary Thue-Morse words of n letters."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


PAIRS = [complements(n) for n in (1024, 2048, 4096)]
TEXTS = [t for pair in PAIRS for t in pair]


def test_words_are_told_apart(spark):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
    path = Q.tokenizer_file("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = {r.doc_id: r.ids_crc32 for r in sstable.read_tables(spark, sstable.write_tables(docs, path)).collect()}
    assert got == {i: zlib.crc32(np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in enumerate(TEXTS)}
    assert neardup.near_duplicates(docs, shingle=2).where("kept and component_id = doc_id").count() == len(TEXTS)
    held = {i for i in range(len(TEXTS)) if zlib.crc32(str(i).encode()) % 5 == 1}
    known = {r.doc_id: r.n_known for r in lm.score_documents(docs).collect()}
    assert known == {i: 1 if i in held else 2 for i in range(len(TEXTS))}
    bench = spark.createDataFrame([(1, " ".join(TEXTS[0] + str(i) for i in range(10)))], "item_id long, text string")
    asked = spark.createDataFrame([(1, " ".join(TEXTS[0] + str(i) for i in range(10))), (2, " ".join(TEXTS[1] + str(i) for i in range(10)))], "doc_id long, text string")
    for limit in (decontam.BROADCAST_BYTES, 0):
        assert {r.doc_id: r.n_hit for r in decontam.decontaminate(asked, bench, broadcast_bytes=limit).collect()} == {1: 10, 2: 0}


def test_pieces_that_share_a_hash_go_to_the_tokenizer(monkeypatch):
    from foliary.llm import common as C

    monkeypatch.setattr(C.WordScanner, "FIRST", (0, 0, 0))
    monkeypatch.setattr(C.WordScanner, "_mixed", staticmethod(lambda parts, starts, ends, keys: np.zeros(len(starts), np.uint64) if keys[0] == 0 else (ends - starts).astype(np.uint64)))
    coder = sstable.WordCoder(open(Q.tokenizer_file("word_bpe_49k.json")).read())
    got = coder.encode([b"one seven", b"three", b"one"])
    assert [x.tolist() for x in got] == [coder.matches.ids(t) for t in ("one seven", "three", "one")]


def test_shards_of_equal_rows(spark):
    same = spark.range(0, 800, 1, 4).select(F.lit(7).cast("long").alias("doc_id"), F.lit("all the same").alias("text"))
    got = sharding.shard_by_bytes(same).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last")).collect()
    assert sorted(r.shard for r in got) == list(range(8))
    assert all(abs(r.n - 100) <= 1 and r.n == r.slots == r.last + 1 for r in got)


def test_shards_follow_a_plain_sort(spark):
    draw = random.Random(8)
    rows = [(i, sentence(draw, draw.randint(1, 60))) for i in range(900)] + [(2000 + i, "one text of many") for i in range(700)] + [(None, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    got = sharding.shard_by_bytes(docs, tolerance=0.01, part_bytes=5000).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(rows)
    assert all(r.text_crc32 == zlib.crc32((r.text or "").encode()) and r.size == len((r.text or "").encode()) + 1 for r in got)
    ordered = sorted(got, key=lambda r: (r.h, -(1 << 63) if r.doc_id is None else r.doc_id))
    assert [r.shard for r in ordered] == sorted(r.shard for r in got)
    total = sum(r.size for r in got)
    most = max(r.size for r in got)
    for s in range(8):
        part = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in part) == list(range(len(part)))
        assert abs(sum(r.size for r in part) - total / 8) <= 0.02 * total / 8 + 2 * most


AWKWARD = "doc_id long, text string, `a.b` string, __mine string, __text string, c0 long, Spans string, SIZE int, Predicted int, body string"


@pytest.fixture()
def awkward(spark):
    rows = [(i, t, "dot", "mine", "own", 5, "s", 6, 7, "b") for i, t in enumerate(["password: hunter2hunter2", None, "", "some words " * 300, "some words"])]
    return spark.createDataFrame(rows + rows[:1], AWKWARD)


def others(row, *gone):
    return {k: v for k, v in row.asDict().items() if k in AWKWARD.replace("`", "") and k.lower() not in gone and k not in ("doc_id", "text")}


def test_columns_are_kept(spark, awkward):
    labels = spark.createDataFrame([(0, 1), (3, 0)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "password hunter2hunter2")], "item_id long, text string")
    found = {
        "spans": (decontam.decontaminate(awkward, bench), decontam.decontaminate(awkward, bench, broadcast_bytes=0), secrets.find_secrets(awkward)),
        "predicted": (toxicity.score(awkward, toxicity.train(awkward, labels)),),
        "size": (sharding.shard_by_bytes(awkward),),
        "": (bpe.encode(awkward, Q.tokenizer_file("byte_bpe_50k.tiktoken")), neardup.keep_one(awkward), secrets.redact_secrets(awkward)),
    }
    for gone, frames in found.items():
        for frame in frames:
            names = [c for c in awkward.columns if c.lower() != gone]
            assert [c for c in frame.columns if c in names] == names
            rows = frame.toPandas().to_dict("records")
            assert rows and all((r["a.b"], r["__mine"], r["__text"], r["c0"], r["body"]) == ("dot", "mine", "own", 5, "b") for r in rows)
            path = __import__("foliary.llm.common", fromlist=["x"]).own_folder(spark, "awkward")
            frame.write.parquet(path)
            assert spark.read.parquet(path).count() == len(rows)


def test_toxic_training_is_fixed_and_bounded(spark):
    rows = [(i, ("foul " if i % 2 else "fair ") * 400) for i in range(40)] + [(1, "fair words"), (1, "foul foul")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    models = [toxicity.train(docs.repartition(n), labels, most_chars=100) for n in (2, 5)]
    assert hashlib.sha256(models[0].weights.tobytes()).digest() == hashlib.sha256(models[1].weights.tobytes()).digest()
    at = [r.score for r in toxicity.score(docs, models[0], threshold=0.5).collect()]
    assert toxicity.score(docs, models[0], threshold=max(at)).where(f"score = {max(at)!r} and predicted = 0").count() == 0
