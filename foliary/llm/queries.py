"""The queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliary.llm import bpe, centroids, chat, decontam, hnsw, lm, neardup, secrets, sharding, sstable, substrings, toxicity
from foliary.llm import common as C
from foliary.llm.oracles import ORACLES


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    model = toxicity.train(docs, C.documents(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model, keep=["doc_id"])
    return found.select("doc_id", C.held_out("doc_id", 3).alias("held_out"), "score", "predicted")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(C.documents(spark, sf_dir), C.documents(spark, sf_dir, "benchmark"), keep=["doc_id"]).drop("spans")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(C.documents(spark, sf_dir), keep=["doc_id"])


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(C.documents(spark, sf_dir))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(C.documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.tiktoken"), keep=["doc_id"], ids=False, digests=True)


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(C.documents(spark, sf_dir, "embeddings"))


def event_log(conversations: DataFrame) -> DataFrame:
    """The log of a chat that ends in these conversations: replies are streamed twice, as they are regenerated once, other turns are drafted, edited and added to."""
    by_turn = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", F.xxhash64("text"), "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    first, rest = F.substr(text, F.lit(1), half), F.substr(text, half + 1)
    seq = lambda k: F.col("n") * 8 + k
    event = lambda k, kind, body, target=None: F.struct(seq(k).alias("seq"), F.lit(kind).alias("event"), (F.lit(None).cast("long") if target is None else seq(target)).alias("target"), body.alias("body"))
    none = F.lit("")
    reply = F.array(event(0, "message", none), event(1, "delta", F.lit("first answer")), event(2, "regenerate", none, 0), event(3, "delta", first, 2), event(4, "delta", rest))
    other = F.array(event(0, "message", F.lit("draft")), event(1, "edit", first, 0), event(2, "delta", rest, 0))
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("n", F.row_number().over(by_turn).cast("long"))
    return rows.select("conv_id", "role", F.inline(F.when(F.col("role") == chat.ASSISTANT, reply).otherwise(other)))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = C.documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.render(event_log(log.unionByName(more)), seq="seq", text="body", event="event", target="target"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(C.documents(spark, sf_dir), shingle=2)


def op9_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write_tables(C.documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))
    return sstable.read_tables(spark, manifest)


def op10_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir).withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    placed = sharding.shard_by_bytes(docs, keep=["doc_id", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(C.documents(spark, sf_dir, "embeddings"), keep=["vec_id"])


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(C.documents(spark, sf_dir), keep=["doc_id"], texts=False).drop("kept_text", "removed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_benchmark_decontamination": op2_benchmark_decontamination,
        "op3_secret_scan": op3_secret_scan,
        "op4_language_model": op4_language_model,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_nearest_neighbours": op6_nearest_neighbours,
        "op7_chat_formatting": op7_chat_formatting,
        "op8_near_duplicates": op8_near_duplicates,
        "op9_token_tables": op9_token_tables,
        "op10_histogram_sharding": op10_histogram_sharding,
        "op11_centroid_clusters": op11_centroid_clusters,
        "op12_substring_dedup": op12_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
