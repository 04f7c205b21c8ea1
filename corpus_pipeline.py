"""A corpus pipeline over the documents table: each stage applies one operator to all rows before it.

toxicity        rows the classifier rejects go
near_duplicates of each group of near copies (five-word shingles, similarity 0.8) one document stays
decontamination rows with a passage of the benchmark go
secret_scan     secrets in the texts are blotted out (and n_chars follows)
byte_bpe        texts become token ids

Every stage but the last returns the columns it was given, whatever their names.  Null and empty
texts are clean, are nobody's copy and have no ids; empty tables give empty ones; without labels
nothing is toxic; texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm import bpe, decontam, neardup, secrets, toxicity
from foliary.llm import common as C
from foliary.llm.queries import tokenizer_file


def plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows with column names that no result and no other column has, and what each column is called then."""
    own = docs.toDF(*(f"__c{i}" for i in range(len(docs.columns))))
    return own, dict(zip(docs.columns, own.columns, strict=True))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored below the threshold; labels serve for training only."""
    model = toxicity.train(docs, C.documents(spark, sf_dir, "labels"))
    own, name = plain(docs)
    return toxicity.score(own, model, text=name["text"]).where("predicted = 0").select(own.columns).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least id of each group; of rows that repeat one id and text, one."""
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any window of the benchmark."""
    own, name = plain(docs)
    found = decontam.decontaminate(own, C.documents(spark, sf_dir, "benchmark"), text=name["text"])
    return found.where("not contaminated").select(own.columns).toDF(*docs.columns)


def blot_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without their secrets; a column ``n_chars`` follows the text."""
    own, name = plain(docs)
    clean = secrets.redact_secrets(own, text=name["text"])
    if "n_chars" in name:
        clean = clean.withColumn(name["n_chars"], F.length(name["text"]).cast(docs.schema["n_chars"].dataType))
    return clean.toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row."""
    return bpe.encode(docs, tokenizer_file("byte_bpe_50k.tiktoken"), keep=["doc_id"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scan", blot_secrets),
    ("byte_bpe", encode),
]

#: SQL has no byte pair merges, classifiers or automata; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again by the next."""
    docs = C.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = C.own_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
