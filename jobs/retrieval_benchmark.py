"""Retrieval benchmark: questions against a corpus, in stages that are written once and taken up again after a failure.

    python -m jobs.retrieval_benchmark --questions BENCHMARK --corpus DOCUMENTS --output FOLDER [--config jobs/retrieval_benchmark.json]

``questions`` holds passages (item_id, text).  A configuration asks for the first n distinct terms of
each passage; the documents that hold the whole passage, term by term, are what it should find.

    truth                 the relevant documents of each question
    ranked (each
    configuration)        its k best documents for each question
    cases                 state, ranks and measures of each question and configuration
    report                the configurations' means over all scorable questions

Every stage is a Parquet folder under a key: a hash of the tables it reads, its settings, and
the keys of the stages it builds on.  A stage that has been written whole is noted in ``stages`` (one
row for each key) and is read from then on; what a killed run left half written is overwritten.  Other
tables or settings give other keys, so results never mix; stages that don't depend on what
changed are used again.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.functions import text as T
from foliary.operators import evaluate, retrieval, runs
from jobs.common import LOG, begin_log, read_config, stored

NOTE = "stage string, rows long"


@dataclass(frozen=True)
class Config:
    configurations: dict[str, int] = field(default_factory=lambda: {"terms_2": 2, "terms_4": 4, "terms_8": 8})
    k: int = 10
    ks: tuple[int, ...] = (1, 3, 5, 10)


def content_key(table: DataFrame) -> str:
    """A hash of a table's rows, in any order: count, sum and parity of row hashes."""
    h = F.xxhash64(*table.columns)
    r = table.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).first()
    return f"{r.n}:{r.s}:{r.x}"


class Stages:
    """Stages below a folder, each written once under its key."""

    def __init__(self, spark: SparkSession, output: str) -> None:
        self.spark, self.output = spark, output.rstrip("/")
        self.written: list[str] = []

    def key(self, *parts: object) -> str:
        return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()[:16]

    def of(self, stage: str, key: str, make: Callable[[], DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
        """The stage's rows: as stored under the key, or else made, written and then noted."""
        path, note = f"{self.output}/{stage}/key={key}", f"{self.output}/stages/key={key}"
        if stored(self.spark, note, NOTE, "json").isEmpty():
            make().write.mode("overwrite").partitionBy(*by).parquet(path)
            rows = self.spark.read.parquet(path).count()
            self.spark.createDataFrame([(stage, rows)], NOTE).coalesce(1).write.mode("overwrite").json(note)
            self.written.append(stage)
            LOG.info("%s: wrote %d rows to %s", stage, rows, path)
        else:
            LOG.info("%s: taken from %s", stage, path)
        return self.spark.read.parquet(path)


def as_chunks(corpus: DataFrame) -> DataFrame:
    return corpus.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.col("doc_id").alias("sequence_number"), "text")


def asked(questions: DataFrame, n: int | None = None) -> DataFrame:
    """query_id and query: the first n (or all) distinct terms of each question's passage."""
    terms = F.array_distinct(T.terms(F.coalesce("text", F.lit(""))))
    return questions.select(F.col("item_id").alias("query_id"), F.array_join(terms if n is None else F.slice(terms, 1, n), " ").alias("query")).where("query <> ''")


def truth(questions: DataFrame, corpus: DataFrame) -> DataFrame:
    """Documents that hold all of a question's terms (a keyword search) and hold them as one passage."""
    passage = lambda c: F.concat(F.lit(" "), F.array_join(T.terms(c), " "), F.lit(" "))
    # hits bring their texts along, so the corpus isn't joined again
    found = retrieval.keyword_search(asked(questions), as_chunks(corpus), k=None, shown=("chunk_id", "document_id", "sequence_number", "text"))
    wanted = questions.select(F.col("item_id").alias("query_id"), passage(F.col("text")).alias("wanted"))
    met = found.join(wanted, "query_id")
    return met.where(F.contains(passage(F.col("text")), F.col("wanted"))).select("query_id", "chunk_id").distinct()


def search(questions: DataFrame, corpus: DataFrame, n: int, k: int) -> DataFrame:
    found = retrieval.keyword_search(asked(questions, n), as_chunks(corpus), k=k)
    return found.select("query_id", "chunk_id", F.col("rank").cast("int").alias("rank"), "keyword_score")


def cases(questions: DataFrame, relevant: DataFrame, ranked: DataFrame, name: str, ks: tuple[int, ...]) -> DataFrame:
    """One configuration's questions: whether they can be scored, what was found, and the measures of those that can."""
    found = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("results"))
    measured = evaluate.retrieval_metrics(ranked, relevant, ks)
    state = F.when(F.size(T.terms(F.coalesce("text", F.lit("")))) == 0, "INVALID_GROUND_TRUTH").when(F.col("needed").isNull(), "ANSWER_NOT_INDEXED").otherwise("SCORABLE")
    every = questions.select(F.col("item_id").alias("query_id"), "text").join(found, "query_id", "left").join(measured, "query_id", "left")
    shown = [c for k in ks for c in (f"recall_at_{k}", f"hit_at_{k}")]
    return every.select("query_id", state.alias("state"), F.coalesce("needed", F.lit(0)).cast("int").alias("relevant"), F.coalesce("results", F.lit(0)).cast("int").alias("results"), F.col("first_rank").cast("int").alias("first_rank"), "reciprocal_rank", *shown, F.lit(name).alias("configuration"))


def report(every: DataFrame, ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Means of each configuration, with the numbers of questions in each state."""
    states = every.groupBy("configuration").agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col("state") == "SCORABLE").alias("scorable"), F.count_if(F.col("results") == 0).alias("without_results"))
    return states.join(runs.across_configurations(ranked, relevant, ks).drop("cases"), "configuration", "left").na.fill(0.0)


def run(spark: SparkSession, questions: str, corpus: str, output: str, config: Config | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Cases, report, and the stages that this run wrote itself."""
    config = config or Config()
    q = spark.read.parquet(questions).select("item_id", "text")
    c = spark.read.parquet(corpus).select("doc_id", "source", "text")
    stages = Stages(spark, output)
    read = [content_key(q), content_key(c)]
    LOG.info("read %s rows of %s and %s rows of %s", read[0].split(":")[0], questions, read[1].split(":")[0], corpus)
    of_truth = stages.key("truth", read)
    relevant = stages.of("truth", of_truth, lambda: truth(q, c))
    ranked, keys = {}, []
    for name, n in sorted(config.configurations.items()):
        key = stages.key("ranked", read, n, config.k)
        keys.append([name, key])
        ranked[name] = stages.of("ranked", key, lambda n=n: search(q, c, n, config.k))
    of_cases = stages.key("cases", of_truth, keys, config.ks)

    def all_cases() -> DataFrame:
        out = None
        for name, rows in ranked.items():
            one = cases(q, relevant, rows, name, config.ks)
            out = one if out is None else out.unionByName(one)
        return out

    every = stages.of("cases", of_cases, all_cases, ("configuration",))

    def whole_report() -> DataFrame:
        out = None
        for name, rows in ranked.items():
            one = rows.withColumn("configuration", F.lit(name))
            out = one if out is None else out.unionByName(one)
        return report(every, out, relevant, config.ks)

    means = stages.of("report", stages.key("report", of_cases), whole_report)
    return every, means, stages.written


def main() -> None:
    from foliary.session import build_session

    options = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("questions", "corpus", "output"):
        options.add_argument(f"--{name}", required=True)
    options.add_argument("--config", default=os.path.join(os.path.dirname(__file__), "retrieval_benchmark.json"))
    given = options.parse_args()
    begin_log()
    spark = build_session("retrieval-benchmark")
    try:
        settings = read_config(given.config)
        _, means, _ = run(spark, given.questions, given.corpus, given.output, Config(**settings | {"ks": tuple(settings["ks"])}))
        for row in means.orderBy("configuration").collect():  # one row a configuration
            LOG.info("%s", row.asDict())
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
