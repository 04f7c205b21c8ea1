"""Incremental intake of documents: what is new is checked, deduplicated by checksum, and cut into classified elements.

    python -m jobs.intake --input DOCUMENTS --output ELEMENTS --checkpoint FOLDER [--config jobs/intake.json]

A run takes the files that have come since the last one (a file stream with a checkpoint, until
nothing is left).  Of each batch, documents without text are left out, and so are those whose
checksum an earlier batch has stored; of equal ones in a batch the least id stays.  The rest become
elements in reading order, one for each line that isn't blank, under ``batch=N/element_type=...``.

A batch that runs again after a failure replaces its own folders and looks for checksums in the
others only, so it gives the same rows.  A run without a checkpoint over stored output adds nothing
that is stored already.  A document that comes again with other text is stored beside its old
version; ``current`` reads the newest.
"""

from __future__ import annotations

import argparse
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.functions.text import collapse
from foliary.operators import corpus
from jobs.common import LOG, begin_log, read_config, stored

#: one size of letters throughout: plain text has no fonts, so only capitals make a heading
FONT_SIZE = 10.0
ELEMENTS = "document_id long, checksum_sha256 string, lang string, source string, needs_ocr boolean, status string, sequence_order int, text string, batch long, element_type string"


@dataclass(frozen=True)
class Config:
    schema: str = "doc_id bigint, text string, lang string, source string"
    ocr_least: int = corpus.OCR_LEAST
    files_per_batch: int | None = None


def accepted(documents: DataFrame) -> DataFrame:
    """Documents that have text, with their checksum."""
    return documents.where(F.coalesce(collapse(F.col("text")), F.lit("")) != "").select(F.col("doc_id").alias("document_id"), "text", "lang", "source", F.sha2("text", 256).alias("checksum_sha256"))


def elements(documents: DataFrame, ocr_least: int) -> DataFrame:
    """Lines of documents as classified elements in reading order."""
    pages = corpus.page_state(documents.withColumn("has_image", F.lit(False)), ocr_least)
    status = F.when(F.col("needs_ocr"), "failed").otherwise("ready")
    lines = pages.select("document_id", "checksum_sha256", "lang", "source", "needs_ocr", status.alias("status"), F.posexplode(F.split("text", "\n")).alias("y0", "text")).where(collapse(F.col("text")) != "")
    blocks = lines.withColumns({"page_number": F.lit(1), "x0": F.lit(0), "font_size": F.lit(FONT_SIZE), "is_bold": F.lit(False)})
    return corpus.classify_blocks(corpus.reading_order(blocks)).drop("page_number", "x0", "y0", "font_size", "is_bold")


def take(batch: DataFrame, number: int, output: str, config: Config) -> None:
    """One batch's elements, in folders of its own."""
    spark = batch.sparkSession
    before = stored(spark, output, ELEMENTS).where(F.col("batch") != number).select("checksum_sha256")
    fresh = corpus.new_documents(accepted(batch), before)
    rows = elements(fresh, config.ocr_least).withColumn("batch", F.lit(number).cast("long"))
    rows.select(*(c.split()[0] for c in ELEMENTS.split(", "))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "element_type").parquet(output)
    wrote = stored(spark, output, ELEMENTS).where(F.col("batch") == number).agg(F.countDistinct("document_id").alias("documents"), F.count(F.lit(1)).alias("elements")).first()
    LOG.info("batch %d: wrote %d elements of %d documents to %s", number, wrote.elements, wrote.documents, output)


def pattern(path: str) -> str:
    """The path as a pattern that only it matches: a stream takes those for single files as well as for folders."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, input: str, output: str, checkpoint: str, config: Config | None = None) -> int:
    """Takes what is new, waits until all of it is stored, and returns how many rows that were."""
    config = config or Config()
    reader = spark.readStream.schema(config.schema)
    if config.files_per_batch:
        reader = reader.option("maxFilesPerTrigger", config.files_per_batch)
    query = reader.parquet(pattern(input)).writeStream.foreachBatch(lambda batch, number: take(batch, number, output, config)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = sum(p["numInputRows"] for p in query.recentProgress)
    LOG.info("read %d new rows of %s", rows, input)
    return rows


def read_elements(spark: SparkSession, output: str) -> DataFrame:
    return stored(spark, output, ELEMENTS)


def current(spark: SparkSession, output: str) -> DataFrame:
    """The elements of each document's newest version."""
    every = read_elements(spark, output)
    newest = every.groupBy("document_id").agg(F.max("batch").alias("batch"))
    return every.join(newest, ["document_id", "batch"], "left_semi")


def main() -> None:
    from foliary.session import build_session

    options = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("input", "output", "checkpoint"):
        options.add_argument(f"--{name}", required=True)
    options.add_argument("--config", default=os.path.join(os.path.dirname(__file__), "intake.json"))
    given = options.parse_args()
    begin_log()
    spark = build_session("intake")
    try:
        run(spark, given.input, given.output, given.checkpoint, Config(**read_config(given.config)))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
