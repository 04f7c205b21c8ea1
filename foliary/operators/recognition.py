"""A run over documents with known texts and boxes: what became of each document, and the run's report.

    truth_texts    document_id, reference
    truth_boxes    document_id, page_number, box_index, label, x0, y0, x1, y1
    responses      document_id, status, error (kind of exception, null if there was none), ocr_available, processing_time_ms, text
    predicted      as truth_boxes, labelled by kinds of blocks or by the labels themselves

A document without any truth is skipped; one without a response, with an error or of status failed has
failed, with a reason.  Texts of successful documents are scored, and boxes of all that were answered
without an error, failed or not.  Only the labels of ``evaluate.LAYOUT_LABELS`` count; boxes of others are
told apart.  Nulls: a null reference is none, a null text an empty one.  Empty tables give a
report of zeros whose rates are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.functions import text as T
from foliary.operators import evaluate
from foliary.operators.runs import rate, times

# Reasons by kind of error, and the kinds that an upload can have besides.
REASONS = {"CorruptedPDFError": "CORRUPTED_PDF", "EncryptedPDFError": "ENCRYPTED_PDF", "DocumentStorageError": "STORAGE_FAILURE", "PDFProcessingError": "PDF_PROCESSING_FAILURE"}
INGESTION = ("DocumentIngestionError", "InvalidUploadError", "EmptyUploadError", "UploadTooLargeError")
NO_TRUTH, NO_OCR, OCR_FAILED, UNEXPECTED = "NO_GROUND_TRUTH", "TESSERACT_UNAVAILABLE", "OCR_FAILED", "UNEXPECTED_FAILURE"

COUNTS = ("comparable_truth", "comparable_predicted", "unsupported_truth", "unsupported_predicted", "tp")


def reason_of(error: Column) -> Column:
    """The reason of an exception's kind; those of an upload carry their own name."""
    known = F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv))
    own = F.concat(F.lit("INGESTION_"), F.upper(F.regexp_replace(error, "Error$", "")))
    return F.coalesce(known[error], F.when(error.isin(*INGESTION), own), F.lit(UNEXPECTED))


def text_distances(pairs: DataFrame) -> DataFrame:
    """reference and text of each row: edits (d), sizes of the reference (n) and of the text (m), by characters and words, as they are and collapsed."""
    words = lambda c: F.filter(F.split(T.collapse(c), " "), lambda w: w != "")
    out = pairs.withColumns({"__r": T.nfkc(F.col("reference")), "__t": T.nfkc(F.col("text"))})
    for suffix, r, t in (("", F.col("reference"), F.col("text")), ("_collapsed", F.col("__r"), F.col("__t"))):
        out = out.withColumns({f"d_cer{suffix}": T.edits(r, t), f"n_cer{suffix}": F.length(r), f"m_cer{suffix}": F.length(t)})
        out = out.withColumns({f"d_wer{suffix}": T.word_distance(words(r), words(t)), f"n_wer{suffix}": F.size(words(r)), f"m_wer{suffix}": F.size(words(t))})
    return out.drop("__r", "__t")


RATES = ("cer", "wer", "cer_collapsed", "wer_collapsed")


def layout_counts(truth: DataFrame, predicted: DataFrame, least: float = 0.5) -> DataFrame:
    """Of each document: boxes of labels that count and of others on both sides, pairs, and the pairs' overlap in all."""
    labels = F.create_map(*(F.lit(x) for kv in evaluate.LAYOUT_LABELS.items() for x in kv))
    mine = predicted.withColumn("label", F.coalesce(labels[F.col("label")], "label"))
    counts = F.coalesce(F.col("label").isin(*evaluate.LAYOUT_LABELS.values()), F.lit(False))
    boxes = lambda df, name: df.groupBy("document_id").agg(F.count_if(counts).alias(f"comparable_{name}"), F.count_if(~counts).alias(f"unsupported_{name}"))
    pairs = evaluate.layout_match(truth.where(counts), mine.where(counts), least)
    paired = pairs.groupBy("document_id").agg(F.count(F.lit(1)).alias("tp"), F.sum("iou").alias("iou"))
    out = boxes(truth, "truth").join(boxes(mine, "predicted"), "document_id", "full_outer").join(paired, "document_id", "left")
    return out.na.fill(0, COUNTS).na.fill(0.0, ["iou"])


def cases(manifest: DataFrame, responses: DataFrame, truth_texts: DataFrame | None = None, truth_boxes: DataFrame | None = None, predicted: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """One row for each document of the manifest (document_id): status, reason_code, processing_time_ms, distances of its text, counts of its boxes."""
    every, truth = manifest.select("document_id").distinct(), F.lit(False)
    if truth_texts is not None:
        every = every.join(truth_texts.where(F.coalesce("reference", F.lit("")) != "").select("document_id", "reference"), "document_id", "left")
        truth |= F.col("reference").isNotNull()
    if truth_boxes is not None:
        every = every.join(truth_boxes.select("document_id", F.lit(True).alias("boxed")).distinct(), "document_id", "left")
        truth |= F.col("boxed").isNotNull()
    answered = responses.select("document_id", F.col("status").alias("given"), "error", "ocr_available", "processing_time_ms", F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("met"))
    every = every.withColumn("truth", truth).join(answered, "document_id", "left")
    broken = F.col("met").isNull() | F.col("error").isNotNull()
    failed = F.lower(F.coalesce("given", F.lit(""))) == "failed"
    every = every.withColumns({
        "status": F.when(~F.col("truth"), "skipped").when(broken | failed, "failed").otherwise("success"),
        "reason_code": F.when(~F.col("truth"), NO_TRUTH).when(broken, reason_of(F.col("error"))).when(failed, F.when(F.coalesce("ocr_available", F.lit(True)), OCR_FAILED).otherwise(NO_OCR)),
        "processing_time_ms": F.when(F.col("truth"), F.col("processing_time_ms").cast("double")),
        "laid_out": F.col("truth") & ~broken,
    })
    kept = ["document_id", "status", "reason_code", "processing_time_ms", "laid_out"]
    out = every.select(*kept)
    if truth_texts is not None:
        scored = text_distances(every.where("status = 'success' and reference is not null").select("document_id", "reference", "text")).drop("reference", "text")
        out = out.join(scored, "document_id", "left")
    if truth_boxes is not None:
        found = layout_counts(truth_boxes, predicted, least)
        scope = F.col("laid_out")
        out = out.join(found, "document_id", "left").withColumns({c: F.when(scope, F.coalesce(c, F.lit(0))) for c in (*COUNTS, "iou")})
    return out


def report(rows: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: counts by status, times of what was attempted, and micro and macro rates of whatever the cases were scored for."""
    n = lambda s: F.count_if(F.col("status") == s)
    attempted = F.count_if(F.col("status") != "skipped")
    columns = [F.count(F.lit(1)).alias("processed"), attempted.alias("attempted"), n("success").alias("successful"), n("failed").alias("failed"), n("skipped").alias("skipped"), rate(n("success"), attempted).alias("success_rate"), *times("processing_time_ms", approximate)]
    if "d_cer" in rows.columns:
        columns.append(F.count("d_cer").alias("texts"))
        for m in RATES:
            columns += [rate(F.sum(f"d_{m}"), F.sum(f"n_{m}")).alias(f"micro_{m}"), F.avg(evaluate.distance_rate(F.col(f"d_{m}"), F.col(f"n_{m}"), F.col(f"m_{m}"))).alias(f"macro_{m}")]
    if "tp" in rows.columns:
        columns += [F.count("tp").alias("layouts"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS), F.try_divide(F.sum("iou"), F.sum("tp")).alias("mean_matched_iou")]
    out = rows.agg(*columns)
    if "tp" in rows.columns:
        both = F.col("precision").isNotNull() & F.col("recall").isNotNull()
        out = out.withColumns({"fp": F.col("comparable_predicted") - F.col("tp"), "fn": F.col("comparable_truth") - F.col("tp"), "precision": rate(F.col("tp"), F.col("comparable_predicted")), "recall": rate(F.col("tp"), F.col("comparable_truth"))})
        out = out.withColumn("f1", F.when(both, rate(2 * F.col("tp"), F.col("comparable_predicted") + F.col("comparable_truth"))))
    return out


def reasons(rows: DataFrame) -> DataFrame:
    """How many documents failed or were skipped for each reason."""
    return rows.where("status <> 'success' and reason_code is not null").groupBy("reason_code").agg(F.count(F.lit(1)).alias("n"))
