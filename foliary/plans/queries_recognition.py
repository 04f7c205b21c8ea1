"""A recognition run over the benchmark's passages: texts with letters misread, words as boxes that are found a little aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.operators import recognition as R
from foliary.plans.catalog import query
from foliary.session import read_table

_LABELS = ("Section-header", "Text", "List-item", "Table", "Picture")
_KINDS = ("heading", "paragraph", "list_item", "table", "picture")


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents fail, break off or get no answer by their length; box n stands from 10 n to 10 n + 8, found 0, 2 or 4 aside."""
    ascii_only = F.regexp_replace("text", r"[^\x00-\x7F]", "~")
    b = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("document_id"), ascii_only.alias("text"))
    size = F.length("text")
    truth = b.where(size % 7 != 3).select("document_id", F.col("text").alias("reference"))
    status = F.when(size % 7 == 1, "failed").otherwise("ready")
    error = F.when(size % 7 == 0, F.when(size % 2 == 0, "CorruptedPDFError").otherwise("KeyError"))
    responses = b.where(size % 7 != 2).select("document_id", status.alias("status"), error.alias("error"), (size % 3 != 0).alias("ocr_available"), (size % 100).alias("processing_time_ms"), F.translate("text", "el", "c1").alias("text"))
    words = b.where(size % 7 != 3).select("document_id", F.posexplode(F.filter(F.split("text", " "), lambda w: w != "")).alias("box_index", "word"))
    kind, aside = F.length("word") % 5, F.length("word") % 3 * 2
    box = lambda names, dx: words.select("document_id", F.lit(1).alias("page_number"), "box_index", F.array(*map(F.lit, names))[kind].alias("label"), (F.col("box_index") * 10.0 + dx).alias("x0"), F.lit(0.0).alias("y0"), (F.col("box_index") * 10.0 + 8 + dx).alias("x1"), F.lit(10.0).alias("y1"))
    return R.cases(b, responses, truth, box(_LABELS, F.lit(0)), box(_KINDS, aside))


_B = r"(SELECT item_id, t, length(t) AS n, length(t) % 7 AS m, translate(t, 'el', 'c1') AS o FROM (SELECT item_id, regexp_replace(text, '[^\x00-\x7F]', '~', 'g') AS t FROM benchmark))"
_CASES = f"""
WITH b AS {_B},
w AS (SELECT item_id, length(unnest(list_filter(string_split(t, ' '), lambda x: x <> ''))) AS k FROM b WHERE m <> 3),
x AS (SELECT item_id, count(*) FILTER (k % 5 < 4) AS comparable, count(*) FILTER (k % 5 = 4) AS other, count(*) FILTER (k % 5 < 4 AND k % 3 < 2) AS tp, sum(CASE k % 3 WHEN 0 THEN 1.0 ELSE 0.6 END) FILTER (k % 5 < 4 AND k % 3 < 2) AS iou FROM w GROUP BY item_id),
c AS (SELECT b.item_id AS document_id, CASE WHEN m = 3 THEN 'skipped' WHEN m < 3 THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN m = 3 THEN 'NO_GROUND_TRUTH' WHEN m = 2 THEN 'UNEXPECTED_FAILURE' WHEN m = 0 AND n % 2 = 0 THEN 'CORRUPTED_PDF' WHEN m = 0 THEN 'UNEXPECTED_FAILURE' WHEN m = 1 AND n % 3 = 0 THEN 'TESSERACT_UNAVAILABLE' WHEN m = 1 THEN 'OCR_FAILED' END AS reason_code,
  CASE WHEN m NOT IN (2, 3) THEN CAST(n % 100 AS DOUBLE) END AS processing_time_ms, CASE WHEN m > 3 THEN levenshtein(t, o) END AS d, CASE WHEN m > 3 THEN n END AS n,
  CASE WHEN m = 1 OR m > 3 THEN coalesce(tp, 0) END AS tp, CASE WHEN m = 1 OR m > 3 THEN coalesce(comparable, 0) END AS comparable, CASE WHEN m = 1 OR m > 3 THEN coalesce(other, 0) END AS other, CASE WHEN m = 1 OR m > 3 THEN coalesce(iou, 0) END AS iou
  FROM b LEFT JOIN x USING (item_id))
"""


@query(
    "recognition_cases",
    _CASES + "SELECT document_id, status, reason_code, processing_time_ms, d AS edits, n AS characters, comparable AS comparable_truth, comparable AS comparable_predicted, other AS unsupported_truth, tp, round(CAST(iou AS DOUBLE), 6) AS iou FROM c",
)
def recognition_cases(spark, sf_dir):
    """What became of each document, with the distance of its text and the counts of its boxes."""
    return _run(spark, sf_dir).select("document_id", "status", "reason_code", "processing_time_ms", F.col("d_cer").cast("long").alias("edits"), F.col("n_cer").cast("long").alias("characters"), "comparable_truth", "comparable_predicted", "unsupported_truth", "tp", F.round("iou", 6).alias("iou"))


@query(
    "recognition_report",
    _CASES + "SELECT count(*) AS processed, count(*) FILTER (status <> 'skipped') AS attempted, count(*) FILTER (status = 'success') AS successful, round(count(*) FILTER (status = 'success') / count(*) FILTER (status <> 'skipped'), 9) AS success_rate, "
    "count(processing_time_ms) AS samples, round(quantile_cont(processing_time_ms, 0.95), 6) AS p95_ms, count(d) AS texts, round(sum(d) / sum(n), 9) AS micro_cer, round(avg(d / n), 9) AS macro_cer, count(tp) AS layouts, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(comparable) - sum(tp) AS BIGINT) AS fp, "
    "CAST(sum(other) AS BIGINT) AS unsupported_predicted, round(sum(tp) / sum(comparable), 9) AS f1, round(CAST(sum(iou) / sum(tp) AS DOUBLE), 9) AS mean_matched_iou FROM c",
)
def recognition_report(spark, sf_dir):
    """The run's report, rates to nine places."""
    out = R.report(_run(spark, sf_dir))
    exact, nine = ("processed", "attempted", "successful", "samples", "texts", "layouts", "tp", "fp", "unsupported_predicted"), ("success_rate", "micro_cer", "macro_cer", "f1", "mean_matched_iou")
    return out.select(*exact, F.round("p95_ms", 6).alias("p95_ms"), *(F.round(c, 9).alias(c) for c in nine))


@query("recognition_reasons", _CASES + "SELECT reason_code, count(*) AS n FROM c WHERE reason_code IS NOT NULL GROUP BY reason_code")
def recognition_reasons(spark, sf_dir):
    return R.reasons(_run(spark, sf_dir))
