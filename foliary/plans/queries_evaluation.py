"""Measures over results, answers, texts and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.operators import evaluate as E
from foliary.operators import retrieval as R
from foliary.plans.catalog import query
from foliary.plans.queries_search import _chunks, _ranked, _scored, _vectors
from foliary.session import read_table

_TRUTH = "SELECT q.vec_id AS query_id, e.vec_id AS chunk_id FROM embeddings e JOIN (SELECT * FROM embeddings WHERE vec_id IN (0, 1, 2, 3, 4)) q ON q.label = e.label"


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the query's own label are relevant."""
    e = read_table(spark, sf_dir, "embeddings")
    q = _vectors(spark, sf_dir).select("query_id").join(e.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    return e.select(F.col("vec_id").alias("chunk_id"), "label").join(F.broadcast(q), "label").select("query_id", "chunk_id")


def _per_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = R.semantic_search(_vectors(spark, sf_dir), _chunks(spark, sf_dir), 10)
    return E.retrieval_metrics(ranked, _truth(spark, sf_dir))


_CASES = f"SELECT t.query_id, count(*) AS needed, min(r.rank) AS first_rank, coalesce(1.0 / min(r.rank), 0) AS rr, count(*) FILTER (r.rank <= 5) AS n5, count(*) FILTER (r.rank <= 10) AS n10 FROM ({_TRUTH}) t LEFT JOIN ({_ranked(_scored(), 10)}) r ON r.query_id = t.query_id AND r.chunk_id = t.chunk_id GROUP BY t.query_id"


@query("recall_mrr", f"SELECT query_id, needed, round(rr, 6) AS reciprocal_rank, round(CAST(n5 AS DOUBLE) / needed, 6) AS recall_at_5, round(CAST(n10 AS DOUBLE) / needed, 6) AS recall_at_10 FROM ({_CASES})")
def recall_mrr(spark, sf_dir):
    return _per_case(spark, sf_dir).select("query_id", "needed", *(F.round(c, 6).alias(c) for c in ("reciprocal_rank", "recall_at_5", "recall_at_10")))


@query("hit_at_k", f"SELECT query_id, n5 > 0 AS hit_at_5, n10 > 0 AS hit_at_10 FROM ({_CASES})")
def hit_at_k(spark, sf_dir):
    return _per_case(spark, sf_dir).select("query_id", "hit_at_5", "hit_at_10")


@query("retrieval_summary", f"SELECT count(*) AS cases, round(avg(rr), 6) AS mrr, round(avg(CAST(n10 AS DOUBLE) / needed), 6) AS recall_at_10, round(avg(CASE WHEN n10 > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_10 FROM ({_CASES})")
def retrieval_summary(spark, sf_dir):
    return E.retrieval_summary(_per_case(spark, sf_dir)).select("cases", *(F.round(c, 6).alias(c) for c in ("mrr", "recall_at_10", "hit_at_10")))


@query("p95_latency", "SELECT event_type, count(value) AS samples, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def p95_latency(spark, sf_dir):
    out = E.latency(read_table(spark, sf_dir, "events"), "value", ["event_type"])
    return out.select("event_type", "samples", *(F.round(c, 6).alias(c) for c in ("mean", "median", "p95")))


_BY_TYPE = "SELECT event_type, round(avg(value), 6) AS mean, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY event_type"


@query("metrics_unpivot", f"SELECT event_type, 'mean' AS metric, mean AS value FROM ({_BY_TYPE}) UNION ALL SELECT event_type, 'n', n FROM ({_BY_TYPE})")
def metrics_unpivot(spark, sf_dir):
    return E.wide_to_long(_by_type(spark, sf_dir), ["event_type"], ["mean", "n"])


@query("metrics_pivot", f"SELECT event_type, mean, n FROM ({_BY_TYPE})")
def metrics_pivot(spark, sf_dir):
    return E.long_to_wide(metrics_unpivot(spark, sf_dir), "event_type", ["mean", "n"])


def _by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).cast("double").alias("n"))


@query("gates", "SELECT 'mean' AS measure, round(avg(value), 6) AS value, 10.0::DOUBLE AS threshold, round(avg(value), 6) >= 10 AS passed FROM events UNION ALL SELECT 'n', CAST(count(*) AS DOUBLE), 100000000.0, count(*) >= 100000000 FROM events")
def gates(spark, sf_dir):
    m = read_table(spark, sf_dir, "events").agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).cast("double").alias("n"))
    return E.gates(m, {"mean": 10.0, "n": 100000000.0})


_ASCII = "text = regexp_replace(text, '[^ -~\\n]', '', 'g') AND n_chars BETWEEN 1 AND 400"
#: letters that the other engine counts as several bytes count as one sign on both sides
_PLAIN_TEXT = r"regexp_replace({}, '[^ -~\n]', '#', 'g')"
_NEXT = f"SELECT a.doc_id, {_PLAIN_TEXT.format('a.text')} AS reference, {_PLAIN_TEXT.format('b.text')} AS other FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1"
_RATE = "CASE WHEN length(reference) > 0 THEN CAST(d AS DOUBLE) / length(reference) WHEN length(other) > 0 THEN 1 ELSE 0 END"
_EDITS = f"SELECT *, levenshtein(reference, other) AS d FROM ({_NEXT})"


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All neighbours' whole texts, letters beyond ASCII as one sign."""
    plain = lambda c: F.regexp_replace(c, r"[^ -~\n]", "#").alias(c)
    return _all_neighbours(spark, sf_dir).select("doc_id", plain("reference"), plain("other"))


@query("levenshtein_cer", f"SELECT doc_id, round({_RATE}, 6) AS cer FROM ({_EDITS})")
def levenshtein_cer(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("doc_id", F.round(E.cer(F.col("reference"), F.col("other")), 6).alias("cer"))


@query("micro_macro_cer", f"SELECT count(*) AS texts, round(sum(d) / sum(length(reference)), 6) AS micro_cer, round(avg({_RATE}), 6) AS macro_cer FROM ({_EDITS})")
def micro_macro_cer(spark, sf_dir):
    return E.micro_macro(_neighbours(spark, sf_dir)).select("texts", F.round("micro_cer", 6).alias("micro_cer"), F.round("macro_cer", 6).alias("macro_cer"))


def _all_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of every document and the next one, of any length and script; dealt out anew, as edits take long."""
    d = read_table(spark, sf_dir, "documents").repartition(64, "doc_id")
    return d.select("doc_id", F.col("text").alias("reference")).join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")), "doc_id")


@query("levenshtein_cer_all")
def levenshtein_cer_all(spark, sf_dir):
    """Character error rates over all neighbours; the twin of ``levenshtein_cer`` counts bytes and is too slow for long texts, so tests compare with plain code."""
    return _all_neighbours(spark, sf_dir).select("doc_id", F.round(E.cer(F.col("reference"), F.col("other")), 6).alias("cer"))


@query("micro_macro_cer_all")
def micro_macro_cer_all(spark, sf_dir):
    return E.micro_macro(_all_neighbours(spark, sf_dir)).select("texts", F.round("micro_cer", 6).alias("micro_cer"), F.round("macro_cer", 6).alias("macro_cer"))


@query("anls_all")
def anls_all(spark, sf_dir):
    """Each whole text as the answer, the next document's whole text as the prediction."""
    a, p = F.array("reference"), F.col("other")
    return _all_neighbours(spark, sf_dir).select("doc_id", F.round(E.anls(a, p), 6).alias("anls"), E.exact_match(a, p).alias("exact_match"))


_KEYS = f"SELECT doc_id, trim(regexp_replace(lower(reference), '\\s+', ' ', 'g')) AS a, trim(regexp_replace(lower(other), '\\s+', ' ', 'g')) AS p FROM ({_NEXT})"
_SHARE = f"SELECT doc_id, a = p AS exact_match, CASE WHEN greatest(length(a), length(p)) > 0 THEN CAST(levenshtein(a, p) AS DOUBLE) / greatest(length(a), length(p)) ELSE 0 END AS share FROM ({_KEYS})"


@query("anls", f"SELECT doc_id, CASE WHEN share < 0.5 THEN round(1 - share, 6) ELSE 0 END AS anls, exact_match FROM ({_SHARE})")
def anls(spark, sf_dir):
    """Whole texts as answers, the next documents' as predictions; letters beyond ASCII as one sign."""
    rows, a, p = _neighbours(spark, sf_dir), F.array("reference"), F.col("other")
    return rows.select("doc_id", F.round(E.anls(a, p), 6).alias("anls"), E.exact_match(a, p).alias("exact_match"))


@query("rank_delta", f"SELECT count(*) FILTER (d > 0) AS improved, count(*) FILTER (d = 0) AS unchanged, count(*) FILTER (d < 0) AS worsened FROM (SELECT CAST(rank - chunk_id % 10 - 1 AS INTEGER) AS d FROM ({_ranked(_scored(), 10)}))")
def rank_delta(spark, sf_dir):
    ranked = R.semantic_search(_vectors(spark, sf_dir), _chunks(spark, sf_dir), 10)
    return E.rank_movement(ranked.select(F.col("rank").alias("base_rank"), (F.col("chunk_id") % 10 + 1).alias("rank"))).select("improved", "unchanged", "worsened")


_BOX = "SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS DOUBLE) AS x0, 0.0::DOUBLE AS y0, CAST(l_linenumber AS DOUBLE) + l_quantity AS x1, 10.0::DOUBLE AS y1 FROM lineitem"


@query("layout_iou", f"SELECT a.l_orderkey, a.l_linenumber, round(CASE WHEN least(a.x1, b.x1) > greatest(a.x0, b.x0) THEN (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * 10 / ((a.x1 - a.x0) * 10 + (b.x1 - b.x0) * 10 - (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * 10) ELSE 0 END, 6) AS iou FROM ({_BOX}) a JOIN ({_BOX}) b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1")
def layout_iou(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    n, w = F.col("l_linenumber").cast("double"), F.col("l_quantity").cast("double")
    boxes = li.select("l_orderkey", "l_linenumber", n.alias("x0"), F.lit(0.0).alias("y0"), (n + w).alias("x1"), F.lit(10.0).alias("y1"))
    other = boxes.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), *(F.col(c).alias(f"o_{c}") for c in ("x0", "y0", "x1", "y1")))
    met = boxes.join(other, ["l_orderkey", "l_linenumber"])
    return met.select("l_orderkey", "l_linenumber", F.round(E.iou(tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")), tuple(F.col(f"o_{c}") for c in ("x0", "y0", "x1", "y1"))), 6).alias("iou"))


@query("layout_match")
def layout_match(spark, sf_dir):
    """Boxes paired one to one, best overlap first; greedy choice has no SQL form, tests use goldens."""
    li = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.lit(1).alias("page_number"), F.col("l_linenumber").alias("box_index"), F.lit("Text").alias("label"), F.col("l_linenumber").cast("double").alias("x0"), F.lit(0.0).alias("y0"), (F.col("l_linenumber") + F.col("l_quantity")).cast("double").alias("x1"), F.lit(10.0).alias("y1"))
    moved = li.withColumn("x0", F.col("x0") + 0.5).withColumn("x1", F.col("x1") + 0.5)
    return E.layout_scores(li, moved, E.layout_match(li, moved))


@query("answer_summary", "SELECT event_type AS configuration, count(*) AS questions, count(*) FILTER (value > 20) AS completed, round(sum(CASE WHEN value > 20 THEN 0.5 ELSE 0 END) / count(*), 6) AS end_to_end_anls, round(quantile_cont(value, 0.95) FILTER (value > 20), 6) AS p95_ms FROM events GROUP BY event_type")
def answer_summary(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    done = F.col("value") > 20
    records = e.select(F.col("event_type").alias("configuration"), F.when(done, "COMPLETED").otherwise("FAILED").alias("status"), F.lit("SCORABLE").alias("ground_truth_status"), F.lit(0.5).alias("anls"), F.lit(False).alias("exact_match"), F.lit(1).alias("labels_emitted"), F.lit(1).alias("labels_valid"), F.col("value").alias("generation_ms"))
    out = E.answer_summary(records)
    return out.select("configuration", "questions", "completed", F.round("end_to_end_anls", 6).alias("end_to_end_anls"), F.round("p95_ms", 6).alias("p95_ms"))


_TRUE_WORDS = "' ' || array_to_string(regexp_extract_all(lower(regexp_replace(d.text, '[^ -~\\n]|_', '#', 'g')), '[a-z0-9]+'), ' ') || ' '"


@query("ground_truth", f"SELECT d.doc_id AS question_key, CASE WHEN contains({_TRUE_WORDS}, ' the ') THEN 'SCORABLE' ELSE 'ANSWER_NOT_INDEXED' END AS state FROM documents d")
def ground_truth(spark, sf_dir):
    """A question on every document; signs that aren't letters, digits or plain punctuation are one sign."""
    d = read_table(spark, sf_dir, "documents").withColumn("text", F.regexp_replace("text", r"[^ -~\n]|_", "#"))
    questions = d.select(F.col("doc_id").alias("question_key"), F.col("doc_id").alias("document_id"), F.array(F.lit("The")).alias("accepted_answers"))
    return E.ground_truth(questions, d.select(F.col("doc_id").alias("document_id"), F.col("doc_id").alias("chunk_id"), "text")).select("question_key", "state")


@query("ground_truth_all")
def ground_truth_all(spark, sf_dir):
    """A question on every document, of any language and script; tests compare with a plain word search."""
    d = read_table(spark, sf_dir, "documents")
    questions = d.select(F.col("doc_id").alias("question_key"), F.col("doc_id").alias("document_id"), F.array(F.lit("The")).alias("accepted_answers"))
    return E.ground_truth(questions, d.select(F.col("doc_id").alias("document_id"), F.col("doc_id").alias("chunk_id"), "text")).select("question_key", "state")
