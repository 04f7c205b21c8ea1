"""Queries over evaluation runs, scopes, listings and values; records are made from the events table by plain rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.operators import context, corpus, extract, grounding, runs
from foliary.operators import evaluate as E
from foliary.plans.catalog import query
from foliary.session import read_table

# one record for each event, by expressions that both engines read alike
_FIELDS = {
    "configuration": "'c' || CAST(user_id % 3 AS VARCHAR(9))",
    "status": "CASE event_type WHEN 'view' THEN 'ABSTAINED' WHEN 'error' THEN 'FAILED' ELSE 'ANSWERED' END",
    "ground_truth_status": "CASE WHEN value > 20 THEN 'SCORABLE' ELSE 'ANSWER_NOT_INDEXED' END",
    "reason_code": "CASE event_type WHEN 'view' THEN 'RETRIEVAL_NO_RELEVANT_EVIDENCE' WHEN 'error' THEN 'MODEL_TIMEOUT' END",
    "anls": "CASE WHEN event_type IN ('view', 'error') THEN CAST(0 AS DOUBLE) ELSE CAST(event_id % 5 AS DOUBLE) / 4 END",
    "exact_match": "event_type NOT IN ('view', 'error') AND event_id % 5 = 4",
    "citation_labels_emitted": "CASE WHEN event_type IN ('view', 'error') THEN 0 ELSE event_id % 4 END",
    "citation_labels_valid": "CASE WHEN event_type IN ('view', 'error') OR event_id % 4 = 0 THEN 0 ELSE event_id % 4 - 1 END",
    "citation_document_hit": "event_id % 2 = 0",
    "all_citations_true_document": "CASE WHEN event_id % 5 > 0 THEN event_id % 5 < 3 END",
    "gold_evidence_citation_hit": "event_id % 7 < 3",
    "gold_evidence_citation_count": "event_id % 2",
    "answer_supported_by_cited_evidence": "CASE WHEN event_id % 6 > 0 THEN event_id % 6 < 4 END",
    "retrieval_time_ms": "value",
    "generation_time_ms": "CASE WHEN event_type <> 'error' THEN value * 3 END",
    "grounding_time_ms": "CAST(NULL AS DOUBLE)",
}
_R = "(SELECT event_id, " + ", ".join(f"{sql} AS {name}" for name, sql in _FIELDS.items()) + " FROM events)"

_RATES = (
    "count(*) FILTER (status = 'ANSWERED' AND citation_labels_emitted > 0) / nullif(count(*) FILTER (status = 'ANSWERED'), 0) AS citation_presence_rate, "
    "sum(citation_labels_valid) FILTER (status = 'ANSWERED') / nullif(sum(citation_labels_emitted) FILTER (status = 'ANSWERED'), 0) AS citation_reference_validity_rate, "
    "count(*) FILTER (status = 'ANSWERED' AND citation_labels_emitted > 0 AND citation_document_hit) / nullif(count(*) FILTER (status = 'ANSWERED' AND citation_labels_emitted > 0), 0) AS citation_document_hit_rate, "
    "sum(citation_labels_valid) FILTER (status = 'ANSWERED' AND all_citations_true_document) / nullif(sum(citation_labels_emitted) FILTER (status = 'ANSWERED'), 0) AS all_citations_true_document_rate, "
    "count(*) FILTER (status = 'ANSWERED' AND citation_labels_emitted > 0 AND gold_evidence_citation_hit) / nullif(count(*) FILTER (status = 'ANSWERED' AND citation_labels_emitted > 0), 0) AS gold_evidence_citation_hit_rate, "
    "sum(gold_evidence_citation_count) FILTER (status = 'ANSWERED' AND citation_labels_emitted > 0) / nullif(sum(citation_labels_emitted) FILTER (status = 'ANSWERED'), 0) AS gold_evidence_citation_precision, "
    "count(*) FILTER (status = 'ANSWERED' AND citation_labels_emitted > 0 AND answer_supported_by_cited_evidence) / nullif(count(answer_supported_by_cited_evidence) FILTER (status = 'ANSWERED' AND citation_labels_emitted > 0), 0) AS answer_supported_by_cited_evidence_rate"
)


def _rounded(sql: str, names: str) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE), 9) AS {n}" for n in names.split()).join(("SELECT configuration, ", f" FROM ({sql})"))


def _round(df: DataFrame, key: str, names: str) -> DataFrame:
    return df.select(key, *(F.round(F.col(n).cast("double"), 9).alias(n) for n in names.split()))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_id", *(F.expr(sql.replace("VARCHAR(9)", "STRING")).alias(name) for name, sql in _FIELDS.items()))


_CITED = "citation_presence_rate citation_reference_validity_rate citation_document_hit_rate all_citations_true_document_rate gold_evidence_citation_hit_rate gold_evidence_citation_precision answer_supported_by_cited_evidence_rate"
_RUN = "attempted scorable unscorable answered abstained failed coverage abstention_rate correct_abstentions end_to_end_anls scorable_anls end_to_end_exact_match scorable_exact_match " + _CITED
_RUN_SQL = (
    "SELECT configuration, count(*) AS attempted, count(*) FILTER (ground_truth_status = 'SCORABLE') AS scorable, count(*) FILTER (ground_truth_status <> 'SCORABLE') AS unscorable, "
    "count(*) FILTER (status = 'ANSWERED') AS answered, count(*) FILTER (status = 'ABSTAINED') AS abstained, count(*) FILTER (status = 'FAILED') AS failed, "
    "count(*) FILTER (status = 'ANSWERED') / count(*) AS coverage, count(*) FILTER (status = 'ABSTAINED') / count(*) AS abstention_rate, "
    "count(*) FILTER (status = 'ABSTAINED' AND ground_truth_status <> 'SCORABLE') AS correct_abstentions, avg(anls) AS end_to_end_anls, avg(anls) FILTER (ground_truth_status = 'SCORABLE') AS scorable_anls, "
    f"avg(CAST(exact_match AS INT)) AS end_to_end_exact_match, avg(CAST(exact_match AS INT)) FILTER (ground_truth_status = 'SCORABLE') AS scorable_exact_match, {_RATES} FROM {_R} GROUP BY configuration"
)


@query("answer_run", _rounded(_RUN_SQL, _RUN))
def answer_run(spark, sf_dir):
    return _round(runs.answer_run(_records(spark, sf_dir)), "configuration", _RUN)


_DIAGNOSTIC = "attempted scorable answered failed completion_rate_scorable raw_end_to_end_anls raw_scorable_anls raw_end_to_end_exact_match raw_scorable_exact_match metric_end_to_end_anls metric_scorable_anls metric_end_to_end_exact_match metric_scorable_exact_match " + _CITED
_DIAGNOSTIC_SQL = (
    "SELECT configuration, count(*) AS attempted, count(*) FILTER (ground_truth_status = 'SCORABLE') AS scorable, count(*) FILTER (status = 'ANSWERED') AS answered, count(*) FILTER (status <> 'ANSWERED') AS failed, "
    "count(*) FILTER (status = 'ANSWERED') / nullif(count(*) FILTER (ground_truth_status = 'SCORABLE'), 0) AS completion_rate_scorable, "
    + ", ".join(f"avg({v}) AS {p}_end_to_end_{n}, avg({v}) FILTER (ground_truth_status = 'SCORABLE') AS {p}_scorable_{n}" for p, n, v in (("raw", "anls", "anls / 2"), ("raw", "exact_match", "0"), ("metric", "anls", "anls"), ("metric", "exact_match", "CAST(exact_match AS INT)")))
    + f", {_RATES} FROM {_R} GROUP BY configuration"
)


@query("diagnostic_run", _rounded(_DIAGNOSTIC_SQL, _DIAGNOSTIC))
def diagnostic_run(spark, sf_dir):
    r = _records(spark, sf_dir).withColumns({"raw_anls": F.col("anls") / 2, "raw_exact_match": F.lit(False), "metric_anls": F.col("anls"), "metric_exact_match": F.col("exact_match")})
    return _round(runs.diagnostic_run(r), "configuration", _DIAGNOSTIC)


_TIMERS = ("retrieval_time_ms", "generation_time_ms", "grounding_time_ms")


@query(
    "run_latencies",
    " UNION ALL ".join(f"SELECT configuration, '{f}' AS field, count({f}) AS samples, round(avg({f}), 6) AS mean_ms, round(quantile_cont({f}, 0.5), 6) AS median_ms, round(quantile_cont({f}, 0.95), 6) AS p95_ms FROM {_R} GROUP BY configuration" for f in _TIMERS),
)
def run_latencies(spark, sf_dir):
    """All timers, one of which has no samples."""
    out = runs.latencies(_records(spark, sf_dir), list(_TIMERS))
    return out.select("configuration", "field", "samples", *(F.round(c, 6).alias(c) for c in ("mean_ms", "median_ms", "p95_ms")))


@query("run_failures", f"SELECT configuration, reason_code, count(*) AS n FROM {_R} WHERE reason_code IS NOT NULL GROUP BY ALL")
def run_failures(spark, sf_dir):
    return runs.histogram(_records(spark, sf_dir), "reason_code")


@query(
    "reliability",
    "SELECT count(*) AS processed, count(*) FILTER (event_type <> 'view') AS attempted, count(*) FILTER (event_type NOT IN ('view', 'error')) AS successful, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'view') AS skipped, "
    "round(count(*) FILTER (event_type NOT IN ('view', 'error')) / count(*) FILTER (event_type <> 'view'), 9) AS success_rate, count(value) FILTER (event_type <> 'view') AS samples, round(avg(value) FILTER (event_type <> 'view'), 6) AS mean_ms, "
    "round(quantile_cont(value, 0.5) FILTER (event_type <> 'view'), 6) AS median_ms, round(quantile_cont(value, 0.95) FILTER (event_type <> 'view'), 6) AS p95_ms FROM events",
)
def reliability(spark, sf_dir):
    status = F.when(F.col("event_type") == "view", "skipped").when(F.col("event_type") == "error", "failed").otherwise("success")
    out = runs.reliability(read_table(spark, sf_dir, "events").select(status.alias("status"), F.col("value").alias("processing_time_ms")))
    counts = ("processed", "attempted", "successful", "failed", "skipped", "samples")
    return out.select(*counts, F.round("success_rate", 9).alias("success_rate"), *(F.round(c, 6).alias(c) for c in ("mean_ms", "median_ms", "p95_ms")))


@query("failure_reasons", "SELECT event_type, CASE event_type WHEN 'error' THEN 'MODEL_TIMEOUT' WHEN 'view' THEN 'MODEL_MODEL_MISSING' WHEN 'click' THEN 'INVALID_CITATION' WHEN 'signup' THEN 'RETRIEVAL_ERROR' ELSE 'KEYERROR' END AS reason, count(*) AS n FROM events GROUP BY ALL")
def failure_reasons(spark, sf_dir):
    kind = F.col("event_type")
    origin = F.when(kind.isin("error", "view"), "model").when(kind == "click", "rag").otherwise("KeyError")
    message = F.when(kind == "error", "Timed out").when(kind == "view", "the model is unavailable").when(kind == "click", "a Citation is wrong").when(kind == "signup", "Retrieval broke")
    return read_table(spark, sf_dir, "events").groupBy("event_type", runs.failure_reason(origin, message).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# answers that cite [S1], [S3] (which isn't there) and for even ids [S2], twice; S1 is an order's first line
_SOURCES = "(SELECT o_orderkey AS record_id, o_orderstatus AS s, o_orderkey % 2 = 0 AS two, o_orderkey % 3 = 0 AS gold FROM orders)"


@query(
    "source_metrics",
    f"SELECT record_id, CASE WHEN two THEN 3 ELSE 2 END AS citation_labels_emitted, CASE WHEN two THEN 2 ELSE 1 END AS citation_labels_valid, s = 'F' OR two AS citation_document_hit, s = 'F' AS all_citations_true_document, "
    f"gold AS gold_evidence_citation_hit, CASE WHEN gold THEN 1 ELSE 0 END AS gold_evidence_citation_count, round(CASE WHEN gold THEN 1.0 ELSE 0.0 END / CASE WHEN two THEN 2 ELSE 1 END, 9) AS gold_evidence_citation_precision, two AS answer_supported_by_cited_evidence FROM {_SOURCES}",
)
def source_metrics(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").withColumn("two", F.col("o_orderkey") % 2 == 0)
    answers = o.select(
        F.col("o_orderkey").alias("record_id"), F.concat(F.lit("It is so [S1] and [S3]"), F.when(F.col("two"), ", by [S2] and [S2].").otherwise(".")).alias("answer"), F.lit("F").alias("target_document_id"),
        F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("one"))).otherwise(F.array(F.lit("none"))).alias("relevant_chunk_ids"), F.array(F.lit("  TWO\twords "), F.lit(" ")).alias("accepted_answers"),
    )
    one = o.select(F.col("o_orderkey").alias("record_id"), F.lit("S1").alias("source_id"), F.col("o_orderstatus").alias("document_id"), F.lit("one").alias("chunk_id"), F.lit("nothing").alias("excerpt"))
    two = o.select(F.col("o_orderkey").alias("record_id"), F.lit("S2").alias("source_id"), F.lit("F").alias("document_id"), F.lit("two").alias("chunk_id"), F.lit("of two  Words").alias("excerpt"))
    out = runs.source_metrics(answers, one.unionByName(two))
    return out.withColumn("gold_evidence_citation_precision", F.round(F.coalesce("gold_evidence_citation_precision", F.lit(0.0)), 9))


_RAG = (
    "(SELECT doc_id, doc_id % 5 = 0 AS quiet, doc_id % 3 > 0 AS cites, contains(lower(text), ' the ') AS fact FROM documents)"
)
_RAG_ROWS = (
    "SELECT doc_id AS case_id, cites AS citations_present, cites AS citations_valid, CASE WHEN NOT quiet THEN cites END AS expected_document_cited, CASE WHEN quiet THEN 0 ELSE 2 END AS facts, "
    "CASE WHEN quiet THEN 0.0 ELSE 0.5 END AS key_fact_coverage, CASE WHEN quiet THEN true ELSE false END AS evidence_support, CASE WHEN quiet THEN NOT cites AND false END AS no_evidence_correct FROM " + _RAG
)


def _rag(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").withColumn("quiet", F.col("doc_id") % 5 == 0).withColumn("cites", F.col("doc_id") % 3 > 0)
    none = F.array().cast("array<string>")
    cases = d.select(F.col("doc_id").alias("case_id"), F.when(F.col("quiet"), none).otherwise(F.array(F.lit(" Report.PDF"))).alias("expected_documents"), F.when(F.col("quiet"), none).otherwise(F.array(F.lit("IT is"), F.lit("zzzz"))).alias("expected_facts"), F.col("quiet").alias("expect_no_evidence"))
    responses = d.select(F.col("doc_id").alias("case_id"), F.lit("so it  is").alias("answer"), F.when(F.col("cites"), F.array(F.lit("S1"))).otherwise(none).alias("citations"), F.col("cites").alias("citations_valid"), F.col("n_chars").cast("double").alias("generation_ms"), (F.col("n_chars") * 2.0).alias("total_ms"))
    sources = d.select(F.col("doc_id").alias("case_id"), F.lit("S1").alias("source_id"), F.col("doc_id").alias("document_id"), F.lit("report.pdf").alias("filename"), F.lit("it is").alias("excerpt"))
    return runs.rag_cases(cases, responses, sources)


@query("rag_cases", _RAG_ROWS)
def rag_cases(spark, sf_dir):
    return _rag(spark, sf_dir).drop("generation_ms", "total_ms")


@query(
    "rag_summary",
    "SELECT count(*) AS cases, 0.5 AS key_fact_coverage, round(avg(CAST(cites AS INT)) FILTER (NOT quiet), 9) AS citation_presence_rate, round(avg(CAST(cites AS INT)) FILTER (NOT quiet), 9) AS citation_validity_rate, "
    "round(avg(CAST(cites AS INT)) FILTER (NOT quiet), 9) AS expected_document_citation_rate, 0.0 AS evidence_support_rate, count(*) FILTER (quiet) AS no_evidence_cases, 0.0 AS no_evidence_correct_rate, "
    f"round(avg(n_chars), 6) AS mean_generation_ms, median(n_chars) AS median_generation_ms, round(2 * avg(n_chars), 6) AS mean_total_ms, 2 * median(n_chars) AS median_total_ms FROM {_RAG} JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id)",
)
def rag_summary(spark, sf_dir):
    out = runs.rag_summary(_rag(spark, sf_dir))
    return out.select(*(F.round(c, 9).alias(c) if c.endswith("rate") else F.round(c, 6).alias(c) if c.startswith("mean") else F.col(c) for c in out.columns))


@query("corpus_preflight", "SELECT c_custkey AS case_id, c_name AS expected_document, c_custkey % 3 <> 0 AS exists, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 4 <> 0 THEN c_nationkey ELSE 0 END AS indexed_chunks FROM customer")
def corpus_preflight(spark, sf_dir):
    """Every third customer's file is missing, every fourth isn't indexed."""
    c = read_table(spark, sf_dir, "customer")
    cases = c.select(F.col("c_custkey").alias("case_id"), F.array("c_name").alias("expected_documents"))
    inventory = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("document_id"), F.concat(F.lit(" "), F.upper("c_name")).alias("original_filename"), (F.col("c_custkey") % 4 != 0).alias("is_indexed"), F.col("c_nationkey").cast("long").alias("chunk_count"))
    return runs.preflight(cases, inventory)


_LINES = "(SELECT l_orderkey, l_linenumber, l_partkey % 2 AS c FROM lineitem)"


@query(
    "across_configurations",
    "WITH t AS (SELECT DISTINCT l_orderkey AS q, l_linenumber AS i FROM lineitem WHERE l_linenumber IN (2, 4)), n AS (SELECT q, count(*) AS needed FROM t GROUP BY q), "
    f"r AS (SELECT configuration, q, i, min(rank) AS rank FROM (SELECT 'c' || c AS configuration, l_orderkey AS q, l_linenumber AS i, row_number() OVER (PARTITION BY c, l_orderkey ORDER BY l_linenumber) AS rank FROM {_LINES}) GROUP BY ALL), "
    "m AS (SELECT configuration, q, 1.0 / min(rank) AS rr, count(*) FILTER (rank <= 1) / any_value(needed) AS r1, count(*) FILTER (rank <= 3) / any_value(needed) AS r3, (min(rank) <= 1)::INT AS h1, (min(rank) <= 3)::INT AS h3 FROM r JOIN t USING (q, i) JOIN n USING (q) GROUP BY ALL) "
    "SELECT configuration, (SELECT count(*) FROM n) AS cases, round(sum(rr) / (SELECT count(*) FROM n), 9) AS mrr, round(sum(r1) / (SELECT count(*) FROM n), 9) AS recall_at_1, round(sum(h1) / (SELECT count(*) FROM n), 9) AS hit_at_1, round(sum(r3) / (SELECT count(*) FROM n), 9) AS recall_at_3, round(sum(h3) / (SELECT count(*) FROM n), 9) AS hit_at_3 FROM m GROUP BY configuration",
)
def across_configurations(spark, sf_dir):
    """Two configurations that rank an order's lines of even and of odd parts; lines 2 and 4 are relevant."""
    from pyspark.sql.window import Window

    lines = read_table(spark, sf_dir, "lineitem").select(F.concat(F.lit("c"), (F.col("l_partkey") % 2).cast("string")).alias("configuration"), F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("chunk_id"))
    ranked = lines.withColumn("rank", F.row_number().over(Window.partitionBy("configuration", "query_id").orderBy("chunk_id")))
    out = runs.across_configurations(ranked, lines.where("chunk_id in (2, 4)"), (1, 3))
    return out.select("configuration", "cases", *(F.round(c, 9).alias(c) for c in out.columns[2:]))


@query("manifest_reasons", "SELECT CASE WHEN p_partkey % 4 = 0 THEN 'NOT_INGESTED' WHEN p_partkey % 4 = 1 THEN 'NOT_READY' WHEN p_partkey % 4 = 2 AND p_size < 10 THEN 'NOT_INDEXED' END AS reason_code, count(*) AS n FROM part GROUP BY 1")
def manifest_reasons(spark, sf_dir):
    k = F.col("p_partkey") % 4
    p = read_table(spark, sf_dir, "part")
    manifest = p.select(F.col("p_partkey").alias("source_record_id"))
    documents = p.where(k != 0).select(F.col("p_partkey").alias("source_record_id"), F.col("p_partkey").alias("document_id"), F.when(k == 1, "failed").otherwise("ready").alias("status"), F.lit(True).alias("is_indexed"), F.when((k == 2) & (F.col("p_size") < 10), 0).otherwise(5).alias("chunk_count"))
    return runs.with_reasons(manifest, documents).groupBy("reason_code").agg(F.count(F.lit(1)).alias("n"))


@query("message_scope", "SELECT doc_id, source AS shown, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '00000000-0000-0000-0000-' || lpad(CAST(doc_id AS VARCHAR), 12, '0') END AS scope FROM documents")
def message_scope(spark, sf_dir):
    """Scopes go into a message and come out again; every third message has none."""
    d = read_table(spark, sf_dir, "documents")
    one = F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    ids = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(one, one))
    coded = d.select("doc_id", context.encode_scope(F.concat(F.lit("  "), "source", F.lit(" ")), ids).alias("content"))
    return coded.select("doc_id", context.strip_scope(F.col("content")).alias("shown"), F.array_join(context.extract_scope(F.col("content")), ",").alias("scope"))


_TALKS = "(SELECT conv_id AS id, max(turn) AS updated_at, min(turn) AS created_at FROM conversations GROUP BY conv_id)"


@query("recent_conversations", f"SELECT id, updated_at FROM {_TALKS} ORDER BY updated_at DESC, created_at DESC, id LIMIT 100")
def recent_conversations(spark, sf_dir):
    talks = read_table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.max("turn").alias("updated_at"), F.min("turn").alias("created_at"))
    return corpus.recent_conversations(talks).select("id", "updated_at")


@query("conversation_messages", "SELECT turn, role, text FROM conversations WHERE conv_id = 3")
def conversation_messages(spark, sf_dir):
    m = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("sequence_number"), F.col("turn").alias("id"), "turn", "role", "text")
    return corpus.messages_of(m, 3).select("turn", "role", "text")


@query("point_lookup", "SELECT doc_id AS document_id, source, text FROM documents WHERE doc_id = 7")
def point_lookup(spark, sf_dir):
    return corpus.one_document(read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "source", "text"), 7)


@query("chunks_with_documents", "SELECT l_orderkey AS document_id, l_linenumber AS chunk_id, o_orderpriority AS original_filename FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def chunks_with_documents(spark, sf_dir):
    chunks = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_id"))
    documents = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderpriority").alias("original_filename"), (F.col("o_orderstatus") == "F").alias("is_indexed"))
    return corpus.with_documents(chunks, documents).select("document_id", "chunk_id", "original_filename")


@query("nested_documents", "SELECT l_orderkey AS document_id, count(DISTINCT l_linenumber % 2) AS pages, count(*) AS elements, min(l_linenumber) FILTER (l_linenumber % 2 = (SELECT min(x.l_linenumber % 2) FROM lineitem x WHERE x.l_orderkey = lineitem.l_orderkey)) AS first_element FROM lineitem GROUP BY l_orderkey")
def nested_documents(spark, sf_dir):
    """Orders as documents of two pages (odd and even lines), lines as elements."""
    l = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), (F.col("l_linenumber") % 2).alias("page_number"), F.col("l_linenumber").alias("sequence_order"), "l_shipdate")  # noqa: E741
    out = corpus.nested_documents(l.select("document_id").distinct(), l.select("document_id", "page_number").distinct(), l)
    elements = F.flatten(F.transform("pages", lambda p: p["elements"]))
    return out.select("document_id", F.size("pages").cast("long").alias("pages"), F.size(elements).cast("long").alias("elements"), F.element_at(elements, 1)["sequence_order"].alias("first_element"))


@query("string_lists", "SELECT doc_id AS document_id, CASE WHEN doc_id % 3 = 1 THEN 'found' ELSE 'not_found' END AS status, CASE WHEN doc_id % 3 = 1 THEN '[\"' || lang || '\",\"' || source || '\"]' END AS value FROM documents")
def string_lists(spark, sf_dir):
    """Lists whose items all stand in the evidence, one of which doesn't, and one with a blank item."""
    d = read_table(spark, sf_dir, "documents")
    bad = F.when(F.col("doc_id") % 3 == 0, F.lit("nowhere")).when(F.col("doc_id") % 3 == 2, F.lit(" ")).otherwise(F.col("source"))
    rows = d.select(F.col("doc_id").alias("document_id"), F.lit("f").alias("field"), F.lit("list[string]").alias("kind"), F.to_json(F.array(F.concat(F.lit(" "), "lang"), bad)).alias("value"), F.concat_ws("\n ", F.upper("lang"), "source").alias("evidence"))
    return extract.outcomes(rows).select("document_id", "status", "value")


@query("percentage_points", "SELECT event_type AS configuration, round((avg(value) / 1000 - 0.05) * 100, 6) AS points FROM events GROUP BY event_type")
def percentage_points(spark, sf_dir):
    now = read_table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("configuration")).agg((F.avg("value") / 1000).alias("rate"))
    delta = E.against_baseline(now, now.select("configuration", F.lit(0.05).alias("rate")), ["rate"])
    return delta.select("configuration", F.round(E.percentage_points(F.col("rate_delta")), 6).alias("points"))


@query("accuracy_claims", "SELECT doc_id FROM documents WHERE doc_id % 4 < 2")
def accuracy_claims(spark, sf_dir):
    forms = ("Acme accuracy: 9", "an ACME Total-System accuracy = 0.9", "accuracy: 93 %", "acme accuracy is good")
    lines = read_table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*(F.lit(x) for x in forms)), (F.col("doc_id") % 4 + 1).cast("int")).alias("value"))
    return E.claims(lines, "acme").select("doc_id")


@query(
    "grounded_claims",
    "SELECT doc_id AS summary_id, doc_id % 6 NOT IN (0, 1, 3) AS grounded FROM documents",
)
def grounded_claims(spark, sf_dir):
    """Six kinds of summaries: a new word, no citation, plurals and framing only, a relation over two sentences, headings, two claims."""
    forms = (
        "The pump runs daily [S1].", "The pump runs [S1]. It stops.", "According to the source, pumps run [S1].", "The pump requires oil [S1].",
        "## Overview:\n- The pump runs [S1].\nNot specified", "The pump runs [S1]. Oil is black [S1]",
    )
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("summary_id"))
    summaries = d.withColumn("summary", F.element_at(F.array(*(F.lit(x) for x in forms)), (F.col("summary_id") % 6 + 1).cast("int")))
    sources = d.select("summary_id", F.lit("S1").alias("source_id"), F.lit("The pump run starts.\nIt requires care. Oil is black. The pumps runs").alias("text"))
    return grounding.grounded(summaries, sources).select("summary_id", "grounded")


@query("sanitized_summaries", "SELECT doc_id AS summary_id, CASE WHEN doc_id % 2 = 0 THEN 'Start.' || chr(10) || '- Identifier/reference mentioned: AB-1. [S1]' ELSE 'Start. - AB-1 requires CD-2 [S1].' END AS summary, doc_id % 2 = 0 AS rewritten FROM documents")
def sanitized_summaries(spark, sf_dir):
    """A relation that only odd documents' sources state."""
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("summary_id"))
    summaries = d.withColumn("summary", F.lit("Start. - AB-1 requires CD-2 [S1]."))
    sources = d.select("summary_id", F.when(F.col("summary_id") % 2 == 0, "See AB-1. It requires care.").otherwise("AB-1 requires care.").alias("text"))
    return grounding.sanitized(summaries, sources, r"(?i)\b(?:requires?|supports?)\b")
