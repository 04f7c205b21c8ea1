"""Queries over whole tables for ingest, manifests, ranked lists and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.operators import chunking, compare, corpus, extract, runs, tables
from foliary.operators import evaluate as E
from foliary.plans.catalog import query
from foliary.session import own_folder, read_table
from foliary.sources import manifests

_PLAIN = "trim(regexp_replace(coalesce({}, ''), '\\s+', ' ', 'g'))"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages: of two in three only the first letters were native text."""
    c = read_table(spark, sf_dir, "conversations").where("text is not null")
    native = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, F.left("text", F.lit(12))).otherwise(F.lit(""))
    return c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page_number"), native.alias("text"), (F.col("turn") % 2 == 0).alias("has_image"), F.col("text").alias("whole"))


@query(
    "ocr_merge",
    f"WITH p AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN left(text, 12) ELSE '' END AS native, turn % 2 = 0 AS has_image, text AS whole FROM conversations WHERE text IS NOT NULL), "
    f"s AS (SELECT *, length({_PLAIN.format('native')}) < 20 AS needs, {_PLAIN.format('native')} <> '' AS has_text, length({_PLAIN.format('whole')}) >= 20 AND turn % 5 <> 4 AS read FROM p) "
    "SELECT conv_id AS document_id, turn AS page_number, needs AND (has_text OR has_image) AND read AS ocr_applied, CASE WHEN needs AND (has_text OR has_image) AND read THEN whole ELSE native END AS text, "
    "needs AND NOT (needs AND (has_text OR has_image) AND read) AS needs_ocr, CASE WHEN needs AND (has_text OR has_image) AND read THEN 'ocr' ELSE 'native' END AS extraction_method FROM s",
)
def ocr_merge(spark, sf_dir):
    """Pages with too little text take what was recognised on them, where there is enough; every fifth page has no result."""
    pages = corpus.page_state(_pages(spark, sf_dir))
    results = pages.where("page_number % 5 <> 4").select("document_id", "page_number", F.col("whole").alias("ocr_text"), F.lit(90.0).alias("ocr_confidence"))
    return corpus.merge_ocr(pages, results).select("document_id", "page_number", "ocr_applied", "text", "needs_ocr", "extraction_method")


@query("running_table_index", "SELECT l_suppkey AS document_id, l_orderkey AS page_number, l_linenumber AS position, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS INTEGER) AS table_index FROM lineitem")
def running_table_index(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("document_id"), F.col("l_orderkey").alias("page_number"), F.col("l_linenumber").alias("position"))
    return tables.running_index(li)


@query(
    "repeated_headers",
    "SELECT p_partkey AS table_id, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END AS row_count, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand || ' | ' || p_type || chr(10) || p_name END AS text FROM part",
)
def repeated_headers(spark, sf_dir):
    """Every other table repeats its header as first row, which goes; blank cells give no text."""
    p = read_table(spark, sf_dir, "part")
    head = F.array("p_brand", "p_type")
    first = F.when(F.col("p_partkey") % 2 == 0, head).otherwise(F.array("p_brand", "p_type", F.lit(" ")))
    rows = tables.without_repeated_header(F.array(first, F.array("p_name", F.lit(""))), head)
    return p.select(F.col("p_partkey").alias("table_id"), F.size(rows).alias("row_count"), chunking.table_text(F.array().cast("array<string>"), rows).alias("text"))


@query("ragged_rows", "SELECT CAST(c_custkey AS INTEGER) AS row_index, split_part(c_name, '#', 1) AS a, split_part(c_name, '#', 2) AS b, '' AS c FROM customer")
def ragged_rows(spark, sf_dir):
    """Cells that a row lacks are empty."""
    c = read_table(spark, sf_dir, "customer")
    return tables.from_cells(["a", "b", "c"], c.select(F.col("c_custkey").cast("int").alias(tables.ROW), F.split("c_name", "#").alias("cells")))


_SEEN = "SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events"


@query("ranked_once", f"SELECT user_id AS query_id, event_type AS chunk_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY min(rank), event_type) AS INTEGER) AS rank FROM ({_SEEN}) GROUP BY user_id, event_type")
def ranked_once(spark, sf_dir):
    """Ranked ids, each once at its best rank."""
    from pyspark.sql.window import Window

    e = read_table(spark, sf_dir, "events")
    ranked = e.select(F.col("user_id").alias("query_id"), F.col("event_type").alias("chunk_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("rank"))
    return E.first_of_each(ranked).select("query_id", "chunk_id", "rank")


_HIT = f"SELECT s.user_id, s.event_type, s.rank, t.wanted FROM ({_SEEN}) s JOIN (SELECT user_id, min(event_type) AS wanted FROM events GROUP BY user_id) t USING (user_id)"


@query("document_hits", f"SELECT user_id AS query_id, coalesce(1.0 / min(rank) FILTER (event_type = wanted), 0) AS reciprocal_rank, coalesce(min(rank) FILTER (event_type = wanted) <= 1, false) AS document_hit_at_1, coalesce(min(rank) FILTER (event_type = wanted) <= 3, false) AS document_hit_at_3 FROM ({_HIT}) GROUP BY user_id")
def document_hits(spark, sf_dir):
    """Whether a relevant item's document is among the first k."""
    from pyspark.sql.window import Window

    e = read_table(spark, sf_dir, "events")
    ranked = e.select(F.col("user_id").alias("query_id"), F.col("event_type").alias("chunk_id"), F.col("event_type").alias("document_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("rank"))
    truth = e.groupBy(F.col("user_id").alias("query_id")).agg(F.min("event_type").alias("chunk_id")).withColumn("document_id", F.col("chunk_id"))
    return E.retrieval_metrics(ranked, truth, (1, 3), document="document_id").select("query_id", "reciprocal_rank", "document_hit_at_1", "document_hit_at_3")


@query("layout_totals", "SELECT tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, other AS unsupported_truth, other AS unsupported_predicted FROM (SELECT count(*) FILTER (l_returnflag <> 'N' AND l_quantity > 10) AS tp, count(*) FILTER (l_returnflag <> 'N' AND l_quantity <= 5) AS fp, count(*) FILTER (l_returnflag <> 'N' AND l_quantity > 5 AND l_quantity <= 10) AS fn, count(*) FILTER (l_returnflag = 'N' AND l_quantity > 10) AS other FROM lineitem)")
def layout_totals(spark, sf_dir):
    """Micro measures over the labels that count; boxes of the others are counted apart."""
    q, li = F.col("l_quantity"), read_table(spark, sf_dir, "lineitem")
    by = li.groupBy(F.col("l_returnflag").alias("label")).agg(F.count_if(q > 10).alias("tp"), F.count_if((q <= 5) & (F.col("l_returnflag") != "N")).alias("fp"), F.count_if((q > 5) & (q <= 10) & (F.col("l_returnflag") != "N")).alias("fn"))
    return runs.layout_totals(by, ("A", "R"))


@query("questions_with_answers", "SELECT d.doc_id AS question_key, d.source FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def questions_with_answers(spark, sf_dir):
    d, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return runs.first_questions(d.select(F.col("doc_id").alias("question_key"), "source"), labels.where("quality = 1").select(F.col("doc_id").alias("question_key")))


@query("picked_questions", "SELECT conv_id AS document_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS place, coalesce(text, '') AS question FROM conversations")
def picked_questions(spark, sf_dir):
    """Turns as questions of one record for each conversation, taken apart again in the order of records."""
    c = read_table(spark, sf_dir, "conversations")
    key = F.format_string("%020d-%s", F.col("turn"), F.col("role"))
    records = manifests.from_question_source(c.select(F.col("conv_id").alias("document_id"), key.alias("question_id"), F.coalesce("text", F.lit("")).alias("question"), F.array("role").alias("answers")))
    every = records.select(F.col("document_id").alias("evaluation_id"), "qa_pairs")
    return manifests.pick_questions(every).select(F.col("evaluation_id").alias("document_id"), F.col("place").cast("int").alias("place"), "question")


@query("scaled_boxes", "SELECT l_orderkey, l_linenumber, round(l_linenumber * (l_quantity + 1) / 10, 6) AS x0, round(l_linenumber * (l_linenumber + 1) / 20, 6) AS y0, round((l_linenumber + l_quantity) * (l_quantity + 1) / 10, 6) AS x1, round((l_linenumber + 2 * l_quantity) * (l_linenumber + 1) / 20, 6) AS y1 FROM lineitem WHERE l_quantity > 3")
def scaled_boxes(spark, sf_dir):
    """Boxes given by width and height, those without area left out, in another page space."""
    n, q = F.col("l_linenumber").cast("double"), F.col("l_quantity").cast("double")
    li = read_table(spark, sf_dir, "lineitem").withColumn("box", E.normal_box(n, n, F.when(q > 3, q).otherwise(0.0), 2 * q)).where("box is not null")
    sized = li.select("l_orderkey", "l_linenumber", "box.*", F.lit(10.0).alias("w"), F.lit(20.0).alias("h"), (q + 1).alias("to_w"), (n + 1).alias("to_h"))
    out = sized.select("l_orderkey", "l_linenumber", *E.scaled_box(["x0", "y0", "x1", "y1"], ("w", "h"), ("to_w", "to_h")))
    return out.select("l_orderkey", "l_linenumber", *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query("metric_texts", "SELECT event_type, CASE WHEN event_type = 'error' THEN 'NOT_APPLICABLE' ELSE printf('%.4f', round(avg(value), 8)) END AS shown FROM events GROUP BY event_type")
def metric_texts(spark, sf_dir):
    by = read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 8).alias("v"))
    return by.select("event_type", E.shown_metric(F.when(F.col("event_type") == "error", "NOT_APPLICABLE").otherwise("MEASURED"), F.col("v")).alias("shown"))


@query("canonical_labels", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN upper(event_type) END AS label FROM events")
def canonical_labels(spark, sf_dir):
    """The caller's own spelling of a label, nothing for another one."""
    e = read_table(spark, sf_dir, "events")
    return e.select("event_id", extract.canonical_label(F.concat(F.lit(" "), F.initcap("event_type")), F.array(F.lit("CLICK"), F.lit("VIEW"))).alias("label"))


@query(
    "coerced_dates",
    "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%B %d, %Y') WHEN 2 THEN NULL ELSE NULL END AS value FROM orders",
)
def coerced_dates(spark, sf_dir):
    """Dates in two forms, identifiers that hold one, and no date at all."""
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    raw = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "MMMM dd, yyyy")).when(k == 2, F.concat(F.lit("INV-"), F.date_format(d, "yyyy-MM-dd"))).otherwise("tomorrow")
    return read_table(spark, sf_dir, "orders").select("o_orderkey", extract.coerce(F.concat(F.lit(" "), raw), F.lit("date")).alias("value"))


@query(
    "normal_cases",
    "SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 3 = 0 THEN [source] WHEN doc_id % 3 = 1 THEN [source, lang] ELSE [lang] END AS documents, CASE WHEN doc_id % 2 = 0 THEN [1, 2] ELSE [CAST(doc_id AS INTEGER), 2] END AS pages FROM documents WHERE doc_id > 2",
)
def normal_cases(spark, sf_dir):
    """Single labels go to the head of their lists, unless they stand in them or are blank."""
    d, k = read_table(spark, sf_dir, "documents").where("doc_id > 2"), F.col("doc_id")
    cases = d.select(
        k.cast("string").alias("id"), F.when(k % 3 == 2, "").otherwise(F.col("source")).alias("expected_document"), F.when(k % 3 == 0, F.array("source")).otherwise(F.array("lang")).alias("expected_documents"),
        F.lit(None).cast("string").alias("expected_chunk"), F.array().cast("array<string>").alias("expected_chunks"), F.when(k % 2 == 0, 0).otherwise(k).cast("int").alias("expected_page"),
        F.when(k % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2))).alias("expected_pages"), F.lit(False).alias("expect_no_evidence"),
    )
    return manifests.normal_cases(cases).select("id", F.col("expected_documents").alias("documents"), F.col("expected_pages").alias("pages"))


@query("report_round_trip", "SELECT event_type AS metric, avg(value) AS value, count(*) AS denominator FROM events GROUP BY event_type")
def report_round_trip(spark, sf_dir):
    """Measures written as CSV and as JSON lines, and read back from both."""
    measured = read_table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("denominator"))
    folder = own_folder(spark, "reports")
    manifests.write_csv(measured, f"{folder}/csv")
    manifests.write_json(measured, f"{folder}/json")
    csv = manifests.read_metrics(spark, f"{folder}/csv", "metric string, value double, denominator long")
    lines = manifests.read_cases(spark, f"{folder}/json", "metric string, value double, denominator long")
    return csv.intersect(lines)


@query("iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END || '+00:00' AS at FROM events")
def iso_times(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", manifests.iso(F.col("ts")).alias("at"))


@query(
    "header_changes",
    "WITH b AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0), t AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 1) "
    "SELECT b.user_id AS table_id, b.event_type AS header, 'header_removed' AS change_type FROM b ANTI JOIN t USING (user_id, event_type) UNION ALL SELECT t.user_id, upper(t.event_type), 'header_added' FROM t ANTI JOIN b USING (user_id, event_type)",
)
def header_changes(spark, sf_dir):
    """Headers on one side only, apart from case and white space: a user's kinds of events of even and of odd number."""
    e = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("table_id"), F.col("event_type").alias("header"), "event_id")
    base = e.where("event_id % 2 = 0").select("table_id", "header").distinct()
    target = e.where("event_id % 2 = 1").select("table_id", F.upper("header").alias("header")).distinct()
    return compare.header_changes(base, target)


@query("blank_metadata", "SELECT doc_id, nullif(trim(CASE WHEN doc_id % 2 = 0 THEN '  ' ELSE ' ' || lang END), '') AS title, nullif(source, '') AS author FROM documents")
def blank_metadata(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "  ").otherwise(F.concat(F.lit(" "), "lang")).alias("title"), F.col("source").alias("author"))
    return d.select("doc_id", *corpus.blank_to_null(["title", "author"]))


@query("extraction_fails_closed", "SELECT doc_id AS document_id, f AS field, CASE WHEN f = 'a' AND doc_id % 4 = 0 THEN 'found' ELSE 'not_found' END AS status, CASE WHEN f = 'a' AND doc_id % 4 = 0 THEN lang END AS value FROM documents, (VALUES ('a'), ('b')) v(f)")
def extraction_fails_closed(spark, sf_dir):
    """A supported field beside another that is sound, unsupported, cites an unknown label, or is missing."""
    d, k = read_table(spark, sf_dir, "documents"), F.col("doc_id") % 4
    evidence = d.select(F.col("doc_id").alias("document_id"), F.lit("S1").alias("source_id"), F.concat_ws(" ", F.lit("in"), "lang", F.lit("only")).alias("text"))
    definitions = d.select(F.col("doc_id").alias("document_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("field"), F.lit("string").alias("kind"))
    no = F.array().cast("array<struct<value:string,sources:array<string>>>")
    item = lambda field, status, value, source: F.struct(F.lit(field).alias("field"), F.lit(status).alias("status"), value.cast("string").alias("value"), F.array(F.lit(source)).alias("sources"), no.alias("candidates"))
    sound = item("a", "found", F.col("lang"), "S1")
    other = F.when(k == 0, item("b", "not_found", F.lit(None), "S1")).when(k == 1, item("b", "found", F.lit("elsewhere"), "S1")).when(k == 2, item("b", "not_found", F.lit(None), "S9"))
    responses = d.select(F.col("doc_id").alias("document_id"), F.inline(F.array_compact(F.array(sound, other))))
    return extract.checked_fields(responses, definitions, evidence).select("document_id", "field", "status", "value")


_TIMED = "SELECT event_type AS method, value > 50 AS failed, CASE WHEN user_id % 3 = 0 THEN 0 ELSE 5 END AS results, 1.0 / (1 + user_id % 4) AS rr, value FROM events"


@query(
    "method_summary",
    "SELECT method, count(*) AS questions, count(*) FILTER (failed) AS errors, round(CAST(count(*) FILTER (NOT failed AND results = 0) AS DOUBLE) / count(*) FILTER (NOT failed), 9) AS no_evidence_rate, round(avg(CASE WHEN failed THEN 0 ELSE rr END), 9) AS mrr, "
    f"round(avg(CASE WHEN failed OR rr < 1 THEN 0.0 ELSE 1.0 END), 9) AS hit_at_1, count(*) FILTER (NOT failed) AS samples, round(avg(value) FILTER (NOT failed), 9) AS mean_ms, round(quantile_cont(value, 0.95) FILTER (NOT failed), 9) AS p95_ms FROM ({_TIMED}) GROUP BY method",
)
def method_summary(spark, sf_dir):
    """Failed questions count with 0, their times don't count."""
    e = read_table(spark, sf_dir, "events")
    rr = 1 / (1 + F.col("user_id") % 4)
    cases = e.select(F.col("event_type").alias("method"), (F.col("value") > 50).alias("failed"), F.when(F.col("user_id") % 3 == 0, 0).otherwise(5).alias("results"), rr.alias("reciprocal_rank"), rr.alias("recall_at_1"), (rr == 1).alias("hit_at_1"), F.col("value").alias("total_ms"))
    out = runs.method_summary(cases, (1,))
    return out.select("method", "questions", "errors", F.round("no_evidence_rate", 9).alias("no_evidence_rate"), F.round("mrr", 9).alias("mrr"), F.round("hit_at_1", 9).alias("hit_at_1"), "samples", F.round("mean_ms", 9).alias("mean_ms"), F.round("p95_ms", 9).alias("p95_ms"))


@query("row_states", "SELECT 't' AS table_id, CAST(p_partkey AS VARCHAR) AS row_key, CASE WHEN p_partkey % 11 = 0 THEN 'row_removed' WHEN p_partkey % 13 = 0 THEN 'row_added' WHEN p_partkey % 7 = 0 THEN 'row_modified' ELSE 'row_unchanged' END AS change_type FROM part WHERE NOT (p_partkey % 11 = 0 AND p_partkey % 13 = 0)")
def row_states(spark, sf_dir):
    """Rows of two versions of a table, those that didn't change too."""
    p, k = read_table(spark, sf_dir, "part"), F.col("p_partkey")
    cells = lambda size: F.array(F.concat(F.lit(" "), "p_name"), size.cast("string"))
    base = p.where(k % 13 != 0).select(F.lit("t").alias("table_id"), k.cast("string").alias("row_key"), cells(F.col("p_size")).alias("cells"))
    target = p.where(k % 11 != 0).select(F.lit("t").alias("table_id"), k.cast("string").alias("row_key"), cells(F.when(k % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))).alias("cells"))
    return compare.row_states(base, target)


@query("manifest_files", "SELECT doc_id AS source_record_id, CASE WHEN doc_id % 5 = 0 THEN 'NOT_INGESTED' WHEN doc_id % 5 = 1 THEN 'NOT_READY' WHEN doc_id % 5 = 2 THEN 'NOT_INDEXED' END AS reason_code FROM documents")
def manifest_files(spark, sf_dir):
    """Records of a manifest meet stored documents by the names of their files."""
    d, k = read_table(spark, sf_dir, "documents"), F.col("doc_id")
    manifest = d.select(k.alias("source_record_id"), F.concat(F.lit("/data/"), "source", F.lit("/"), k.cast("string"), F.lit(".pdf")).alias("local_pdf_path"))
    stored = d.where("doc_id % 5 <> 0").select(k.alias("document_id"), F.concat(k.cast("string"), F.lit(".pdf")).alias("original_filename"), F.when(k % 5 == 1, "failed").otherwise("ready").alias("status"), (k % 5 != 2).alias("is_indexed"), F.lit(3).alias("chunk_count"))
    return runs.with_reasons(manifest, stored, by_file=True).select("source_record_id", "reason_code")
