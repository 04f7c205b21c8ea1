"""Store, history, context and stream queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliary.operators import chunking, context, corpus
from foliary.plans.catalog import query
from foliary.session import read_table
from foliary.streaming import streams


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("conversation_id"), (F.col("turn") + 1).alias("sequence_number"), "role", F.col("text").alias("content"))


@query("doc_list_page", "SELECT doc_id, lang, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40")
def doc_list_page(spark, sf_dir):
    return corpus.listing(_documents(spark, sf_dir).select("doc_id", "lang", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], 3, 20)


@query("doc_status_counts", "SELECT lang, source, count(*) AS n, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM documents GROUP BY lang, source")
def doc_status_counts(spark, sf_dir):
    return _documents(spark, sf_dir).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).withColumn("pages", corpus.total_pages(F.col("n"), 20).cast("long"))


@query("dup_checksum", "SELECT sha256(text) AS checksum_sha256, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_checksum(spark, sf_dir):
    return _documents(spark, sf_dir).groupBy(F.sha2("text", 256).alias("checksum_sha256")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("corpus_dedupe", "SELECT min(doc_id) AS document_id FROM documents WHERE lang <> 'en' AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en') GROUP BY sha256(text)")
def corpus_dedupe(spark, sf_dir):
    d = _documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), "lang", F.sha2("text", 256).alias("checksum_sha256"))
    return corpus.new_documents(d.where("lang <> 'en'"), d.where("lang = 'en'")).select("document_id")


@query("orphan_anti", "SELECT doc_id FROM labels WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id)")
def orphan_anti(spark, sf_dir):
    return read_table(spark, sf_dir, "labels").select("doc_id").join(read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("ready_semi", "SELECT doc_id, source FROM documents WHERE n_chars > 100 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def ready_semi(spark, sf_dir):
    return _documents(spark, sf_dir).where("n_chars > 100").select("doc_id", "source").join(read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("doc_summary", "SELECT conv_id AS document_id, count(*) AS pages, count(*) FILTER (role = 'assistant') AS ocr_pages, sum(length(text))::BIGINT AS characters, count(*) FILTER (role = 'user') AS headings FROM conversations GROUP BY conv_id")
def doc_summary(spark, sf_dir):
    """Conversations stand in for documents: their turns for pages and elements."""
    c = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), "text", (F.col("role") == "assistant").alias("ocr_applied"), F.when(F.col("role") == "user", "heading").otherwise("paragraph").alias("element_type"))
    tables = spark.createDataFrame([], "document_id long, rows array<array<string>>")
    return corpus.document_summary(c.select("document_id").distinct(), c, c, tables).select("document_id", "pages", "ocr_pages", "characters", "headings")


@query("ingest_status", "SELECT lang AS document_id, count(*) AS page_count, count(*) FILTER (length(text) < 60) AS open_pages, CASE WHEN count(*) FILTER (length(text) < 60) > 0 THEN 'failed' ELSE 'ready' END AS status FROM (SELECT lang, array_to_string(regexp_extract_all(text, '[^ \\n]+'), ' ') AS text FROM documents) GROUP BY lang")
def ingest_status(spark, sf_dir):
    pages = _documents(spark, sf_dir).select(F.col("lang").alias("document_id"), "text", F.lit(False).alias("has_image"), F.lit(False).alias("ocr_applied"))
    return corpus.document_status(corpus.page_state(pages, 60)).select("document_id", "page_count", "open_pages", "status")


@query("replace_index", "SELECT doc_id AS document_id, 'new' AS version FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id, 'old' FROM documents WHERE lang <> 'de'")
def replace_index(spark, sf_dir):
    stored = _documents(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.lit("old").alias("version"))
    fresh = _documents(spark, sf_dir).where("lang = 'de'").select(F.col("doc_id").alias("document_id"), F.lit("new").alias("version"))
    return corpus.replace_index(stored, fresh)


@query("delete_cascade", "SELECT conv_id AS document_id, count(*) AS kept FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY conv_id")
def delete_cascade(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "document_id")
    return corpus.delete_cascade(c.where("role = 'system'"), {"m": c})["m"].groupBy("document_id").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "append_sequence",
    "SELECT conv_id AS conversation_id, role, coalesce((SELECT max(turn) + 1 FROM conversations s WHERE s.conv_id = c.conv_id AND s.turn < 2), 0) + row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS sequence_number "
    "FROM conversations c WHERE turn >= 2 AND trim(text) <> '' AND role IN ('user', 'assistant')",
)
def append_sequence(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    stored = c.where("turn < 2").select(F.col("conv_id").alias("conversation_id"), (F.col("turn") + 1).alias("sequence_number"))
    incoming = c.where("turn >= 2").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("arrival"), "role", F.col("text").alias("content"))
    return corpus.append_messages(stored, incoming).select("conversation_id", "role", "sequence_number")


@query("title_if_empty", "SELECT conv_id AS conversation_id, CASE WHEN conv_id % 2 = 0 THEN 'kept' ELSE left(arg_min(text, turn) FILTER (role = 'user'), 512) END AS title FROM conversations GROUP BY conv_id")
def title_if_empty(spark, sf_dir):
    m = _messages(spark, sf_dir)
    conversations = m.select("conversation_id").distinct().withColumn("title", F.when(F.col("conversation_id") % 2 == 0, "kept").otherwise(" "))
    return corpus.titles(conversations, m)


_BACK = "sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n"


@query("history_budget", f"SELECT conv_id AS conversation_id, turn + 1 AS sequence_number FROM (SELECT *, {_BACK} FROM conversations) WHERE n <= 10 AND used <= 900")
def history_budget(spark, sf_dir):
    return context.stored_history(_messages(spark, sf_dir), 10, 900).select("conversation_id", "sequence_number")


@query(
    "history_clip",
    "WITH s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations), "
    "z AS (SELECT *, length(role) + 2 + length(text) + CASE WHEN n > 1 THEN 2 ELSE 0 END AS size FROM s WHERE n <= 10), "
    "u AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM z) "
    "SELECT conv_id AS conversation_id, turn + 1 AS sequence_number, role || ': ' || CASE WHEN used <= 900 THEN text ELSE rtrim(substring(text, 1, CAST(900 - (used - size) - CASE WHEN n > 1 THEN 2 ELSE 0 END - length(role) - 2 AS BIGINT))) END AS line "
    "FROM u WHERE used <= 900 OR (used - size <= 900 AND 900 - (used - size) - CASE WHEN n > 1 THEN 2 ELSE 0 END - length(role) - 2 > 0)",
)
def history_clip(spark, sf_dir):
    return context.prompt_history(_messages(spark, sf_dir), 10, 900)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source as one query's results, shortest first."""
    d = _documents(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("source").orderBy("n_chars", "doc_id"))
    none = F.lit(None)
    return d.select(F.col("source").alias("query_id"), rank.alias("rank"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("lang").alias("original_filename"), "text", none.cast("int").alias("start_page"), none.cast("int").alias("end_page"), none.cast("string").alias("section_heading"))


@query(
    "context_pack",
    "WITH r AS (SELECT source AS query_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rank, * FROM documents), "
    "h AS (SELECT *, '[S' || rank || ']\nDocument: ' || lang || '\nDocument ID: ' || doc_id || '\nChunk ID: ' || doc_id || '\nPage: (unavailable)\nSection: (none)\nFinal rank: ' || rank || '\nReranker score: (not reranked)\nContent:\n' AS head FROM r), "
    "u AS (SELECT *, sum(length(head) + length(text) + CASE WHEN rank > 1 THEN 2 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM h) "
    "SELECT query_id, CAST(rank AS INTEGER) AS rank, 'S' || rank AS source_id, length(head) + CASE WHEN used <= 3000 THEN length(text) ELSE 3000 - length(head) END AS chars, left(text, 500) AS excerpt FROM u WHERE used <= 3000 OR (rank = 1 AND 3000 - length(head) > 0)",
)
def context_pack(spark, sf_dir):
    out = context.pack_context(_results(spark, sf_dir), 3000)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "source_id", F.length("block").cast("long").alias("chars"), "excerpt")


@query("scope_inheritance", "SELECT conv_id AS conversation_id, turn + 1 AS sequence_number, last_value(CASE WHEN role = 'user' AND turn % 4 = 0 THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS effective_scope FROM conversations")
def scope_inheritance(spark, sf_dir):
    m = _messages(spark, sf_dir).withColumn("scope", F.when((F.col("role") == "user") & ((F.col("sequence_number") - 1) % 4 == 0), F.col("sequence_number") - 1))
    return context.inherited_scope(m).select("conversation_id", "sequence_number", "effective_scope")


@query("summary_batches")
def summary_batches(spark, sf_dir):
    """Greedy batches of each source's documents; each begins where the one before it ended, which tests compare with a loop."""
    d = _documents(spark, sf_dir).select("source", "doc_id", "text")
    return context.batches(d, "source", "doc_id", "text", 6000).groupBy("source", "batch").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("block")).alias("chars"))


@query("version_chain", "SELECT conv_id AS document_id, turn AS version_number, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_version, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS is_latest FROM conversations")
def version_chain(spark, sf_dir):
    return corpus.version_chain(read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("version_number")))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page_number"), "text", F.lit(False).alias("ocr"))


@query("chunk_documents")
def chunk_documents(spark, sf_dir):
    """Chunks of every document; the state machine has no SQL form, so tests compare it with a plain one."""
    return chunking.chunk_pages(_pages(spark, sf_dir))


@query("chunk_single", "SELECT CAST(doc_id AS VARCHAR) AS document_id, length(t) AS character_count, len(string_split(t, ' ')) AS token_count, sha256(t || '\n1\n1\n\ntext') AS fingerprint_sha256 FROM (SELECT doc_id, array_to_string(regexp_extract_all(text, '[^ \\n]+'), ' ') AS t FROM documents WHERE n_chars < 1100) WHERE t <> ''")
def chunk_single(spark, sf_dir):
    """Documents that are one chunk: its counts and fingerprint."""
    out = chunking.chunk_pages(_pages(spark, sf_dir).join(_documents(spark, sf_dir).where("n_chars < 1100").select(F.col("doc_id").cast("string").alias("document_id")), "document_id", "left_semi"))
    return out.select("document_id", F.col("character_count").cast("long").alias("character_count"), F.col("token_count").cast("long").alias("token_count"), "fingerprint_sha256")


@query("chunk_single_all")
def chunk_single_all(spark, sf_dir):
    """Of all documents' chunks those that are their document's only one; tests compare with ``chunk_documents``."""
    out = chunk_documents(spark, sf_dir).withColumn("chunks", F.count(F.lit(1)).over(Window.partitionBy("document_id"))).where("chunks = 1")
    return out.select("document_id", F.col("character_count").cast("long").alias("character_count"), F.col("token_count").cast("long").alias("token_count"), "fingerprint_sha256")


@query("stream_window", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def stream_window(spark, sf_dir):
    """The batch form of the stream's windows: the same plan over a table."""
    out = streams.latency_windows(read_table(spark, sf_dir, "events"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("mean", 6).alias("mean"))


@query("stream_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS b FROM events), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k")
def stream_sessions(spark, sf_dir):
    out = streams.sessions(read_table(spark, sf_dir, "events"))
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")
