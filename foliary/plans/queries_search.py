"""Search queries over embeddings and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.operators import retrieval as R
from foliary.operators import search as S
from foliary.plans.catalog import query
from foliary.session import own_folder, read_table

ASKED = (0, 1, 2, 3, 4)
WORDS = {0: "the and", 1: "der die", 2: "de la", 3: "that with", 4: "und ist"}


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks, one each, with their embeddings where they have one."""
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.col("doc_id").alias("sequence_number"), "text", F.col("lang").alias("content_type"))
    e = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return d.join(e, "chunk_id", "left")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(*ASKED))
    asked = F.create_map(*(x for k, v in WORDS.items() for x in (F.lit(k), F.lit(v))))
    return e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), asked[F.col("vec_id").cast("int")].alias("query"))


def _scored(where: str = "true") -> str:
    return (
        "SELECT q.vec_id AS query_id, d.doc_id AS chunk_id, d.source AS document_id, d.doc_id AS sequence_number, "
        "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS s FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id, "
        f"(SELECT * FROM embeddings WHERE vec_id IN (0, 1, 2, 3, 4)) q WHERE {where}"
    )


def _ranked(inner: str, k: int, score: str = "s") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, document_id, sequence_number, chunk_id) AS rank FROM ({inner}) QUALIFY rank <= {k}"


_SEM = "query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(s, 6) AS semantic_score"


def _shown(df: DataFrame) -> DataFrame:
    return df.select("query_id", "chunk_id", F.col("rank").cast("int").alias("rank"), F.round("semantic_score", 6).alias("semantic_score"))


@query("semantic_topk", f"SELECT {_SEM} FROM ({_ranked(_scored(), 10)})")
def semantic_topk(spark, sf_dir):
    return _shown(R.semantic_search(_vectors(spark, sf_dir), _chunks(spark, sf_dir), 10))


@query("semantic_floor", f"SELECT {_SEM} FROM ({_ranked(f'SELECT * FROM ({_scored()}) WHERE s >= 0.2', 50)})")
def semantic_floor(spark, sf_dir):
    return _shown(R.semantic_search(_vectors(spark, sf_dir), _chunks(spark, sf_dir), 50, floor=0.2))


_LANG = "d.lang = 'en'"


@query("semantic_filtered", f"SELECT {_SEM} FROM ({_ranked(_scored(_LANG), 10)})")
def semantic_filtered(spark, sf_dir):
    return _shown(R.semantic_search(_vectors(spark, sf_dir), _chunks(spark, sf_dir), 10, filters=R.Filters(content_types=["en"])))


_TERMS = "SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents"
_QUERY = "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{w}')" for k, v in WORDS.items() for w in v.split()) + ") v(query_id, term)"
_HITS = (
    f"SELECT q.query_id, t.doc_id AS chunk_id, any_value(t.source) AS document_id, t.doc_id AS sequence_number, CAST(count(*) AS DOUBLE) AS s "
    f"FROM ({_TERMS}) t JOIN ({_QUERY}) q ON q.term = t.term GROUP BY q.query_id, t.doc_id HAVING count(DISTINCT t.term) = 2"
)


@query("keyword_and_topk", f"SELECT CAST(query_id AS BIGINT) AS query_id, chunk_id, CAST(rank AS INTEGER) AS rank, s AS keyword_score FROM ({_ranked(_HITS, 10)})")
def keyword_and_topk(spark, sf_dir):
    out = R.keyword_search(_vectors(spark, sf_dir).select("query_id", "query"), _chunks(spark, sf_dir), k=10)
    return out.select("query_id", "chunk_id", F.col("rank").cast("int").alias("rank"), "keyword_score")


_FUSED = (
    f"SELECT query_id, chunk_id, any_value(document_id) AS document_id, any_value(sequence_number) AS sequence_number, sum(1.0 / (60 + rank)) AS h "
    f"FROM (SELECT query_id, chunk_id, document_id, sequence_number, rank FROM ({_ranked(_scored(), 40)}) UNION ALL "
    f"SELECT query_id, chunk_id, document_id, sequence_number, rank FROM ({_ranked(_HITS, 40)})) GROUP BY query_id, chunk_id"
)
_HYBRID = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(h, 12) DESC, document_id, sequence_number, chunk_id) AS rank FROM ({_FUSED}) QUALIFY rank <= 10"


@query("hybrid_rrf", f"SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(h, 6) AS hybrid_score FROM ({_HYBRID})")
def hybrid_rrf(spark, sf_dir):
    q, c = _vectors(spark, sf_dir), _chunks(spark, sf_dir)
    pool = R.pool_size(10)
    semantic, keyword = R.semantic_search(q, c, pool), R.keyword_search(q, c, k=pool)
    # scores that differ only by the order of their sum are ties
    fused = R.fuse(semantic, keyword, pool).withColumn("hybrid_score", F.round("hybrid_score", 12)).drop("rank")
    return R.ranked(fused, "hybrid_score", 10).select("query_id", "chunk_id", F.col("rank").cast("int").alias("rank"), F.round("hybrid_score", 6).alias("hybrid_score"))


_QUOTA = (
    f"SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY s DESC, sequence_number, chunk_id) AS dr FROM ({_scored()}) QUALIFY dr <= 40"
)


@query("selected_scope_quota", f"SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, CAST(dr AS INTEGER) AS document_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, dr, document_id, sequence_number, chunk_id) AS rank FROM ({_QUOTA}) QUALIFY rank <= 10)")
def selected_scope_quota(spark, sf_dir):
    every = R.semantic_search(_vectors(spark, sf_dir), _chunks(spark, sf_dir), k=None)
    return R.selected_scope(every, "semantic_score", 10).select("query_id", "chunk_id", F.col("rank").cast("int").alias("rank"), F.col("document_rank").cast("int").alias("document_rank"))


_RERANK = (
    "SELECT p.query_id, p.chunk_id, p.rank AS base_rank, "
    "CAST(len(list_intersect(q.terms, list_distinct(regexp_extract_all(lower(left(d.text, 2048)), '[\\p{L}\\p{N}]+')))) AS DOUBLE) / len(q.terms) "
    "- len(list_distinct(regexp_extract_all(lower(left(d.text, 2048)), '[\\p{L}\\p{N}]+'))) / 1e6 AS rs "
    f"FROM ({_ranked(_scored(), 40)}) p JOIN documents d ON d.doc_id = p.chunk_id JOIN (SELECT query_id, list(DISTINCT term) AS terms FROM ({_QUERY}) GROUP BY query_id) q ON q.query_id = p.query_id"
)


@query("rerank_movement", f"SELECT query_id, chunk_id, CAST(base_rank AS INTEGER) AS base_rank, CAST(rank AS INTEGER) AS rank, CAST(base_rank - rank AS INTEGER) AS rank_delta FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rs DESC, base_rank, chunk_id) AS rank FROM ({_RERANK}) QUALIFY rank <= 10)")
def rerank_movement(spark, sf_dir):
    q, c = _vectors(spark, sf_dir), _chunks(spark, sf_dir)
    out = R.rerank(R.semantic_search(q, c, R.pool_size(10, rerank=True)), q, c, 10)
    return out.select("query_id", "chunk_id", *(F.col(x).cast("int").alias(x) for x in ("base_rank", "rank", "rank_delta")))


@query("page_range_overlap", "SELECT conv_id, first_turn, last_turn FROM (SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY conv_id) WHERE last_turn >= 2 AND first_turn <= 4")
def page_range_overlap(spark, sf_dir):
    spans = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))
    for c in R.page_overlap(2, 4, "first_turn", "last_turn"):
        spans = spans.where(c)
    return spans


@query("candidate_union", f"SELECT query_id, count(*) AS candidates FROM (SELECT DISTINCT query_id, chunk_id FROM (SELECT query_id, chunk_id FROM ({_ranked(_scored(), 20)}) UNION ALL SELECT query_id, chunk_id FROM ({_ranked(_HITS, 20)}))) GROUP BY query_id")
def candidate_union(spark, sf_dir):
    q, c = _vectors(spark, sf_dir), _chunks(spark, sf_dir)
    return R.union_first(R.semantic_search(q, c, 20), R.keyword_search(q, c, k=20)).groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"))


@query("phrase_search", f"SELECT CAST(a.query_id AS BIGINT) AS query_id, d.doc_id AS chunk_id FROM documents d, (VALUES (0, 'of the'), (1, 'in the'), (2, 'to the')) a(query_id, phrase) WHERE contains(' ' || array_to_string(regexp_extract_all(lower(d.text), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ', ' ' || a.phrase || ' ')")
def phrase_search(spark, sf_dir):
    q = spark.createDataFrame([(0, "of the"), (1, "in the"), (2, "to the")], "query_id long, query string")
    return R.phrase_search(q, R.build_postings(_chunks(spark, sf_dir)))


@query("postings_size", f"SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM ({_TERMS}) GROUP BY term")
def postings_size(spark, sf_dir):
    p = R.build_postings(_chunks(spark, sf_dir))
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("positions")).alias("occurrences"))


@query("cover_density")
def cover_density(spark, sf_dir):
    """How near query words stand; other engines here have no such ranking, so tests hold it against brute force."""
    out = R.cover_density_search(_vectors(spark, sf_dir).select("query_id", "query"), _chunks(spark, sf_dir), k=10)
    return out.select("query_id", "chunk_id", "rank", F.round("keyword_score", 6).alias("keyword_score"))


@query("query_terms", f"SELECT CAST(query_id AS BIGINT) AS query_id, term FROM ({_QUERY})")
def query_terms(spark, sf_dir):
    return R.query_terms(_vectors(spark, sf_dir)).select("query_id", "term")




def search_index(spark: SparkSession, sf_dir: str) -> S.Index:
    """The stored index over all documents, in a folder of its own."""
    return S.build(_chunks(spark, sf_dir), own_folder(spark, "search-index"))


def many_queries(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """n queries: the first vectors, and two words of the document of the same id each."""
    e = read_table(spark, sf_dir, "embeddings").where(F.col("vec_id") < n).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    d = read_table(spark, sf_dir, "documents").where(F.col("doc_id") < n)
    words = F.filter(F.split("text", r"[^\\p{L}]+"), lambda w: F.length(w) > 3)
    return e.join(d.select(F.col("doc_id").alias("query_id"), F.coalesce(F.nullif(F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1))), F.lit("")), F.lit("document")).alias("query")), "query_id")


@query("index_semantic_topk", f"SELECT {_SEM} FROM ({_ranked(_scored(), 10)})")
def index_semantic_topk(spark, sf_dir):
    """The same results as ``semantic_topk``, from stored unit vectors."""
    return _shown(S.search(search_index(spark, sf_dir), _vectors(spark, sf_dir).drop("query"), "semantic", 10))


@query("index_keyword_topk")
def index_keyword_topk(spark, sf_dir):
    """Stems, groups, phrases and exclusions; SQL engines here have no such ranking, so tests hold it against plain code."""
    q = spark.createDataFrame([(0, "document words"), (1, '"with the" station'), (2, "tion or station -the")], "query_id long, query string")
    return S.search(search_index(spark, sf_dir), q, "keyword", 10).select("query_id", "chunk_id", "rank", F.round("keyword_score", 9).alias("keyword_score"))


@query("index_hybrid_topk")
def index_hybrid_topk(spark, sf_dir):
    """Both branches of the stored index, fused; tests hold the branches and the fusion against plain code."""
    return S.search(search_index(spark, sf_dir), _vectors(spark, sf_dir), "hybrid", 10).select("query_id", "chunk_id", "rank", F.round("hybrid_score", 9).alias("hybrid_score"))
