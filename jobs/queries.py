"""The jobs as queries: each runs twice into one new folder, and the output is read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.session import own_folder
from jobs import intake, retrieval_benchmark


def job1_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = own_folder(spark, "job1-intake")
    for _ in range(2):
        intake.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/elements", f"{folder}/checkpoint")
    return intake.read_elements(spark, f"{folder}/elements")


def _benchmark(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame]:
    folder = own_folder(spark, name)
    for _ in range(2):
        cases, report, _ = retrieval_benchmark.run(spark, f"{sf_dir}/benchmark.parquet", f"{sf_dir}/documents.parquet", folder)
    return cases, report


def job2_retrieval_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _benchmark(spark, sf_dir, "job2-retrieval-benchmark")[0]


def benchmark_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the same run, measures to nine places."""
    out = _benchmark(spark, sf_dir, "benchmark-report")[1]
    return out.select("configuration", "questions", "scorable", "without_results", *(F.round(c, 9).alias(c) for c in out.columns[4:]))


JOB1 = r"""
WITH d AS (SELECT doc_id, lang, source, text, sha256(text) AS checksum FROM documents WHERE trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) <> ''
  QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1),
l AS (SELECT doc_id, lang, source, checksum, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) < 20 AS needs_ocr, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM d),
b AS (SELECT *, trim(regexp_replace(line, '\s+', ' ', 'g')) AS plain FROM l WHERE trim(regexp_replace(line, '\s+', ' ', 'g')) <> '')
SELECT doc_id AS document_id, checksum AS checksum_sha256, lang, source, needs_ocr, CASE WHEN needs_ocr THEN 'failed' ELSE 'ready' END AS status,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INTEGER) AS sequence_order, line AS text, CAST(0 AS BIGINT) AS batch,
  CASE WHEN length(line) <= 100 AND len(string_split(plain, ' ')) <= 20 AND line = upper(line) AND regexp_matches(line, '\p{L}') THEN 'heading'
       WHEN regexp_matches(line, '^\s*(?:[-*•]|\d+[.)]|[A-Za-z][)])\s+') THEN 'list_item' ELSE 'paragraph' END AS element_type
FROM b
"""

_COUNTS = ", ".join(f"count(*) FILTER (rank <= {k}) AS n{k}" for k in (1, 3, 5, 10))
_MEASURES = ", ".join(f"CASE WHEN needed IS NOT NULL THEN coalesce(n{k}, 0) / needed END AS recall_at_{k}, CASE WHEN needed IS NOT NULL THEN coalesce(n{k}, 0) > 0 END AS hit_at_{k}" for k in (1, 3, 5, 10))
_TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_CASES = f"""
WITH dw AS (SELECT doc_id, source, {_TERMS} AS w FROM documents),
iw AS (SELECT item_id, {_TERMS} AS w FROM benchmark),
relevant AS (SELECT item_id, doc_id FROM iw, dw WHERE len(iw.w) > 0 AND contains(' ' || array_to_string(dw.w, ' ') || ' ', ' ' || array_to_string(iw.w, ' ') || ' ')),
needed AS (SELECT item_id, count(*) AS needed FROM relevant GROUP BY 1),
term AS (SELECT item_id, term, min(p) AS p FROM (SELECT item_id, generate_subscripts(w, 1) AS p, unnest(w) AS term FROM iw) GROUP BY 1, 2),
placed AS (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY p) AS p FROM term),
configuration AS (SELECT * FROM (VALUES ('terms_2', 2), ('terms_4', 4), ('terms_8', 8)) v(configuration, n)),
asked AS (SELECT configuration, item_id, term, count(*) OVER (PARTITION BY configuration, item_id) AS wanted FROM configuration JOIN placed ON p <= n),
word AS (SELECT doc_id, source, term, count(*) AS c FROM (SELECT doc_id, source, unnest(w) AS term FROM dw) WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2, 3),
hit AS (SELECT configuration, item_id, doc_id, any_value(source) AS source, sum(c) AS s FROM asked JOIN word USING (term) GROUP BY 1, 2, 3 HAVING count(*) = any_value(wanted)),
ranked AS (SELECT configuration, item_id, doc_id, row_number() OVER (PARTITION BY configuration, item_id ORDER BY s DESC, source, doc_id) AS rank FROM hit QUALIFY rank <= 10),
found AS (SELECT configuration, item_id, count(*) AS results FROM ranked GROUP BY 1, 2),
met AS (SELECT configuration, item_id, min(rank) AS first_rank, {_COUNTS} FROM ranked JOIN relevant USING (item_id, doc_id) GROUP BY 1, 2),
cases AS (SELECT i.item_id AS query_id, CASE WHEN len(i.w) = 0 OR i.w IS NULL THEN 'INVALID_GROUND_TRUTH' WHEN needed IS NULL THEN 'ANSWER_NOT_INDEXED' ELSE 'SCORABLE' END AS state,
  CAST(coalesce(needed, 0) AS INTEGER) AS relevant, CAST(coalesce(results, 0) AS INTEGER) AS results, CAST(first_rank AS INTEGER) AS first_rank,
  CASE WHEN needed IS NOT NULL THEN coalesce(1.0 / first_rank, 0.0) END AS reciprocal_rank, {_MEASURES}, c.configuration
  FROM iw i CROSS JOIN configuration c LEFT JOIN needed USING (item_id) LEFT JOIN found USING (configuration, item_id) LEFT JOIN met USING (configuration, item_id))
"""

JOB2 = f"{_CASES} SELECT * FROM cases"

REPORT = _CASES + "SELECT configuration, count(*) AS questions, count(*) FILTER (state = 'SCORABLE') AS scorable, count(*) FILTER (results = 0) AS without_results, round(coalesce(avg(reciprocal_rank), 0), 9) AS mrr, " + ", ".join(f"round(coalesce(avg(recall_at_{k}), 0), 9) AS recall_at_{k}, round(coalesce(avg(CAST(hit_at_{k} AS DOUBLE)), 0), 9) AS hit_at_{k}" for k in (1, 3, 5, 10)) + " FROM cases GROUP BY configuration"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_intake": job1_intake, "job2_retrieval_benchmark": job2_retrieval_benchmark, "benchmark_report": benchmark_report}


def oracle_sql() -> dict[str, str]:
    return {"job1_intake": JOB1, "job2_retrieval_benchmark": JOB2, "benchmark_report": REPORT}
