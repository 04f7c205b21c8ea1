"""Comparison, personal data, extraction and citation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.functions import text as T
from foliary.operators import compare, context, extract, pii
from foliary.plans.catalog import query
from foliary.session import read_table


def _lines(spark: SparkSession, sf_dir: str, even: bool) -> DataFrame:
    """Lines of a source's documents with even or odd ids: two versions of one text."""
    d = read_table(spark, sf_dir, "documents").where(F.col("doc_id") % 2 == (0 if even else 1))
    rows = d.select(F.col("source").alias("pair_id"), "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "normal"))
    return rows.where("normal <> ''").select("pair_id", (F.col("doc_id") * 100000 + F.col("i")).alias("sequence_number"), "normal")


_SIDE = "SELECT *, row_number() OVER (PARTITION BY source, line ORDER BY seq) AS k FROM (SELECT source, doc_id * 100000 + generate_subscripts(l, 1) - 1 AS seq, unnest(l) AS line FROM (SELECT source, doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id % 2 = {})) WHERE line <> ''"


@query("exact_align", f"SELECT source AS pair_id, count(*) FILTER (b.seq IS NOT NULL AND t.seq IS NOT NULL) AS same, count(*) FILTER (t.seq IS NULL) AS removed, count(*) FILTER (b.seq IS NULL) AS added FROM ({_SIDE.format(0)}) b FULL JOIN ({_SIDE.format(1)}) t USING (source, line, k) GROUP BY source")
def exact_align(spark, sf_dir):
    met = compare.exact_pairs(_lines(spark, sf_dir, True), _lines(spark, sf_dir, False))
    b, t = F.col("b_sequence_number"), F.col("t_sequence_number")
    return met.groupBy("pair_id").agg(F.count_if(b.isNotNull() & t.isNotNull()).alias("same"), F.count_if(t.isNull()).alias("removed"), F.count_if(b.isNull()).alias("added"))


_TOKENS = "list_distinct(regexp_extract_all(lower({}), '[a-zA-Z0-9_]+'))"


_LATIN = "list_distinct(regexp_extract_all(lower(regexp_replace({}, '[^ -~\\n]', 'z', 'g')), '[a-z0-9_]+([-''][a-z0-9_]+)?', 0))"


@query("token_overlap_pairs", f"SELECT item_id, doc_id, CASE WHEN least(len(a), len(b)) > 0 THEN round(CAST(len(list_intersect(a, b)) AS DOUBLE) / least(len(a), len(b)), 6) ELSE 0 END AS overlap FROM (SELECT item_id, doc_id, {_LATIN.format('x.text')} AS a, {_LATIN.format('d.text')} AS b FROM benchmark x JOIN documents d ON item_id = doc_id)")
def token_overlap_pairs(spark, sf_dir):
    """Each item and the document of its id; letters beyond ASCII, which the other engine doesn't know as such, are one letter on both sides."""
    plain = F.regexp_replace("text", r"[^ -~\n]", "z")
    x = read_table(spark, sf_dir, "benchmark").select("item_id", plain.alias("a"))
    d = read_table(spark, sf_dir, "documents").select("doc_id", plain.alias("b"))
    met = x.join(d, F.col("item_id") == F.col("doc_id"))
    return met.select("item_id", "doc_id", F.round(T.token_overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


@query("token_overlap_all")
def token_overlap_all(spark, sf_dir):
    """Overlap of all items with the documents of their ids, of any script; letters beyond ASCII have no twin, so tests compare with plain sets."""
    x = read_table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("a"))
    met = x.join(read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("b")), F.col("item_id") == F.col("doc_id"))
    return met.select("item_id", "doc_id", F.round(T.token_overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


_NEW = "SELECT p_partkey, p_name, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS p_size, p_brand FROM part WHERE p_partkey % 11 <> 0"


def _parts(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    if new:
        p = p.where(F.col("p_partkey") % 11 != 0).withColumn("p_size", F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    else:
        p = p.where(F.col("p_partkey") % 13 != 0)
    cells = p.select(F.lit("t").alias("table_id"), F.col("p_partkey").cast("string").alias("row_key"), F.explode(F.create_map(F.lit("p_size"), F.col("p_size").cast("string"), F.lit("p_brand"), F.col("p_brand").cast("string"))).alias("header", "value"))
    return cells


@query("row_diff", "SELECT CAST(coalesce(b.p_partkey, t.p_partkey) AS VARCHAR) AS row_key, CASE WHEN b.p_partkey IS NULL THEN 'row_added' ELSE 'row_removed' END AS change_type FROM (SELECT p_partkey FROM part WHERE p_partkey % 13 <> 0) b FULL JOIN (SELECT p_partkey FROM part WHERE p_partkey % 11 <> 0) t ON b.p_partkey = t.p_partkey WHERE b.p_partkey IS NULL OR t.p_partkey IS NULL")
def row_diff(spark, sf_dir):
    rows = lambda new: _parts(spark, sf_dir, new).select("table_id", "row_key").distinct()
    return compare.row_changes(rows(False), rows(True)).select("row_key", "change_type")


@query("cell_diff", "SELECT CAST(p_partkey AS VARCHAR) AS row_key, 'p_size' AS header, CAST(p_size AS VARCHAR) AS before, CAST(p_size + 1 AS VARCHAR) AS after FROM part WHERE p_partkey % 7 = 0 AND p_partkey % 11 <> 0 AND p_partkey % 13 <> 0")
def cell_diff(spark, sf_dir):
    return compare.cell_changes(_parts(spark, sf_dir, False), _parts(spark, sf_dir, True)).select("row_key", "header", "before", "after")


@query("header_diff", "SELECT 't' AS table_id, 'Price' AS header, 'header_added' AS change_type UNION ALL SELECT 't', 'Qty', 'header_removed'")
def header_diff(spark, sf_dir):
    b = spark.createDataFrame([("t", "Product"), ("t", "Qty")], "table_id string, header string")
    t = spark.createDataFrame([("t", " product "), ("t", "Price")], "table_id string, header string")
    return compare.header_changes(b, t)


@query("metadata_diff", "SELECT doc_id AS pair_id, 'title' AS field, CASE WHEN lang = 'en' THEN 'added' ELSE 'modified' END AS change_type FROM documents WHERE lang <> source")
def metadata_diff(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"), F.when(F.col("lang") != "en", F.col("lang")).alias("base_title"), F.col("source").alias("target_title"))
    return compare.metadata_changes(d, ("title",)).select("pair_id", "field", "change_type")


@query("align_text")
def align_text(spark, sf_dir):
    """Alignment of two versions with modified lines; greedy pairing in order has no SQL form, tests compare with all pairs."""
    lines = lambda even, s: _lines(spark, sf_dir, even).withColumn("source_id", F.concat(F.lit(s), "sequence_number")).withColumn("text", F.col("normal"))
    return compare.statistics(compare.changes(lines(True, "A"), lines(False, "B"), unchanged=True))


@query("pii_email_prefilter", "SELECT doc_id FROM documents WHERE regexp_matches(text, '[A-Za-z0-9.]+@[A-Za-z0-9]+[.][A-Za-z0-9]+')")
def pii_email_prefilter(spark, sf_dir):
    found = pii.detect_pii(read_table(spark, sf_dir, "documents"), ("EMAIL",), "doc_id", "n_chars")
    return found.select(F.col("document_id").alias("doc_id")).distinct()


@query("pii_card_luhn", "WITH c AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\\b[0-9]{16}\\b')) AS m FROM documents) SELECT doc_id, m AS matched_text FROM c WHERE list_sum([CASE WHEN i % 2 = 1 THEN (CAST(m[i] AS INTEGER) * 2) // 10 + (CAST(m[i] AS INTEGER) * 2) % 10 ELSE CAST(m[i] AS INTEGER) END for i in range(1, 17)]) % 10 = 0")
def pii_card_luhn(spark, sf_dir):
    """Words of 16 digits, each a text of its own: in the whole text a longer number with blanks or dashes may take one's digits."""
    d = read_table(spark, sf_dir, "documents")
    words = F.regexp_extract_all("text", F.lit("(?<![0-9A-Za-z_])([0-9]{16})(?![0-9A-Za-z_])"))
    runs = d.select("doc_id", F.explode(F.array_distinct(words)).alias("text"), F.lit(1).alias("page_number"))
    found = pii.detect_pii(runs, ("CREDIT_CARD",), "doc_id")
    return found.select(F.col("document_id").alias("doc_id"), "matched_text").distinct()


@query("pii_scan")
def pii_scan(spark, sf_dir):
    """All detections with places and ids; look-around has no twin in the other engine, so tests compare with plain regular expressions."""
    return pii.detect_pii(read_table(spark, sf_dir, "documents"), pii.KINDS, "doc_id", "n_chars")


@query("pii_counts")
def pii_counts(spark, sf_dir):
    return pii.counts_by_type(pii_scan(spark, sf_dir))


@query("pii_redact")
def pii_redact(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    out = pii.redact_text(d, pii_scan(spark, sf_dir), None, "doc_id", "n_chars")
    return out.where("redactions > 0").select("document_id", "redactions", "verified", F.sha2("redacted_text", 256).alias("redacted_sha256"))


@query("citations", "SELECT doc_id AS query_id, n_chars % 7 > 0 AND n_chars % 7 <= 3 AS valid FROM documents")
def citations(spark, sf_dir):
    """Answers that cite [S1] to [S6], or nothing; three sources are known."""
    d = read_table(spark, sf_dir, "documents")
    k = F.col("n_chars") % 7
    answers = d.select(F.col("doc_id").alias("query_id"), F.when(k > 0, F.concat(F.lit("See [S"), k.cast("string"), F.lit("] and [S1], again [S1]."))).otherwise("None.").alias("answer"))
    sources = d.select(F.col("doc_id").alias("query_id"), F.explode(F.array(*(F.lit(f"S{i}") for i in (1, 2, 3)))).alias("source_id"))
    return context.check_citations(answers, sources).select("query_id", "valid")


@query("value_coercion", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN CAST(CAST(l_quantity AS BIGINT) * 1000 AS VARCHAR) END AS value FROM lineitem")
def value_coercion(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    n = F.col("l_quantity").cast("long").cast("string")
    raw = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("€ "), n, F.lit(",000,"))).otherwise(F.concat(n, F.lit("%")))
    return li.select("l_orderkey", "l_linenumber", extract.coerce(raw, F.lit("number")).alias("value"))


@query("value_supported", "SELECT doc_id, contains(lower(text), lower(left(text, 12))) AS first_words, contains(lower(text), 'zzz9') AS other FROM (SELECT doc_id, array_to_string(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[^ \\n]+'), ' ') AS text FROM documents)")
def value_supported(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    first = F.left(T.normal_key(F.col("text")), F.lit(12))
    return d.select("doc_id", extract.supported(first, F.lit("string"), F.col("text")).alias("first_words"), extract.supported(F.lit("ZZZ9"), F.lit("string"), F.col("text")).alias("other"))


@query("stable_ids", "SELECT doc_id, 'docs-' || left(sha256('docs' || '|' || lang || '|' || doc_id), 20) AS evaluation_id FROM documents")
def stable_ids(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", T.stable_id("docs", F.lit("docs"), F.col("lang"), F.col("doc_id"), separator="|").alias("evaluation_id"))


_NATIONS = "(SELECT n_regionkey AS pair_id, n_nationkey AS k, n_name FROM nation)"


@query(
    "table_alignment",
    "SELECT CAST(n_regionkey AS VARCHAR) AS pair_id, CASE WHEN n_nationkey % 5 <> 1 THEN 'b' || n_nationkey END AS base_table, CASE WHEN n_nationkey % 5 <> 2 THEN 't' || n_nationkey END AS target_table, "
    "CASE n_nationkey % 5 WHEN 1 THEN 'added' WHEN 2 THEN 'removed' ELSE 'matched' END AS change_type FROM nation",
)
def table_alignment(spark, sf_dir):
    """A table for each nation on both sides, but some on one only; headers and keys tell them apart."""
    n = read_table(spark, sf_dir, "nation")
    side = lambda mark, gone: n.where(F.col("n_nationkey") % 5 != gone).select(F.col("n_regionkey").alias("pair_id"), F.concat(F.lit(mark), F.col("n_nationkey").cast("string")).alias("table_id"), F.lit(1).alias("page_number"), F.col("n_nationkey").alias("table_index"), F.array("n_name", F.concat("n_name", F.lit(" x"))).alias("headers"), F.array(F.lower("n_name")).alias("keys"))
    return compare.table_alignment(side("b", 1), side("t", 2)).drop("score")


@query(
    "all_changes",
    "SELECT CAST(pair_id AS VARCHAR) AS pair_id, 'C' || row_number() OVER (PARTITION BY pair_id ORDER BY place, k) AS change_id, about, kind AS change_type FROM (SELECT pair_id, 0 AS place, k, 'metadata' AS about, 'modified' AS kind FROM "
    + _NATIONS
    + " WHERE k % 3 = 0 UNION ALL SELECT pair_id, 1, k, 'text', 'added' FROM "
    + _NATIONS
    + " UNION ALL SELECT pair_id, 2, k, 'table', 'removed' FROM "
    + _NATIONS
    + " WHERE k % 2 = 0)",
)
def all_changes(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("pair_id"), F.col("n_nationkey").alias("k"), "n_name")
    of = lambda kind: n.withColumn("change_type", F.lit(kind))
    found = compare.all_changes(("metadata", of("modified").where("k % 3 = 0"), ["k"]), ("text", of("added"), ["k"]), ("table", of("removed").where("k % 2 = 0"), ["k"]))
    return found.drop("detail")


@query("summary_changes_cited", "SELECT CAST(r_regionkey AS VARCHAR) AS pair_id, CASE WHEN r_regionkey % 3 = 2 THEN 0 ELSE 2 END AS cited, CASE WHEN r_regionkey % 3 = 1 THEN 1 ELSE 0 END AS unknown, r_regionkey % 3 = 0 AS grounded FROM region")
def summary_changes_cited(spark, sf_dir):
    r = read_table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("pair_id"))
    say = F.when(F.col("pair_id") % 3 == 0, "It grew [C1], then [C2] and [C1].").when(F.col("pair_id") % 3 == 1, "It grew [C1] [C9].").otherwise("It grew.")
    found = r.select("pair_id", F.explode(F.array(F.lit("C1"), F.lit("C2"))).alias("change_id"))
    return compare.summary_grounded(r.select("pair_id", say.alias("summary")), found)


@query("exact_totals", "SELECT CAST(sum(CAST(p_partkey AS DECIMAL(38, 6)) + 0.000001) AS VARCHAR) AS total, count(*) AS numbers FROM part")
def exact_totals(spark, sf_dir):
    """Cells of six decimals with signs of currency and commas; the sum as text without trailing zeros, padded to six."""
    from foliary.operators import tables

    cells = read_table(spark, sf_dir, "part").select(F.concat(F.lit(" € "), F.col("p_partkey").cast("string"), F.lit(".000,001 ")).alias("price"))
    out = tables.exact_totals(cells, "price")
    return out.select(F.col("sum").cast("decimal(38,6)").cast("string").alias("total"), "numbers")
