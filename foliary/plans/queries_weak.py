"""Queries over whole tables for operators on boxes, words and long texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.operators import evaluate as E
from foliary.operators import pii, tables
from foliary.plans.catalog import query
from foliary.session import read_table

_WORDS = r"SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM documents"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words on a line: word n stands from n to n + 1."""
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("w"))
    n = F.col("n").cast("double")
    return d.select("document_id", F.lit(1).alias("page_number"), F.posexplode("w").alias("n", "word")).select("document_id", "page_number", F.col("n").alias("word_index"), "word", n.alias("x0"), F.lit(0.0).alias("y0"), (n + 1).alias("x1"), F.lit(1.0).alias("y1"))


@query(
    "word_boxes",
    f"WITH t AS ({_WORDS}), s AS (SELECT doc_id, list_transform(w, lambda x: lower(x)) AS w FROM t WHERE len(w) >= 4), "
    "p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM s) "
    "SELECT doc_id AS detection_id, CAST(min(i) - 1 AS DOUBLE) AS x0, 0.0::DOUBLE AS y0, CAST(min(i) + 2 AS DOUBLE) AS x1, 1.0::DOUBLE AS y1 FROM p WHERE w[i] = w[2] AND w[i + 1] = w[3] AND w[i + 2] = w[4] GROUP BY doc_id",
)
def word_boxes(spark, sf_dir):
    """The second to fourth word of every document, in capitals and spread out, found on its page."""
    words = _words(spark, sf_dir)
    three = words.where("word_index between 1 and 3").groupBy("document_id", "page_number").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("word_index", "word"))).alias("w"))
    found = three.where("n = 3").select(F.col("document_id").alias("detection_id"), "document_id", "page_number", F.array_join(F.transform("w", lambda x: F.translate(x["word"], "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")), " \t ").alias("matched_text"))
    return pii.word_boxes(words, found)


_BOX = "SELECT l_suppkey AS page, l_orderkey * 8 + l_linenumber AS i, l_linenumber * 10.0 AS x0, (l_orderkey % 97) * 5.0 AS y0, l_linenumber * 10.0 + 5 + l_linenumber AS x1, (l_orderkey % 97) * 5.0 + CAST(l_quantity AS DOUBLE) AS y1 FROM lineitem"
_NEAR = f"SELECT a.page, a.i AS a, b.i AS b, (least(a.x1, b.x1 + 1) - greatest(a.x0, b.x0 + 1)) * (least(a.y1, b.y1 + 1) - greatest(a.y0, b.y0 + 1)) AS common, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS areas FROM ({_BOX}) a JOIN ({_BOX}) b ON a.page = b.page WHERE least(a.x1, b.x1 + 1) > greatest(a.x0, b.x0 + 1) AND least(a.y1, b.y1 + 1) > greatest(a.y0, b.y0 + 1)"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as boxes, a supplier's on one page."""
    li = read_table(spark, sf_dir, "lineitem")
    x, y = F.col("l_linenumber") * 10.0, (F.col("l_orderkey") % 97) * 5.0
    return li.select(F.lit(1).alias("document_id"), F.col("l_suppkey").alias("page_number"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("box_index"), F.lit("Text").alias("label"), x.alias("x0"), y.alias("y0"), (x + 5 + F.col("l_linenumber")).alias("x1"), (y + F.col("l_quantity").cast("double")).alias("y1"))


@query("layout_pairs", f"SELECT page AS page_number, count(*) AS pairs, round(sum(common / (areas - common)), 3) AS iou FROM ({_NEAR}) WHERE common / (areas - common) >= 0.5 GROUP BY page")
def layout_pairs(spark, sf_dir):
    """All pairs of boxes of a page, one side moved by one, that overlap by half."""
    truth = _boxes(spark, sf_dir)
    moved = truth.withColumns({c: F.col(c) + 1 for c in ("x0", "y0", "x1", "y1")})
    return E.layout_pairs(truth, moved).groupBy("page_number").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum("iou"), 3).alias("iou"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as texts with twenty decimals and a currency sign; the first line of an order has none."""
    li = read_table(spark, sf_dir, "lineitem")
    exact = F.col("l_extendedprice").cast("decimal(16,2)") + F.col("l_linenumber").cast("decimal(10,0)") * F.lit("0.00000000000000000001").cast("decimal(20,20)")
    return li.select("l_suppkey", F.when(F.col("l_linenumber") == 1, "n/a").otherwise(F.concat(F.lit(" € "), exact.cast("decimal(38,20)").cast("string"))).alias("cell"))


@query(
    "exact_group_totals",
    "SELECT l_suppkey, regexp_replace(CAST(sum(CASE WHEN l_linenumber > 1 THEN CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS DECIMAL(38, 20)) + CAST(l_linenumber AS DECIMAL(18, 0)) * CAST('0.00000000000000000001' AS DECIMAL(20, 20)) END) AS VARCHAR), '\\.?0+$', '') AS sum, "
    "count(*) FILTER (l_linenumber > 1) AS numbers, count(*) AS row_count FROM lineitem GROUP BY l_suppkey",
)
def exact_group_totals(spark, sf_dir):
    """Sums of texts to their last digit, by group."""
    return tables.exact_totals(_cells(spark, sf_dir), "cell", ("l_suppkey",)).select("l_suppkey", "sum", "numbers", "row_count")


@query("table_sum_text", "SELECT regexp_replace(CAST(sum(CAST(p_retailprice AS DECIMAL(38, 2))) AS VARCHAR), '\\.?0+$', '') AS value, count(*) AS row_count FROM part")
def table_sum_text(spark, sf_dir):
    """A plan over a column of texts with commas and a currency sign."""
    part = read_table(spark, sf_dir, "part")
    cells = part.select(F.col("p_partkey").cast("int").alias(tables.ROW), F.concat(F.lit("$"), F.format_number("p_retailprice", 2)).alias("Price"))
    return tables.run(cells, tables.TableQueryPlan("sum", "price"))
