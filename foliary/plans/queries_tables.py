"""Table-query operators over typed tables, and over numbers written as texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.operators import tables as Q
from foliary.plans.catalog import query
from foliary.session import read_table

PART = "SELECT row_number() OVER (ORDER BY p_partkey) AS row_index, * FROM part"


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part table; its key, dense from 1, numbers the rows."""
    return read_table(spark, sf_dir, "part").withColumn(Q.ROW, F.col("p_partkey").cast("int"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").withColumn(Q.ROW, F.col("l_orderkey") * 8 + F.col("l_linenumber"))


def _run(df: DataFrame, plan: Q.TableQueryPlan) -> DataFrame:
    return Q.run(df, plan, check=False)


LINES = "SELECT l_orderkey * 8 + l_linenumber AS row_index, * FROM lineitem"
KEYED = "SELECT CAST(p_partkey AS INTEGER) AS row_index, * FROM part"


@query("table_select", f"SELECT row_index, p_name, p_size FROM ({KEYED}) ORDER BY row_index LIMIT 10")
def table_select(spark, sf_dir):
    return _run(_part(spark, sf_dir), Q.TableQueryPlan("select", return_columns=("p_name", "P_SIZE")))


def _filter(op: str, sql: str, value: str = "25") -> None:
    @query(f"table_filter_{op}", f"SELECT row_index, p_name, p_size FROM ({KEYED}) WHERE p_size {sql} {value}")
    def f(spark, sf_dir):
        return _run(_part(spark, sf_dir), Q.TableQueryPlan("filter", return_columns=("p_name", "p_size"), filter_column="p_size", filter_operator=op, filter_value=value))


for _op, _sql in (("eq", "="), ("neq", "<>"), ("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
    _filter(_op, _sql)


@query("table_filter_text", f"SELECT row_index, p_name, p_brand FROM ({KEYED}) WHERE lower(trim(p_brand)) = 'brand#11'")
def table_filter_text(spark, sf_dir):
    return _run(_part(spark, sf_dir), Q.TableQueryPlan("filter", return_columns=("p_name", "p_brand"), filter_column="p_brand", filter_operator="eq", filter_value="BRAND#11"))


@query("table_min", f"SELECT row_index, l_orderkey, l_extendedprice FROM ({LINES}) WHERE l_extendedprice = (SELECT min(l_extendedprice) FROM lineitem)")
def table_min(spark, sf_dir):
    return _run(_lines(spark, sf_dir), Q.TableQueryPlan("min", "l_extendedprice", ("l_orderkey", "l_extendedprice")))


@query("table_max", f"SELECT row_index, l_orderkey, l_quantity FROM ({LINES}) WHERE l_quantity = (SELECT max(l_quantity) FROM lineitem)")
def table_max(spark, sf_dir):
    return _run(_lines(spark, sf_dir), Q.TableQueryPlan("max", "l_quantity", ("l_orderkey", "l_quantity")))


@query("table_sum", "SELECT CAST(sum(CAST(l_quantity AS DECIMAL(38,4))) AS DOUBLE) AS value, count(*) AS row_count FROM lineitem")
def table_sum(spark, sf_dir):
    out = _run(_lines(spark, sf_dir), Q.TableQueryPlan("sum", "l_quantity"))
    return out.select(F.col("value").cast("double").alias("value"), "row_count")


@query("table_average", "SELECT round(CAST(sum(CAST(l_extendedprice AS DECIMAL(38,4))) AS DOUBLE) / count(*), 3) AS value, count(*) AS row_count FROM lineitem")
def table_average(spark, sf_dir):
    out = _run(_lines(spark, sf_dir), Q.TableQueryPlan("average", "l_extendedprice"))
    return out.select(F.round(F.col("value").cast("double"), 3).alias("value"), "row_count")


@query("table_count", "SELECT count(*) AS value, count(*) AS row_count FROM orders")
def table_count(spark, sf_dir):
    return _run(read_table(spark, sf_dir, "orders").withColumn(Q.ROW, F.col("o_orderkey")), Q.TableQueryPlan("count"))


@query("table_sort", f"SELECT row_index, p_name, p_retailprice FROM ({KEYED}) ORDER BY p_retailprice DESC, row_index")
def table_sort(spark, sf_dir):
    return _run(_part(spark, sf_dir), Q.TableQueryPlan("sort", "p_retailprice", ("p_name", "p_retailprice")))


@query("table_top_n", f"SELECT row_index, l_orderkey, l_extendedprice FROM ({LINES}) ORDER BY CAST(l_extendedprice AS DECIMAL(38,10)) DESC, row_index LIMIT 20")
def table_top_n(spark, sf_dir):
    return _run(_lines(spark, sf_dir), Q.TableQueryPlan("top_n", "l_extendedprice", ("l_orderkey", "l_extendedprice"), limit=20))


@query(
    "parse_currency",
    "SELECT l_orderkey, l_linenumber, CAST(regexp_replace(regexp_replace(cell, '^[\\s€$£₹]+', ''), ',', '', 'g') AS DOUBLE) AS value FROM "
    "(SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN '€ ' WHEN l_linenumber % 3 = 1 THEN '$' ELSE '' END || "
    "CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ',000.50' AS cell FROM lineitem)",
)
def parse_currency(spark, sf_dir):
    sign = F.when(F.col("l_linenumber") % 3 == 0, "€ ").when(F.col("l_linenumber") % 3 == 1, "$").otherwise("")
    cell = F.concat(sign, F.col("l_quantity").cast("int").cast("string"), F.lit(",000.50"))
    return read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", Q.number(cell).cast("double").alias("value"))


@query("table_question", "SELECT CAST(p_partkey AS INTEGER) AS row_index, p_name, p_size FROM part WHERE p_size = (SELECT max(p_size) FROM part)")
def table_question(spark, sf_dir):
    """Which part has the highest size? planned from the question's words."""
    own = _part(spark, sf_dir).select(Q.ROW, "p_name", F.col("p_size").alias("size"))
    plan = Q.plan_from_question("Which part has the highest size?", ["p_name", "size"])
    return _run(own, plan).withColumnRenamed("size", "p_size")


_CELLS = "SELECT CAST(n_regionkey AS VARCHAR) AS table_id, list(n_name ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey"


@query("table_inventory", f"SELECT table_id, CAST(len(names) AS INTEGER) AS row_count, 2 AS column_count FROM ({_CELLS})")
def table_inventory(spark, sf_dir):
    return Q.inventory(_extracted(spark, sf_dir)).select("table_id", "row_count", "column_count")


@query("table_preview", f"SELECT table_id, CAST(least(len(names), 2) AS INTEGER) AS shown, len(names) > 2 AS truncated FROM ({_CELLS})")
def table_preview(spark, sf_dir):
    return Q.preview(_extracted(spark, sf_dir), 2).select("table_id", F.size("rows").alias("shown"), "truncated")


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted tables, one for each region: its nations."""
    rows = F.array_sort(F.collect_list(F.array(F.col("n_name"), F.col("n_nationkey").cast("string"))))
    return read_table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("string").alias("table_id")).agg(rows.alias("rows")).select("table_id", F.lit("d").alias("document_id"), F.lit(1).alias("page_number"), F.lit(1).alias("table_index"), F.array(F.lit("name"), F.lit("key")).alias("headers"), "rows")
