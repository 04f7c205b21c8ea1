import pytest
from pyspark.sql import functions as F

from foliary.operators import tables as Q


@pytest.fixture(scope="module")
def sales(spark):
    rows = spark.createDataFrame([(1, ["A", "1200", "10"]), (2, ["B", "1750", "8"]), (3, ["C", "950", "12"])], "row_index int, cells array<string>")
    return Q.from_cells(["Product", "Revenue", "Units"], rows).cache()


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_extremes_return_original_cells(sales):
    assert rows(Q.run(sales, Q.TableQueryPlan("max", "revenue"))) == [(2, "B", "1750")]
    assert rows(Q.run(sales, Q.TableQueryPlan("min", "Revenue"))) == [(3, "C", "950")]
    assert rows(Q.run(sales, Q.TableQueryPlan("max", "Units"))) == [(3, "C", "12")]


def test_sum_average_count(sales):
    value = lambda plan: Q.run(sales, plan).select(Q.shown(F.col("value"))).first()[0]
    assert value(Q.TableQueryPlan("sum", "Revenue")) == "3900"
    assert value(Q.TableQueryPlan("average", "Revenue")) == "1300"
    assert value(Q.TableQueryPlan("count")) == "3"


def test_filter_sort_top_select(sales):
    more = Q.TableQueryPlan("filter", filter_column="Revenue", filter_operator="gt", filter_value="1000")
    assert [r[1] for r in rows(Q.run(sales, more))] == ["A", "B"]
    assert [r[1] for r in rows(Q.run(sales, Q.TableQueryPlan("top_n", "Revenue", limit=2)))] == ["B", "A"]
    assert [r[1] for r in rows(Q.run(sales, Q.TableQueryPlan("sort", "Revenue", sort_direction="asc")))] == ["C", "A", "B"]
    assert len(rows(Q.run(sales, Q.TableQueryPlan("select", limit=2)))) == 2


def test_currency_text(spark):
    t = Q.from_cells(["P", "V"], spark.createDataFrame([(1, ["a", "€1,200.50"]), (2, ["b", "€800.50"])], "row_index int, cells array<string>"))
    assert Q.run(t, Q.TableQueryPlan("sum", "V")).select(Q.shown(F.col("value"))).first()[0] == "2001"
    cases = {"1,2,3": "123", " $5": "5", "-€5": None, "(5)": None, "5%": None, "1e3": None, ".5": None, "+7.25": "7.25", "": None}
    df = spark.createDataFrame(list(cases.items()), "c string, e string")
    assert [r.got == r.e for r in df.select("e", Q.shown(Q.number(F.col("c"))).alias("got")).collect()] == [True] * len(cases)


def test_ragged_and_ties(spark):
    t = Q.from_cells(["K", "N"], spark.createDataFrame([(1, ["x", "2"]), (2, ["y", "2"]), (3, ["z"])], "row_index int, cells array<string>"))
    with pytest.raises(Q.TableQueryError):
        Q.run(t, Q.TableQueryPlan("max", "N"))
    assert [r[0] for r in rows(Q.run(t.where("row_index < 3"), Q.TableQueryPlan("max", "N")))] == [1, 2]
    assert [r[0] for r in rows(Q.run(t, Q.TableQueryPlan("sort", "K", sort_direction="desc")))] == [3, 2, 1]


@pytest.mark.parametrize("bad", [dict(operation="nope"), dict(operation="sum"), dict(operation="sort", target_column="A", limit=0), dict(operation="select", filter_column="A"), dict(operation="filter", filter_column="A", filter_operator="like", filter_value="x")])
def test_bad_plans(bad):
    with pytest.raises(Q.TableQueryError):
        Q.TableQueryPlan(**bad)


def test_unknown_column_and_guard(sales):
    with pytest.raises(Q.TableQueryError):
        Q.run(sales, Q.TableQueryPlan("sum", "Nothing"))
    with pytest.raises(Q.TableQueryError):
        Q.run(sales, Q.TableQueryPlan("sum", "Product"))
    with pytest.raises(Q.TableQueryError):
        Q.run(sales, Q.TableQueryPlan("count"), max_rows=2)


def test_questions():
    headers = ["Product", "Qty", "Price"]
    plan = Q.plan_from_question("Which product has the highest price?", headers)
    assert (plan.operation, plan.target_column, plan.return_columns) == ("max", "Price", ("Product", "Price"))
    assert Q.plan_from_question("total quantity", headers).target_column == "Qty"
    assert Q.plan_from_question("How many rows?", headers).operation == "count"
    assert Q.plan_from_question("tell me a story", headers) is None
    with pytest.raises(Q.TableQueryError):
        Q.plan_from_question("highest weight", headers)


def test_answers(sales):
    plan = Q.TableQueryPlan("max", "Revenue", ("Product", "Revenue"))
    assert Q.answer_text(plan, Q.run(sales, plan)) == "B has the highest Revenue at 1750. [T1]"
    assert Q.answer_text(Q.TableQueryPlan("count"), Q.run(sales, Q.TableQueryPlan("count")), "how many products") == "There are 3 products in the table. [T1]"
    total = Q.TableQueryPlan("sum", "Revenue")
    assert Q.answer_text(total, Q.run(sales, total)) == "The sum of Revenue is 3900. [T1]"


def test_repeated_header(spark):
    df = spark.createDataFrame([([["a", "b"], ["1", "2"]], ["a", "b"]), ([["1", "2"]], ["a", "b"])], "rows array<array<string>>, headers array<string>")
    assert [len(r[0]) for r in df.select(Q.without_repeated_header(F.col("rows"), F.col("headers"))).collect()] == [1, 1]


def test_totals_of_many_digits(spark):
    rows = spark.createDataFrame([("12345678901234567890123456789",), ("0.0000000000000000000000001",), (" $1,000.5\u00a0",), ("-2",), ("n/a",)], "x string")
    r = Q.exact_totals(rows, "x").first()
    assert (r["sum"], r.numbers, r.row_count) == ("12345678901234567890123457790", 4, 5)
    small = Q.exact_totals(spark.createDataFrame([("0.1",), ("0.2",), ("0.4",)], "x string"), "x").first()
    assert (small["sum"], small.average) == ("0.7", "0.2333333333333333333333333333")
    assert Q.exact_totals(rows.limit(0), "x").first()["sum"] == "0"
