"""Functions that fail, answers that need repair, and plans worded by a generator."""

import json

import pytest
from pyspark.sql import functions as F

from foliary.operators import tables as Q
from foliary.sources import connectors as K


def failing(path, times):
    """A call that fails its first ``times`` times on a machine, and notes each."""
    import os

    os.makedirs(path, exist_ok=True)
    n = len(os.listdir(path))
    open(f"{path}/{n}", "w").close()
    if n < times:
        raise OSError("not now")


def test_a_parser_that_fails_twice_is_read_whole(spark, tmp_path):
    import hashlib

    def parser(content):
        failing(f"{tmp_path}/{hashlib.md5(content).hexdigest()}", 2)
        if b"broken" in content:
            raise ValueError("no such page")
        return [{"page_number": i, "text": t} for i, t in enumerate(content.decode().split("\f"), 1)]

    for i in range(6):
        (tmp_path / f"f{i}.pdf").write_bytes(f"first of {i}\fsecond of {i}".encode() if i != 3 else b"broken")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(str(tmp_path)).repartition(3)
    rows = K.parse_files(files, parser, "page_number int, text string").cache()
    assert rows.where("error is null").count() == 10
    assert {(r.page_number, r.text) for r in rows.where("path like '%f4.pdf'").collect()} == {(1, "first of 4"), (2, "second of 4")}
    assert [(r.error, r.place, r.text) for r in rows.where("error is not null").collect()] == [("ValueError: no such page", None, None)]


def test_answers_are_repaired_once(spark):
    def generate(prompts):
        out = []
        for p in prompts:
            if "down" in p:
                raise ConnectionError("closed")
            good = json.dumps({"label": p[:3]})
            out.append("{" if "worse" in p else good if "good" in p or "invalid_previous_output" in p else json.dumps({"other": 1}))
        return out

    asked = ["good one", "bad one", "worse one", "down one", "good two", None]
    rows = K.ask(spark.createDataFrame(list(enumerate(asked)), "request_id int, prompt string").coalesce(1), generate, K.json_object(("label",), ("label",)), attempts=2)
    got = {r.request_id: (r.answer, r.status, r.error) for r in rows.collect()}
    assert got == {
        0: ('{"label": "goo"}', K.ANSWERED, None),
        1: ('{"label": "bad"}', K.REPAIRED, None),
        2: (None, K.INVALID, "it is no JSON"),
        3: (None, K.UNREACHABLE, "ConnectionError: closed"),
        4: ('{"label": "goo"}', K.ANSWERED, None),
        5: (json.dumps({"label": "\n\n<"}), K.REPAIRED, None),
    }


def test_json_objects():
    check = K.json_object(("a",), ("a", "b"))
    assert [check(x) for x in ('{"a": 1}', '{"b": 1}', '{"a": 1, "c": 2}', "[1]", "x", None)] == [None, "missing: a", "unknown: c", "it is no JSON object", "it is no JSON", "it is no JSON"]


HEADERS = ["Product", "Qty", "Price"]


def test_plans_by_rule_or_by_a_generator():
    never = lambda prompt: pytest.fail("a rule fits")
    assert Q.plan_for("What is the highest price?", HEADERS, never).operation == "max"
    said = iter(['{"operation": "sort", "target_column": "Weight"}', '{"operation": "top_n", "target_column": "price", "limit": 2, "filter_column": null}'])
    prompts = []
    plan = Q.plan_for("Show me the two dearest products", HEADERS, lambda p: prompts.append(p) or next(said))
    assert (plan.operation, plan.target_column, plan.limit) == ("top_n", "price", 2)
    assert len(prompts) == 2 and "Weight" in prompts[1] and "no column" in prompts[1]
    with pytest.raises(Q.TableQueryError, match="JSON"):
        Q.plan_for("Show me something", HEADERS, lambda p: "not a plan")
    with pytest.raises(Q.TableQueryError, match="no rule"):
        Q.plan_for("Show me something", HEADERS)
    for text in ('{"operation": "drop"}', '{"sql": "x"}', "[]", "{}", '{"operation": "count", "limit": "x"}'):
        with pytest.raises(Q.TableQueryError):
            Q.plan_from_json(text, HEADERS)


def test_totals_of_texts(spark):
    cells = spark.createDataFrame([("a", 1, "1200.000000000000000001"), ("b", 2, " €1,750 "), ("a", 3, "0.1")], "k string, row_index int, x string")
    assert [r.value for op in ("sum", "average") for r in Q.run(cells, Q.TableQueryPlan(op, "X")).collect()] == ["2950.100000000000000001", "983.3666666666666666670000000"[:-7]]
    by = {r.k: (r.sum, r.numbers, r.row_count) for r in Q.exact_totals(cells.withColumn("x", F.when(F.col("row_index") == 3, "n/a").otherwise(F.col("x"))), "x", ("k",)).collect()}
    assert by == {"a": ("1200.000000000000000001", 1, 2), "b": ("1750", 1, 1)}
