"""The jobs: two runs over growing input, runs that failed, and the SQL twins."""

import glob
import json
import os
import subprocess
import sys

import pytest

from jobs import intake, queries, retrieval_benchmark
from tests.helpers import plain, views

DOCUMENT = "doc_id long, text string, lang string, source string"


def add(spark, folder, rows):
    spark.createDataFrame(rows, DOCUMENT).coalesce(1).write.mode("append").parquet(f"{folder}/documents")


def shown(frame, without=()):
    return sorted((tuple(r) for r in frame.drop(*without).collect()), key=repr)


FIRST = [(1, "INTRODUCTION\nA first line.\n\n- an item", "en", "a"), (2, "same text of some length", "en", "a"), (3, "same text of some length", "en", "b"), (4, "short", "de", "b"), (5, None, "de", "b"), (6, " \n ", "de", "b")]
THEN = [(7, "same text of some length", "en", "a"), (8, "1) new and numbered\nthe rest", "en", "c"), (1, "INTRODUCTION\nA second version.", "en", "a")]


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}"


def take(spark, folder, checkpoint="checkpoint", **config):
    return intake.run(spark, f"{folder}/documents", f"{folder}/elements", f"{folder}/{checkpoint}", intake.Config(**config))


def test_intake_takes_only_what_is_new(spark, folder):
    add(spark, folder, FIRST)
    assert take(spark, folder) == len(FIRST)
    first = intake.read_elements(spark, f"{folder}/elements")
    assert [(r.document_id, r.sequence_order, r.element_type, r.text, r.status, r.batch) for r in first.orderBy("document_id", "sequence_order").collect()] == [
        (1, 1, "heading", "INTRODUCTION", "ready", 0),
        (1, 2, "paragraph", "A first line.", "ready", 0),
        (1, 3, "list_item", "- an item", "ready", 0),
        (2, 1, "paragraph", "same text of some length", "ready", 0),
        (4, 1, "paragraph", "short", "failed", 0),
    ]
    before = shown(first)
    assert take(spark, folder) == 0
    add(spark, folder, THEN)
    assert take(spark, folder) == len(THEN)
    every = intake.read_elements(spark, f"{folder}/elements")
    assert shown(every.where("batch = 0")) == before
    assert {(r.document_id, r.text) for r in every.where("batch > 0").collect()} == {(8, "1) new and numbered"), (8, "the rest"), (1, "INTRODUCTION"), (1, "A second version.")}
    assert {r.text for r in intake.current(spark, f"{folder}/elements").where("document_id = 1").collect()} == {"INTRODUCTION", "A second version."}


def test_intake_runs_a_failed_batch_again(spark, folder):
    add(spark, folder, FIRST)
    add(spark, folder, THEN)
    take(spark, folder, files_per_batch=1)
    before = shown(intake.read_elements(spark, f"{folder}/elements"))
    assert {r[-2] for r in before} == {0, 1}
    commits = f"{folder[7:]}/checkpoint/commits"
    for name in os.listdir(commits):  # as if the driver was lost after the last write
        if "1" in name:
            os.remove(f"{commits}/{name}")
    take(spark, folder, files_per_batch=1)
    assert shown(intake.read_elements(spark, f"{folder}/elements")) == before
    take(spark, folder, checkpoint="another")  # a lost checkpoint: everything is read again, nothing is added
    assert shown(intake.read_elements(spark, f"{folder}/elements"), ["batch"]) == shown(intake.read_elements(spark, f"{folder}/elements").dropDuplicates(["checksum_sha256", "document_id", "sequence_order"]), ["batch"])


def test_intake_stops_and_goes_on(spark, folder, monkeypatch):
    add(spark, folder, FIRST)
    add(spark, folder, THEN)
    real = intake.take

    def broken(batch, number, output, config):
        if number == 1:
            raise RuntimeError("lost")
        real(batch, number, output, config)

    monkeypatch.setattr(intake, "take", broken)
    with pytest.raises(Exception, match="lost"):
        take(spark, folder, files_per_batch=1)
    monkeypatch.setattr(intake, "take", real)
    take(spark, folder, files_per_batch=1)
    once = shown(intake.read_elements(spark, f"{folder}/elements"))
    intake.run(spark, f"{folder}/documents", f"{folder}/other", f"{folder}/fresh", intake.Config(files_per_batch=1))
    assert once == shown(intake.read_elements(spark, f"{folder}/other"))


def test_intake_of_an_empty_table(spark, folder):
    add(spark, folder, [])
    take(spark, folder)
    assert intake.read_elements(spark, f"{folder}/elements").count() == 0


ITEMS = [(1, "Alpha beta gamma delta"), (2, "nowhere to be found at all"), (3, ""), (4, None), (5, "one two")]
CORPUS = [(10, "alpha beta gamma delta and more", "en", "a"), (11, "delta gamma beta alpha", "en", "a"), (12, "alpha, alpha beta?", "en", "b"), (13, "x ONE two one two", "en", "b"), (14, None, "en", "b")]


@pytest.fixture
def benchmark(spark, folder):
    add(spark, folder, CORPUS)
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/items")
    config = retrieval_benchmark.Config({"two": 2, "four": 4}, 3, (1, 3))
    return lambda output="run", config=config: retrieval_benchmark.run(spark, f"{folder}/items", f"{folder}/documents", f"{folder}/{output}", config)


def test_benchmark_cases_and_report(benchmark):
    cases, report, written = benchmark()
    assert written == ["truth", "ranked", "ranked", "cases", "report"]
    got = {(r.configuration, r.query_id): (r.state, r.relevant, r.results, r.first_rank, r.recall_at_1) for r in cases.collect()}
    assert got["two", 1] == ("SCORABLE", 1, 3, 2, 0.0)  # document 12 says alpha twice
    assert got["four", 1] == ("SCORABLE", 1, 2, 1, 1.0)
    assert got["two", 5] == ("SCORABLE", 1, 1, 1, 1.0)
    assert {got["two", i][0] for i in (3, 4)} == {"INVALID_GROUND_TRUTH"} and got["four", 2] == ("ANSWER_NOT_INDEXED", 0, 0, None, None)
    means = {r.configuration: (r.questions, r.scorable, r.without_results, r.mrr, r.recall_at_1, r.hit_at_3) for r in report.collect()}
    assert means == {"two": (5, 2, 3, 0.75, 0.5, 1.0), "four": (5, 2, 3, 1.0, 1.0, 1.0)}


def test_benchmark_goes_on_after_a_failure(benchmark, monkeypatch):
    real, calls = retrieval_benchmark.search, []

    def broken(*args):
        calls.append(args)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(*args)

    monkeypatch.setattr(retrieval_benchmark, "search", broken)
    with pytest.raises(RuntimeError, match="lost"):
        benchmark()
    cases, report, written = benchmark()
    assert written == ["ranked", "cases", "report"] and len(calls) == 3
    whole, means, _ = benchmark("fresh")
    assert shown(cases) == shown(whole) and shown(report) == shown(means)
    assert benchmark()[2] == []


def test_benchmark_keeps_what_settings_leave_alone(benchmark, spark, folder):
    benchmark()
    assert benchmark(config=retrieval_benchmark.Config({"two": 2, "three": 3}, 3, (1, 3)))[2] == ["ranked", "cases", "report"]
    add(spark, folder, [(20, "one two three", "en", "a")])
    cases, _, written = benchmark()
    assert written == ["truth", "ranked", "ranked", "cases", "report"]
    assert cases.where("query_id = 5 and configuration = 'two'").first().relevant == 2


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_against_sql(spark, sf_dir, name):
    got = queries.queries()[name](spark, sf_dir).toPandas()
    expected = views(sf_dir).sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns) and plain(got) == plain(expected)


def test_command_lines(tmp_path, sf_dir):
    for args in (["jobs.intake", "--input", f"{sf_dir}/documents.parquet", "--output", f"{tmp_path}/elements", "--checkpoint", f"{tmp_path}/checkpoint"], ["jobs.retrieval_benchmark", "--questions", f"{sf_dir}/benchmark.parquet", "--corpus", f"{sf_dir}/documents.parquet", "--output", f"{tmp_path}/benchmark"]):
        done = subprocess.run([sys.executable, "-m", *args], capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr
        assert "foliary.jobs" in done.stderr and "wrote" in done.stderr
    assert glob.glob(f"{tmp_path}/elements/batch=0/element_type=paragraph/*.parquet")
    notes = [json.loads(line) for path in glob.glob(f"{tmp_path}/benchmark/stages/*/*.json") for line in open(path)]
    assert sorted(n["stage"] for n in notes) == ["cases", "ranked", "ranked", "ranked", "report", "truth"]
