"""Reports on evaluation runs: what was answered, cited and grounded, how long it took, and whether the corpus fits the cases.

Rates without a denominator are null.  Percentiles are exact and interpolated; ``approximate``
takes a bounded sketch of each group instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliary.functions import text as T
from foliary.operators.context import citations

# States of records and codes of reasons.
ANSWERED, ABSTAINED, SCORABLE = "ANSWERED", "ABSTAINED", "SCORABLE"
NO_EVIDENCE = "RETRIEVAL_NO_RELEVANT_EVIDENCE"
REVIEW = ("GROUNDING_REJECTED", "UNCLASSIFIED", "EMPTY_ANSWER", "EXACT_OR_ANLS_CORRECT", "FORMAT_MISMATCH", "NO_CITATION", "VALID_CITATION_WRONG_ANSWER")


def rate(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def times(value: str, approximate: bool = False) -> list[Column]:
    """samples, mean, median and 95th percentile; nulls don't count."""
    at = (lambda p: F.percentile_approx(value, F.lit(p), F.lit(10_000))) if approximate else (lambda p: F.percentile(value, F.lit(p)))
    return [F.count(value).alias("samples"), F.avg(value).alias("mean_ms"), at(0.5).alias("median_ms"), at(0.95).alias("p95_ms")]


def latencies(records: DataFrame, fields: list[str], by: str = "configuration", approximate: bool = False) -> DataFrame:
    """One row for each configuration and timer, those without samples too."""
    long = records.select(by, *(F.col(f).cast("double").alias(f) for f in fields)).unpivot([by], fields, "field", "ms")
    return long.groupBy(by, "field").agg(*times("ms", approximate))


def histogram(records: DataFrame, column: str, by: str = "configuration") -> DataFrame:
    """How often each reason or bucket occurs; null and empty ones don't."""
    return records.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(by, column).agg(F.count(F.lit(1)).alias("n"))


def citation_rates() -> list[Column]:
    """Over answered records; where a rate is one of labels it counts labels, else records."""
    answered = F.col("status") == ANSWERED
    citing = answered & (F.coalesce("citation_labels_emitted", F.lit(0)) > 0)
    emitted = F.sum(F.when(answered, F.col("citation_labels_emitted")))
    true = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    return [
        rate(F.count_if(citing), F.count_if(answered)).alias("citation_presence_rate"),
        rate(F.sum(F.when(answered, F.col("citation_labels_valid"))), emitted).alias("citation_reference_validity_rate"),
        rate(F.count_if(citing & true("citation_document_hit")), F.count_if(citing)).alias("citation_document_hit_rate"),
        rate(F.sum(F.when(answered, F.when(true("all_citations_true_document"), F.col("citation_labels_valid")).otherwise(0))), emitted).alias("all_citations_true_document_rate"),
        rate(F.count_if(citing & true("gold_evidence_citation_hit")), F.count_if(citing)).alias("gold_evidence_citation_hit_rate"),
        rate(F.sum(F.when(answered, F.when(citing, F.col("gold_evidence_citation_count")).otherwise(0))), emitted).alias("gold_evidence_citation_precision"),
        rate(F.count_if(citing & true("answer_supported_by_cited_evidence")), F.count_if(citing & F.col("answer_supported_by_cited_evidence").isNotNull())).alias("answer_supported_by_cited_evidence_rate"),
    ]


def scores(name: str, anls: str, exact: str) -> list[Column]:
    """Means over all records, and over those that can be scored; a record that failed counts with its 0."""
    scorable = F.col("ground_truth_status") == SCORABLE
    out = []
    for label, column in (("anls", F.col(anls)), ("exact_match", F.col(exact).cast("double"))):
        out += [F.avg(column).alias(f"{name}end_to_end_{label}"), F.avg(F.when(scorable, column)).alias(f"{name}scorable_{label}")]
    return out


def answer_run(records: DataFrame, by: str = "configuration") -> DataFrame:
    """One row for each configuration: how many were answered, abstained from or failed, how well, and the citation rates."""
    scorable, answered, abstained = F.col("ground_truth_status") == SCORABLE, F.col("status") == ANSWERED, F.col("status") == ABSTAINED
    return records.groupBy(by).agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(scorable).alias("scorable"), F.count_if(~scorable).alias("unscorable"),
        F.count_if(answered).alias("answered"), F.count_if(abstained).alias("abstained"), F.count_if(~answered & ~abstained).alias("failed"),
        rate(F.count_if(answered), F.count(F.lit(1))).alias("coverage"), rate(F.count_if(abstained), F.count(F.lit(1))).alias("abstention_rate"),
        F.count_if(abstained & ~scorable).alias("correct_abstentions"), *scores("", "anls", "exact_match"), *citation_rates(),
    )


def diagnostic_run(records: DataFrame, by: str = "configuration") -> DataFrame:
    """As ``answer_run`` for records with answers as given (raw_) and as cleaned for scoring (metric_)."""
    scorable, answered = F.col("ground_truth_status") == SCORABLE, F.col("status") == ANSWERED
    return records.groupBy(by).agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(scorable).alias("scorable"), F.count_if(answered).alias("answered"), F.count_if(~answered).alias("failed"),
        rate(F.count_if(answered), F.count_if(scorable)).alias("completion_rate_scorable"),
        *scores("raw_", "raw_anls", "raw_exact_match"), *scores("metric_", "metric_anls", "metric_exact_match"), *citation_rates(),
    )


def source_metrics(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """What an answer's labels point to.

    answers: record_id, answer, target_document_id, relevant_chunk_ids, accepted_answers; sources:
    record_id, source_id, document_id, chunk_id, excerpt.  Labels count once each, in any number of
    occurrences; those without a source are emitted but not valid.
    """
    a = answers.select("record_id", "target_document_id", "relevant_chunk_ids", F.filter(F.transform("accepted_answers", T.normal_key), lambda x: x != "").alias("accepted"), citations(F.coalesce("answer", F.lit(""))).alias("labels"))
    cited = a.select("record_id", "target_document_id", "relevant_chunk_ids", "accepted", F.explode("labels").alias("source_id")).join(sources.dropDuplicates(["record_id", "source_id"]), ["record_id", "source_id"])
    target = F.coalesce(F.col("document_id") == F.col("target_document_id"), F.lit(False))
    gold = F.coalesce(F.array_contains("relevant_chunk_ids", F.col("chunk_id")), F.lit(False))
    excerpt = T.normal_key(F.col("excerpt"))
    supports = F.coalesce(F.exists("accepted", lambda x: excerpt.contains(x)), F.lit(False))
    found = cited.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("valid"), F.bool_or(target).alias("hit"), F.bool_and(target).alias("all_true"), F.count_if(gold).alias("gold"), F.bool_or(supports).alias("supported")
    )
    out = a.select("record_id", F.size("labels").cast("long").alias("citation_labels_emitted")).join(found, "record_id", "left")
    return out.select(
        "record_id", "citation_labels_emitted", F.coalesce("valid", F.lit(0)).alias("citation_labels_valid"), F.coalesce("hit", F.lit(False)).alias("citation_document_hit"),
        F.when(F.col("citation_labels_emitted") > 0, F.coalesce("all_true", F.lit(False))).alias("all_citations_true_document"),
        (F.coalesce("gold", F.lit(0)) > 0).alias("gold_evidence_citation_hit"), F.coalesce("gold", F.lit(0)).alias("gold_evidence_citation_count"),
        rate(F.col("gold"), F.col("valid")).alias("gold_evidence_citation_precision"), F.col("supported").alias("answer_supported_by_cited_evidence"),
    )


def answer_state(n_sources: Column, answer: Column, no_answer: str) -> tuple[Column, Column]:
    """Status and reason of a response: without sources, or with the sentence that says so, it abstains."""
    abstains = (n_sources == 0) | F.coalesce(answer == no_answer, F.lit(False))
    return F.when(abstains, ABSTAINED).otherwise(ANSWERED), F.when(abstains, NO_EVIDENCE)


def failure_reason(origin: Column, message: Column, provider: str = "MODEL") -> Column:
    """A stable code for what went wrong: in the model's service (origin ``model``), in answering (``rag``), else elsewhere."""
    m = F.lower(F.coalesce(message, F.lit("")))
    has = lambda *words: F.lit(True) if not words else m.contains(words[0]) & has(*words[1:])
    model = F.when(has("timed out") | has("within"), f"{provider}_TIMEOUT").when(has("model", "unavailable"), f"{provider}_MODEL_MISSING").when(has("unavailable") | has(f"start {provider.lower()}"), f"{provider}_UNAVAILABLE").otherwise(f"{provider}_ERROR")
    rag = F.when(has("citation"), "INVALID_CITATION").otherwise("GROUNDING_REJECTED")
    return F.when(origin == "model", model).when(origin == "rag", rag).when(has("search") | has("retriev"), "RETRIEVAL_ERROR").otherwise(F.upper(origin))


def rag_cases(cases: DataFrame, responses: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for each case's response.

    cases: case_id, expected_documents, expected_facts, expect_no_evidence; responses: case_id,
    answer, citations, citations_valid, generation_ms, total_ms; sources: case_id, source_id,
    document_id, filename, excerpt.
    """
    docs, facts = F.transform("expected_documents", T.normal_key), F.transform("expected_facts", T.normal_key)
    met = cases.select("case_id", docs.alias("docs"), facts.alias("facts"), "expect_no_evidence").join(responses, "case_id")
    some = sources.join(responses.select("case_id", "citations"), "case_id")
    cited = F.array_contains("citations", F.col("source_id"))
    names = F.array(T.normal_key(F.col("document_id").cast("string")), T.normal_key(F.col("filename")))
    found = some.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(cited).alias("cited"), F.flatten(F.collect_list(F.when(cited, names))).alias("names"),
        T.normal_key(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cited, F.struct("source_id", "excerpt")))), lambda s: s["excerpt"]), " ")).alias("said"),
    )
    out = met.join(found, "case_id", "left")
    n, held = F.coalesce("n", F.lit(0)), T.normal_key(F.col("answer"))
    hits = F.size(F.filter("facts", lambda f: held.contains(f)))
    none = F.size("citations") == 0
    return out.select(
        "case_id", (~none).alias("citations_present"), "citations_valid",
        F.when(F.size("docs") > 0, F.arrays_overlap("docs", F.coalesce("names", F.array().cast("array<string>")))).alias("expected_document_cited"),
        F.size("facts").alias("facts"), F.when(F.size("facts") > 0, hits / F.size("facts")).otherwise(F.lit(0.0)).alias("key_fact_coverage"),
        F.when(F.size("facts") > 0, F.forall("facts", lambda f: F.coalesce("said", F.lit("")).contains(f))).otherwise((F.coalesce("cited", F.lit(0)) > 0) | F.col("expect_no_evidence")).alias("evidence_support"),
        F.when(F.col("expect_no_evidence"), (n == 0) & none).alias("no_evidence_correct"), "generation_ms", "total_ms",
    )


def rag_summary(cases: DataFrame) -> DataFrame:
    """One row over the result of ``rag_cases``; cases that expect no evidence have a rate of their own."""
    asked = F.col("no_evidence_correct").isNull()
    mean = lambda c, where=asked: F.avg(F.when(where, F.col(c).cast("double")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return cases.agg(
        F.count(F.lit(1)).alias("cases"), zero(mean("key_fact_coverage", asked & (F.col("facts") > 0))).alias("key_fact_coverage"),
        zero(mean("citations_present")).alias("citation_presence_rate"), zero(mean("citations_valid")).alias("citation_validity_rate"),
        F.avg(F.col("expected_document_cited").cast("double")).alias("expected_document_citation_rate"), zero(mean("evidence_support")).alias("evidence_support_rate"),
        F.count_if(~asked).alias("no_evidence_cases"), F.avg(F.col("no_evidence_correct").cast("double")).alias("no_evidence_correct_rate"),
        *(c for f in ("generation_ms", "total_ms") for c in (F.avg(f).alias(f"mean_{f}"), F.percentile(f, F.lit(0.5)).alias(f"median_{f}"))),
    )


def preflight(cases: DataFrame, inventory: DataFrame) -> DataFrame:
    """Each document a case expects (case_id, expected_documents), whether it is there, and with how many indexed chunks.

    inventory: document_id, original_filename, is_indexed, chunk_count.  Documents are named by file or id.
    """
    wanted = cases.select("case_id", F.explode("expected_documents").alias("expected_document")).withColumn("key", F.trim(T.casefold(F.col("expected_document"))))
    keys = inventory.select(F.explode(F.array_distinct(F.array(F.trim(T.casefold(F.col("original_filename"))), T.casefold(F.col("document_id").cast("string"))))).alias("key"), F.when(F.col("is_indexed"), F.col("chunk_count")).otherwise(0).alias("chunks"))
    held = keys.groupBy("key").agg(F.max("chunks").alias("chunks"))
    return wanted.join(held, "key", "left").select("case_id", "expected_document", F.col("chunks").isNotNull().alias("exists"), F.coalesce("chunks", F.lit(0)).alias("indexed_chunks"))


def require_corpus(checks: DataFrame) -> None:
    """Raises where an expected document is missing, or has no indexed chunks; the first ten are named."""
    for bad, what in ((~F.col("exists"), "not found"), (F.col("indexed_chunks") == 0, "without indexed chunks")):
        some = [r[0] for r in checks.where(bad).select("expected_document").distinct().orderBy("expected_document").limit(10).collect()]
        if some:
            raise ValueError(f"the cases don't fit the corpus, expected documents {what}: {', '.join(some)}")


def across_configurations(ranked: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Means of each configuration over the same cases (ranked: configuration, query_id, chunk_id, rank; truth: query_id, chunk_id).

    A case that a configuration gives no result for counts as 0.
    """
    needed = truth.select("query_id", "chunk_id").distinct()
    per_case = needed.groupBy("query_id").agg(F.count(F.lit(1)).alias("needed"))
    total = per_case.agg(F.count(F.lit(1)).alias("cases"))
    first = ranked.groupBy("configuration", "query_id", "chunk_id").agg(F.min("rank").alias("rank"))
    met = first.join(needed, ["query_id", "chunk_id"]).groupBy("configuration", "query_id").agg(F.min("rank").alias("first_rank"), *(F.count_if(F.col("rank") <= k).alias(f"n_{k}") for k in ks)).join(per_case, "query_id")
    names = ranked.select("configuration").distinct()
    sums = met.groupBy("configuration").agg(F.sum(1 / F.col("first_rank")).alias("rr"), *(c for k in ks for c in (F.sum(F.col(f"n_{k}") / F.col("needed")).alias(f"r_{k}"), F.count_if(F.col(f"n_{k}") > 0).alias(f"h_{k}"))))
    out = names.join(sums, "configuration", "left").crossJoin(F.broadcast(total))  # total is one row
    mean = lambda c: F.coalesce(F.col(c), F.lit(0)) / F.col("cases")
    return out.select("configuration", "cases", mean("rr").alias("mrr"), *(c for k in ks for c in (mean(f"r_{k}").alias(f"recall_at_{k}"), mean(f"h_{k}").alias(f"hit_at_{k}"))))


def reliability(records: DataFrame, approximate: bool = False) -> DataFrame:
    """One row over documents (status success, failed or skipped; processing_time_ms): counts, success rate and times of those attempted."""
    attempted = F.col("status").isin("success", "failed")
    timed = records.withColumn("ms", F.when(attempted, F.col("processing_time_ms").cast("double")))
    n = lambda s: F.count_if(F.col("status") == s)
    return timed.agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(attempted).alias("attempted"), n("success").alias("successful"), n("failed").alias("failed"), n("skipped").alias("skipped"),
        rate(n("success"), F.count_if(attempted)).alias("success_rate"), *times("ms", approximate),
    )


def layout_totals(scores_by_label: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Micro precision, recall and F1 over the labels that count, and how many boxes others have (from ``layout_scores``)."""
    counts = F.col("label").isin(*labels)
    total = lambda c: F.sum(F.when(counts, F.col(c)).otherwise(0))
    tp, fp, fn = total("tp"), total("fp"), total("fn")
    return scores_by_label.agg(
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.sum(F.when(~counts, F.col("tp") + F.col("fn")).otherwise(0)).alias("unsupported_truth"), F.sum(F.when(~counts, F.col("tp") + F.col("fp")).otherwise(0)).alias("unsupported_predicted"),
    )


def first_questions(questions: DataFrame, answers: DataFrame, most: int | None = None) -> DataFrame:
    """Questions that have an accepted answer, the first ``most`` of them by key (a report's own bound)."""
    asked = questions.join(answers.select("question_key").distinct(), "question_key", "left_semi")
    return asked if most is None else asked.orderBy("question_key").limit(most)


def with_reasons(manifest: DataFrame, documents: DataFrame, by_file: bool = False) -> DataFrame:
    """Records of a manifest against the stored documents: ready, or the reason why one is skipped.

    They meet by ``source_record_id``, or by the file's name (``local_pdf_path``, ``original_filename``); of several
    documents of one name the one of least id counts.
    """
    if by_file:
        key, stored = F.regexp_extract("local_pdf_path", r"([^/\\]+)$", 1), documents.withColumn("key", F.col("original_filename"))
        first = Window.partitionBy("key").orderBy("document_id")
        stored = stored.withColumn("n", F.row_number().over(first)).where("n = 1")
    else:
        key, stored = F.col("source_record_id"), documents.withColumn("key", F.col("source_record_id"))
    d = stored.select("key", "document_id", "status", "is_indexed", "chunk_count")
    met = manifest.withColumn("__key", key).join(d, F.col("__key") == F.col("key"), "left").drop("key", "__key")
    reason = F.when(F.col("document_id").isNull(), "NOT_INGESTED").when(F.col("status") != "ready", "NOT_READY").when(~F.coalesce("is_indexed", F.lit(False)) | (F.coalesce("chunk_count", F.lit(0)) == 0), "NOT_INDEXED")
    return met.withColumn("reason_code", reason).withColumn("ready", reason.isNull())


def method_summary(cases: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), by: str = "method", approximate: bool = False) -> DataFrame:
    """One row for each method over all its questions: a question that failed counts with 0, but its times don't count.

    cases: method, failed, results, reciprocal_rank, recall_at_k, hit_at_k, total_ms.
    """
    failed = F.coalesce(F.col("failed"), F.lit(False))
    mean = lambda c: F.avg(F.when(failed, 0.0).otherwise(F.coalesce(F.col(c).cast("double"), F.lit(0.0))))
    timed = cases.withColumn("ms", F.when(~failed, F.col("total_ms").cast("double")))
    return timed.groupBy(by).agg(
        F.count(F.lit(1)).alias("questions"), F.count_if(failed).alias("errors"), rate(F.count_if(~failed & (F.coalesce("results", F.lit(0)) == 0)), F.count_if(~failed)).alias("no_evidence_rate"),
        mean("reciprocal_rank").alias("mrr"), *(c for k in ks for c in (mean(f"recall_at_{k}").alias(f"recall_at_{k}"), mean(f"hit_at_{k}").alias(f"hit_at_{k}"))), *times("ms", approximate),
    )


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last run of each experiment (experiment, finished_at, run_id)."""
    order = Window.partitionBy("experiment").orderBy(F.desc("finished_at"), F.desc("run_id"))
    return runs.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
