"""Measures of retrieval, answers, recognised text and layout, as plans over tables of cases and results."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliary.functions import text as T

KS = (1, 3, 5, 10)
ANLS_LEAST = 0.5
LAYOUT_LABELS = {"heading": "Section-header", "paragraph": "Text", "list_item": "List-item", "table": "Table"}


def first_of_each(ranked: DataFrame, case: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """Ranked ids, each once per case at its best rank, ranks closed up."""
    best = ranked.groupBy(case, item).agg(F.min("rank").alias("rank"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(case).orderBy("rank", item)))


def retrieval_metrics(ranked: DataFrame, truth: DataFrame, ks: tuple[int, ...] = KS, case: str = "query_id", item: str = "chunk_id", document: str | None = None) -> DataFrame:
    """Per case: recall and hit at k, reciprocal rank, first relevant rank; with ``document`` (a column of both sides), document hits too.

    truth: one row for each relevant item.  Cases without relevant items don't occur.
    """
    r = ranked.select(case, item, "rank", *([document] if document else []))
    t = truth.select(case, item).distinct().withColumn("relevant", F.lit(True))
    needed = t.groupBy(case).agg(F.count(F.lit(1)).alias("needed"))
    met = t.join(r.groupBy(case, item).agg(F.min("rank").alias("rank")), [case, item]).groupBy(case).agg(
        F.min("rank").alias("first_rank"), *(F.count_if(F.col("rank") <= k).alias(f"n_{k}") for k in ks)
    )
    out = needed.join(met, case, "left")
    n = lambda k: F.coalesce(f"n_{k}", F.lit(0))
    cols = [c for k in ks for c in ((n(k) / F.col("needed")).alias(f"recall_at_{k}"), (n(k) > 0).alias(f"hit_at_{k}"))]
    out = out.select(case, "needed", "first_rank", F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal_rank"), *cols)
    if document:
        docs = truth.select(case, document).distinct().join(r.groupBy(case, document).agg(F.min("rank").alias("rank")), [case, document]).groupBy(case).agg(F.min("rank").alias("document_rank"))
        out = out.join(docs, case, "left").select("*", *(F.coalesce(F.col("document_rank") <= k, F.lit(False)).alias(f"document_hit_at_{k}") for k in ks)).drop("document_rank")
    return out


def retrieval_summary(per_case: DataFrame, ks: tuple[int, ...] = KS, cases: int | None = None) -> DataFrame:
    """Means over all scorable cases; a case without a row counts as 0 where ``cases`` gives their number."""
    of = F.lit(cases) if cases is not None else F.count(F.lit(1))
    cols = [F.sum("reciprocal_rank") / of]
    out = per_case.agg(F.count(F.lit(1)).alias("cases"), cols[0].alias("mrr"), *(c for k in ks for c in ((F.sum(f"recall_at_{k}") / of).alias(f"recall_at_{k}"), (F.count_if(F.col(f"hit_at_{k}")) / of).alias(f"hit_at_{k}"))))
    return out


def rank_movement(ranked: DataFrame) -> DataFrame:
    """How reranking moved results (base_rank, rank): counts and mean ranks."""
    delta = F.col("base_rank") - F.col("rank")
    return ranked.agg(F.count_if(delta > 0).alias("improved"), F.count_if(delta == 0).alias("unchanged"), F.count_if(delta < 0).alias("worsened"), F.avg("base_rank").alias("mean_base_rank"), F.avg("rank").alias("mean_rank"))


def latency(samples: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Mean, median and 95th percentile (interpolated) of samples; nulls don't count."""
    return samples.groupBy(*(by or [])).agg(F.count(value).alias("samples"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.percentile(value, F.lit(0.95)).alias("p95"))


def page_match(relevant: DataFrame, results: DataFrame) -> DataFrame:
    """Results that meet a case's labels: by chunk where the case names chunks, else by document (id or file name) and, where it names pages, by overlapping pages.

    relevant: query_id, chunk_ids, documents, pages (arrays); results: query_id, rank, chunk_id, document_id, original_filename, start_page, end_page.
    """
    met = results.join(relevant, "query_id")
    filled = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    wanted = F.transform("documents", lambda d: T.normal_key(d))
    document = F.arrays_overlap(wanted, F.array(T.normal_key(F.col("document_id").cast("string")), T.normal_key(F.col("original_filename"))))
    pages = F.exists("pages", lambda p: (p >= F.col("start_page")) & (p <= F.coalesce("end_page", "start_page")))
    hit = F.when(filled("chunk_ids"), F.array_contains("chunk_ids", F.col("chunk_id").cast("string"))).otherwise(document & F.when(filled("pages"), F.coalesce(pages, F.lit(False))).otherwise(F.lit(True)))
    return met.withColumn("relevant", F.coalesce(hit, F.lit(False))).drop("chunk_ids", "documents", "pages")


def distance_rate(distance: Column, reference: Column, other: Column) -> Column:
    """Edits over the reference's length; an empty reference gives 0 for an empty other, else 1."""
    return F.when(reference == 0, F.when(other == 0, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(distance / reference)


def cer(reference: Column, other: Column) -> Column:
    return distance_rate(T.edits(reference, other), F.length(reference), F.length(other))


def wer(reference: Column, other: Column) -> Column:
    split = lambda c: F.filter(F.split(T.collapse(c), " "), lambda w: w != "")
    x, y = split(reference), split(other)
    return distance_rate(T.word_distance(x, y), F.size(x), F.size(y))


def text_rates(pairs: DataFrame, reference: str = "reference", other: str = "other") -> DataFrame:
    """Per pair: cer and wer on texts as they are, and on normalised ones."""
    r, o = F.col(reference), F.col(other)
    return pairs.withColumns({"cer": cer(r, o), "wer": wer(r, o)}).withColumns({"__r": T.nfkc(r), "__o": T.nfkc(o)}).withColumns({"cer_collapsed": cer(F.col("__r"), F.col("__o")), "wer_collapsed": wer(F.col("__r"), F.col("__o"))}).drop("__r", "__o")


def micro_macro(pairs: DataFrame, reference: str = "reference", other: str = "other") -> DataFrame:
    """Character error rate over all characters, and its mean over texts."""
    d = T.edits(F.col(reference), F.col(other))
    return pairs.agg(F.count(F.lit(1)).alias("texts"), F.try_divide(F.sum(d), F.sum(F.length(reference))).alias("micro_cer"), F.avg(cer(F.col(reference), F.col(other))).alias("macro_cer"))


def text_summary(pairs: DataFrame, reference: str = "reference", other: str = "other") -> DataFrame:
    """One row: character and word error rates, over all characters or words and as means over texts, of texts as they are and of normal ones."""
    split = lambda c: F.filter(F.split(T.collapse(c), " "), lambda w: w != "")
    out = pairs.select(F.col(reference).alias("r"), F.col(other).alias("o")).withColumns({"nr": T.nfkc(F.col("r")), "no": T.nfkc(F.col("o"))})
    measures = {"cer": (F.length, T.edits, lambda c: F.col(c)), "wer": (F.size, T.word_distance, lambda c: split(F.col(c)))}
    for name, (size, distance, form) in measures.items():
        for suffix, x, y in (("", "r", "o"), ("_collapsed", "nr", "no")):
            out = out.withColumns({f"d_{name}{suffix}": distance(form(x), form(y)), f"n_{name}{suffix}": size(form(x)), f"m_{name}{suffix}": size(form(y))})
    names = [f"{n}{s}" for n in measures for s in ("", "_collapsed")]
    micro = lambda n: F.try_divide(F.sum(f"d_{n}"), F.sum(f"n_{n}"))
    macro = lambda n: F.avg(distance_rate(F.col(f"d_{n}"), F.col(f"n_{n}"), F.col(f"m_{n}")))
    return out.agg(F.count(F.lit(1)).alias("texts"), *(c for n in names for c in (micro(n).alias(f"micro_{n}"), macro(n).alias(f"macro_{n}"))))


def anls(answers: Column, prediction: Column) -> Column:
    """1 minus the share of edits, 0 from half on, both empty: 1; the best over accepted answers, 0 without any."""
    keys, p = F.transform(answers, T.normal_key), T.normal_key(prediction)

    def score(a: Column, d: Column) -> Column:
        longest = F.greatest(F.length(a), F.length(p))
        share = d / longest
        return F.when(longest == 0, F.lit(1.0)).when(share < ANLS_LEAST, F.round(1 - share, 12)).otherwise(F.lit(0.0))

    return F.coalesce(F.array_max(F.zip_with(keys, T.edits_within(keys, p, F.lit(ANLS_LEAST)), score)), F.lit(0.0))


def exact_match(answers: Column, prediction: Column) -> Column:
    return F.exists(answers, lambda a: T.normal_key(a) == T.normal_key(prediction))


def answer_occurs(answer: Column, text: Column) -> Column:
    """Whether an answer stands in a text, not inside a longer word: borders count only where the answer has a letter or digit."""
    a, t = T.normal_key(answer), T.normal_key(text)
    quoted = F.regexp_replace(a, r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    pattern = F.concat(F.lit("(?U)"), F.when(a.rlike(r"(?U)^\w"), r"(?<!\w)").otherwise(""), quoted, F.when(a.rlike(r"(?U)\w$"), r"(?!\w)").otherwise(""))
    return (a != "") & F.regexp_like(t, pattern)


def ground_truth(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """questions: question_key, document_id, accepted_answers; chunks: chunk_id, document_id, text.  Relevant chunks and state of each question.

    A question's chunks are those of its own document (a join on it), tested one by one.
    """
    named = F.filter(F.transform("accepted_answers", lambda a: F.trim(a)), lambda a: a != "")
    q = questions.withColumn("answers", named)
    held = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    met = q.join(chunks.select("document_id", "chunk_id", "text"), "document_id").where(F.exists("answers", lambda a: answer_occurs(a, F.col("text"))))
    relevant = met.groupBy("question_key").agg(F.array_sort(F.collect_set(F.col("chunk_id").cast("string"))).alias("relevant_chunks"))
    out = q.join(held, "document_id", "left").join(relevant, "question_key", "left")
    state = F.when(F.size("answers") == 0, "INVALID_GROUND_TRUTH").when(F.col("chunks").isNull(), "DOCUMENT_PROCESSING_FAILED").when(F.col("relevant_chunks").isNull(), "ANSWER_NOT_INDEXED").otherwise("SCORABLE")
    return out.select("question_key", "document_id", state.alias("state"), F.coalesce("relevant_chunks", F.array().cast("array<string>")).alias("relevant_chunks"))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Overlap of two boxes (x0, y0, x1, y1) over their union; 0 where there is none."""
    wide = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    high = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    both = wide * high
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def _strips(y0: Column, y1: Column, base: float, near: int = 0) -> Column:
    """Where a box of a page stands: classes of height and strips of the page, for ``near`` > 0 all that a box it matches can be in.

    Boxes that overlap by 1 / base of their union have heights within a factor of base, and tops
    no further apart than base - 1 times the height of either.
    """
    kind = F.floor(F.log(y1 - y0) / math.log(base) + 1e-9).cast("int")
    high = lambda c: F.pow(F.lit(base), c + 1)
    if not near:
        return F.array(F.struct(kind.alias("kind"), F.floor(y0 / high(kind)).alias("strip")))
    kinds = F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: kind + d)
    return F.flatten(F.transform(kinds, lambda c: F.transform(F.sequence(F.lit(-near), F.lit(near)), lambda d: F.struct(c.alias("kind"), (F.floor(y0 / high(c)) + d).alias("strip")))))


def layout_pairs(truth: DataFrame, predicted: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of boxes of one page and label that overlap enough: only boxes of like heights and near strips of a page meet."""
    key = ["document_id", "page_number", "label"]
    mapped = F.create_map(*(F.lit(x) for kv in LAYOUT_LABELS.items() for x in kv))
    p = predicted.withColumn("label", F.coalesce(mapped[F.col("label")], "label"))
    g = truth.select(*key, *(F.col(c).alias(f"g_{c}") for c in ("box_index", "x0", "y0", "x1", "y1")))
    q = p.select(*key, *(F.col(c).alias(f"p_{c}") for c in ("box_index", "x0", "y0", "x1", "y1")))
    box = lambda s: tuple(F.col(f"{s}_{c}").cast("double") for c in ("x0", "y0", "x1", "y1"))
    if least > 0:
        base = max(2.0, 1 / least)
        g = g.where("g_y1 > g_y0").select("*", F.inline(_strips(box("g")[1], box("g")[3], base)))
        q = q.where("p_y1 > p_y0").select("*", F.inline(_strips(box("p")[1], box("p")[3], base, math.ceil(base - 1))))
    met = g.join(q, [*key, "kind", "strip"] if least > 0 else key)
    return met.withColumn("iou", iou(box("g"), box("p"))).drop("kind", "strip").where(F.col("iou") >= least)


def layout_match(truth: DataFrame, predicted: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of boxes of one page and label, best overlap first, each box once.

    truth, predicted: document_id, page_number, box_index, label, x0, y0, x1, y1.  A group of the greedy
    choice is one label of one page.
    """
    near = layout_pairs(truth, predicted, least)
    key = ["document_id", "page_number", "label"]
    names = [*key, "truth_index", "predicted_index", "iou"]
    kinds = {f.name: f.dataType.simpleString() for f in near.schema}
    schema = f"document_id {kinds['document_id']}, page_number {kinds['page_number']}, label string, truth_index {kinds['g_box_index']}, predicted_index {kinds['p_box_index']}, iou double"

    def greedy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, left, right = None, set(), set()
        for f in frames:
            rows = []
            for r in zip(*(f[c].tolist() for c in (*key, "g_box_index", "p_box_index", "iou")), strict=True):
                if r[:3] != now:
                    now, left, right = r[:3], set(), set()
                if r[3] not in left and r[4] not in right:
                    left.add(r[3])
                    right.add(r[4])
                    rows.append(r)
            yield pd.DataFrame(rows, columns=names)

    # many pages pass through one task in order, so a small page costs no call of its own
    ordered = near.select(*key, "g_box_index", "p_box_index", "iou").repartition(*key).sortWithinPartitions(*key, F.desc("iou"), "g_box_index", "p_box_index")
    return ordered.mapInPandas(greedy, schema)


def layout_scores(truth: DataFrame, predicted: DataFrame, matches: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each label, and mean overlap of the pairs."""
    mapped = F.create_map(*(F.lit(x) for kv in LAYOUT_LABELS.items() for x in kv))
    counted = lambda df, n, label="label": df.groupBy(label).agg(F.count(F.lit(1)).alias(n))
    t, p = counted(truth, "truth"), counted(predicted.withColumn("label", F.coalesce(mapped[F.col("label")], "label")), "predicted")
    m = matches.groupBy("label").agg(F.count(F.lit(1)).alias("tp"), F.avg("iou").alias("mean_iou"))
    out = t.join(p, "label", "full_outer").join(m, "label", "full_outer").na.fill(0, ["truth", "predicted", "tp"])
    precision, recall = F.try_divide("tp", "predicted"), F.try_divide("tp", "truth")
    f1 = F.when(F.col("truth") + F.col("predicted") > 0, 2 * F.col("tp") / (F.col("truth") + F.col("predicted")))
    return out.select("label", "tp", (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("truth") - F.col("tp")).alias("fn"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "mean_iou")


def scaled_box(box: list[str], from_size: tuple[str, str], to_size: tuple[str, str]) -> list[Column]:
    """A box of one page space in another."""
    sx, sy = F.col(to_size[0]) / F.col(from_size[0]), F.col(to_size[1]) / F.col(from_size[1])
    return [(F.col(c) * (sx if i % 2 == 0 else sy)).alias(c) for i, c in enumerate(box)]


def normal_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """(x, y, width, height) as (x0, y0, x1, y1), null without area."""
    return F.when((w > 0) & (h > 0), F.struct(x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1")))


def key_fact_coverage(answer: Column, facts: Column) -> Column:
    """Share of facts that stand in an answer; null without facts."""
    seen = T.normal_key(answer)
    return F.when(F.size(facts) > 0, F.size(F.filter(facts, lambda f: seen.contains(T.normal_key(f)))) / F.size(facts))


def answer_summary(records: DataFrame, by: str = "configuration") -> DataFrame:
    """records: configuration, status, ground_truth_status, anls, exact_match, labels_emitted, labels_valid, generation_ms.

    Rates over all, over scorable and over answered questions are different numbers, and each is given.
    """
    done = F.col("status") == "COMPLETED"
    scorable = F.col("ground_truth_status") == "SCORABLE"
    return records.groupBy(by).agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if(done).alias("completed"),
        F.count_if(F.col("status") == "ABSTAINED").alias("abstained"),
        F.count_if(scorable).alias("scorable"),
        (F.sum(F.when(done, F.col("anls")).otherwise(0.0)) / F.count(F.lit(1))).alias("end_to_end_anls"),
        F.try_divide(F.sum(F.when(done & scorable, F.col("anls")).otherwise(0.0)), F.count_if(scorable)).alias("scorable_anls"),
        F.avg(F.when(done, F.col("anls"))).alias("answered_anls"),
        F.try_divide(F.count_if(done & F.col("exact_match")), F.count(F.lit(1))).alias("end_to_end_exact_match"),
        F.try_divide(F.sum("labels_valid"), F.sum("labels_emitted")).alias("citation_validity"),
        F.avg(F.when(done, F.col("generation_ms"))).alias("mean_ms"),
        F.median(F.when(done, F.col("generation_ms"))).alias("median_ms"),
        F.percentile(F.when(done, F.col("generation_ms")), F.lit(0.95)).alias("p95_ms"),
    )


# What marks citations, emphasis, code and headings in answers.
LABEL = r"^S\d+$"
MARKS = (
    (r"(?s)(\*\*|__)(.+?)\1", "$2"),
    (r"(?<!\*)\*([^*\n]+)\*(?!\*)", "$1"),
    (r"`([^`\n]+)`", "$1"),
    (r"(?mdU)^\s{0,3}#{1,6}\s+", ""),
)


def strip_citations(answer: Column, labels: Column) -> Column:
    """An answer without the labels it was given (others stay), and without marks of emphasis, code and headings; null stays null."""
    known = F.filter(labels, lambda x: x.rlike(LABEL))
    plain = F.aggregate(known, answer, lambda s, x: F.replace(s, F.concat(F.lit("["), x, F.lit("]")), F.lit("")))
    for pattern, into in MARKS:
        plain = F.regexp_replace(plain, pattern, into)
    return T.collapse(plain)


def review_bucket(status: Column, raw: Column, metric: Column, raw_anls: Column, raw_exact: Column, metric_anls: Column, metric_exact: Column, citations: Column, citations_valid: Column, supported: Column) -> Column:
    """Which pile an answer goes to for review, the first that fits.

    raw, metric: the answer as given and as cleaned for scoring; supported: whether its cited
    evidence holds it, null where that isn't known.
    """
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    right = lambda exact, anls: F.coalesce(exact, F.lit(False)) | (F.coalesce(anls, F.lit(0.0)) > 0)
    rules = (
        (status == "GROUNDING_REJECTED", "GROUNDING_REJECTED"),
        (status != "ANSWERED", "UNCLASSIFIED"),
        (~filled(raw) | ~filled(metric), "EMPTY_ANSWER"),
        (right(raw_exact, raw_anls), "EXACT_OR_ANLS_CORRECT"),
        (right(metric_exact, metric_anls), "FORMAT_MISMATCH"),
        (F.coalesce(F.size(citations), F.lit(0)) <= 0, "NO_CITATION"),
        (citations_valid & F.coalesce(~supported, F.lit(False)), "VALID_CITATION_WRONG_ANSWER"),
    )
    out = F.lit("UNCLASSIFIED")
    for rule, bucket in reversed(rules):
        out = F.when(rule, bucket).otherwise(out)
    return out


def gates(measures: DataFrame, least: dict[str, float]) -> DataFrame:
    """Each measure against its threshold: measure, value, threshold, passed; a null value fails."""
    rows = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value"), F.lit(float(x)).alias("threshold")) for m, x in least.items()))
    return measures.select(F.inline(rows)).withColumn("passed", F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False)))


def against_baseline(current: DataFrame, baseline: DataFrame, measures: list[str], tolerance: float = 0.0, by: str = "configuration") -> DataFrame:
    """Deltas to a baseline, and whether one fell by more than the tolerance."""
    met = current.alias("c").join(baseline.alias("b"), by, "left")
    deltas = {m: F.col(f"c.{m}") - F.col(f"b.{m}") for m in measures}
    worse = F.lit(False)
    for d in deltas.values():
        worse = worse | F.coalesce(d < -tolerance, F.lit(False))
    return met.select(by, *(d.alias(f"{m}_delta") for m, d in deltas.items()), worse.alias("regression"))


def percentage_points(delta: Column) -> Column:
    """A difference of two rates in percentage points."""
    return delta * 100


def wide_to_long(wide: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    return wide.select(*keys, *(F.col(m).cast("double").alias(m) for m in measures)).unpivot(keys, measures, "metric", "value")


def long_to_wide(long: DataFrame, key: str, measures: list[str]) -> DataFrame:
    return long.groupBy(key).pivot("metric", measures).agg(F.first("value"))


def shown_metric(status: Column, value: Column, places: int = 4) -> Column:
    return F.when(status == "MEASURED", F.format_string(f"%.{places}f", value)).otherwise(status)


def claims(lines: DataFrame, product: str) -> DataFrame:
    """Lines of a report that claim one accuracy for a whole product (or its total system), which no measure here is."""
    name = re.escape(product)
    return lines.where(F.col("value").rlike(rf"(?i)\b{name}(?:\s+total[- ]system)?\s+accuracy\s*(?:=|:)\s*[0-9]"))
