"""Bounded evidence for answers: context packing, citations, conversation history, batches.

Budgets are running sums over a window.  Where the rule is "stop at the first that doesn't fit",
the sum is monotone and a filter on it is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliary.functions.text import page_label

CONTEXT_CHARS, EXCERPT = 12_000, 500
HISTORY_MESSAGES, HISTORY_CHARS = 10, 6_000
BATCH_CHARS = 6_000
CITATION = r"\[S([0-9]+)\]"


def _running(size: str, scope: str, order: list) -> Column:
    return F.sum(size).over(Window.partitionBy(scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def header(label: Column, score: Column | None = None) -> Column:
    """What stands above a source's text; values that are missing are named as such."""
    shown = F.lit("(not reranked)") if score is None else F.coalesce(F.format_string("%.6f", score), F.lit("(not reranked)"))
    rows = [
        F.concat(F.lit("["), label, F.lit("]")),
        F.concat(F.lit("Document: "), "original_filename"),
        F.concat(F.lit("Document ID: "), F.col("document_id").cast("string")),
        F.concat(F.lit("Chunk ID: "), F.col("chunk_id").cast("string")),
        F.concat(F.lit("Page: "), page_label(F.col("start_page"), F.col("end_page"))),
        F.concat(F.lit("Section: "), F.coalesce(F.nullif("section_heading", F.lit("")), F.lit("(none)"))),
        F.concat(F.lit("Final rank: "), F.col("rank").cast("string")),
        F.concat(F.lit("Reranker score: "), shown),
        F.lit("Content:"),
    ]
    return F.concat(F.concat_ws("\n", *rows), F.lit("\n"))


def pack_context(results: DataFrame, max_chars: int = CONTEXT_CHARS) -> DataFrame:
    """Ranked results (query_id, rank, text, ...) as labelled blocks that fit the budget: query_id, rank, source_id, block, excerpt.

    A first block that is too long is clipped; a later one that doesn't fit ends the context.
    """
    score = F.col("rerank_score") if "rerank_score" in results.columns else None
    order = Window.partitionBy("query_id").orderBy("rank")
    out = results.withColumn("n", F.row_number().over(order)).withColumn("source_id", F.concat(F.lit("S"), F.col("n").cast("string"))).withColumn("head", header(F.col("source_id"), score))
    out = out.withColumn("size", F.length("head") + F.length("text") + F.when(F.col("n") > 1, 2).otherwise(0)).withColumn("used", _running("size", "query_id", ["rank"]))
    room = max_chars - F.length("head")
    out = out.where((F.col("used") <= max_chars) | ((F.col("n") == 1) & (room > 0)))
    clipped = F.when(F.col("used") <= max_chars, F.col("text")).otherwise(F.substring("text", F.lit(1), room))
    # a clipped first block fills the budget, so nothing follows it: later sums are over it, too
    return out.withColumn("included", clipped).select("query_id", "rank", "source_id", F.concat("head", "included").alias("block"), F.left("included", F.lit(EXCERPT)).alias("excerpt"))


def context_text(packed: DataFrame) -> DataFrame:
    """One text for each query."""
    return packed.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("context"), F.count(F.lit(1)).alias("sources"))


def citations(answer: Column) -> Column:
    """Labels S1, S2, ... in an answer, each once, in order."""
    return F.transform(F.array_distinct(F.regexp_extract_all(answer, F.lit(CITATION))), lambda n: F.concat(F.lit("S"), n))


def check_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answers: query_id, answer; sources: query_id, source_id.  Valid answers cite something, and nothing unknown."""
    known = sources.groupBy("query_id").agg(F.collect_set("source_id").alias("known"))
    out = answers.join(known, "query_id", "left").withColumn("citations", citations(F.col("answer"))).withColumn("unknown", F.array_except("citations", F.coalesce("known", F.array().cast("array<string>"))))
    return out.select("query_id", "answer", "citations", "unknown", ((F.size("citations") > 0) & (F.size("unknown") == 0)).alias("valid"))


def stored_history(messages: DataFrame, n: int = HISTORY_MESSAGES, chars: int = HISTORY_CHARS) -> DataFrame:
    """The newest whole messages of each conversation (conversation_id, sequence_number, role, content) within both limits."""
    newest = Window.partitionBy("conversation_id").orderBy(F.desc("sequence_number"))
    out = messages.withColumn("newest", F.row_number().over(newest)).where(F.col("newest") <= n).withColumn("size", F.length("content"))
    out = out.withColumn("used", _running("size", "conversation_id", [F.desc("sequence_number")])).where(F.col("used") <= chars)
    return out.drop("newest", "size", "used")


def prompt_history(messages: DataFrame, n: int = HISTORY_MESSAGES, chars: int = HISTORY_CHARS) -> DataFrame:
    """History lines ``role: content`` within the budget, the oldest one clipped if part of it fits: conversation_id, sequence_number, line."""
    newest = Window.partitionBy("conversation_id").orderBy(F.desc("sequence_number"))
    out = messages.withColumn("newest", F.row_number().over(newest)).where(F.col("newest") <= n)
    out = out.withColumn("prefix", F.concat("role", F.lit(": "))).withColumn("extra", F.when(F.col("newest") > 1, 2).otherwise(0))
    out = out.withColumn("size", F.length("prefix") + F.length("content") + F.col("extra")).withColumn("used", _running("size", "conversation_id", [F.desc("sequence_number")]))
    left = chars - (F.col("used") - F.col("size")) - F.col("extra") - F.length("prefix")
    fits = F.col("used") <= chars
    # only the first that doesn't fit has room left: behind it the sum is over the budget already
    whole_before = (F.col("used") - F.col("size")) <= chars
    kept = out.where(fits | (whole_before & (left > 0)))
    clipped = F.rtrim(F.substring("content", F.lit(1), left))
    return kept.select("conversation_id", "sequence_number", F.concat("prefix", F.when(fits, F.col("content")).otherwise(clipped)).alias("line"))


def history_text(lines: DataFrame) -> DataFrame:
    return lines.groupBy("conversation_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence_number", "line"))), lambda x: x["line"]), "\n\n").alias("history"))


def bounded_join(items: DataFrame, scope: str, order: str, text: str, chars: int, separator: str = "\n\n") -> DataFrame:
    """Texts of a group one behind the other up to a budget, the last one clipped."""
    first = F.row_number().over(Window.partitionBy(scope).orderBy(order)) == 1
    gap = F.when(first, 0).otherwise(len(separator))
    out = items.select(scope, order, F.col(text).alias("text"), gap.alias("gap")).withColumn("size", F.length("text") + F.col("gap"))
    out = out.withColumn("before", F.coalesce(_running("size", scope, [order]) - F.col("size"), F.lit(0)) + F.col("gap")).where(F.col("before") < chars)
    out = out.withColumn("text", F.substring("text", F.lit(1), F.lit(chars) - F.col("before")))
    return out.groupBy(scope).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "text"))), lambda x: x["text"]), separator).alias("joined"))


def batches(items: DataFrame, scope: str, order: str, text: str, chars: int = BATCH_CHARS, separator: int = 2, marker: str = " [truncated]") -> DataFrame:
    """Greedy batches: a new one begins where the next block would pass the limit; longer blocks are clipped with a marker.

    Where a batch begins depends on the one before it, so sizes are folded in order, per group.
    """
    block = F.when(F.length(text) > chars, F.concat(F.substring(text, F.lit(1), F.lit(chars - len(marker))), F.lit(marker))).otherwise(F.col(text))
    listed = items.groupBy(scope).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("text")))).alias("xs"))
    state = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        size = F.length(x["text"])
        fits = (s["used"] > 0) & (s["used"] + separator + size <= chars)
        batch = F.when(fits, s["batch"]).otherwise(s["batch"] + 1)
        return F.struct(batch.alias("batch"), F.when(fits, s["used"] + separator + size).otherwise(size).alias("used"), F.concat(s["out"], F.array(batch)).alias("out"))

    numbered = listed.withColumn("bs", F.aggregate("xs", state, step, lambda s: s["out"]))
    return numbered.select(scope, F.explode(F.arrays_zip("xs", "bs")).alias("z")).select(scope, F.col("z.xs.o").alias(order), F.col("z.bs").alias("batch"), F.col("z.xs.text").alias("block"))


def evidence(chunks: DataFrame, request: Column, chars: int, scope: str = "document_id") -> DataFrame:
    """Chunks by the number of request words they hold, as many as fit; later ones that don't are skipped, the first is clipped."""
    from foliary.functions.text import terms

    score = F.size(F.array_intersect(F.array_distinct(terms(request)), F.array_distinct(terms(F.col("text")))))
    rows = chunks.where(F.trim("text") != "").select(scope, F.struct((-score).alias("s"), F.col("sequence_number").alias("q"), F.col("chunk_id").alias("c"), F.col("text").alias("t")).alias("x"))
    listed = rows.groupBy(scope).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    kind = "array<struct<q:int,c:string,t:string>>"
    state = F.struct(F.lit(0).alias("used"), F.array().cast(kind).alias("out"))

    def step(s: Column, x: Column) -> Column:
        first = F.size(s["out"]) == 0
        text = F.when(first, F.substring(x["t"], F.lit(1), F.lit(chars))).otherwise(x["t"])
        fits = (s["used"] < chars) & (s["used"] + F.length(text) <= chars)
        more = F.array(F.struct(x["q"].cast("int").alias("q"), x["c"].cast("string").alias("c"), text.alias("t")))
        return F.struct((s["used"] + F.when(fits, F.length(text)).otherwise(0)).alias("used"), F.when(fits, F.concat(s["out"], more)).otherwise(s["out"]).alias("out"))

    picked = listed.select(scope, F.array_sort(F.aggregate("xs", state, step, lambda s: s["out"])).alias("e"))
    rows = picked.select(scope, F.posexplode("e").alias("i", "e"))
    return rows.select(scope, F.concat(F.lit("E"), (F.col("i") + 1).cast("string")).alias("source_id"), F.col("e.c").alias("chunk_id"), F.col("e.q").alias("sequence_number"), F.col("e.t").alias("text"))


def clean_rewrite(rewritten: Column, question: Column) -> Column:
    """A rewritten query on one line without quotes, or the question where nothing is left."""
    from foliary.functions.text import collapse

    plain = F.trim(F.regexp_replace(collapse(F.coalesce(rewritten, F.lit(""))), "^[\"'`]+|[\"'`]+$", ""))
    return F.when(plain == "", question).otherwise(plain)


def inherited_scope(messages: DataFrame) -> DataFrame:
    """Each message's scope of documents: its own, or the last one given before it."""
    order = Window.partitionBy("conversation_id").orderBy("sequence_number").rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("effective_scope", F.last("scope", ignorenulls=True).over(order))


# What a scope stands between in a message, and the ids in it.
SCOPE_BEGIN, SCOPE_END = "\x1eSCOPE:", "\x1e"
SCOPE = r"\x1eSCOPE:([0-9a-fA-F,-]+)\x1e"
UUID = r"^[0-9a-fA-F]{8}(?:-?[0-9a-fA-F]{4}){3}-?[0-9a-fA-F]{12}$"


def encode_scope(content: Column, ids: Column) -> Column:
    """A message with the ids of the documents it is about behind it, each once; without ids just the message."""
    once = F.array_distinct(ids)
    return F.when(F.size(once) > 0, F.concat(F.trim(content), F.lit(SCOPE_BEGIN), F.array_join(once, ","), F.lit(SCOPE_END))).otherwise(F.trim(content))


def extract_scope(content: Column) -> Column:
    """The ids of the last scope in a message; none where one of them is no id."""
    found = F.regexp_extract_all(content, F.lit(SCOPE), F.lit(1))
    ids = F.array_distinct(F.transform(F.split(F.element_at(found, -1), ","), F.lower))
    return F.when((F.size(found) > 0) & F.forall(ids, lambda x: x.rlike(UUID)), ids).otherwise(F.array().cast("array<string>"))


def strip_scope(content: Column) -> Column:
    """A message as people see it."""
    return F.trim(F.regexp_replace(content, SCOPE, ""))
