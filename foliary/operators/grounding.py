"""Whether a cited summary says only what its sources say: words of each segment against words of what it cites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.operators.context import CITATION, citations

# Grammar and reporting words that need no support, words that state a relation,
# headings that are no claims, and what identifiers, words and sentence borders are.
STOP_WORDS = (
    "a after an and are as at be been before being but by can could did do does during for from he her his in into is it its "
    "may might of on or our over she than that the their these this those to under was were we with without would you your"
).split()
FRAMING = "according content contain contains describe describes document evidence explicitly following mention mentions report reports said say source state states text".split()
RELATIONS = (
    "associated associate supports support supported referenced references relates related specifies specify establishes establish "
    "defines define indicates indicate causes cause requires require proves prove because therefore purpose applies covers governs outlines"
).split()
HEADINGS = ("dates / time periods", "explicit facts", "explicit obligations", "identifiers / references", "not specified", "overview", "qualifications")
IDENTIFIER = r"\b[A-Z]{2,}[A-Z0-9]*(?:[-/][A-Z0-9]+)+\b"
TOKEN = r"([a-z0-9]+)"
SENTENCE = r"(?<=[.!?])\s+|\r?\n+"
LIST_MARK = r"^\s*[-*•\uFFFD]\s*"


def plain_words(text: Column) -> Column:
    """Distinct small-lettered words with simple plurals taken off."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN))

    def single(w: Column) -> Column:
        long = F.length(w) > 4
        return F.when(long & w.endswith("ies"), F.concat(F.substring(w, F.lit(1), F.length(w) - 3), F.lit("y"))).when(long & w.endswith("s"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)

    return F.array_distinct(F.transform(found, single))


def meaningful(text: Column) -> Column:
    skip = F.array(*(F.lit(w) for w in (*STOP_WORDS, *FRAMING)))
    return F.array_except(plain_words(text), skip)


def segments(summary: Column, bullets: bool = False) -> Column:
    """Claims of a summary, sentence by sentence; a segment of citations alone belongs to the one before it.

    Headings that are known and cite nothing are left out.  With ``bullets`` every line has to be
    one, else there are no segments.
    """
    lines = F.filter(F.transform(F.split(summary, r"\R"), lambda x: F.trim(x)), lambda x: x != "")
    if bullets:
        lines = F.when(F.forall(lines, lambda x: x.startswith("-")), F.transform(lines, lambda x: F.trim(F.substring(x, F.lit(2), F.length(x))))).otherwise(F.array().cast("array<string>"))
    lines = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^#{1,6}\s*", "")))
    heading = lambda x: ~x.rlike(CITATION) & F.lower(F.trim(F.regexp_replace(x, ":+$", ""))).isin(*HEADINGS)
    lines = F.filter(lines, lambda x: ~heading(x))
    parts = F.filter(F.transform(F.flatten(F.transform(lines, lambda x: F.split(x, SENTENCE))), lambda x: F.trim(x)), lambda x: x != "")

    def add(out: Column, part: Column) -> Column:
        only = part.rlike(r"^(?:\[S[0-9]+\]\s*)+$") & (F.size(out) > 0)
        joined = F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.element_at(out, -1), part)))
        return F.when(only, joined).otherwise(F.concat(out, F.array(part)))

    return F.aggregate(parts, F.array().cast("array<string>"), add)


def grounded(summaries: DataFrame, sources: DataFrame, bullets: bool = False) -> DataFrame:
    """summaries: summary_id, summary; sources: summary_id, source_id, text.  summary_id, segments, bad, grounded.

    A segment must cite known sources, say something, and say nothing that they don't; one that
    names an identifier or a relation must have all its words in one of their sentences.
    """
    parts = summaries.select("summary_id", F.posexplode_outer(segments(F.col("summary"), bullets)).alias("i", "part"))
    parts = parts.withColumn("cited", citations(F.coalesce("part", F.lit("")))).withColumn("claim", F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("part", F.lit("")), CITATION, ""), LIST_MARK, "")))
    parts = parts.withColumn("said", meaningful(F.col("claim"))).withColumn("strict", F.col("claim").rlike(IDENTIFIER) | F.arrays_overlap(plain_words(F.col("claim")), F.array(*(F.lit(w) for w in RELATIONS))))
    cited = parts.select("summary_id", "i", "said", "strict", F.explode("cited").alias("source_id"))
    held = sources.select("summary_id", "source_id", meaningful(F.col("text")).alias("words"), F.transform(F.split("text", SENTENCE), lambda s: meaningful(s)).alias("sentences"))
    met = cited.join(held, ["summary_id", "source_id"], "left").groupBy("summary_id", "i").agg(
        F.count_if(F.col("words").isNull()).alias("unknown"), F.flatten(F.collect_list("words")).alias("words"), F.flatten(F.collect_list("sentences")).alias("sentences")
    )
    out = parts.join(met, ["summary_id", "i"], "left")
    inside = F.size(F.array_except("said", F.coalesce("words", F.array().cast("array<string>")))) == 0
    one = F.exists(F.coalesce("sentences", F.array().cast("array<array<string>>")), lambda s: F.size(F.array_except(F.col("said"), s)) == 0)
    good = (F.size("cited") > 0) & (F.coalesce("unknown", F.lit(0)) == 0) & (F.size("said") > 0) & inside & (~F.col("strict") | one)
    return out.groupBy("summary_id").agg(F.count(F.lit(1)).alias("segments"), F.count_if(~F.coalesce(good, F.lit(False))).alias("bad")).withColumn("grounded", F.col("bad") == 0)


def extractive(sources: DataFrame, sentences: int = 2, chars: int = 400, marker: str = "…") -> DataFrame:
    """First sentences of each source with its label: what stands in for a summary that isn't grounded."""
    lead = F.array_join(F.slice(F.split(F.trim("text"), SENTENCE), 1, sentences), " ")
    clipped = F.when(F.length(lead) > chars, F.concat(F.rtrim(F.substring(lead, F.lit(1), F.lit(chars))), F.lit(marker))).otherwise(lead)
    return sources.select("summary_id", "source_id", F.concat(clipped, F.lit(" ["), "source_id", F.lit("]")).alias("line"))


def sanitized(summaries: DataFrame, sources: DataFrame, relation: str) -> DataFrame:
    """Summaries in which no identifier of the sources is tied to something by a relation that no source sentence with it states.

    summaries: summary_id, summary; sources: summary_id, text; relation: the pattern of relation
    phrases.  Such a sentence is replaced by one that only says that the identifiers are mentioned,
    with its citations; others stay as they are.
    """
    named = lambda c: F.regexp_extract_all(c, F.lit(f"({IDENTIFIER})"))
    parts = sources.select("summary_id", F.explode(F.split("text", SENTENCE)).alias("said"))
    found = parts.select("summary_id", F.explode(named(F.col("said"))).alias("id"), F.col("said").rlike(relation).alias("told"))
    loose = found.groupBy("summary_id", "id").agg(F.bool_or("told").alias("told")).where("not told").groupBy("summary_id").agg(F.collect_set("id").alias("loose"))
    met = summaries.join(loose, "summary_id", "left").withColumn("fragments", F.split("summary", SENTENCE))

    def safe(x: Column) -> Column:
        ids = F.array_distinct(F.filter(named(x), lambda i: F.array_contains("loose", i)))
        cited = F.array_join(F.transform(F.regexp_extract_all(x, F.lit(f"({CITATION})"), F.lit(1)), lambda c: c), " ")
        said = F.concat(F.regexp_extract(x, r"^(\s*[-*•\uFFFD]\s*)", 1), F.lit("Identifier/reference mentioned: "), F.array_join(ids, ", "), F.lit("."), F.when(cited != "", F.concat(F.lit(" "), cited)).otherwise(""))
        return F.when((F.size(ids) > 0) & x.rlike(relation), said).otherwise(x)

    written = met.withColumn("safe", F.transform("fragments", safe))
    changed = F.col("loose").isNotNull() & (F.col("safe") != F.col("fragments"))
    return written.select("summary_id", F.when(changed, F.array_join("safe", "\n")).otherwise(F.col("summary")).alias("summary"), F.coalesce(changed, F.lit(False)).alias("rewritten"))
