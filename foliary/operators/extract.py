"""Checks of extracted values: coercion to a type, support by the evidence, and the outcome of a field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliary.functions.text import casefold, collapse

# Types, the date pattern, and words that speak for true and false.
KINDS = ("string", "integer", "number", "boolean", "date", "list[string]")
DATE = (
    r"(?i)(\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b|\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b|"
    r"\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s+\d{1,2}(?:,?\s+\d{4})?\b)"
)
TRUE = r"\b(true|yes|enabled|active|required|allowed|available)\b"
FALSE = r"\b(false|no|disabled|inactive|not required|unavailable|prohibited)\b"
NUMBER_EDGES = (r"^[\s€$£₹]+", r"[\s,]+$")
NUMBER = r"((?<![A-Za-z])[-+]?\d[\d,]*(?:\.\d+)?(?![A-Za-z]))"
IDENTIFIER = r"^[A-Za-z]{2,}[A-Za-z0-9]*(?:[-/][A-Za-z0-9]+)+$"


def looks_like_identifier(text: Column) -> Column:
    return F.trim(text).rlike(IDENTIFIER)


def coerce(text: Column, kind: Column) -> Column:
    """A raw value as normal text of its type, null where it doesn't fit; lists are JSON arrays of texts, none of them blank."""
    plain = F.trim(text)
    number = F.replace(F.regexp_replace(F.regexp_replace(plain, NUMBER_EDGES[0], ""), NUMBER_EDGES[1], ""), F.lit(","), F.lit(""))
    items = F.transform(F.from_json(plain, "array<string>"), lambda x: F.trim(x))
    decimal = number.cast("decimal(38,10)").cast("string")
    shown = F.regexp_replace(F.regexp_replace(decimal, "0+$", ""), r"\.$", "")
    return (
        F.when(kind == "string", F.nullif(plain, F.lit("")))
        .when(kind == "integer", F.when(plain.rlike(r"^[+-]?[0-9]+$"), plain.cast("decimal(38,0)").cast("string")))
        .when(kind == "number", F.when(number.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), shown))
        .when(kind == "boolean", F.when(F.lower(plain).isin("true", "false"), F.lower(plain)))
        .when(kind == "date", F.when(plain.rlike(DATE) & ~looks_like_identifier(plain), plain))
        .when(kind == "list[string]", F.when((F.size(items) > 0) & F.forall(items, lambda x: x.isNotNull() & (x != "")), F.to_json(items)))
    )


def supported(value: Column, kind: Column, evidence: Column) -> Column:
    """Whether a coerced value stands in the evidence."""
    seen = collapse(casefold(evidence))
    own = collapse(casefold(value))
    numbers = F.transform(F.regexp_extract_all(F.lower(evidence), F.lit(NUMBER)), lambda n: F.replace(n, F.lit(","), F.lit("")).try_cast("decimal(38,10)"))
    return F.coalesce(
        F.when(kind.isin("string", "date"), (own != "") & seen.contains(own))
        .when(kind.isin("integer", "number"), F.array_contains(numbers, value.try_cast("decimal(38,10)")))
        .when(kind == "list[string]", F.forall(F.from_json(value, "array<string>"), lambda x: (collapse(casefold(x)) != "") & seen.contains(collapse(casefold(x)))))
        .when(kind == "boolean", F.when(value == "true", F.lower(evidence).rlike(TRUE)).otherwise(F.lower(evidence).rlike(FALSE))),
        F.lit(False),
    )


def outcomes(candidates: DataFrame) -> DataFrame:
    """candidates: document_id, field, kind, value, evidence.  Per field: found (one supported value), ambiguous (several), not_found."""
    rows = candidates.withColumn("coerced", coerce(F.col("value"), F.col("kind")))
    rows = rows.withColumn("supported", F.coalesce(supported(F.col("coerced"), F.col("kind"), F.col("evidence")), F.lit(False)))
    grouped = rows.groupBy("document_id", "field").agg(F.array_sort(F.collect_set(F.when(F.col("supported"), casefold(F.col("coerced"))))).alias("keys"), F.min(F.when(F.col("supported"), F.col("coerced"))).alias("one"))
    n = F.size("keys")
    return grouped.select("document_id", "field", F.when(n == 1, "found").when(n > 1, "ambiguous").otherwise("not_found").alias("status"), F.when(n == 1, F.col("one")).alias("value"), F.when(n > 1, F.col("keys")).alias("candidates"))


def canonical_label(answer: Column, labels: Column) -> Column:
    """The caller's own spelling of a label, null where it is none of them."""
    return F.get(F.filter(labels, lambda x: casefold(F.trim(x)) == casefold(F.trim(answer))), F.lit(0))


def checked_fields(responses: DataFrame, definitions: DataFrame, evidence: DataFrame) -> DataFrame:
    """A generator's fields as far as its whole response holds: one fault anywhere, and all of a document's fields are not_found.

    responses: document_id, field, status, value, sources (labels), candidates (value and sources each).
    definitions: document_id, field, kind.  evidence: document_id, source_id, text (a prompt's worth).

    A response answers exactly the fields asked for, each once, and cites only labels there are.
    not_found has no value and no candidates; found has one value that fits its kind and stands in what it
    cites; ambiguous has two such candidates at least, that differ, and no value.
    """
    labels = evidence.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("source_id", "text"))).alias("held"))
    texts = F.array().cast("array<string>")
    none = F.array().cast("array<struct<value:string,sources:array<string>>>")
    given = responses.select("document_id", "field", "status", "value", F.coalesce("sources", texts).alias("sources"), F.coalesce("candidates", none).alias("candidates"), F.lit(True).alias("given"))
    asked = definitions.select("document_id", "field", "kind", F.lit(True).alias("asked"))
    met = asked.join(given, ["document_id", "field"], "full_outer").join(labels, "document_id", "left")
    known = lambda xs: F.forall(xs, lambda x: F.coalesce(F.map_contains_key("held", x), F.lit(False)))
    holds = lambda v, xs: (F.size(xs) > 0) & known(xs) & supported(coerce(v, F.col("kind")), F.col("kind"), F.array_join(F.transform(xs, lambda x: F.try_element_at("held", x)), "\n"))
    empty = F.size("candidates") == 0
    keys = F.array_distinct(F.transform("candidates", lambda c: casefold(coerce(c["value"], F.col("kind")))))
    fits = (
        F.when(F.col("status") == "not_found", F.col("value").isNull() & empty)
        .when(F.col("status") == "found", F.col("value").isNotNull() & empty & holds(F.col("value"), F.col("sources")))
        .when(F.col("status") == "ambiguous", F.col("value").isNull() & F.forall("candidates", lambda c: holds(c["value"], c["sources"])) & (F.size(keys) >= 2))
    )
    good = F.coalesce(F.col("given") & F.col("asked") & known(F.col("sources")) & fits, F.lit(False))
    whole = Window.partitionBy("document_id")
    once = F.count(F.lit(1)).over(Window.partitionBy("document_id", "field")) == 1
    rows = met.withColumn("good", good & once).withColumn("sound", F.bool_and("good").over(whole)).where("asked").dropDuplicates(["document_id", "field"])
    said = lambda c: F.col("sound") & (F.col("status") == c)
    status = F.when(F.col("sound"), F.col("status")).otherwise("not_found")
    return rows.select("document_id", "field", status.alias("status"), F.when(said("found"), coerce(F.col("value"), F.col("kind"))).alias("value"), F.when(said("found"), F.array_distinct("sources")).otherwise(texts).alias("sources"), F.when(said("ambiguous"), keys).otherwise(texts).alias("candidates"))
