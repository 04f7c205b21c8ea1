"""Personal data of high confidence: e-mail addresses, phone numbers, IBANs and payment cards.

Patterns and checksums are column expressions.  Places count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliary.functions.text import casefold, normal_key, spans, stable_id

# Kinds in their order, the patterns, and IBAN lengths by country.
KINDS = ("EMAIL", "PHONE_NUMBER", "IBAN", "CREDIT_CARD")
PATTERNS = {
    "EMAIL": r"(?U)(?<![\w.+-])[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+(?![\w.-])",
    "PHONE_NUMBER": r"(?U)(?<![\w])(?:\+\d{1,3}[ .-]?)?\(?\d{3}\)?[ .-]\d{3,4}[ .-]\d{3,4}(?![\w])",
    "IBAN": r"(?<![A-Za-z0-9])[A-Za-z]{2}[ -]?\d{2}(?:[ -]?[A-Za-z0-9]){10,34}(?![A-Za-z0-9])",
    "CREDIT_CARD": r"(?U)(?<![\w])(?:\d[ -]?){13,19}(?![\w])",
}
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def iban_valid(text: Column) -> Column:
    """Length of the country and remainder 1 modulo 97, taken digit by digit."""
    plain = F.upper(F.regexp_replace(text, "[ -]", ""))
    length = F.create_map(*(x for c, n in IBAN_LENGTHS.items() for x in (F.lit(c), F.lit(n))))[F.left(plain, F.lit(2))]
    turned = F.concat(F.substring(plain, 5, 64), F.left(plain, F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        letter = code >= 65
        return F.when(letter, (rest * 100 + (code - 55)) % 97).otherwise((rest * 10 + (code - 48)) % 97)

    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(step(r, c)))
    return F.coalesce((F.length(plain) == length) & plain.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$") & (rest == 1), F.lit(False))


def card_valid(text: Column) -> Column:
    plain = F.regexp_replace(text, "[ -]", "")
    return F.length(plain).between(13, 19) & F.call_function("luhn_check", plain)


def _valid(kind: str, m: Column) -> Column:
    if kind == "PHONE_NUMBER":
        return F.length(digits_of(m)).between(10, 15)
    if kind == "IBAN":
        return iban_valid(m)
    if kind == "CREDIT_CARD":
        return card_valid(m)
    return F.lit(True)


def _of_kind(text: Column, kind: str) -> Column:
    own = F.filter(spans(text, PATTERNS[kind]), lambda s: _valid(kind, s["matched"]))

    def shown(s: Column) -> Column:
        # blanks behind a card's number don't belong to it
        matched = F.trim(s["matched"]) if kind == "CREDIT_CARD" else s["matched"]
        return F.struct(s["start"].cast("int").alias("start"), (s["start"] + F.length(matched)).cast("int").alias("end"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), matched.alias("matched"))

    return F.transform(own, shown)


def detections(text: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """array of (start, end, kind, matched), by place, then kind."""
    found = [_of_kind(text, kind) for kind in kinds]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*found))))


def check_kinds(kinds: tuple[str, ...]) -> None:
    bad = set(kinds) - set(KINDS)
    if bad:
        raise ValueError(f"unknown kinds: {sorted(bad)}")


def detect_pii(texts: DataFrame, kinds: tuple[str, ...] = KINDS, document: str = "document_id", page: str = "page_number", text: str = "text") -> DataFrame:
    """One row for each detection, with an id that depends on document, page, place and text.

    Texts without an at sign, and without a run of digits, are left out before the patterns run.
    """
    check_kinds(kinds)
    likely = F.col(text).contains("@") | F.col(text).rlike("[0-9][0-9 ().-]*[0-9]")
    rows = texts.where(likely).select(F.col(document).alias("document_id"), F.col(page).alias("page_number"), F.explode(detections(F.col(text), kinds)).alias("d"))
    out = rows.select("document_id", "page_number", F.col("d.kind").alias("pii_type"), F.col("d.start").alias("start_offset"), F.col("d.end").alias("end_offset"), F.col("d.matched").alias("matched_text"))
    return out.withColumn("detection_id", stable_id("pii", F.col("document_id"), F.col("page_number"), F.col("pii_type"), F.col("start_offset"), F.col("end_offset"), casefold(F.col("matched_text")), separator=":", digits=24))


def counts_by_type(found: DataFrame, by: str = "document_id") -> DataFrame:
    """Counts of each kind, zero where there is none."""
    return found.groupBy(by).agg(*(F.count_if(F.col("pii_type") == k).alias(k.lower()) for k in KINDS))


def redacted(text: Column, found: Column, mark: str = "[REDACTED]") -> Column:
    """The text with spans (start, end), which may overlap, replaced."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, d: Column) -> Column:
        fresh = d["start"] >= s["at"]
        piece = F.concat(s["out"], F.substring(text, s["at"] + 1, d["start"] - s["at"]), F.lit(mark))
        return F.struct(F.when(fresh, piece).otherwise(s["out"]).alias("out"), F.greatest(s["at"], d["end"]).alias("at"))

    return F.aggregate(F.array_sort(found), state, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def redact_text(texts: DataFrame, found: DataFrame, selected: DataFrame | None = None, document: str = "document_id", page: str = "page_number", text: str = "text") -> DataFrame:
    """Texts without the selected detections (default: all), and whether none of those is left in them.

    ``selected`` (detection_id) must name detections that are still found; ``unknown_ids`` gives the others.
    """
    if selected is not None:
        found = found.join(selected.select("detection_id").distinct(), "detection_id", "left_semi")
    grouped = found.groupBy("document_id", "page_number").agg(F.collect_list(F.struct(F.col("start_offset").alias("start"), F.col("end_offset").alias("end"), F.col("matched_text").alias("matched"))).alias("spans"))
    base = texts.select(F.col(document).alias("document_id"), F.col(page).alias("page_number"), F.col(text).alias("text"))
    out = base.join(grouped, ["document_id", "page_number"], "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int,matched:string>>")))
    out = out.withColumn("redacted_text", redacted(F.col("text"), F.col("spans")))
    left = F.exists(detections(F.col("redacted_text")), lambda d: F.exists("spans", lambda s: (s["matched"] == d["matched"])))
    return out.select("document_id", "page_number", "redacted_text", F.size("spans").alias("redactions"), (~left).alias("verified"))


def redact_pages(texts: DataFrame, kinds: tuple[str, ...] = KINDS, document: str = "document_id", page: str = "page_number", text: str = "text") -> DataFrame:
    """As ``redact_text`` with all detections of some kinds; they are found in the row itself, so nothing is shuffled."""
    check_kinds(kinds)
    spans = F.transform(detections(F.col("text"), kinds), lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), d["matched"].alias("matched")))
    base = texts.select(F.col(document).alias("document_id"), F.col(page).alias("page_number"), F.col(text).alias("text")).withColumn("spans", F.coalesce(spans, F.array().cast("array<struct<start:int,end:int,matched:string>>")))
    out = base.withColumn("redacted_text", redacted(F.col("text"), F.col("spans")))
    left = F.exists(detections(F.col("redacted_text"), kinds), lambda d: F.exists("spans", lambda s: s["matched"] == d["matched"]))
    return out.select("document_id", "page_number", "redacted_text", F.size("spans").alias("redactions"), (~left).alias("verified"))


def unknown_ids(found: DataFrame, selected: DataFrame) -> DataFrame:
    return selected.select("detection_id").distinct().join(found, "detection_id", "left_anti")


def word_boxes(words: DataFrame, found: DataFrame, most: int = 10) -> DataFrame:
    """Box around the first run of up to ``most`` words of a page that spells a detection, apart from case and white space.

    words: document_id, page_number, word_index, word, x0, y0, x1, y1; blank words don't count.
    found: detection_id, document_id, page_number, matched_text.  A detection that no run spells has no row.

    Both sides become numbered tokens and meet on their page; equal tokens of a detection that fall on
    one begin, all of them, are a run, and it counts where it begins and ends with whole words.
    """
    page = ["document_id", "page_number"]
    parts = lambda c: F.filter(F.split(normal_key(F.col(c)), " "), lambda t: t != "")
    tokens = words.select(*page, "word_index", "x0", "y0", "x1", "y1", F.size(parts("word")).alias("n"), F.posexplode(parts("word")).alias("i", "token"))
    by_page = Window.partitionBy(*page).orderBy("word_index", "i")
    placed = tokens.withColumn("at", F.row_number().over(by_page)).withColumn("word_number", F.sum(F.when(F.col("i") == 0, 1).otherwise(0)).over(by_page.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    asked = found.select("detection_id", *page, F.size(parts("matched_text")).alias("needed"), F.posexplode(parts("matched_text")).alias("j", "token"))
    # a page's tokens asked for come to its words as one list, so the words stay where they were numbered
    by_name = asked.groupBy(*page).agg(F.collect_list(F.struct("token", "detection_id", "needed", "j")).alias("asked"))
    met = placed.join(by_name, page).select("*", F.inline(F.transform(F.filter("asked", lambda a: a["token"] == F.col("token")), lambda a: F.struct(a["detection_id"].alias("detection_id"), a["needed"].alias("needed"), a["j"].alias("j")))))
    met = met.drop("asked").withColumn("begin", F.col("at") - F.col("j"))
    whole = F.bool_and(((F.col("j") > 0) | (F.col("i") == 0)) & ((F.col("j") < F.col("needed") - 1) | (F.col("i") == F.col("n") - 1)))
    run = met.groupBy("detection_id", *page, "needed", "begin").agg(
        F.count(F.lit(1)).alias("met"), whole.alias("whole"), (F.max("word_number") - F.min("word_number") + 1).alias("words"), *(f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1")))
    )
    fits = run.where((F.col("met") == F.col("needed")) & F.col("whole") & (F.col("words") <= most))
    first = fits.groupBy("detection_id").agg(F.min_by(F.struct("x0", "y0", "x1", "y1"), "begin").alias("box"))
    return first.select("detection_id", "box.*")
