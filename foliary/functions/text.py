"""Text functions as column expressions; only what Spark lacks (NFKC, sequence similarity) is a pandas UDF."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as P

WORD = r"(?U)\w+(?:[-']\w+)?"
TERM = r"[\p{L}\p{N}]+"


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def casefold(text: Column) -> Column:
    """Small letters, with the one fold that ``lower`` lacks in everyday text."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normal_key(text: Column) -> Column:
    """What two texts are compared by, apart from case and white space."""
    return collapse(casefold(text))


def words(text: Column) -> Column:
    """Small-lettered words, with inner hyphen or apostrophe."""
    return F.regexp_extract_all(casefold(text), F.lit(f"({WORD})"))


def terms(text: Column) -> Column:
    """Runs of letters and digits in small letters: what the index holds."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"))


@F.pandas_udf(P.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility-composed text with white space collapsed; null stays null."""
    return text.map(lambda s: None if s is None else " ".join(unicodedata.normalize("NFKC", s).split()))


@F.pandas_udf(P.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two texts by longest matching blocks, rounded to 6 places."""
    return pd.Series([None if x is None or y is None else round(difflib.SequenceMatcher(None, x, y).ratio(), 6) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(P.LongType())
def word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edits between two lists of words."""

    def distance(x, y) -> int | None:
        if x is None or y is None:
            return None
        row = list(range(len(y) + 1))
        for i, u in enumerate(x, 1):
            left, row[0] = row[0], i
            for j, v in enumerate(y, 1):
                left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (u != v))
        return row[-1]

    return pd.Series([distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


#: product of lengths up to which the JVM's edit distance, which fills a whole table, is the faster one
SMALL_TABLE = 1 << 18


def edit_distance(a: str, b: str) -> int:
    """Edits between two texts; a whole column of the table is one number, a bit for each character.

    Bit 0 is the row above the longer text, where each step to the right adds one.  What is shifted beyond
    the text never comes back, so it is cut off only now and then.  Work is the length of one text times
    the other's in machine words, so texts of 100,000 characters take seconds.
    """
    if len(a) < len(b):
        a, b = b, a
    if a == b or not b:
        return len(a) - len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a, 1):
        at[c] = at.get(c, 0) | 1 << i
    every = (2 << len(a)) - 1
    inner = every - 1
    up, down = inner, 0
    for start in range(0, len(b), 256):
        for c in b[start : start + 256]:
            same = at.get(c, 0)
            across = (((same & up) + up) ^ up) | same | down
            less = up & across
            more = (down | (every ^ (across | up))) << 1
            up = less << 1 | (inner ^ (across | more))
            down = more & across
        up, down = up & inner, down & inner
    return len(b) + up.bit_count() - down.bit_count()


@F.pandas_udf(P.LongType())
def _long_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edit_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


def edits(a: Column, b: Column) -> Column:
    """Edits between two texts of any length; null where one is null."""
    small = F.length(a).cast("long") * F.length(b) <= SMALL_TABLE
    return F.when(small, F.levenshtein(F.when(small, a), F.when(small, b)).cast("long")).otherwise(_long_distance(F.when(~small, a), F.when(~small, b)))


@F.pandas_udf(P.ArrayType(P.LongType()))
def edits_within(answers: pd.Series, text: pd.Series, share: pd.Series) -> pd.Series:
    """Edits between each of some texts and another; null where their lengths alone differ by that share of the longer one, or one is null."""

    def distance(x: str | None, y: str | None, least: float) -> int | None:
        if x is None or y is None or (x != y and abs(len(x) - len(y)) >= least * max(len(x), len(y))):
            return None
        return edit_distance(x, y)

    return pd.Series([None if xs is None else [distance(x, y, least) for x in xs] for xs, y, least in zip(answers, text, share, strict=True)], dtype="object")


def token_overlap(a: Column, b: Column) -> Column:
    """Share of the smaller set of words that both have; 0 if one has none."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(F.lit(0.0))


def page_label(start: Column, end: Column) -> Column:
    return F.when(start.isNull(), F.lit("(unavailable)")).when(end.isNull() | (end == start), start.cast("string")).otherwise(F.concat_ws("-", start.cast("string"), end.cast("string")))


def stable_id(prefix: str, *parts: Column, separator: str = "\0", digits: int = 20) -> Column:
    """``prefix-`` and the first digits of a SHA-256 over the parts."""
    joined = F.concat_ws(separator, *(p.cast("string") for p in parts))
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(joined, 256), 1, digits))


def spans(text: Column, pattern: str) -> Column:
    """All matches of a pattern with their places: array of (start, end, matched), code points, ends exclusive.

    What lies between the matches comes from ``split``; running lengths of both give the places.
    """
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    lengths = F.transform(found, lambda m: F.length(m))

    def place(m: Column, i: Column) -> Column:
        before = lambda xs, n: F.aggregate(F.slice(xs, F.lit(1), n), F.lit(0), lambda a, x: a + x)
        start = before(gaps, i + 1) + before(lengths, i)
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("matched"))

    return F.transform(found, place)
