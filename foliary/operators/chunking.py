"""Structure-aware chunks of documents.

Headings close what was collected and become the context of what follows; lists and paragraphs are
collected up to a target length, tables stand alone.  The collecting is a state machine over a
document's units in reading order, so documents are streamed through it, sorted, a partition at a time; units, headings and
table texts are built with column expressions before it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliary.functions.text import collapse

TARGET, MAX, OVERLAP = 1200, 1800, 150
#: units whose chunks a task holds before they leave it
UNITS = 128
SCHEMA = "document_id string, sequence_number int, text string, start_page int, end_page int, section_heading string, content_type string, contains_ocr boolean, character_count int, token_count int, fingerprint_sha256 string"
_SENTENCE_END = re.compile(r"[.!?](?:\s|$)")


@dataclass(frozen=True)
class Limits:
    target: int = TARGET
    most: int = MAX
    overlap: int = OVERLAP
    hard_split: bool = False  # cut an unbroken run at the limit instead of after its first character

    def __post_init__(self) -> None:
        if not 0 < self.target <= self.most or not 0 <= self.overlap < self.most:
            raise ValueError("target must be at most the maximum, and the overlap below it")


@dataclass(frozen=True)
class Unit:
    text: str
    page: int
    heading: str | None
    kind: str
    ocr: bool


def split_long(text: str, limits: Limits) -> list[str]:
    """Pieces of at most the maximum: at the last sentence end that fits, else the last blank, else after one character."""
    out = []
    while len(text) > limits.most:
        head = text[: limits.most + 1]
        ends = [m.end() for m in _SENTENCE_END.finditer(head)]
        cut = max(1, (ends[-1] - 1) if ends else head.rfind(" "))
        if limits.hard_split and not ends and " " not in head:
            cut = limits.most
        piece, text = text[:cut].rstrip(), text[cut:].lstrip()
        if piece:
            out.append(piece)
        else:
            out.append(text[: limits.most])
            text = text[limits.most :].lstrip()
    return [*out, text] if text else out


def tail_of(text: str, limits: Limits) -> str:
    """The end of a chunk that the next one repeats, from a word's begin."""
    if not limits.overlap or len(text) <= limits.overlap:
        return ""
    tail = text[-limits.overlap :]
    return tail.split(" ", 1)[-1]


@dataclass
class Collector:
    """Units since the last border."""

    limits: Limits
    done: list[tuple[str, list[Unit]]] = field(default_factory=list)
    text: str = ""
    units: list[Unit] = field(default_factory=list)
    only_tail: bool = False

    def take(self, unit: Unit) -> None:
        if not self.text:
            self.text, self.units, self.only_tail = unit.text, [unit], False
            return
        joined = len(self.text) + 1 + len(unit.text)
        if joined > self.limits.most or (len(self.text) >= self.limits.target and joined > self.limits.target):
            self.done.append((self.text, self.units))
            tail = tail_of(self.text, self.limits)
            if tail and len(tail) + 1 + len(unit.text) <= self.limits.most:
                self.text, self.units = f"{tail} {unit.text}", [self.units[-1], unit]
            else:
                self.text, self.units = unit.text, [unit]
        else:
            self.text, self.units = f"{self.text} {unit.text}", [*self.units, unit]

    def close(self) -> None:
        if self.text:
            self.done.append((self.text, self.units))
        self.text, self.units = "", []


def assemble(units: list[Unit | None], limits: Limits) -> list[tuple[str, list[Unit]]]:
    """Chunks of units in reading order; None is a border, and a table is one on both sides."""
    c = Collector(limits)
    for unit in units:
        if unit is None or unit.kind == "table":
            c.close()
        if unit is not None:
            for piece in split_long(unit.text, limits):
                c.take(Unit(piece, unit.page, unit.heading, unit.kind, unit.ocr))
            if unit.kind == "table":
                c.close()
    c.close()
    return c.done


def content_type(kinds: set[str]) -> str:
    if len(kinds) > 1:
        return "mixed"
    kind = next(iter(kinds))
    return kind if kind in ("table", "list") else "text"


def drafted(document, number: int, text: str, units: list[Unit]) -> tuple:
    text = " ".join(text.split())
    first, last = min(u.page for u in units), max(u.page for u in units)
    heading = next((u.heading for u in units if u.heading), None)
    kind = content_type({u.kind for u in units})
    mark = hashlib.sha256("\n".join([text, str(first), str(last), heading or "", kind]).encode()).hexdigest()
    return (document, number, text, first, last, heading, kind, any(u.ocr for u in units), len(text), len(text.split()), mark)


def table_text(headers: Column, rows: Column) -> Column:
    """A table's cells, blank ones left out, a line for each row."""
    line = lambda cells: F.array_join(F.filter(F.transform(cells, lambda c: collapse(F.coalesce(c, F.lit("")))), lambda c: c != ""), " | ")
    lines = F.concat(F.array(line(headers)), F.transform(rows, line))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def units_of(pages: DataFrame, elements: DataFrame | None = None, tables: DataFrame | None = None) -> DataFrame:
    """Units in reading order: document_id, page_number, place, kind (text, list, table, heading), text, heading, ocr.

    pages: document_id, page_number, text, ocr.  elements: document_id, page_number, sequence_order,
    element_type, text.  tables: document_id, page_number, table_index, headers, rows.  A page's own
    text counts only where it has no text elements, and no elements or no tables.
    """
    key = ["document_id", "page_number"]
    base = pages.select(*key, collapse(F.coalesce("text", F.lit(""))).alias("page_text"), F.coalesce("ocr", F.lit(False)).alias("ocr"))
    none = F.lit(None).cast("boolean")
    if elements is not None:
        e = elements.withColumn("text", collapse(F.coalesce("text", F.lit(""))))
        state = e.groupBy(*key).agg(F.lit(True).alias("any_element"), F.max((F.col("text") != "") & (F.col("element_type") != "table")).alias("text_element"))
        base = base.join(state, key, "left")
    else:
        base = base.withColumn("any_element", none).withColumn("text_element", none)
    if tables is not None:
        base = base.join(tables.select(*key).distinct().withColumn("any_table", F.lit(True)), key, "left")
    else:
        base = base.withColumn("any_table", none)
    flag = lambda c: F.coalesce(c, F.lit(False))
    own = ~flag(F.col("text_element")) & (~flag(F.col("any_element")) | ~flag(F.col("any_table"))) & (F.col("page_text") != "")
    shape = lambda df, order, place, kind, text: df.select(*key, F.lit(order).alias("layer"), place.cast("int").alias("place"), kind.alias("kind"), text.alias("text"), "ocr")
    out = shape(base.where(own), 0, F.lit(0), F.lit("text"), F.col("page_text"))
    if elements is not None:
        kind = F.when(F.col("element_type") == "heading", "heading").when(F.col("element_type") == "list_item", "list").otherwise("text")
        kept = e.where("text <> '' and element_type <> 'table'").join(base.select(*key, "ocr"), key)
        out = out.unionByName(shape(kept, 0, F.col("sequence_order"), kind, F.col("text")))
    if tables is not None:
        cells = tables.withColumn("text", table_text(F.col("headers"), F.col("rows"))).where("text <> ''").join(base.select(*key, "ocr"), key)
        out = out.unionByName(shape(cells, 1, F.col("table_index"), F.lit("table"), F.col("text")))
    order = Window.partitionBy("document_id").orderBy("page_number", "layer", "place").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("heading", F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(order))


def chunk_units(units: DataFrame, limits: Limits | None = None) -> DataFrame:
    limits = limits or Limits()

    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def finish(document: str, found: list[Unit | None]) -> list[tuple]:
        return [drafted(document, i, t, u) for i, (t, u) in enumerate(assemble(found, limits), 1)]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, found = None, []
        for whole in batches:
            for start in range(0, len(whole), UNITS):
                out = []
                for r in whole.iloc[start : start + UNITS].itertuples(index=False):
                    if r.document_id != now:
                        if found:
                            out += finish(now, found)
                        now, found = r.document_id, []
                    found.append(None if r.kind == "heading" else Unit(r.text, int(r.page_number), r.heading if isinstance(r.heading, str) else None, r.kind, bool(r.ocr)))
                yield pd.DataFrame(out, columns=names)
        if found:
            yield pd.DataFrame(finish(now, found), columns=names)

    own = units.select(F.col("document_id").cast("string").alias("document_id"), "page_number", "layer", "place", "kind", "text", "heading", "ocr")
    ordered = own.repartition("document_id").sortWithinPartitions("document_id", "page_number", "layer", "place")
    return ordered.mapInPandas(stream, SCHEMA)


def chunk_pages(pages: DataFrame, elements: DataFrame | None = None, tables: DataFrame | None = None, limits: Limits | None = None) -> DataFrame:
    """Chunks of documents, numbered from 1, with pages, heading, kind, counts and fingerprint."""
    return chunk_units(units_of(pages, elements, tables), limits)
