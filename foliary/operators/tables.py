"""Queries over one table: select, filter, min, max, sum, average, count, sort and top-n.

A plan is checked against the table's columns, then becomes DataFrame operations; Catalyst does
the rest.  Cells may be texts (numbers are then recognised in them) or of any Spark type.  Rows
have a number (``row_index``, from 1), which breaks ties and says where results come from.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, fields, replace
from decimal import Context, Decimal, localcontext
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliary.functions.text import casefold
from foliary.sources.connectors import repair_prompt

OPERATIONS = ("select", "filter", "min", "max", "sum", "average", "count", "sort", "top_n")
COMPARISONS = ("eq", "neq", "gt", "gte", "lt", "lte")
NUMBER = "decimal(38,10)"
ROW = "row_index"
MOST_COLUMNS, MOST_ROWS = 50, 100


class TableQueryError(ValueError):
    """A plan that doesn't fit the table."""


@dataclass(frozen=True)
class TableQueryPlan:
    operation: str
    target_column: str | None = None
    return_columns: tuple[str, ...] = ()
    filter_column: str | None = None
    filter_operator: str | None = None
    filter_value: str | None = None
    sort_direction: str = "desc"
    limit: int = 10

    def __post_init__(self) -> None:
        seen, kept = set(), []
        for c in self.return_columns:
            if c.strip().casefold() not in seen:
                seen.add(c.strip().casefold())
                kept.append(c)
        object.__setattr__(self, "return_columns", tuple(kept))
        if self.operation not in OPERATIONS:
            raise TableQueryError(f"unknown operation {self.operation!r}")
        if len(kept) > MOST_COLUMNS:
            raise TableQueryError(f"more than {MOST_COLUMNS} columns")
        if self.sort_direction not in ("asc", "desc"):
            raise TableQueryError(f"unknown direction {self.sort_direction!r}")
        if not 1 <= self.limit <= MOST_ROWS:
            raise TableQueryError(f"the limit must be 1 to {MOST_ROWS}")
        filtering = (self.filter_column, self.filter_operator, self.filter_value)
        if self.operation == "filter":
            if None in filtering:
                raise TableQueryError("a filter needs a column, an operator and a value")
            if self.filter_operator not in COMPARISONS:
                raise TableQueryError(f"unknown comparison {self.filter_operator!r}")
        elif any(x is not None for x in filtering):
            raise TableQueryError("only a filter has filter fields")
        if self.operation in ("min", "max", "sum", "average", "sort", "top_n") and not self.target_column:
            raise TableQueryError(f"{self.operation} needs a target column")


def number(cell: Column) -> Column:
    """A cell as a number: leading currency signs and all commas go, then digits with a sign and fraction; else null."""
    text = F.regexp_replace(cell.cast("string"), r"(?U)^\s+|\s+$", "")
    clean = F.regexp_replace(F.regexp_replace(text, r"^[\s€$£₹]+", ""), ",", "")
    return F.when(clean.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), clean.cast(NUMBER))


def with_rows(df: DataFrame, order: list[Column | str] | None = None) -> DataFrame:
    """Adds row numbers in a given order, for tables that have none.

    The numbering needs one order over the whole table; extracted tables are small, and large ones
    should bring a key of their own as ``row_index``.
    """
    return df if ROW in df.columns else df.withColumn(ROW, F.row_number().over(Window.orderBy(*(order or df.columns))))


def from_cells(headers: list[str], rows: DataFrame, cells: str = "cells") -> DataFrame:
    """An extracted table's rows (``row_index``, ``cells``: texts) by header; a missing cell is empty."""
    return rows.select(ROW, *(F.coalesce(F.get(cells, F.lit(i)), F.lit("")).alias(h) for i, h in enumerate(headers)))


def resolve(name: str, columns: list[str]) -> str:
    """A column by its name, apart from case and outer blanks."""
    by = {}
    for c in columns:
        key = c.strip().casefold()
        if not key or key in by:
            raise TableQueryError("headers must be non-empty and unique")
        by[key] = c
    if name.strip().casefold() not in by:
        raise TableQueryError(f"no column {name!r}; there are: {', '.join(columns)}")
    return by[name.strip().casefold()]


def resolved(plan: TableQueryPlan, columns: list[str]) -> TableQueryPlan:
    """The plan with the table's own column names and default return columns."""
    own = [c for c in columns if c != ROW]
    name = lambda c: None if c is None else resolve(c, own)
    target = name(plan.target_column)
    kept = tuple(name(c) for c in plan.return_columns)
    if not kept:
        kept = tuple(dict.fromkeys([own[0], target])) if plan.operation in ("min", "max", "sort", "top_n") else tuple(own)
    return replace(plan, target_column=target, return_columns=kept, filter_column=name(plan.filter_column))


def _cell(df: DataFrame, column: str) -> Column:
    return F.col(f"`{column}`")


def _is_text(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.simpleString() == "string"


def _number(df: DataFrame, column: str) -> Column:
    return number(_cell(df, column)) if _is_text(df, column) else _cell(df, column).cast(NUMBER)


def comparison(df: DataFrame, plan: TableQueryPlan) -> Column:
    """Numbers where both sides are, else small-lettered texts; order comparisons are for numbers only."""
    cell, value = F.coalesce(_cell(df, plan.filter_column).cast("string"), F.lit("")), F.lit(plan.filter_value)
    x, y = _number(df, plan.filter_column), number(value)
    both = x.isNotNull() & y.isNotNull()
    equal = F.when(both, x == y).otherwise(casefold(F.trim(cell)) == casefold(F.trim(value)))
    ordered = {"gt": x > y, "gte": x >= y, "lt": x < y, "lte": x <= y}
    if plan.filter_operator == "eq":
        return equal
    if plan.filter_operator == "neq":
        return ~equal
    return F.coalesce(both & ordered[plan.filter_operator], F.lit(False))


def check_numeric(df: DataFrame, column: str) -> None:
    """Raises where a text column holds a cell that is no number (one aggregate over the table)."""
    if _is_text(df, column) and df.where(_number(df, column).isNull()).limit(1).count():
        raise TableQueryError(f"column {column!r} isn't numeric")


def guard_rows(df: DataFrame, most: int | None) -> None:
    if most is not None and df.limit(most + 1).count() > most:
        raise TableQueryError(f"the table has more than {most} rows")


def run(df: DataFrame, plan: TableQueryPlan, max_rows: int | None = None, check: bool = True) -> DataFrame:
    """The plan's rows (``row_index`` and return columns), or for sum, average and count one row: value, row_count.

    The sum and average of texts are texts of up to 28 digits, of numbers decimals.

    ``check`` looks for cells that are no numbers before numeric operations; leave it out for typed tables.
    """
    plan = resolved(plan, df.columns)
    guard_rows(df, max_rows)
    op, target = plan.operation, plan.target_column
    if check and (op in ("min", "max", "sum", "average") or (op == "filter" and plan.filter_operator not in ("eq", "neq"))):
        check_numeric(df, target or plan.filter_column)
    kept = [ROW, *(f"`{c}`" for c in plan.return_columns)]
    if op == "count":
        return df.agg(F.count(F.lit(1)).alias("value"), F.count(F.lit(1)).alias("row_count"))
    if op in ("sum", "average") and _is_text(df, target):
        return exact_totals(df, target).select(F.col(op).alias("value"), "row_count")
    if op in ("sum", "average"):
        x = _number(df, target)
        total = F.sum(x.cast("decimal(38,10)"))
        value = total if op == "sum" else F.try_divide(total, F.count(x))
        return df.agg(value.alias("value"), F.count(F.lit(1)).alias("row_count"))
    if op == "select":
        return df.orderBy(ROW).limit(plan.limit).select(*kept)
    if op == "filter":
        return df.where(comparison(df, plan)).select(*kept)
    if op in ("min", "max"):
        x = _number(df, target)
        best = df.agg((F.min if op == "min" else F.max)(x).alias("__best"))  # one row
        return df.join(F.broadcast(best), x == F.col("__best")).select(*kept)
    numeric = not _is_text(df, target) or not df.where(_number(df, target).isNull()).limit(1).count()
    key = _number(df, target) if numeric else casefold(F.coalesce(_cell(df, target), F.lit("")))
    ordered = df.orderBy(key.asc() if plan.sort_direction == "asc" else key.desc(), F.col(ROW).asc())
    return (ordered.limit(plan.limit) if op == "top_n" else ordered).select(*kept)


def shown(value: Column) -> Column:
    """A decimal as text, without trailing zeros."""
    text = value.cast("string")
    return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)


# Words that name an operation, in the order in which they are tried, column aliases,
# words for rows, and the sentences of answers.
PHRASES = (
    ("max", ("highest", "maximum", "max", "largest", "greatest")),
    ("min", ("lowest", "minimum", "min", "smallest", "least")),
    ("average", ("average", "mean")),
    ("sum", ("total", "sum")),
    ("count", ("how many", "count")),
)
ALIASES = {"qty": {"quantity", "quantities", "units", "unit"}, "no": {"number", "count"}}
NOUNS = ("product", "record", "row")
SENTENCES = {
    "count": "There {are} {value} {noun} in the table. [T1]",
    "number": "The {operation} of {column} is {value}. [T1]",
    "extreme": "{label} has the {most} {column} at {value}. [T1]",
    "filter": "{n} rows match the requested filter. [T1]",
    "rows": "The table query returned {n} rows. [T1]",
}

_RULES = tuple((operation, re.compile("|".join(phrases))) for operation, phrases in PHRASES)
_AROUND = re.compile(r"^\s*(?:of\s+)?|(?:\s+column)?(?:\s+(?:in|from)\s+the\s+table)?\s*$")


def _hints(text: str) -> set[str]:
    return set(re.findall(r"[a-z0-9]+", text.casefold()))


def plan_from_question(question: str, headers: list[str]) -> TableQueryPlan | None:
    """A plan for a plainly worded question, or None; raises where it asks for a column there isn't.

    The first rule of ``PHRASES`` that occurs gives the operation, a header (but the first, which
    names rows) that shares a word with the question the column; what stands behind the rule's words
    is the column asked for, where there is none.
    """
    asked = question.casefold()
    for operation, rule in _RULES:
        if not (said := rule.search(asked)):
            continue
        if operation == "count":
            return TableQueryPlan(operation)
        wanted = _hints(asked)
        for header in headers[1:]:
            if wanted & (_hints(header) | ALIASES.get(header.casefold(), set())):
                return TableQueryPlan(operation, header, tuple(dict.fromkeys((headers[0], header))))
        missing = _AROUND.sub("", asked[said.end() :].partition("?")[0])
        if missing:
            raise TableQueryError(f"no column for {missing!r}; there are: {', '.join(headers)}")
        return None
    return None


def plan_from_json(text: str, headers: list[str]) -> TableQueryPlan:
    """A plan from a JSON object with the fields of a plan, checked against the table's headers."""
    try:
        given = json.loads(text)
    except (TypeError, ValueError) as error:
        raise TableQueryError("a plan must be JSON") from error
    names = {f.name for f in fields(TableQueryPlan)}
    if not isinstance(given, dict) or not given.keys() <= names:
        raise TableQueryError(f"a plan is an object with the fields {', '.join(sorted(names))}")
    kept = {k: v for k, v in given.items() if v is not None}
    kept["return_columns"] = tuple(str(c) for c in kept.get("return_columns", ()))
    if "filter_value" in kept:
        kept["filter_value"] = str(kept["filter_value"])
    try:
        plan = TableQueryPlan(**kept)
    except (TypeError, AttributeError) as error:
        raise TableQueryError("a plan lacks its operation, or a field has another type") from error
    resolved(plan, headers)
    return plan


def plan_for(question: str, headers: list[str], generate: Callable[[str], str] | None = None) -> TableQueryPlan:
    """The plan of a question: by rule where a rule fits, else as ``generate`` words it in JSON, with one repair."""
    plan = plan_from_question(question, headers)
    if plan is not None:
        return plan
    if generate is None:
        raise TableQueryError("no rule fits the question")
    prompt = f"Question: {question}\nColumns: {json.dumps(headers, ensure_ascii=False)}\nReturn one JSON object with the fields {', '.join(f.name for f in fields(TableQueryPlan))}."
    answer = generate(prompt)
    try:
        return plan_from_json(answer, headers)
    except TableQueryError as fault:
        return plan_from_json(generate(repair_prompt(prompt, str(answer), str(fault))), headers)


def _facts(plan: TableQueryPlan, result: DataFrame, question: str) -> tuple[str, dict]:
    """Which sentence a result makes, and what stands in it."""
    op, column = plan.operation, plan.target_column
    if op in ("sum", "average", "count"):
        value = result.select(shown(F.col("value"))).first()[0]
        said = _hints(question)
        noun = next((n for n in NOUNS if said & {n, f"{n}s"}), NOUNS[-1])
        one = value == "1"
        return ("count" if op == "count" else "number"), {"value": value, "operation": op, "column": column, "noun": noun if one else f"{noun}s", "are": "is" if one else "are"}
    if op in ("min", "max"):
        best = result.orderBy(ROW).first()
        if best is not None:
            label = [c for c in plan.return_columns if c != column] or [column]
            return "extreme", {"label": best[label[0]], "most": {"min": "lowest", "max": "highest"}[op], "column": column, "value": best[column]}
        return "rows", {"n": "no"}
    n = result.count()
    return ("filter", {"n": n}) if op == "filter" else ("rows", {"n": n or "no"})


def answer_text(plan: TableQueryPlan, result: DataFrame, question: str = "") -> str:
    """One sentence for a small result; ends with the table's label."""
    sentence, facts = _facts(plan, result, question)
    return SENTENCES[sentence].format(**facts)


def inventory(tables: DataFrame) -> DataFrame:
    """One row for each extracted table: its place and size."""
    return tables.select("table_id", "document_id", "page_number", "table_index", F.size("rows").alias("row_count"), F.size("headers").alias("column_count"), "headers")


def preview(tables: DataFrame, rows: int = 10) -> DataFrame:
    """The first rows of each extracted table, and whether there are more."""
    if not 0 <= rows <= 100:
        raise TableQueryError("a preview has 0 to 100 rows")
    return tables.select("table_id", "headers", F.slice("rows", 1, rows).alias("rows") if rows else F.array().cast("array<array<string>>").alias("rows"), (F.size("rows") > rows).alias("truncated"))


def running_index(tables: DataFrame) -> DataFrame:
    """Numbers tables through their document, by page and place."""
    return tables.withColumn("table_index", F.row_number().over(Window.partitionBy("document_id").orderBy("page_number", "position")))


def without_repeated_header(rows: Column, headers: Column) -> Column:
    """Rows of a table without a first row that repeats the headers."""
    return F.when(F.get(rows, F.lit(0)) == headers, F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(rows)


def combined(filters: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, filters, F.lit(True))


def exact_totals(df: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Sum and average of a text column to 28 significant digits, whatever the cells' digits (up to 38 before and 28 behind the point); one row, or one for each group.

    Whole parts and fractions are summed apart, both exactly; only their two sums meet in decimal arithmetic.
    """
    cell = F.replace(F.regexp_replace(_cell(df, column).cast("string"), r"(?U)^[\s€$£₹]+|\s+$", ""), F.lit(","), F.lit(""))
    good = cell.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$")
    signed = lambda x: F.when(cell.startswith("-"), -x).otherwise(x)  # noqa: E731 - a product would lose digits
    digits = F.regexp_replace(cell, "^[+-]", "")
    whole = signed(F.substring_index(digits, ".", 1).cast("decimal(38,0)"))
    part = signed(F.concat(F.lit("0."), F.when(digits.contains("."), F.substring_index(digits, ".", -1)).otherwise("0")).cast("decimal(38,28)"))
    sums = df.groupBy(*by).agg(F.sum(F.when(good, whole)).alias("w"), F.sum(F.when(good, part)).alias("p"), F.count_if(good).alias("n"), F.count(F.lit(1)).alias("row_count"))

    @F.pandas_udf("sum string, average string")
    def total(w: pd.Series, p: pd.Series, n: pd.Series) -> pd.DataFrame:
        def text(x: Decimal) -> str:
            plain = format(x.normalize(), "f")
            return plain.rstrip("0").rstrip(".") if "." in plain else plain

        rows = []
        with localcontext(Context(prec=28)):
            for a, b, k in zip(w, p, n, strict=True):
                s = Decimal(a or 0) + Decimal(b or 0)
                rows.append((text(s), text(s / Decimal(int(k))) if k else None))
        return pd.DataFrame(rows, columns=["sum", "average"])

    return sums.select(*by, total("w", "p", "n").alias("t"), "n", "row_count").select(*by, "t.sum", "t.average", F.col("n").alias("numbers"), "row_count")
