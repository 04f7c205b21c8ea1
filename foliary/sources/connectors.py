"""Places for what isn't part of the engine: parsers of files and generators of text, given as functions.

Spark deals files and requests over tasks; a function gets one batch at a time, is called again when
it fails, and what it can't do becomes a row that says so.  A lost task calls it again, so a
function must stand being called twice for the same input.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as P

ATTEMPTS = 3
ANSWERED, REPAIRED, INVALID, UNREACHABLE = "ANSWERED", "REPAIRED", "INVALID", "UNREACHABLE"
#: characters of a faulty answer that its repair is shown
SHOWN = 6000

Generator = Callable[[list[str]], list[str]]
Check = Callable[[str], str | None]


class ConnectorError(RuntimeError):
    """What a function raised, after the last attempt."""


def tried(call: Callable, *args, attempts: int = ATTEMPTS):
    """The result of a call that is made again while it fails."""
    for n in range(1, attempts + 1):
        try:
            return call(*args)
        except Exception as error:  # noqa: BLE001 - whatever a given function raises
            if n == attempts:
                raise ConnectorError(f"{type(error).__name__}: {error}") from error


def parse_files(files: DataFrame, parser: Callable[[bytes], list[dict]], schema: str, attempts: int = ATTEMPTS) -> DataFrame:
    """Rows of ``schema`` that a parser gives for each file (path, content), with path, place and error.

    A file that can't be parsed gives one row with its error and nothing else; the rest goes on.
    """
    own = P.StructType.fromDDL(schema)
    out = P.StructType([P.StructField("path", P.StringType()), P.StructField("place", P.IntegerType()), P.StructField("error", P.StringType()), *own])

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [{"path": path, "place": i, "error": None} | {c: r.get(c) for c in own.names} for i, r in enumerate(tried(parser, bytes(content), attempts=attempts))]
                except ConnectorError as error:
                    rows = [{"path": path, "place": None, "error": str(error)} | dict.fromkeys(own.names)]
                yield pd.DataFrame(rows, columns=out.names).astype({"place": "Int32"})

    return files.select("path", "content").mapInPandas(task, out)


def repair_prompt(prompt: str, answer: str, fault: str) -> str:
    return f"{prompt}\n\n<invalid_previous_output>\n{answer[:SHOWN]}\n</invalid_previous_output>\nThe output above is not valid: {fault}. Return a corrected one only."


def checked_answers(prompts: list[str], generate: Generator, check: Check | None, attempts: int) -> list[tuple[str | None, str, str | None]]:
    """(answer, status, error) of each prompt: a faulty answer is asked for once more, with its fault."""
    answers = tried(generate, prompts, attempts=attempts)
    if len(answers) != len(prompts):
        raise ConnectorError(f"{len(answers)} answers to {len(prompts)} prompts")
    faults = [check(a) if check else None for a in answers]
    out: list[tuple[str | None, str, str | None]] = [(a, ANSWERED, None) for a in answers]
    broken = [i for i, f in enumerate(faults) if f is not None]
    if broken:
        again = tried(generate, [repair_prompt(prompts[i], answers[i], faults[i]) for i in broken], attempts=attempts)
        for i, answer in zip(broken, again, strict=True):
            fault = check(answer)
            out[i] = (answer, REPAIRED, None) if fault is None else (None, INVALID, fault)
    return out


def ask(requests: DataFrame, generate: Generator, check: Check | None = None, attempts: int = ATTEMPTS, batch: int = 16) -> DataFrame:
    """Answers to requests (request_id, prompt): request_id, answer, status, error.

    ``generate`` answers a list of prompts; ``check`` names an answer's fault, or None.  A batch that fails
    every time is asked prompt by prompt, so one prompt can't take others with it.
    """
    kind = requests.schema["request_id"].dataType
    schema = P.StructType([P.StructField("request_id", kind), *(P.StructField(c, P.StringType()) for c in ("answer", "status", "error"))])

    def each(prompts: list[str]) -> list[tuple[str | None, str, str | None]]:
        try:
            return checked_answers(prompts, generate, check, attempts)
        except ConnectorError as error:
            if len(prompts) == 1:
                return [(None, UNREACHABLE, str(error))]
            return [each([p])[0] for p in prompts]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for i in range(0, len(rows), batch):
                part = rows.iloc[i : i + batch]
                found = each([p or "" for p in part["prompt"]])
                yield pd.DataFrame([(k, *f) for k, f in zip(part["request_id"], found, strict=True)], columns=schema.names)

    return requests.select("request_id", "prompt").mapInPandas(task, schema)


def json_object(required: tuple[str, ...] = (), allowed: tuple[str, ...] | None = None) -> Check:
    """A check that an answer is one JSON object with the keys that are required, and none beyond the allowed."""

    def check(answer: str) -> str | None:
        try:
            value = json.loads(answer)
        except (TypeError, ValueError):
            return "it is no JSON"
        if not isinstance(value, dict):
            return "it is no JSON object"
        missing = [k for k in required if k not in value]
        unknown = [] if allowed is None else sorted(k for k in value if k not in allowed)
        return f"missing: {', '.join(missing)}" if missing else f"unknown: {', '.join(unknown)}" if unknown else None

    return check
