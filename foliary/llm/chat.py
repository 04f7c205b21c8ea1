"""Chat formatting from event logs.

A conversation is a log of events: messages, streamed deltas, edits and regenerations.  The log is
dealt out by conversation, sorted by sequence number, and folded into final messages, which are
then rendered with a template that marks turns and keeps track of what is under the loss mask.

Events (column ``event``; without it every row is a message):
  message     a new message of ``role`` with ``text``
  delta       ``text`` is added to message ``target``, or to the last one
  edit        message ``target`` (or the last) gets ``text``; messages after it, which answered the old text, go
  regenerate  message ``target`` (or the last of the assistant) and all after it go; a new empty assistant message opens
``target`` counts messages by the sequence number of the event that opened them; one that doesn't
exist is ignored, and so are unknown events.

Every row sends its event without the text first, then the text.  A task folds a conversation's
events (numbers and roles only), knows from that which text ends up where, and then lets the texts
stream through in the order of events: a message is rendered once its last piece is there and all
before it are out.  So beside numbers only texts wait that stand behind a message still growing; a
plain log is rendered row by row.  Rendered text leaves in parts of about ``PART`` characters, whole
turns each, so no conversation has to fit in memory as one string.

A control string inside a text gets a backslash behind its first character (one more, if it has
some already), which no template mark has; taking one away gives the text back.

Defined results: null texts and roles are empty; rows of one sequence number go by event, role and
a hash of the text; repeated rows are messages each; null numbers come first; null conversation ids
are one conversation; an empty table gives an empty one; columns that aren't named play no part,
whatever they are called.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.llm import common as C

TURN, END = "<|turn|>", "<|end|>"
#: Strings that chat templates use as marks.
CONTROL = (TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
PART = 1 << 20
ASSISTANT = "assistant"

_ESCAPE = re.compile("|".join(f"(?<={re.escape(c[0])})(?=\\\\*{re.escape(c[1:])})" for c in CONTROL))
_UNESCAPE = re.compile("|".join(f"(?<={re.escape(c[0])})\\\\(?=\\\\*{re.escape(c[1:])})" for c in CONTROL))


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub("", text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Message:
    __slots__ = ("pieces", "role", "seq", "stays")

    def __init__(self, seq: int | None, role: str, pieces: list[int]) -> None:
        self.seq, self.role, self.pieces, self.stays = seq, role, pieces, True


class Fold:
    """State of one conversation: its messages, with the numbers of the events whose texts they are made of."""

    def __init__(self) -> None:
        self.messages: list[Message] = []
        self.place: dict[int, int] = {}  # of a message in the list, by identity
        self.by_seq: dict[int | None, list[Message]] = {}
        self.of_assistant: list[Message] = []
        self.events = 0

    @staticmethod
    def _last(stack: list[Message]) -> Message | None:
        while stack and not stack[-1].stays:
            stack.pop()
        return stack[-1] if stack else None

    def _find(self, target: int | None, role: str | None = None) -> int | None:
        if target is not None:
            found = self._last(self.by_seq.get(target, []))
        else:
            found = self._last(self.of_assistant if role else self.messages)
        return None if found is None else self.place[id(found)]

    def _open(self, seq: int | None, role: str, pieces: list[int]) -> None:
        message = Message(seq, role, pieces)
        self.place[id(message)] = len(self.messages)
        self.messages.append(message)
        self.by_seq.setdefault(seq, []).append(message)
        if role == ASSISTANT:
            self.of_assistant.append(message)

    def _drop(self, first: int) -> None:
        for message in self.messages[first:]:
            message.stays = False
            del self.place[id(message)]
        del self.messages[first:]

    def take(self, event: str, seq: int | None, target: int | None, role: str) -> None:
        n, self.events = self.events, self.events + 1
        if event == "message":
            self._open(seq, role, [n])
        elif event == "delta" and (i := self._find(target)) is not None:
            self.messages[i].pieces.append(n)
        elif event == "edit" and (i := self._find(target)) is not None:
            self._drop(i + 1)
            self.messages[i].pieces = [n]
        elif event == "regenerate" and (i := self._find(target, ASSISTANT)) is not None:
            self._drop(i)
            self._open(seq, ASSISTANT, [])

    def plan(self) -> np.ndarray:
        """The message each event's text goes to (-1: none)."""
        out = np.full(self.events, -1, np.int64)
        for i, message in enumerate(self.messages):
            out[message.pieces] = i
        return out


class Stream:
    """Texts of one conversation's events, in turn, become its messages."""

    def __init__(self, fold: Fold) -> None:
        self.messages, self.to, self.event, self.out = fold.messages, fold.plan(), 0, 0
        self.missing = [len(m.pieces) for m in fold.messages]
        self.waiting: dict[int, list[str]] = {}

    def take(self, text: str) -> Iterator[tuple[str, str]]:
        """Messages that are whole, and next, with this event's text."""
        i = int(self.to[self.event])
        self.event += 1
        if i >= 0:
            self.waiting.setdefault(i, []).append(text)
            self.missing[i] -= 1
        while self.out < len(self.messages) and not self.missing[self.out]:
            yield self.messages[self.out].role, "".join(self.waiting.pop(self.out, ()))
            self.out += 1


class Renderer:
    """Parts of one conversation's rendered text."""

    def __init__(self, conv) -> None:
        self.conv, self.part, self.pieces, self.size, self.loss = conv, 0, [], 0, []

    def turn(self, role: str, text: str) -> Iterator[tuple]:
        head, body = TURN + _role_out(role) + "\n", escape(text)
        if role == ASSISTANT:
            start = self.size + len(head)
            self.loss.append({"start": start, "end": start + len(body)})
        self.pieces += [head, body, END, "\n"]
        self.size += len(head) + len(body) + len(END) + 1
        if self.size >= PART:
            yield self.flush()

    def end(self) -> Iterator[tuple]:
        if self.pieces or not self.part:
            yield self.flush()

    def flush(self) -> tuple:
        out = (self.conv, self.part, "".join(self.pieces), self.loss)
        self.part, self.pieces, self.size, self.loss = self.part + 1, [], 0, []
        return out


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def render(log: DataFrame, conv_id: str = "conv_id", seq: str = "turn", role: str = "role", text: str = "text", event: str | None = None, target: str | None = None) -> DataFrame:
    """Rendered conversations: conv_id, part, formatted, loss (spans of ``formatted``, in code points).

    Parts of one conversation are in one partition, one behind the other.
    """
    C.prepare(log.sparkSession)
    own = C.Kept(log, "unused int")
    kind = F.coalesce(own.column(event), F.lit("message")) if event else F.lit("message")
    aim = own.column(target).cast("long") if target else F.lit(None).cast("long")
    body = F.coalesce(own.column(text), F.lit(""))
    rows = own.df.select(own.column(conv_id).cast("long").alias("c"), own.column(seq).cast("long").alias("s"), kind.alias("e"), F.coalesce(own.column(role), F.lit("")).alias("r"), aim.alias("t"), body.alias("x"))
    twice = rows.withColumn("h", F.xxhash64("x")).withColumn("late", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("x", F.when(F.col("late"), F.col("x")))
    ordered = twice.repartition("c").sortWithinPartitions("c", "late", F.col("s").asc_nulls_first(), "e", "r", "h", F.col("t").asc_nulls_first(), "x").select("c", "late", "s", "e", "r", "t", "x")

    @C.tidy
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold, stream, renderer, begun = None, Fold(), None, None, False
        for batch in C.slices(batches):
            out = []
            for c, late, s, e, r, t, x in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if not begun or c != now:
                    if begun:
                        out += renderer.end()
                    now, fold, stream, renderer, begun = c, Fold(), None, Renderer(c), True
                if not late:
                    fold.take(e, s, t, r)
                    continue
                if stream is None:
                    stream = Stream(fold)
                for message in stream.take(x):
                    out += renderer.turn(*message)
            yield _parts(out)
        if begun:
            yield _parts(list(renderer.end()))

    return ordered.mapInArrow(task, "conv_id long, part int, formatted string, loss array<struct<start:long,end:long>>")


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.string(), _SPAN]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["conv_id", "part", "formatted", "loss"])


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Turns (role, text) of a rendered part."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(TURN, at):
            raise ValueError("a turn must begin here")
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        yield _role_in(formatted[at + len(TURN) : line]), unescape(formatted[line + 1 : end])
        at = end + len(END) + 1


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests of each conversation, from what ``render`` returned (as it lies, part behind part)."""

    @C.tidy
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, begun = None, False

        def row() -> tuple:
            return (state["conv"], state["turns"], state["hash"].hexdigest(), state["loss"], state["loss_hash"].hexdigest(), state["chars"])

        for batch in batches:
            out = []
            for conv, part, text, loss in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if part == 0:
                    if begun:
                        out.append(row())
                    begun, state = True, {"conv": conv, "turns": 0, "hash": hashlib.sha256(), "loss": 0, "loss_hash": hashlib.sha256(), "chars": 0}
                for role, body in parse(text):
                    state["turns"] += 1
                    state["hash"].update(f"{role}\n{body}\n".encode())
                for span in loss:
                    body = unescape(text[span["start"] : span["end"]])
                    state["loss"] += len(body)
                    state["loss_hash"].update(body.encode())
                state["chars"] += len(text)
            yield _digests(out)
        if begun:
            yield _digests([row()])

    return rendered.mapInArrow(task, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
