"""Streaming forms of indexing, numbering and monitoring.  Every stateful step is bounded by a watermark or by a key's own state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliary.operators.chunking import Limits, chunk_pages
from foliary.operators.corpus import write_index


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(path)


def index_stream(pages: DataFrame, path: str, checkpoint: str, limits: Limits | None = None, buckets: int = 64):
    """Chunks each batch's documents into the index.

    A batch's documents replace what is stored of them (an upsert by versions of buckets, see
    ``write_index``), so running a batch again gives the same index; ``corpus.read_index`` reads it.
    """

    def one(batch: DataFrame, _: int) -> None:
        write_index(chunk_pages(batch, limits=limits), path, buckets)

    return pages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Numberer(StatefulProcessor):
    """Gives a conversation's messages their next sequence numbers, each message one.

    State of a conversation: the last number, the latest arrival, and the messages that have a number
    and arrived within ``horizon`` of it.  One of those that is sent again gets none; older ones are
    forgotten, and what arrives before the horizon counts as sent again.
    """

    def __init__(self, horizon: int) -> None:
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "n long, arrival long")
        self.seen = handle.getMapState("seen", "arrival long, message string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        number, latest = self.last.get() if self.last.exists() else (0, None)
        parts = [x for x in rows if len(x)]
        if not parts:
            return
        pdf = pd.concat(parts).sort_values(["arrival", "message_id"], kind="stable")
        pdf = pdf[pdf["content"].fillna("").str.strip() != ""]
        out = []
        for r in pdf.itertuples(index=False):
            mark = (int(r.arrival), str(r.message_id))
            if self.seen.containsKey(mark) or (latest is not None and mark[0] < latest - self.horizon):
                continue
            number += 1
            self.seen.updateValue(mark, (number,))
            out.append((r.conversation_id, number, r.role, r.content))
        newest = [int(x) for x in pdf["arrival"]] + ([] if latest is None else [latest])
        if newest:
            bound = max(newest) - self.horizon
            for mark in [m for m in self.seen.keys() if m[0] < bound]:
                self.seen.removeKey(mark)
            self.last.update((number, max(newest)))
        if out:
            yield pd.DataFrame(out, columns=["conversation_id", "sequence_number", "role", "content"])

    def close(self) -> None:
        pass


def number_messages(messages: DataFrame, horizon: int = 1 << 62) -> DataFrame:
    """Stream of conversation_id, arrival, role, content (and message_id, where there is one) with sequence numbers (needs the RocksDB state store).

    A message is known by its arrival and id (or, without one, role and text).  ``horizon``, in units of
    ``arrival``, says how long after the newest one a message may be sent again.
    """
    own = messages if "message_id" in messages.columns else messages.withColumn("message_id", F.sha2(F.concat_ws("\0", "role", "content"), 256))
    return own.groupBy("conversation_id").transformWithStateInPandas(Numberer(horizon), "conversation_id long, sequence_number long, role string, content string", "Append", "None")


def latency_windows(events: DataFrame, width: str = "1 day", late: str = "1 hour", slide: str | None = None, time: str = "ts") -> DataFrame:
    """Counts and means of each window and kind of event; later rows than ``late`` are left out."""
    window: Column = F.window("at", width, slide) if slide else F.window("at", width)
    return events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("window_start"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Each user's sessions: runs of events with no longer gap than ``gap``."""
    rows = events.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
