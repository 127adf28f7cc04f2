"""Streams. The upsert and the chat history are the reference's loops as streams; event windows are an extension."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..sources.sinks import KeyedTable


def stream_upsert(rows: DataFrame, table: KeyedTable, order, checkpoint: str, log: str | None = None) -> None:
    """Takes what is there, batch by batch, into a keyed table; the checkpoint makes a restart go on where it stopped, and a batch that the
    table has already seen is skipped. An older row that comes in a later batch doesn't replace a newer one: order decides over the table's row too.
    With log, a folder, each batch adds a row to it: batch, n_rows (as observed while they were written), seconds, n_buckets."""

    def take(batch: DataFrame, n: int) -> None:
        seen, began = Observation(), time.monotonic()
        buckets = table.upsert(batch.observe(seen, F.count(F.lit(1)).alias("n_rows")), order, over_table=True, batch=n)
        if log and buckets:
            batch.sparkSession.createDataFrame([(n, seen.get["n_rows"], time.monotonic() - began, len(buckets))], "batch long, n_rows long, seconds double, n_buckets int").coalesce(1).write.mode("append").parquet(log)

    rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class ChatHistory(StatefulProcessor):
    """A conversation's turns as a list in the state store: a batch appends its own turns to it and rewrites none."""

    def __init__(self, most: int | None, idle_ms: int | None):
        self.most, self.idle_ms = most, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.said = handle.getListState("said", "turn long, role string, content string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t), r, x) for p in rows for t, r, x in zip(p["turn"], p["role"], p["text"], strict=True)]
        said = sorted([*self.said.get(), *new], key=lambda x: (x[0], x[1] or "", x[2] or ""))
        if self.most and len(said) > self.most:
            said = said[-self.most :]
            self.said.put(said)
        else:
            self.said.appendList(new)
        if self.idle_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame({"conv_id": [key[0]], "n_turns": [len(said)], "messages": [json.dumps([{"role": r, "content": x} for _, r, x in said], ensure_ascii=False)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.said.clear()
        yield pd.DataFrame({"conv_id": pd.Series([], dtype="int64"), "n_turns": pd.Series([], dtype="int64"), "messages": pd.Series([], dtype="object")})

    def close(self) -> None:
        pass


def chat_history(turns: DataFrame, most: int | None = None, idle: float | None = None) -> DataFrame:
    """turns: a stream of (conv_id, turn, role, text). After each batch the messages so far, as JSON, of each conversation in it. The state
    holds all its turns, or where ``most`` is given the last of them; with ``idle`` (seconds) a conversation without a turn for so long is forgotten.
    State lists need the RocksDB state store, which is set for streams that the session starts from now on."""
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    step = ChatHistory(most, None if idle is None else int(idle * 1000))
    return turns.groupBy("conv_id").transformWithStateInPandas(step, "conv_id long, n_turns long, messages string", "Update", "None" if idle is None else "ProcessingTime")


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "2 hours", time: str = "ts") -> DataFrame:
    """Extension: tumbling windows per event type over event time, late rows beyond the watermark dropped."""
    e = events.withColumn("__t", F.col(time).cast("timestamp"))
    e = e.withWatermark("__t", late) if e.isStreaming else e
    return e.groupBy(F.window("__t", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", time: str = "ts") -> DataFrame:
    """Extension: sessions per user."""
    e = events.withColumn("__t", F.col(time).cast("timestamp"))
    e = e.withWatermark("__t", late) if e.isStreaming else e
    return e.groupBy(F.session_window("__t", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")
