"""The fold of session updates into the current state, in batch and as a stream.

A start of a tool call overwrites all its fields, a progress patches those that are not null and may come first; plan, mode and the like keep
their last value; chunks are appended.  The batch fold is one aggregation that combines before the shuffle: a field's value is that of the last row that
sets it, where a start sets all fields and a progress those it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("title", "kind", "status", "raw_input", "raw_output")
START, PROGRESS = "tool_call", "tool_call_update"
LAST = ("plan", "mode", "commands")
CHUNKS = ("user_chunk", "agent_chunk", "thought_chunk")
UPDATE = "session_id string, seq bigint, update_type string, tool_call_id string, title string, kind string, status string, raw_input string, raw_output string, text string"


def tool_calls(updates: DataFrame) -> DataFrame:
    """(session_id, tool_call_id, title, kind, status, raw_input, raw_output): the state of every tool call."""
    rows = updates.filter(F.col("update_type").isin(START, PROGRESS) & F.col("tool_call_id").isNotNull())
    sets = lambda c: F.when((F.col("update_type") == START) | F.col(c).isNotNull(), F.col("seq"))
    return rows.groupBy("session_id", "tool_call_id").agg(*(F.max_by(c, sets(c)).alias(c) for c in FIELDS))


def last_values(updates: DataFrame) -> DataFrame:
    """(session_id, update_type, text): the last plan, mode and commands."""
    return updates.filter(F.col("update_type").isin(*LAST)).groupBy("session_id", "update_type").agg(F.max_by("text", "seq").alias("text"))


def chunk_log(updates: DataFrame) -> DataFrame:
    """(session_id, update_type, chunks, chars, first_seq, last_seq): the append logs, measured; the rows themselves are the log."""
    rows = updates.filter(F.col("update_type").isin(*CHUNKS))
    return rows.groupBy("session_id", "update_type").agg(F.count("*").alias("chunks"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def timings(events: DataFrame, keys: list[str], order: list[str], is_start: Column, is_end: Column, at: Column) -> DataFrame:
    """events with seconds, of each end since the last start before it under the same keys; 0 for an end without a start."""
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = events.withColumn("_start", F.last(F.when(is_start, at), ignorenulls=True).over(own)).filter(is_end)
    return rows.withColumn("seconds", F.coalesce(at - F.col("_start"), F.lit(0.0))).drop("_start")


def correlated(frames: DataFrame) -> DataFrame:
    """(id, method, result): requests with their response, null without one; responses without a request are ignored.  frames: kind, id, method, result."""
    asked = frames.filter("kind = 'request'").select("id", "method")
    answers = frames.filter("kind = 'response'").groupBy("id").agg(F.min("result").alias("result"))
    return asked.join(answers, "id", "left")


def stream_tool_calls(updates: DataFrame, timeout: str = "NoTimeout") -> DataFrame:
    """The same as tool_calls of a stream of updates (schema UPDATE): the changed states of every micro-batch, in update mode.

    State is a row of fields per tool call and, for each, the sequence number of the update that set it, so updates may come in any order, within
    a batch and across batches.  With ProcessingTimeTimeout the state is dropped GRACE_MS after the last update.
    """
    out = "session_id string, tool_call_id string, " + ", ".join(f"{f} string" for f in FIELDS)
    state = ", ".join([*(f"{f} string" for f in FIELDS), *(f"{f}_seq bigint" for f in FIELDS)])

    def step(key: tuple, batches: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        before = list(kept.get) if kept.exists else [None] * len(FIELDS) + [-1] * len(FIELDS)
        fields, set_by = before[: len(FIELDS)], before[len(FIELDS) :]
        rows = pd.concat(list(batches)).reset_index(drop=True)
        for k, f in enumerate(FIELDS):
            setting = rows[(rows["update_type"] == START) | rows[f].notna()]
            if len(setting) and (last := setting.loc[setting["seq"].idxmax()])["seq"] >= set_by[k]:
                fields[k], set_by[k] = None if pd.isna(last[f]) else last[f], int(last["seq"])
        kept.update((*fields, *set_by))
        if timeout == "ProcessingTimeTimeout":
            kept.setTimeoutDuration(GRACE_MS)
        yield pd.DataFrame([(*key, *fields)], columns=["session_id", "tool_call_id", *FIELDS])

    rows = updates.filter(F.col("update_type").isin(START, PROGRESS) & F.col("tool_call_id").isNotNull())
    return rows.groupBy("session_id", "tool_call_id").applyInPandasWithState(step, out, state, "update", timeout)


#: How long a session without updates stays, and the gap that ends one.
GRACE_MS = 300_000
IDLE = "30 minutes"


def idle_sessions(events: DataFrame, key: str, at: str = "ts", gap: str = IDLE) -> DataFrame:
    """(key, began, last_at, events): sessions that end after a gap; in a stream the same with a watermark on ``at``."""
    rows = events.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("events"), F.max(at).alias("last_at"))
    return rows.select(key, F.col("w.start").alias("began"), "last_at", "events")


def routed(updates: DataFrame) -> dict[str, DataFrame]:
    """Updates by type, those without type left out; for a stream, call it in foreachBatch."""
    known = updates.filter("update_type is not null")
    return {"tools": known.filter(F.col("update_type").isin(START, PROGRESS)), "values": known.filter(F.col("update_type").isin(*LAST)), "chunks": known.filter(F.col("update_type").isin(*CHUNKS))}
