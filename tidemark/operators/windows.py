"""Windows that start at the first message and again at the first message after five minutes.

The start of a window depends on the start before it, but only through one number: the earliest
time the next window may start. Every time chunk of a session is turned into a small table that maps
this number at its beginning to the number at its end. These tables are folded per session, and then
every chunk lists its own windows. No task holds more of a session than one chunk of it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.functions import text as T
from tidemark.operators.ordering import top_per_group


def _over_groups(df: DataFrame, keys: list[str], order: list[str], fn, schema: str) -> DataFrame:
    """Run ``fn(frame, bounds)`` over whole groups in key order, many small groups per call.

    Rows arrive sorted, batch by batch; only the unfinished last group is held back. ``bounds`` are
    the row numbers at which groups begin, and the end.
    """
    def run(batches):
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if pdf.empty:
                continue
            if held and all(held[-1][k].iloc[-1] == pdf[k].iloc[-1] for k in keys):
                held.append(pdf)
                continue
            pdf = pd.concat([*held, pdf], ignore_index=True) if held else pdf.reset_index(drop=True)
            bounds = _bounds(pdf, keys)
            last = bounds[-2]
            held = [pdf.iloc[last:]]
            if last:
                yield fn(pdf.iloc[:last], bounds[:-1])
        if held:
            pdf = pd.concat(held, ignore_index=True)
            yield fn(pdf, _bounds(pdf, keys))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _bounds(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    changed = np.zeros(len(pdf), dtype=bool)
    changed[0] = True
    for k in keys:
        v = pdf[k].to_numpy()
        changed[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(changed), len(pdf))


def _jump_tables(width: int, chunk_us: int):
    def run(pdf: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        us, chunks, sessions, out = pdf["us"].to_numpy(), pdf["chunk"].to_numpy(), pdf["session"].to_numpy(), []
        for a, b in zip(bounds[:-1], bounds[1:]):
            t = us[a:b]
            nxt = np.searchsorted(t, t + width)
            end = np.empty(len(t), dtype=np.int64)
            for i in range(len(t) - 1, -1, -1):
                end[i] = t[i] + width if nxt[i] == len(t) else end[nxt[i]]
            n = min(len(t), int(np.searchsorted(t, int(chunks[a]) * chunk_us + width)) + 1)
            keep = np.flatnonzero(np.append(end[1:n] != end[:n - 1], True))  # last entry of every run with one end
            out += [(sessions[a], chunks[a], t[i], end[i]) for i in keep]
        return pd.DataFrame(out, columns=["session", "chunk", "entry", "leave"])
    return run


def _fold(pdf: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
    entry, leave = pdf["entry"].to_numpy(), pdf["leave"].to_numpy()
    chunks, sessions, out = pdf["chunk"].to_numpy(), pdf["session"].to_numpy(), []
    for a, b in zip(bounds[:-1], bounds[1:]):
        free, steps = np.iinfo(np.int64).min, np.append(a + np.flatnonzero(np.append(True, chunks[a + 1:b] != chunks[a:b - 1])), b)
        for c, d in zip(steps[:-1], steps[1:]):
            out.append((sessions[a], chunks[c], free))
            i = c + int(np.searchsorted(entry[c:d], free))
            if i < d:
                free = int(leave[i])
    return pd.DataFrame(out, columns=["session", "chunk", "free"])


def _list_starts(width: int):
    def run(pdf: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        us, free, sessions, out = pdf["us"].to_numpy(), pdf["free"].to_numpy(), pdf["session"].to_numpy(), []
        for a, b in zip(bounds[:-1], bounds[1:]):
            i = a + int(np.searchsorted(us[a:b], free[a]))
            while i < b:
                out.append((sessions[a], us[i]))
                i = a + int(np.searchsorted(us[a:b], us[i] + width))
        return pd.DataFrame(out, columns=["session", "start_us"])
    return run


def anchored_starts(df: DataFrame, session: str, ts: str, minutes: int = 5, chunk_minutes: int = 60) -> DataFrame:
    """Window starts of every session, in microseconds."""
    width, chunk_us = minutes * 60_000_000, max(chunk_minutes, minutes) * 60_000_000
    kind = df.schema[session].dataType.simpleString()
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    t = df.select(F.col(session).alias("session"), us.alias("us")).distinct().withColumn("chunk", F.floor(F.col("us") / chunk_us))
    tables = _over_groups(t, ["session", "chunk"], ["us"], _jump_tables(width, chunk_us),
                          f"session {kind}, chunk bigint, entry bigint, leave bigint")
    free = _over_groups(tables, ["session"], ["chunk", "entry"], _fold, f"session {kind}, chunk bigint, free bigint")
    return _over_groups(t.join(free, ["session", "chunk"]), ["session", "chunk"], ["us"], _list_starts(width),
                        f"session {kind}, start_us bigint").withColumnRenamed("session", session)


def anchored_windows(df: DataFrame, session: str, ts: str, minutes: int = 5, chunk_minutes: int = 60) -> DataFrame:
    """Windows with their messages counted; a window ends where the next one starts, the last at the last message."""
    width = minutes * 60_000_000
    starts = anchored_starts(df, session, ts, minutes, chunk_minutes)
    nxt = starts.withColumn("next_us", F.lead("start_us").over(W.partitionBy(session).orderBy("start_us")))
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    slot = lambda c: F.floor(c / width)
    placed = nxt.select(session, "start_us", "next_us", F.explode(F.array(
        slot(F.col("start_us")), slot(F.col("start_us")) + 1)).alias("_slot"))
    m = df.select(session, us.alias("_us")).withColumn("_slot", slot(F.col("_us")))
    # Counted per time first: messages of one instant are one row before they meet the windows.
    m = m.groupBy(session, "_slot", "_us").agg(F.count(F.lit(1)).alias("_n"))
    hit = m.join(placed, [session, "_slot"]).where((F.col("_us") >= F.col("start_us")) & (F.col("_us") < F.col("start_us") + width))
    return hit.groupBy(session, "start_us", "next_us").agg(F.sum("_n").alias("msg_count"), F.max("_us").alias("_last")).select(
        session, F.timestamp_micros("start_us").alias("start"), F.timestamp_micros(F.coalesce("next_us", "_last")).alias("end"), "msg_count")


def anchored_keywords(df: DataFrame, session: str, ts: str, text: str, pattern: str, k: int = 5, minutes: int = 5) -> DataFrame:
    """Top words of every anchored window."""
    width = minutes * 60_000_000
    slot = lambda c: F.floor(c / width)
    starts = anchored_starts(df, session, ts, minutes).select(session, "start_us", F.explode(F.array(
        slot(F.col("start_us")), slot(F.col("start_us")) + 1)).alias("_slot"))
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    words = (df.select(session, us.alias("_us"), F.explode(T.words(F.col(text), pattern)).alias("word"))
             .groupBy(session, "_us", "word").agg(F.count(F.lit(1)).alias("n")).withColumn("_slot", slot(F.col("_us"))))
    hit = words.join(starts, [session, "_slot"]).where((F.col("_us") >= F.col("start_us")) & (F.col("_us") < F.col("start_us") + width))
    counts = hit.groupBy(session, "start_us", "word").agg(F.sum("n").alias("n"))
    return top_per_group(counts, [session, "start_us"], [F.desc("n"), F.asc("word")], k, "rank").withColumn("start", F.timestamp_micros("start_us")).drop("start_us")
