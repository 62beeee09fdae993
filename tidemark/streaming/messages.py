"""Live-room messages: one row shape, deduplication, batched sink, sessions, topic windows.

All functions take a streaming or a batch frame unless they say otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import text as T
from tidemark.operators.comments import ordered_dedup
from tidemark.operators.ordering import top_per_group

#: fixed values: message kinds by method of the decoded event
ROUTES = {"WebcastChatMessage": "chat", "WebcastGiftMessage": "gift", "WebcastMemberMessage": "member",
          "WebcastLikeMessage": "like", "WebcastSocialMessage": "subscribe"}
#: fixed values: the method of control messages and the status that ends a room
CONTROL_METHOD, END_STATUS = "WebcastControlMessage", 3


def normalize_messages(df: DataFrame, routes: Mapping[str, str] = ROUTES) -> DataFrame:
    """Decoded events to message rows; other methods are left out.

    Input: session_id, msg_id, method, user_id, username, content, gift_name, gift_id,
    repeat_count, action, ts.
    """
    kind = F.lit(None).cast("string")
    for method, name in routes.items():
        kind = F.when(F.col("method") == method, name).otherwise(kind)
    member = F.when(F.col("action") == 1, "enter").otherwise("leave")
    body = (F.when(F.col("_kind") == "chat", F.col("content")).when(F.col("_kind") == "gift", F.col("gift_name"))
            .when((F.col("_kind") == "member") & ~F.col("action").isin(1, 2), F.concat(F.lit("action="), F.col("action"))))
    extra = F.when(F.col("_kind") == "gift", F.to_json(F.struct("gift_id", "repeat_count")))
    return df.withColumn("_kind", kind).where("_kind is not null").select(
        "session_id", F.nullif(F.col("msg_id"), F.lit("")).alias("msg_id"),
        F.when(F.col("_kind") == "member", member).otherwise(F.col("_kind")).alias("msg_type"),
        "user_id", "username", body.alias("content"), extra.alias("extra"), F.col("ts").alias("timestamp"))


def dedup_messages(df: DataFrame, keys: Sequence[str] = ("session_id", "msg_id"), ts: str = "timestamp",
                   delay: str = "10 minutes") -> DataFrame:
    """First row of every id; rows without an id pass.

    On a stream the ids are kept for the watermark delay, which bounds the state by time instead
    of a fixed number of ids.
    """
    known = F.coalesce(F.col(keys[-1]), F.lit("")) != ""
    if df.isStreaming:
        d = df.withWatermark(ts, delay)
        return d.where(known).dropDuplicatesWithinWatermark(list(keys)).unionByName(d.where(~known))
    return ordered_dedup(df.where(known), list(keys), [ts]).select(*df.columns).unionByName(df.where(~known))


def write_batches(df: DataFrame, path: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] | None = None,
                  interval: str | None = "2 seconds", mode: str = "append"):
    """Start a query that writes every micro-batch to its own folder, so a retried batch replaces itself.

    ``interval`` None processes what is there and stops.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        out = shape(batch) if shape else batch
        out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(save)
    w = w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)
    return w.start()


def late_rows(query) -> int:
    """Rows that came after the watermark and were left out, over the batches whose progress is still known."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def ends_room(method: Column, status: Column) -> Column:
    """Whether a decoded message is the control message that ends its room."""
    return F.coalesce((method == CONTROL_METHOD) & (status == END_STATUS), F.lit(False))


def session_lifecycle(df: DataFrame, session: str = "session_id", ts: str = "timestamp", ended: Column | None = None) -> DataFrame:
    """Start, last message, number of messages and status of every session.

    A plain grouped aggregate, so the rows of a busy session are combined before the shuffle; on a
    stream it runs in update mode and the newest row of a session replaces the older one.
    """
    over = F.lit(False) if ended is None else F.coalesce(ended, F.lit(False))
    return df.groupBy(session).agg(
        F.min(ts).alias("started_at"), F.max(ts).alias("last_at"), F.count(F.lit(1)).alias("n_messages"),
        F.max(F.when(over, F.col(ts))).alias("ended_at")).withColumn(
        "status", F.when(F.col("ended_at").isNotNull(), "ended").otherwise("live"))


def window_words(df: DataFrame, session: str, ts: str, text: str, pattern: str, minutes: int = 5, delay: str = "10 minutes",
                 stop_words: Sequence[str] = ()) -> DataFrame:
    """Word counts per session and tumbling window.

    On a stream the append mode gives closed windows only; the update mode gives every change, so that a
    reader of ``latest_counts`` also has the windows that were open when the stream ended.
    """
    d = df.withWatermark(ts, delay) if df.isStreaming else df
    words = d.select(session, ts, F.explode(T.words(F.col(text), pattern)).alias("word"))
    if stop_words:
        words = words.where(~F.col("word").isin(*stop_words))
    counts = words.groupBy(session, F.window(ts, f"{minutes} minutes").alias("w"), "word").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(session, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "word", "n")


def latest_counts(batches: DataFrame, keys: Sequence[str], n: str = "n", batch: str = "batch_id") -> DataFrame:
    """The newest count of each key from the batches of an update stream."""
    return batches.groupBy(*keys).agg(F.max_by(n, batch).alias(n))


def window_keywords(counts: DataFrame, session: str, k: int = 5) -> DataFrame:
    """Top words of every window; also the shape of a micro-batch, which holds whole windows."""
    return top_per_group(counts, [session, "start", "end"], [F.desc("n"), F.asc("word")], k, "rank")

