"""Conversation exports and transcripts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.text import sentences


def flatten(messages: DataFrame, keys: Sequence[str], content: str, created_ms: str, zone: str = "Asia/Shanghai",
            width: int = 500, kinds: Sequence[str] = ("text", "reasoning", "tool_use")) -> DataFrame:
    """One row per content block: text and reasoning whole, tool input shortened, local time."""
    d = messages.select(*keys, created_ms, F.posexplode(content).alias("pos", "_b")).where(F.col("_b.type").isin(*kinds))
    text = F.when(F.col("_b.type") == "tool_use", F.left(F.col("_b.input"), F.lit(width))).otherwise(F.col("_b.text"))
    local = F.from_utc_timestamp(F.timestamp_millis(created_ms), zone)
    return d.select(*keys, F.col("pos").cast("long").alias("pos"), F.col("_b.type").alias("kind"), text.alias("text"),
                    F.date_format(local, "yyyy-MM-dd HH:mm:ss").alias("local_time"))


def read_transcripts(segments: DataFrame) -> DataFrame:
    """Transcribed segments: session_id, segment_idx, text; empty ones left out."""
    return segments.select("session_id", "segment_idx", F.trim("text").alias("text")).where("text <> ''")


def transcript_stats(segments: DataFrame, ends: str = r"[。！？!?\n]+") -> DataFrame:
    return segments.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_segments"), F.sum(F.length("text")).cast("long").alias("n_chars"),
        F.sum(F.size(sentences(F.col("text"), ends))).cast("long").alias("n_sentences"))
