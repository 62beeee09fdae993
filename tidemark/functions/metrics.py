"""Parsing and shaping of metric columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import lexicons


def _scaled(number: Column, unit: Column) -> Column:
    factor = (F.when(F.lower(unit).isin("万", "w"), F.lit(10000))
              .when(unit == "亿", F.lit(100000000)).otherwise(F.lit(1)))
    return F.floor(number.cast("decimal(24,6)") * factor).cast("long")


def parse_count(col: Column, mode: str = "search") -> Column:
    """Text count with 万/亿/w units to a long.

    ``anchored``: the whole text is a number, else NULL. ``search``: first number anywhere, thousands
    separators removed, else NULL. ``zero``: like anchored, but 0 where there is no number.
    """
    text = F.regexp_replace(F.coalesce(col, F.lit("")), r"^\s+|\s+$", "")
    if mode == "search":
        text = F.regexp_replace(text, "[,+]", "")
        pattern = r"(\d+(?:\.\d+)?)\s*([万亿wW])?"
        hit = text.rlike(r"\d") & ~text.isin("", "-", "--", "null", "None")
    else:
        pattern = r"^(\d+(?:\.\d+)?)\s*([万亿])?$"
        hit = text.rlike(pattern)
    value = _scaled(F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2))
    return F.when(hit, value).otherwise(F.lit(0).cast("long") if mode == "zero" else F.lit(None))


def parse_int(col: Column) -> Column:
    """First whole part of a number in the text, thousands separators removed; ``-`` is NULL."""
    text = F.regexp_replace(F.coalesce(col, F.lit("")), r"[,+]", "")
    return F.nullif(F.regexp_extract(text, r"(-?\d+)", 1), F.lit("")).cast("long")


def parse_rate(col: Column) -> Column:
    """``3.21%`` -> 0.0321; a bare number stays as it is; text without a number is NULL."""
    text = F.replace(F.coalesce(col, F.lit("")), F.lit(","), F.lit(""))
    number = F.nullif(F.regexp_extract(text, r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")
    return F.when(F.contains(text, F.lit("%")), number / 100).otherwise(number)


def format_count(col: Column) -> Column:
    """亿 and 万 with one decimal, thousands separators below. The unit goes by the count itself, before it is rounded (halves up)."""
    return (F.when(col.isNull(), F.lit(None).cast("string"))
            .when(col >= 100000000, F.concat(F.format_string("%.1f", F.round(col / 1e7) / 10), F.lit("亿")))
            .when(col >= 10000, F.concat(F.format_string("%.1f", F.round(col / 1e3) / 10), F.lit("万")))
            .otherwise(F.format_number(col.cast("long"), 0)))


def duration_seconds(col: Column) -> Column:
    """``mm:ss`` to seconds; NULL when it is not a time."""
    m, s = F.regexp_extract(col, r"^(\d+):(\d+)", 1), F.regexp_extract(col, r"^(\d+):(\d+)", 2)
    return F.when(m == "", F.lit(None)).otherwise(m.cast("long") * 60 + s.cast("long"))


def at_least_one(col: Column) -> Column:
    return F.greatest(F.coalesce(col, F.lit(0)), F.lit(1))


def engagement_ratios(df: DataFrame, likes: str, comments: str, shares: str, collects: str,
                      followers: str) -> DataFrame:
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in (comments, shares, collects)),
                F.coalesce(F.col(likes), F.lit(0)))
    return (df.withColumn("total_engagement", total)
            .withColumn("comment_like_ratio", F.col(comments) / at_least_one(F.col(likes)))
            .withColumn("share_like_ratio", F.col(shares) / at_least_one(F.col(likes)))
            .withColumn("collect_like_ratio", F.col(collects) / at_least_one(F.col(likes)))
            .withColumn("engagement_per_follower",
                        F.col("total_engagement") / at_least_one(F.col(followers))))


def note_key(note_id: Column, title: Column, post_time: Column, digest: str = "sha1") -> Column:
    """``id:<id>`` where an id is known, else a 16-digit hash of title and time."""
    f = {"sha1": F.sha1, "md5": F.md5}[digest]
    bare = [F.trim(F.coalesce(c, F.lit(""))) for c in (note_id, title, post_time)]
    return F.when(~bare[0].isin("", "-"), F.concat(F.lit("id:"), bare[0])).otherwise(
        F.concat(F.lit("h:"), F.substring(f(F.concat(bare[1], F.lit("|"), bare[2])), 1, 16)))


def null_outliers(col: Column, at_most: float) -> Column:
    """Implausible or non-positive values become NULL, never 0."""
    return F.when((col > 0) & (col <= at_most), col)


def period_label(ts: Column) -> Column:
    y = F.year(ts)
    return (F.when(ts.isNull(), "未知").when(y <= 2020, "早期(≤2020)")
            .when(y <= 2022, "中期(2021-2022)").otherwise("近期(2023-2026)"))


def weighted_engagement(parts: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for c, w in parts.items():
        out = out + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.lit(float(w))
    return out


FOLLOWER_TIERS = lexicons.FOLLOWER_TIERS
