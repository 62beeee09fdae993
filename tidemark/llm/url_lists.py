"""URL lists with dates: entries become validity intervals, and captures meet the entries active when they were fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.llm.html_text import host_of, path_of
from tidemark.llm.words import fresh

#: Date of entries that are never removed.
OPEN_END = "9999-12-31"


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, since, until) from dated entries (list, pattern, action, dated); ``until`` is not included.

    ``action`` is ``add`` or ``remove``; others, and rows with a NULL, are left out. On one date additions
    win over removals, and repeated entries change nothing. An addition holds until the next removal. A pattern's
    history has one row a day at most, which bounds the window.
    """
    days = (entries.where("action in ('add', 'remove') and list is not null and pattern is not null and dated is not null")
            .groupBy("list", "pattern", F.col("dated").cast("date").alias("dated")).agg(F.max(F.col("action") == "add").alias("active")))
    history = W.partitionBy("list", "pattern").orderBy("dated")
    turns = days.withColumn("_before", F.lag("active").over(history)).where(F.col("active") != F.coalesce("_before", F.lit(False)))
    until = F.coalesce(F.lead("dated").over(history), F.lit(OPEN_END).cast("date"))
    return turns.withColumn("until", until).where("active").select("list", "pattern", F.col("dated").alias("since"), "until")


def url_keys(url: Column) -> Column:
    """Patterns that hold a URL: its host, the domains above it, and its host with each folder of its path.

    ``a.b.com/x/y`` has a.b.com, b.com, a.b.com/ and a.b.com/x/. A NULL or other text without a host has none.
    """
    host, path = host_of(url), path_of(url)
    labels, parts = F.split(host, r"\."), F.split(path, "/")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    folders = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(
        host, F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.array_distinct(F.concat(domains, folders))).otherwise(F.array().cast("array<string>"))


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def active_lists(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched", into: str = "lists") -> DataFrame:
    """``captures`` with the sorted names of the lists that held the URL on the day it was fetched.

    As-of join on (pattern, month): an interval is copied to the months it covers among those of the captures, so a
    pattern that holds a third of all captures is many keys and a capture meets only intervals of its month. Equal
    (URL, day) pairs are looked up once. Captures without a URL or a date have no lists, as has every capture when
    there are no entries. The number of lists is fixed by the caller and bounds a row. ``into`` gets underscores
    before it if ``captures`` has such a column; all others stay as they are.
    """
    into, own_url, own_day = fresh(captures, into), fresh(captures, "_url"), fresh(captures, "_day")
    day = F.col(f"`{fetched}`").cast("date")
    seen = captures.select(F.col(f"`{url}`").alias("_url"), day.alias("_day")).where("_url is not null and _day is not null").distinct()
    keys = seen.select("_url", "_day", F.explode(url_keys(F.col("_url"))).alias("pattern")).withColumn("month", _month(F.col("_day")))
    span = seen.agg(F.min("_day").alias("a"), F.max("_day").alias("b"))
    first, last = (_month(span.select(c).scalar()) for c in ("a", "b"))
    valid = intervals(entries).withColumns({"_a": F.greatest(_month(F.col("since")), first), "_b": F.least(_month(F.col("until")), last)})
    valid = valid.where("_a <= _b").select("list", "pattern", "since", "until", F.explode(F.sequence("_a", "_b")).alias("month"))
    held = (keys.join(valid, ["pattern", "month"]).where("since <= _day and _day < until")
            .groupBy("_url", "_day").agg(F.array_sort(F.collect_set("list")).alias(into)).withColumnsRenamed({"_url": own_url, "_day": own_day}))
    out = captures.join(held, (F.col(f"`{url}`") == F.col(own_url)) & (day == F.col(own_day)), "left").drop(own_url, own_day)
    return out.withColumn(into, F.coalesce(into, F.array().cast("array<string>")))


def allowed(captures: DataFrame, entries: DataFrame, block: list[str], allow: list[str] = (), url: str = "url", fetched: str = "fetched") -> DataFrame:
    """Captures that no list of ``block`` held when they were fetched, or that one of ``allow`` held too."""
    into = fresh(captures, "_lists")
    d = active_lists(captures, entries, url, fetched, into)
    of = lambda names: F.arrays_overlap(F.col(into), F.array(*[F.lit(x) for x in names]).cast("array<string>"))
    return d.where(~of(block) | of(list(allow))).drop(into)
