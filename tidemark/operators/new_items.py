"""New items of observed listings: which are real news, which are old posts seen late.

A listing row is (account, run, item, pos); runs are ordered. The decision for an item depends on
its first two sightings and on the account's first run, so it is a grouped job and not a replay.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.operators.ordering import lag_in_chunks, top_per_group
from tidemark.session import write_through

#: fixed values: depth of the head of a listing, age of a stale item, items released per run
HEAD_WINDOW, STALE_DAYS, RELEASE_LIMIT = 8, 7, 5

#: Later sightings up to which one task replays an account; beyond, rounds over single sightings give the same result.
REPLAYED_ROWS = 100_000


def _sightings(listings: DataFrame) -> DataFrame:
    """First position, first run and second run of every item."""
    seen = listings.groupBy("account", "item", "run").agg(F.min("pos").alias("pos"))
    two = top_per_group(seen, ["account", "item"], [F.asc("run")], 2, "_k")
    return two.groupBy("account", "item").agg(
        F.max(F.when(F.col("_k") == 1, F.col("run"))).alias("first_run"), F.max(F.when(F.col("_k") == 1, F.col("pos"))).alias("first_pos"),
        F.max(F.when(F.col("_k") == 2, F.col("run"))).alias("second_run"))


def _first_runs(listings: DataFrame) -> DataFrame:
    return listings.groupBy("account").agg(F.min("run").alias("base_run"))


def detect_by_head(listings: DataFrame, head: int = HEAD_WINDOW, published: DataFrame | None = None,
                   stale_days: int = STALE_DAYS) -> DataFrame:
    """New ids in the first ``head`` positions are queued and confirmed when seen again.

    Deeper new ids are posts the baseline missed; the first run of an account only builds the
    baseline; a confirmed item that was published long before is suppressed as stale.
    """
    d = _sightings(listings).join(_first_runs(listings), "account")
    status = (F.when(F.col("first_run") == F.col("base_run"), "baseline").when(F.col("first_pos") >= head, "deep_position")
              .when(F.col("second_run").isNull(), "queued").otherwise("confirmed"))
    out = d.select("account", "item", "first_run", "first_pos", "second_run", status.alias("status"))
    if published is None:
        return out
    old = F.datediff(F.col("second_run"), F.col("published")) > stale_days
    return (out.join(published.select("account", "item", "published"), ["account", "item"], "left")
            .withColumn("status", F.when((F.col("status") == "confirmed") & F.coalesce(old, F.lit(False)), "stale").otherwise(F.col("status")))
            .drop("published"))


def retry_backlog(decided: DataFrame, done: DataFrame, runs: DataFrame) -> DataFrame:
    """Confirmed items and the runs in which they still had to be reported, as one interval for each item.

    ``done``: account, item, run of the successful fetch; ``runs``: account, run. ``first_open`` is the confirming
    run, ``last_open`` the run of the details or, if they never arrived, the account's last run; every run after the
    first is a retry. An item that stays open for ever is still one row.
    """
    ends = runs.groupBy("account").agg(F.max("run").alias("_final"))
    fetched = done.groupBy("account", "item").agg(F.min("run").alias("_done"))
    d = (decided.where("status = 'confirmed'").select("account", "item", F.col("second_run").alias("first_open"))
         .join(fetched, ["account", "item"], "left").join(ends, "account"))
    return d.select("account", "item", "first_open", F.coalesce("_done", "_final").alias("last_open"),
                    F.col("_done").isNotNull().alias("arrived")).where("last_open >= first_open")


def _release_in_order(limit: int):
    """Queued items of one account, released on a later sighting, at most ``limit`` per run."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values(["run", "pos", "item"])
        out, released, now, used = [], set(), None, 0
        for r, item in zip(d["run"], d["item"]):  # an item stands once in a run
            if r != now:
                now, used = r, 0
            if used < limit and item not in released:
                used += 1
                released.add(item)
                out.append((pdf["account"].iloc[0], item, r))
        return pd.DataFrame(out, columns=["account", "item", "released_run"])
    return run


def _release_in_rounds(later: DataFrame, limit: int) -> DataFrame:
    """(account, item, released_run) as the replay gives it, without a task that holds an account.

    A sighting is certain when it is the first open one of its item and stands so high in its run that the run has room for it even
    if all before it are released. Each round releases the certain ones, closes the other sightings of their items and the full runs.
    The earliest open sighting of an account is always certain, so the rounds end; each is written to the shared folder.
    """
    left = write_through(later.withColumn("room", F.lit(limit)), "open-sightings")
    out = []
    while not left.isEmpty():
        high = top_per_group(left, ["account", "run"], [F.asc("pos"), F.asc("item")], limit, "place").where("place <= room")
        first = left.groupBy("account", "item").agg(F.min("run").alias("run"))
        sure = write_through(high.join(first, ["account", "item", "run"]).select("account", "item", "run"), "released")
        out.append(sure)
        used = sure.groupBy("account", "run").agg(F.count(F.lit(1)).cast("int").alias("used"))
        left = write_through(left.join(sure.select("account", "item"), ["account", "item"], "left_anti").join(used, ["account", "run"], "left")
                             .withColumn("room", F.col("room") - F.coalesce("used", F.lit(0))).where("room > 0").drop("used"), "open-sightings")
    none = later.select("account", "item", "run").where(F.lit(False))
    return reduce(DataFrame.unionByName, out, none).withColumnRenamed("run", "released_run")


def detect_by_quota(listings: DataFrame, totals: DataFrame, chunk: Column, limit: int = RELEASE_LIMIT, replayed_rows: int = REPLAYED_ROWS) -> DataFrame:
    """New ids are queued only up to the growth of the account's post count, the rest is old.

    A queued id is released on its next sighting, at most ``limit`` per account and run in listing
    order. Only accounts in which a run would go over the limit are replayed run by run, and only
    with their queued items; for all others the second sighting is the release. Of these, accounts with more than
    ``replayed_rows`` sightings are worked off in rounds over all of their rows at once, with the same result.
    ``totals``: account, run, total. An unknown total (NULL) in a run or in the one before allows nothing.
    """
    growth = lag_in_chunks(totals, ["account"], ["run"], chunk, ["total"]).select(
        "account", "run", F.greatest(F.coalesce(F.col("total") - F.col("prev_total"), F.lit(0)), F.lit(0)).alias("quota"))
    first = _sightings(listings).join(_first_runs(listings), "account")
    fresh = first.where(F.col("first_run") > F.col("base_run")).join(
        growth.withColumnRenamed("run", "first_run"), ["account", "first_run"], "left")
    place = F.row_number().over(W.partitionBy("account", "first_run").orderBy("first_pos", "item"))
    cols = ["account", "item", "first_run", "first_pos", "second_run", "status"]
    decided = (fresh.withColumn("status", F.when(place <= F.coalesce("quota", F.lit(0)), "queued").otherwise("known")).select(*cols)
               .unionByName(first.where(F.col("first_run") == F.col("base_run")).withColumn("status", F.lit("baseline")).select(*cols)))
    decided = write_through(decided, "first-sightings")  # read four times below
    queued = decided.where("status = 'queued'").select("account", "item", "first_run", "second_run")
    crowded = (queued.where("second_run is not null").groupBy("account", "second_run").agg(F.count(F.lit(1)).alias("n"))
               .where(F.col("n") > limit).select("account").distinct())
    simple = queued.join(crowded, "account", "left_anti").select("account", "item", F.col("second_run").alias("released_run"))
    later = (listings.join(queued.join(crowded, "account", "left_semi").select("account", "item", "first_run"), ["account", "item"])
             .where(F.col("run") > F.col("first_run")).groupBy("account", "item", "run").agg(F.min("pos").alias("pos")))
    kinds = {f.name: f.dataType.simpleString() for f in listings.schema.fields}
    later = write_through(later, "later-sightings")  # read three times
    large = later.groupBy("account").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > replayed_rows).select("account")
    in_rounds = _release_in_rounds(later.join(large, "account", "left_semi"), limit)
    replayed = later.join(large, "account", "left_anti").groupBy("account").applyInPandas(
        _release_in_order(limit), f"account {kinds['account']}, item {kinds['item']}, released_run {kinds['run']}")
    released = simple.where("released_run is not null").unionByName(replayed).unionByName(in_rounds)
    return (decided.drop("second_run").join(released, ["account", "item"], "left")
            .withColumn("status", F.when(F.col("released_run").isNotNull(), "released").otherwise(F.col("status"))))
