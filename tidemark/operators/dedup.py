"""Set operations on keyed tables: best versions, stable ids, purges, imports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.joins import unseen
from tidemark.operators.ordering import number_rows, text_code


def best_version(df: DataFrame, keys: Sequence[str], score: Column, tie: Sequence[str]) -> DataFrame:
    """Per key the row with the highest score; ties by the smaller tie columns."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct((-score).alias("s"), *tie)).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, "_r.*")


def union_unknown(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First table, plus the rows of the second one with keys the first does not have."""
    return first.unionByName(unseen(second, keys, first), allowMissingColumns=True)


def unique_items(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one that was inserted first."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def allocate_ids(items: DataFrame, ledger: DataFrame, path: str, code: str, order: str, prefix: str = "SRC",
                 width: int = 3) -> DataFrame:
    """Known paths keep their id; new ones get the next free number of their code."""
    kept = ledger.select(path, F.col("source_id").alias("_id"))
    number = F.regexp_extract("source_id", r"-(\d+)$", 1).cast("long")
    highest = ledger.groupBy(code).agg(F.max(number).alias("_top"))
    known = items.join(kept, path)
    text = items.schema[order].dataType.simpleString() == "string"
    lead = text_code(F.col(order)) if text else F.col(order)
    fresh = number_rows(unseen(items, [path], ledger), lead, order, "_no", [code])
    fresh = fresh.join(highest, code, "left").withColumn("_n", F.coalesce("_top", F.lit(0)) + F.col("_no"))
    new_id = F.concat_ws("-", F.lit(prefix), F.col(code), F.lpad(
        F.col("_n").cast("string"), F.greatest(F.lit(width), F.length(F.col("_n").cast("string"))), F.lit("0")))
    return (known.withColumn("is_new", F.lit(False)).withColumnRenamed("_id", "source_id")
            .unionByName(fresh.withColumn("source_id", new_id).withColumn("is_new", F.lit(True))
                         .drop("_no", "_top", "_n")))


def purge_accounts(accounts: DataFrame, snapshots: DataFrame, posts: DataFrame, rejected: DataFrame,
                   blacklist: DataFrame, key: str) -> dict[str, DataFrame]:
    """Remove rejected accounts with their snapshots, count their posts, record them in the blacklist."""
    gone = rejected.select(key).distinct()
    return {
        "accounts": unseen(accounts, [key], gone),
        "snapshots": unseen(snapshots, [key], gone),
        "kept_posts": posts.join(gone, key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("n_posts")),
        "blacklist": union_unknown(rejected, blacklist, [key]),
    }


def import_existing(dumps: DataFrame, accounts: DataFrame, key: str, item: str, ts: str) -> dict[str, DataFrame]:
    """Accounts, one baseline snapshot each, and items marked as already confirmed, for new accounts only."""
    fresh = unseen(dumps, [key], accounts)
    per = fresh.groupBy(key).agg(F.max(ts).alias("checked_at"), F.count(F.lit(1)).alias("video_count_seen"))
    return {
        "accounts": per.select(key, F.col("checked_at").alias("added_at"), F.lit(True).alias("baselined")),
        "snapshots": per.withColumn("ok", F.lit(1)),
        "items": fresh.select(key, item).distinct().withColumns(
            {"seen_count": F.lit(2), "notified": F.lit(1)}),
    }
