"""Longitudinal operators: deltas, baselines, growth, tiers, schedules, queues."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions import rules as R
from tidemark.functions.lexicons import TIER_CYCLE_DAYS
from tidemark.operators.joins import latest_and_previous, latest_rows
from tidemark.operators.ordering import lag_in_chunks, number_rows, order_statistics, text_code, top_per_group


def follower_delta(snapshots: DataFrame, account: str, order: Sequence[str], value: str, ok: Column) -> DataFrame:
    """Latest minus previous valid snapshot, NULL when either is unknown."""
    pair = latest_and_previous(snapshots.where(ok), account, order, [value])
    return pair.select(account, F.col(f"last_{value}").alias("latest"), F.col(f"prev_{value}").alias("previous"),
                       (F.col(f"last_{value}") - F.col(f"prev_{value}")).alias("delta"), "n_rows")


def trend(snapshots: DataFrame, account: str, order: Sequence[str], values: Sequence[str], chunk: Column) -> DataFrame:
    """Difference to the previous snapshot of the account for every snapshot."""
    lagged = lag_in_chunks(snapshots, [account], order, chunk, values)
    return lagged.select(*snapshots.columns, *[(F.col(v) - F.col(f"prev_{v}")).alias(f"delta_{v}") for v in values])


def growth(snapshots: DataFrame, item: str, day: str, order: Sequence[str], value: str,
           as_of: Column, new_days: int, posted: str | None = None) -> DataFrame:
    """First against last snapshot of an item: gain, tracked days, and whether it is new."""
    pick = F.struct(F.col(day).alias("d"), F.col(value).alias("v"))
    first_last = snapshots.groupBy(item).agg(
        F.count(F.lit(1)).alias("snapshots"), F.min_by(pick, F.struct(*order)).alias("a"),
        F.max_by(pick, F.struct(*order)).alias("b"), F.min(posted or day).alias("_posted"))
    return first_last.select(
        item, "snapshots", F.datediff("b.d", "a.d").cast("long").alias("days_tracked"),
        F.col("a.v").alias("first_value"), F.col("b.v").alias("last_value"), (F.col("b.v") - F.col("a.v")).alias("gain"),
        (F.to_date("_posted") >= F.date_sub(as_of, new_days)).alias("is_new"))


def recent_baseline(posts: DataFrame, account: str, order: Sequence[str], value: str, n: int | None = 20) -> DataFrame:
    """Usual value of an account: the upper middle of the last n posts, or the median of all posts.

    The recent mode sorts at most n values per account; the other one uses exact ranks.
    """
    known = posts.where(F.col(value).isNotNull())
    if n is None:
        return order_statistics(known, [account], [value], {"median": 0.5}).select(
            account, F.col(f"median_{value}").alias("baseline"))
    recent = top_per_group(known.select(account, *dict.fromkeys([*order, value])), [account],
                           [F.desc(c) for c in order], n, "_rn")
    values = F.sort_array(F.collect_list(F.col(value)))
    return recent.groupBy(account).agg(values.alias("_v")).select(
        account, F.get("_v", F.floor(F.size("_v") / 2).cast("int")).alias("baseline"))


def breakouts(posts: DataFrame, baseline: DataFrame, account: str, value: str, saves: str) -> DataFrame:
    """Posts with their multiple of the account baseline and their save ratio."""
    return posts.join(baseline, account, "left").withColumns({
        "multiple": F.try_divide(F.col(value), F.col("baseline")),
        "save_ratio": F.try_divide(F.col(saves) * F.lit(1.0), F.col(value))})


def auto_tier(snapshots: DataFrame, account: str, order: Sequence[str], day: str, count: str, chunk: Column,
              as_of: Column, pinned: DataFrame | None = None, new_days: int = 7, a_idle: int = 7,
              b_idle: int = 21) -> DataFrame:
    """S / A / B by the days since the count column last changed; pinned accounts stay S."""
    seen = snapshots.withColumn("_seen", F.lit(1))
    lagged = lag_in_chunks(seen, [account], order, chunk, [count, "_seen"])
    changed = (F.col("prev__seen").isNotNull() & F.col(count).isNotNull()
               & ~F.col(count).eqNullSafe(F.col(f"prev_{count}")))
    per = lagged.groupBy(account).agg(F.min(day).alias("_first"), F.max(F.when(changed, F.col(day))).alias("last_change"))
    out = per.select(
        account, F.datediff(as_of, "_first").cast("long").alias("observed_days"),
        F.datediff(as_of, F.coalesce("last_change", "_first")).cast("long").alias("idle_days"), "last_change")
    tier = F.when(F.col("observed_days") < new_days, "S").when(F.col("idle_days") <= a_idle, "S") \
        .when(F.col("idle_days") <= b_idle, "A").otherwise("B")
    if pinned is None:
        return out.withColumn("tier", tier)
    pins = pinned.select(account).distinct().withColumn("_pin", F.lit(True))
    return out.join(pins, account, "left").withColumn("tier", F.when(F.col("_pin"), "S").otherwise(tier)).drop("_pin")


def staggered_schedule(accounts: DataFrame, tier: str, order: Column, row_id: str, base: Column,
                       cycles: Mapping[str, int] = TIER_CYCLE_DAYS) -> DataFrame:
    """Accounts of a tier spread over the days of its cycle by their position."""
    numbered = number_rows(accounts, order, row_id, "_k", [tier])
    cycle = F.lit(1)
    for name, days in cycles.items():
        cycle = F.when(F.col(tier) == name, F.lit(days)).otherwise(cycle)
    return numbered.withColumn("next_check", F.date_add(base, F.pmod(F.col("_k") - 1, cycle).cast("int") + 1)).drop("_k")


def due_accounts(accounts: DataFrame, today: Column) -> DataFrame:
    return accounts.where(F.col("next_check").isNull() | (F.col("next_check") <= today))


def tier_distribution(accounts: DataFrame, tier: str, cycles: Mapping[str, int] = TIER_CYCLE_DAYS) -> DataFrame:
    """Accounts per tier and the checks per day they cause."""
    rate = F.lit(1.0)
    for name, days in cycles.items():
        rate = F.when(F.col(tier) == name, F.lit(1.0 / days)).otherwise(rate)
    return accounts.groupBy(tier).agg(F.count(F.lit(1)).alias("n")).withColumn("daily_load", F.col("n") * rate)


def cumulative_daily(df: DataFrame, ts: str, as_of: Column | None = None) -> DataFrame:
    """Rows per day with empty days filled, and the running total.

    The running sum is over one row per calendar day.
    """
    daily = df.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    last = F.max("day") if as_of is None else F.greatest(F.max("day"), as_of)
    calendar = daily.agg(F.sequence(F.min("day"), last).alias("d")).select(F.explode("d").alias("day"))
    filled = calendar.join(daily, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))
    return filled.withColumn("total", F.sum("n").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)))


def top_and_bottom(df: DataFrame, row_id: str, metric: str, n: int) -> DataFrame:
    """First n and last n rows by a metric, unknown values left out."""
    known = df.where(F.col(metric).isNotNull()).select(row_id, F.col(metric).alias("value"))
    parts = [known.orderBy(o, row_id).limit(n).withColumn("block", F.lit(b))
             for b, o in (("top", F.desc("value")), ("bottom", F.asc("value")))]
    return parts[0].unionByName(parts[1]).withColumn("metric", F.lit(metric))


def seeded_sample(df: DataFrame, row_id: str, n: int, seed: str = "42") -> DataFrame:
    """Reproducible sample: the first n rows by a hash of seed and id."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(row_id).cast("string"))), row_id).limit(n)


def batch_numbers(pending: DataFrame, order: str, size: int = 10) -> DataFrame:
    """Pending rows numbered and cut into batches, without a global sort in one task."""
    text = pending.schema[order].dataType.simpleString() == "string"
    out = number_rows(pending, text_code(F.col(order)) if text else F.col(order), order, "row_no")
    return out.withColumn("batch", F.floor((F.col("row_no") - 1) / size) + 1)


def budgeted_queue(df: DataFrame, run: Sequence[str], order: Column, row_id: str, budget: int) -> DataFrame:
    """At most ``budget`` rows per run are taken now; the rest stays in the result as deferred."""
    numbered = number_rows(df, order, row_id, "queue_pos", run)
    return numbered.withColumn("status", F.when(F.col("queue_pos") <= budget, "now").otherwise("deferred"))


def change_feed(items: DataFrame, run: Sequence[str], item: str, payload: Sequence[str], part_size: int = 1000) -> DataFrame:
    """Per run and account the changed items as one nested list, long lists in numbered parts."""
    # Numbered by a hash of the item (52 bits, exact as a double), so that any kind of id will do.
    d = items.select(*run, item, *payload).withColumn("_h", F.shiftright(F.xxhash64(item), 12))
    numbered = number_rows(d, F.col("_h"), item, "_no", run)
    numbered = numbered.withColumn("part", F.floor((F.col("_no") - 1) / part_size))
    return numbered.groupBy(*run, "part").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.array_sort(F.collect_list(F.struct(item, *payload))).alias("items"))


def is_stale(published: Column, as_of: Column, days: int = 7) -> Column:
    """Older than the limit; unknown or garbled dates are never stale."""
    text = F.regexp_extract(F.coalesce(published, F.lit("")), r"^\s*(\d{4}-\d{2}-\d{2})", 1)
    return F.coalesce(F.datediff(as_of, F.try_to_date(F.nullif(text, F.lit("")), "yyyy-MM-dd")) > days, F.lit(False))


def score_gate(df: DataFrame, service: Column, followers: str, row_id: str, least: float, max_add: int) -> DataFrame:
    """Service accounts above the line are added up to the limit, the rest is kept with its status."""
    ok = service & (F.col(followers) >= least)
    last = (df.where(ok).orderBy(F.desc(followers), row_id).limit(max_add)
            .agg(F.min(F.struct(F.col(followers).alias("f"), (-F.col(row_id)).alias("i"))).alias("c")).scalar())
    here = F.struct(F.col(followers).alias("f"), (-F.col(row_id)).alias("i"))
    return (df.withColumn("_cut", last)
            .withColumn("status", F.when(ok & (here >= F.col("_cut")), "added").when(ok, "waiting")
                        .when(service, "candidate").otherwise("context")).drop("_cut"))


def dirty_page_guard(pages: DataFrame, accounts: DataFrame, key: str, seen: Column, stored: Column) -> DataFrame:
    """Snapshot is valid only when the scraped name equals the stored one; both arrive normalized."""
    return pages.join(accounts, key, "left").withColumn("ok", F.coalesce(seen == stored, F.lit(False)))


def ratio_sanity(likes: Column, followers: Column, at_most: float = 50) -> Column:
    """Likes per follower, NULL when implausible."""
    r = F.try_divide(likes, followers)
    return F.when(r <= at_most, r)


def message_browse(messages: DataFrame, session: str, ts: str, row_id: str, limit: int, msg_type: str = "all",
                   session_id=None) -> DataFrame:
    """Messages of one session in time order; the session that started last by default."""
    if session_id is None:
        starts = messages.groupBy(session).agg(F.min(ts).alias("_start"))
        session_id = starts.agg(F.max_by(session, F.struct("_start", session)).alias("s")).scalar()
    else:
        session_id = F.lit(session_id)
    d = messages.withColumn("_sid", session_id).where(F.col(session) == F.col("_sid")).drop("_sid")
    if msg_type != "all":
        d = d.where(F.col("event_type") == msg_type)
    return d.orderBy(ts, row_id).limit(limit)


def session_counts(messages: DataFrame, session: str, msg_type: str, types: Sequence[str]) -> DataFrame:
    return messages.groupBy(session).agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(msg_type) == x).alias(f"n_{x}") for x in types])


def drop_counters(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """How many rows fall at the first failing check, and how many pass."""
    reason = None
    for name, bad in checks.items():
        reason = F.when(bad, name) if reason is None else reason.when(bad, name)
    d = df.select(reason.otherwise("ok").alias("_r"))
    return d.agg(F.count(F.lit(1)).alias("total"),
                 *[F.count_if(F.col("_r") == n).alias(f"n_{n}") for n in [*checks, "ok"]])


def valid_rows(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    for bad in checks.values():
        df = df.where(~F.coalesce(bad, F.lit(False)))
    return df


def is_news(nickname: Column, enterprise: Column, personal: Column, words: Sequence[str]) -> Column:
    """News words in a verification text, or in the nickname of an account with enterprise text."""
    low = [w.lower() for w in words]
    ev, cv, nick = (F.lower(F.coalesce(c, F.lit(""))) for c in (enterprise, personal, nickname))
    return R.has_any(ev, low) | R.has_any(cv, low) | ((ev != "") & R.has_any(nick, low))


def anchored_service(text: Column, strong: Sequence[str], excluded: Sequence[str], anchors: Sequence[str],
                     cross_service: Sequence[str], cross_context: Sequence[str]) -> Column:
    """Strong service word, no excluded word, and a regional anchor or both kinds of cross-border words."""
    anchored = R.has_any(text, anchors) | (R.has_any(text, cross_service) & R.has_any(text, cross_context))
    return R.has_any(text, strong) & ~R.has_any(text, excluded) & anchored


def account_panel(accounts: DataFrame, snapshots: DataFrame, key: str, order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Accounts with the latest value of the snapshot columns."""
    return accounts.join(latest_rows(snapshots.select(key, *dict.fromkeys([*order, *cols])), [key], order), key, "left")
