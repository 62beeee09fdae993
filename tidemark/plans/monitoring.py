"""Monitoring queries: customers are accounts, orders their snapshots and posts, events their messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import metrics as M, rules as R, text as T
from tidemark.operators import dedup as D, joins as J, monitor as Mo
from tidemark.plans.posts import rounded
from tidemark.plans.registry import query
from tidemark.session import scratch_path, write_through
from tidemark.sources.stored import StoredTable

ORDER = ["o_orderdate", "o_orderkey"]
def as_of():
    return F.to_date(F.lit("2001-08-02"))


AS_OF_SQL = "DATE '2001-08-02'"


def snaps(t):
    return t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")


@query("latest_snapshot", "J1", """SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN (
  SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
  ON c_custkey = o_custkey""")
def latest_snapshot(t):
    acc = t.customer.select("c_custkey", "c_name")
    s = snaps(t).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate", "o_totalprice")
    return J.join_latest(acc, s, "c_custkey", ORDER).drop("o_orderdate")


@query("latest_and_previous", "J2", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT o_custkey, max(o_totalprice) FILTER (WHERE rn = 1) AS last_o_totalprice, max(o_totalprice) FILTER (WHERE rn = 2) AS prev_o_totalprice,
  CAST(count(*) AS BIGINT) AS n_rows FROM r GROUP BY o_custkey""")
def latest_and_previous(t):
    return J.latest_and_previous(snaps(t), "o_custkey", ORDER, ["o_totalprice"])


@query("follower_delta", "W2", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders WHERE o_orderstatus <> 'P'),
g AS (SELECT o_custkey, max(o_totalprice) FILTER (WHERE rn = 1) AS latest, max(o_totalprice) FILTER (WHERE rn = 2) AS previous, CAST(count(*) AS BIGINT) AS n_rows FROM r GROUP BY 1)
SELECT o_custkey, latest, previous, round(latest - previous, 4) AS delta, n_rows FROM g""")
def follower_delta(t):
    d = Mo.follower_delta(snaps(t), "o_custkey", ORDER, "o_totalprice", F.col("o_orderstatus") != "P")
    return d.withColumn("delta", F.round("delta", 4))


@query("trend_report", "W3", """SELECT o_custkey, o_orderkey, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 4) AS delta FROM orders""")
def trend_report(t):
    d = Mo.trend(snaps(t), "o_custkey", ORDER, ["o_totalprice"], F.year("o_orderdate"))
    return d.select("o_custkey", "o_orderkey", F.round("delta_o_totalprice", 4).alias("delta"))


@query("cross_day_growth", "W4", f"""SELECT o_custkey, CAST(count(*) AS BIGINT) AS snapshots,
  CAST(datediff('day', min(o_orderdate), max(o_orderdate)) AS BIGINT) AS days_tracked,
  arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS first_value, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS last_value,
  round(arg_max(o_totalprice, (o_orderdate, o_orderkey)) - arg_min(o_totalprice, (o_orderdate, o_orderkey)), 4) AS gain,
  CAST(min(o_orderdate) AS DATE) >= {AS_OF_SQL} - 1500 AS is_new FROM orders GROUP BY o_custkey""")
def cross_day_growth(t):
    g = Mo.growth(snaps(t), "o_custkey", "o_orderdate", ORDER, "o_totalprice", as_of(), 1500)
    return g.withColumn("gain", F.round("gain", 4))


_RECENT = """base AS (SELECT o_custkey, list_sort(list(o_totalprice))[len(list(o_totalprice)) // 2 + 1] AS baseline FROM (
  SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 5) GROUP BY o_custkey)"""


@query("recent_baseline", "W5", f"WITH {_RECENT} SELECT * FROM base")
def recent_baseline(t):
    return Mo.recent_baseline(snaps(t), "o_custkey", ORDER, "o_totalprice", 5)


@query("median_baseline", "W5", "SELECT o_custkey, round(median(o_totalprice), 4) AS baseline FROM orders GROUP BY o_custkey")
def median_baseline(t):
    return Mo.recent_baseline(snaps(t), "o_custkey", ORDER, "o_totalprice", None).withColumn("baseline", F.round("baseline", 4))


@query("breakout_ratio", "W6", f"""WITH {_RECENT} SELECT o_orderkey, o_custkey, round(o_totalprice / baseline, 9) AS multiple,
  round(o_custkey / o_totalprice, 9) AS save_ratio FROM orders JOIN base USING (o_custkey) ORDER BY o_totalprice / baseline DESC, o_orderkey LIMIT 100""")
def breakout_ratio(t):
    b = Mo.recent_baseline(snaps(t), "o_custkey", ORDER, "o_totalprice", 5)
    d = Mo.breakouts(snaps(t).withColumn("saves", F.col("o_custkey")), b, "o_custkey", "o_totalprice", "saves")
    return rounded(d.orderBy(F.desc("multiple"), "o_orderkey").limit(100).select("o_orderkey", "o_custkey", "multiple", "save_ratio"),
                   "multiple", "save_ratio")


_TIER = f"""s AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(floor(o_totalprice / 200000) AS BIGINT) AS cnt FROM orders),
l AS (SELECT *, lag(cnt) OVER w AS pc, lag(1) OVER w AS seen FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY day, o_orderkey)),
g AS (SELECT o_custkey, min(day) AS first, max(day) FILTER (WHERE seen IS NOT NULL AND cnt IS DISTINCT FROM pc) AS last_change FROM l GROUP BY 1),
x AS (SELECT o_custkey, CAST(datediff('day', first, {AS_OF_SQL}) AS BIGINT) AS observed_days,
  CAST(datediff('day', coalesce(last_change, first), {AS_OF_SQL}) AS BIGINT) AS idle_days, last_change FROM g),
tier AS (SELECT *, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9500) THEN 'S' WHEN observed_days < 7 THEN 'S'
  WHEN idle_days <= 200 THEN 'S' WHEN idle_days <= 500 THEN 'A' ELSE 'B' END AS tier FROM x)"""


def tiers(t):
    s = snaps(t).select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"),
                        F.floor(F.col("o_totalprice") / 200000).alias("cnt"))
    pins = t.customer.where("c_acctbal > 9500").select(F.col("c_custkey").alias("o_custkey"))
    return Mo.auto_tier(s, "o_custkey", ["day", "o_orderkey"], "day", "cnt", F.year("day"), as_of(), pins, a_idle=200, b_idle=500)


@query("auto_tier", "W7", f"WITH {_TIER} SELECT * FROM tier")
def auto_tier(t):
    return tiers(t)


@query("staggered_schedule", "W8", f"""WITH {_TIER}, k AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY observed_days, o_custkey) - 1 AS k FROM tier)
SELECT o_custkey, tier, {AS_OF_SQL} + CAST(k % CASE tier WHEN 'S' THEN 1 WHEN 'A' THEN 3 ELSE 7 END AS INT) + 1 AS next_check FROM k""")
def staggered_schedule(t):
    d = Mo.staggered_schedule(tiers(t), "tier", F.col("observed_days"), "o_custkey", as_of())
    return d.select("o_custkey", "tier", "next_check")


@query("due_accounts", "W8", f"""WITH {_TIER}, k AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY observed_days, o_custkey) - 1 AS k FROM tier),
n AS (SELECT o_custkey, tier, {AS_OF_SQL} + CAST(k % CASE tier WHEN 'S' THEN 1 WHEN 'A' THEN 3 ELSE 7 END AS INT) + 1 AS next_check FROM k)
SELECT * FROM n WHERE next_check <= {AS_OF_SQL} + 2""")
def due_accounts(t):
    d = Mo.staggered_schedule(tiers(t), "tier", F.col("observed_days"), "o_custkey", as_of())
    return Mo.due_accounts(d, F.date_add(as_of(), 2)).select("o_custkey", "tier", "next_check")


@query("tier_distribution", "A26", f"""WITH {_TIER} SELECT tier, CAST(count(*) AS BIGINT) AS n,
  round(count(*) * CASE tier WHEN 'S' THEN 1.0 WHEN 'A' THEN 1.0 / 3 ELSE 1.0 / 7 END, 9) AS daily_load FROM tier GROUP BY tier""")
def tier_distribution(t):
    return rounded(Mo.tier_distribution(tiers(t), "tier"), "daily_load")


@query("cumulative_daily", "W9", """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1),
c AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM d), greatest((SELECT max(day) FROM d), DATE '2024-02-05'), INTERVAL 1 DAY)) AS DATE) AS day)
SELECT day, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(sum(coalesce(n, 0)) OVER (ORDER BY day) AS BIGINT) AS total FROM c LEFT JOIN d USING (day)""")
def cumulative_daily(t):
    return Mo.cumulative_daily(t.events, "ts", F.to_date(F.lit("2024-02-05")))


@query("rank_blocks", "T1", """(SELECT l_orderkey * 10 + l_linenumber AS row_id, l_extendedprice AS value, 'top' AS block, 'l_extendedprice' AS metric FROM lineitem ORDER BY value DESC, row_id LIMIT 15)
UNION ALL (SELECT l_orderkey * 10 + l_linenumber AS row_id, l_extendedprice AS value, 'bottom', 'l_extendedprice' FROM lineitem ORDER BY value, row_id LIMIT 15)""")
def rank_blocks(t):
    li = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), "l_extendedprice")
    return Mo.top_and_bottom(li, "row_id", "l_extendedprice", 15)


@query("top_per_group", "T2", """SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rank
FROM orders QUALIFY rank <= 3""")
def top_per_group(t):
    from tidemark.operators.ordering import top_per_group as top

    return top(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query("seeded_sample", "T4", "SELECT doc_id, source FROM documents ORDER BY md5('42' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 20")
def seeded_sample(t):
    return Mo.seeded_sample(t.documents.select("doc_id", "source"), "doc_id", 20)


@query("batch_number", "T5", """SELECT page_id, CAST(row_number() OVER (ORDER BY page_id) AS BIGINT) AS row_no,
  CAST((row_number() OVER (ORDER BY page_id) - 1) // 10 + 1 AS BIGINT) AS batch FROM pages""")
def batch_number(t):
    return Mo.batch_numbers(t.pages.select("page_id"), "page_id", 10)


@query("budgeted_queue", "T6", """SELECT event_id, CAST(ts AS DATE) AS run, CAST(row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS BIGINT) AS queue_pos,
  CASE WHEN queue_pos <= 10 THEN 'now' ELSE 'deferred' END AS status FROM events""")
def budgeted_queue(t):
    e = t.events.select("event_id", F.to_date("ts").alias("run"), F.unix_micros(F.col("ts").cast("timestamp")).alias("_t"))
    return Mo.budgeted_queue(e, ["run"], F.col("_t"), "event_id", 10).drop("_t")


@query("change_feed", "S9", """SELECT user_id, CAST(ts AS DATE) AS run, CAST(count(*) AS BIGINT) AS n_items,
  string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS item_ids, max(value) AS best FROM events GROUP BY 1, 2""")
def change_feed(t):
    e = t.events.select("user_id", F.to_date("ts").alias("run"), "event_id", "value")
    f = Mo.change_feed(e, ["user_id", "run"], "event_id", ["value"])
    return f.select("user_id", "run", "n_items", F.array_join(F.transform("items", lambda x: x["event_id"].cast("string")), ",").alias("item_ids"),
                    F.array_max(F.transform("items", lambda x: x["value"])).alias("best"))


@query("seen_filter", "J3", """SELECT page_id, url FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels) AND page_id NOT IN (SELECT conv_id FROM conversations)""")
def seen_filter(t):
    return J.unseen(t.pages.select("page_id", "url"), ["page_id"], t.labels.select(F.col("doc_id").alias("page_id")),
                    t.conversations.select(F.col("conv_id").alias("page_id")))


@query("collected_keywords", "S11", """SELECT DISTINCT user_id, event_type FROM events WHERE (user_id, event_type) NOT IN (SELECT user_id, event_type FROM events WHERE value > 100)""")
def collected_keywords(t):
    todo = t.events.select("user_id", "event_type").distinct()
    return J.unseen(todo, ["user_id", "event_type"], t.events.where("value > 100"))


@query("pending_pages", "D7", """SELECT page_id FROM pages EXCEPT SELECT doc_id FROM labels""")
def pending_pages(t):
    return J.unseen(t.pages.select("page_id"), ["page_id"], t.labels.select(F.col("doc_id").alias("page_id")))


@query("watchlist", "J4", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def watchlist(t):
    names = t.orders.where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return J.watched(t.customer.select("c_custkey", "c_name"), ["c_custkey"], names)


@query("profile_enrichment", "J5", """SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0""")
def profile_enrichment(t):
    prof = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return t.orders.select("o_orderkey", "o_custkey").join(prof, "o_custkey", "left")


@query("coalesce_upsert", "J7", """WITH old AS (SELECT * FROM orders WHERE o_orderdate < '1998-01-01' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
n AS (SELECT o_custkey, arg_max(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderstatus <> 'P') AS price,
  arg_max(o_orderpriority, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderpriority <> '5-LOW') AS prio FROM orders WHERE o_orderdate >= '1998-01-01' GROUP BY 1)
SELECT coalesce(n.o_custkey, old.o_custkey) AS o_custkey, coalesce(n.price, old.o_totalprice) AS o_totalprice, coalesce(n.prio, old.o_orderpriority) AS o_orderpriority
FROM old FULL JOIN n ON n.o_custkey = old.o_custkey""")
def coalesce_upsert(t):
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus")
    old = J.latest_rows(o.where("o_orderdate < '1998-01-01'"), ["o_custkey"], ORDER).select("o_custkey", "o_totalprice", "o_orderpriority")
    new = o.where("o_orderdate >= '1998-01-01'").select(
        "o_custkey", "o_orderkey", "o_orderdate", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("o_totalprice"),
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    return J.merge_known(old, new, ["o_custkey"], ORDER)


@query("replace_upsert", "J7 S3", """SELECT o_custkey, o_orderkey, o_totalprice, CASE WHEN o_orderdate >= '1998-01-01' THEN 'new' ELSE 'old' END AS origin FROM (
  (SELECT * FROM orders WHERE o_orderdate >= '1998-01-01') UNION ALL (SELECT * FROM orders WHERE o_orderdate < '1998-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= '1998-01-01')))""")
def replace_upsert(t):
    o = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    new = o.where("o_orderdate >= '1998-01-01'").drop("o_orderdate").withColumn("origin", F.lit("new"))
    old = o.where("o_orderdate < '1998-01-01'").drop("o_orderdate").withColumn("origin", F.lit("old"))
    return J.replace_rows(old, new, ["o_custkey"])


@query("stored_upsert", "J7", """SELECT o_custkey, o_orderkey, o_totalprice, CASE WHEN o_orderdate < '1997-01-01' THEN 'first' WHEN o_orderdate < '1998-01-01' THEN 'second' ELSE 'third' END AS batch
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def stored_upsert(t):
    """The latest order of each customer in a stored table, which takes three batches; the last one comes twice."""
    o = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    parts = {"first": "o_orderdate < '1997-01-01'", "second": "o_orderdate >= '1997-01-01' AND o_orderdate < '1998-01-01'", "third": "o_orderdate >= '1998-01-01'"}
    stored = None
    for name in [*parts, "third"]:
        new = J.latest_rows(o.where(parts[name]), ["o_custkey"], ORDER).select("o_custkey", "o_orderkey", "o_totalprice", F.lit(name).alias("batch"))
        stored = stored or StoredTable(t.spark, scratch_path(t.spark, "stored"), new.schema, ["o_custkey"], 16)
        stored.merge(new, name, lambda old, changes: J.replace_rows(old, changes, ["o_custkey"]))
    return stored.read()


@query("insert_missing", "J7", """SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL
SELECT DISTINCT o_custkey, '' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def insert_missing(t):
    old = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    new = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.lit("").alias("c_name")).distinct()
    return J.insert_missing(old, new, ["c_custkey"])


@query("previous_day_inherit", "J9", """SELECT c.c_custkey, c.c_name, coalesce(p.c_mktsegment, '?NEW') AS grade FROM customer c LEFT JOIN (SELECT c_name, c_mktsegment FROM customer WHERE c_acctbal > 0) p USING (c_name)""")
def previous_day_inherit(t):
    prev = t.customer.where("c_acctbal > 0").select("c_name", F.col("c_mktsegment").alias("grade"))
    return J.inherit_labels(t.customer.select("c_custkey", "c_name"), prev, "c_name", ["grade"])


@query("recent_fallback", "J10", """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(count(*) AS BIGINT) AS density FROM events GROUP BY 1, 2)
SELECT a.user_id, a.day, a.density, b.day AS base_day, b.density AS base_density FROM d a LEFT JOIN d b ON a.user_id = b.user_id AND b.day BETWEEN a.day - 5 AND a.day - 1
QUALIFY row_number() OVER (PARTITION BY a.user_id, a.day ORDER BY b.day DESC) = 1""")
def recent_fallback(t):
    d = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("density"))
    return J.recent_before(d, d, ["user_id"], "day", "density", 5)


@query("valid_posts", "F10", """SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE props IS NULL) AS BIGINT) AS n_no_raw,
  CAST(count(*) FILTER (WHERE props IS NOT NULL AND event_type = 'error') AS BIGINT) AS n_news, CAST(count(*) FILTER (WHERE event_type <> 'error' AND value <= 5) AS BIGINT) AS n_no_follower,
  CAST(count(*) FILTER (WHERE event_type <> 'error' AND value > 5 AND ts IS NULL) AS BIGINT) AS n_no_time, CAST(count(*) FILTER (WHERE event_type <> 'error' AND value > 5) AS BIGINT) AS n_ok FROM events""")
def valid_posts(t):
    return Mo.drop_counters(t.events, {"no_raw": F.col("props").isNull(), "news": F.col("event_type") == "error",
                                       "no_follower": F.col("value") <= 5, "no_time": F.col("ts").isNull()})


@query("score_gate", "F12", """WITH q AS (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 8000 ORDER BY c_acctbal DESC, c_custkey LIMIT 15)
SELECT c_custkey, CASE WHEN c_custkey IN (SELECT c_custkey FROM q) THEN 'added' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 8000 THEN 'waiting'
  WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'candidate' ELSE 'context' END AS status FROM customer""")
def score_gate(t):
    return Mo.score_gate(t.customer, F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "c_acctbal", "c_custkey", 8000, 15).select("c_custkey", "status")


COUNTRY_WORDS = {"one": ["NATION_1"], "two": ["NATION_2"], "seven": ["NATION_7"]}


@query("country_required_filter", "F13", """SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE (contains(n_name, 'NATION_1') OR contains(n_name, 'NATION_2') OR contains(n_name, 'NATION_7')) AND (c_acctbal = 0 OR c_acctbal >= 1000)""")
def country_required_filter(t):
    d = t.customer.select("c_custkey", "c_nationkey", "c_acctbal").join(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    found = F.size(R.dictionary_labels(F.col("n_name"), COUNTRY_WORDS)) > 0
    return d.where(found & ((F.col("c_acctbal") == 0) | (F.col("c_acctbal") >= 1000))).select("c_custkey", "n_name")


@query("stale_posts", "F14", f"""SELECT o_orderkey, CAST(o_orderdate AS DATE) < {AS_OF_SQL} - 700 AS stale FROM orders""")
def stale_posts(t):
    return t.orders.select("o_orderkey", Mo.is_stale(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"), as_of(), 700).alias("stale"))


@query("dirty_page_guard", "F15", """SELECT o_orderkey, c_custkey, lower(regexp_replace(c_name, '[^0-9A-Za-z]+', '', 'g')) = 'customer' || lpad(CAST(o_orderkey % 2000 AS VARCHAR), 9, '0') AS ok
FROM orders JOIN customer ON o_custkey = c_custkey""")
def dirty_page_guard(t):
    scraped = F.concat(F.lit("Customer #"), F.lpad((F.col("o_orderkey") % 2000).cast("string"), 9, "0"))
    pages = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"), scraped.alias("scraped"))
    norm = dict(keep="0-9A-Za-z", lower=True)
    return Mo.dirty_page_guard(pages, t.customer.select("c_custkey", "c_name"), "c_custkey", T.normalize_name(F.col("scraped"), **norm),
                               T.normalize_name(F.col("c_name"), **norm)).select("o_orderkey", "c_custkey", "ok")


@query("outlier_null", "F16", "SELECT c_custkey, CASE WHEN c_acctbal > 0 AND c_acctbal <= 9000 THEN c_acctbal END AS followers FROM customer")
def outlier_null(t):
    return t.customer.select("c_custkey", M.null_outliers(F.col("c_acctbal"), 9000).alias("followers"))


@query("message_browse", "F17", """WITH s AS (SELECT user_id FROM events GROUP BY user_id ORDER BY min(ts) DESC, user_id DESC LIMIT 1)
SELECT event_id, user_id, event_type, ts FROM events WHERE user_id = (SELECT user_id FROM s) AND event_type = 'view' ORDER BY ts, event_id LIMIT 50""")
def message_browse(t):
    return Mo.message_browse(t.events.select("event_id", "user_id", "event_type", "ts"), "user_id", "ts", "event_id", 50, "view")


@query("ratio_sanity", "F18", """SELECT o_orderkey, CASE WHEN o_totalprice / nullif(c_acctbal, 0) <= 50 THEN round(o_totalprice / c_acctbal, 9) END AS likes_per_follower
FROM orders JOIN customer ON o_custkey = c_custkey""")
def ratio_sanity(t):
    d = t.orders.select("o_orderkey", "o_custkey", "o_totalprice").join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey")
    return d.select("o_orderkey", F.round(Mo.ratio_sanity(F.col("o_totalprice"), F.col("c_acctbal")), 9).alias("likes_per_follower"))


@query("news_filter", "F9", """SELECT s_suppkey, s_name, regexp_matches(lower(n_name), '(nation_7|nation_1)') OR (n_name <> '' AND contains(lower(s_name), '00003')) AS is_news
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def news_filter(t):
    d = t.supplier.select("s_suppkey", "s_name", "s_nationkey").join(t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    words = ["NATION_7", "NATION_1", "00003"]
    return d.select("s_suppkey", "s_name", Mo.is_news(F.col("s_name"), F.col("n_name"), F.lit(None).cast("string"), words).alias("is_news"))


@query("anchored_services", "F11", """SELECT doc_id FROM documents WHERE (contains(text, 'tion') OR contains(text, 'ment')) AND NOT (contains(text, 'idiot') OR contains(text, 'pathetic'))
  AND (contains(text, 'License') OR contains(text, '$$$') OR ((contains(text, 'que') OR contains(text, 'with')) AND (contains(text, 'eau') OR contains(text, 'ther'))))""")
def anchored_services(t):
    return t.documents.where(Mo.anchored_service(F.col("text"), ["tion", "ment"], ["idiot", "pathetic"], ["License", "$$$"],
                                                 ["que", "with"], ["eau", "ther"])).select("doc_id")


@query("session_counts", "A33", """SELECT user_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS n_view,
  CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS n_click, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS n_purchase FROM events GROUP BY user_id""")
def session_counts(t):
    return Mo.session_counts(t.events, "user_id", "event_type", ["view", "click", "purchase"])


@query("best_version", "D2", """SELECT c_nationkey, c_custkey, c_name FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal) + 10 * length(c_mktsegment) DESC, c_custkey) = 1""")
def best_version(t):
    d = t.customer.select("c_nationkey", "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return D.best_version(d, ["c_nationkey"], F.floor("c_acctbal") + 10 * F.length("c_mktsegment"), ["c_custkey"]).select("c_nationkey", "c_custkey", "c_name")


@query("priority_union", "D4", """SELECT c_custkey, 'found' AS origin FROM customer WHERE c_acctbal > 5000 UNION ALL
SELECT DISTINCT o_custkey, 'history' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)""")
def priority_union(t):
    first = t.customer.where("c_acctbal > 5000").select("c_custkey", F.lit("found").alias("origin"))
    return D.union_unknown(first, t.orders.select(F.col("o_custkey").alias("c_custkey"), F.lit("history").alias("origin")).distinct(), ["c_custkey"])


@query("unique_comments", "D6", """SELECT conv_id, text, min(turn) AS turn FROM conversations GROUP BY conv_id, text""")
def unique_comments(t):
    return D.unique_items(t.conversations.select("conv_id", "text", "turn"), ["conv_id", "text"], ["turn"])


_LEDGER = """ledger AS (SELECT page_id, code, 'SRC-' || code || '-' || lpad(CAST(rn AS VARCHAR), CAST(greatest(3, length(CAST(rn AS VARCHAR))) AS INT), '0') AS source_id, rn FROM (
  SELECT page_id, code, row_number() OVER (PARTITION BY code ORDER BY page_id) AS rn FROM items WHERE page_id IN (SELECT doc_id FROM labels)))"""


@query("stable_ids", "D8", f"""WITH items AS (SELECT page_id, upper(regexp_extract(url, 'https?://[^/]+/([a-z]+)/', 1)) AS code FROM pages), {_LEDGER},
top AS (SELECT code, max(rn) AS t FROM ledger GROUP BY code),
fresh AS (SELECT i.page_id, i.code, coalesce(t, 0) + row_number() OVER (PARTITION BY i.code ORDER BY i.page_id) AS n FROM items i LEFT JOIN top USING (code)
  WHERE i.page_id NOT IN (SELECT page_id FROM ledger))
SELECT page_id, code, source_id, false AS is_new FROM ledger UNION ALL
SELECT page_id, code, 'SRC-' || code || '-' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INT), '0'), true FROM fresh""")
def stable_ids(t):
    items = t.pages.select("page_id", F.upper(F.regexp_extract("url", r"https?://[^/]+/([a-z]+)/", 1)).alias("code"))
    nothing = items.limit(0).withColumn("source_id", F.lit(""))
    seen = J.watched(items, ["page_id"], t.labels.select(F.col("doc_id").alias("page_id")))
    ledger = D.allocate_ids(seen, nothing, "page_id", "code", "page_id").select("page_id", "code", "source_id")
    out = D.allocate_ids(items, write_through(ledger, "ledger"), "page_id", "code", "page_id")
    return out.select("page_id", "code", "source_id", "is_new")


@query("purge_accounts", "D9", """WITH bad AS (SELECT c_custkey FROM customer WHERE c_acctbal < -800)
SELECT 'accounts' AS part, CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_custkey NOT IN (FROM bad)
UNION ALL SELECT 'snapshots', CAST(count(*) AS BIGINT) FROM orders WHERE o_custkey NOT IN (FROM bad)
UNION ALL SELECT 'kept_posts', CAST(count(DISTINCT o_custkey) AS BIGINT) FROM orders WHERE o_custkey IN (FROM bad) AND o_orderstatus = 'F'
UNION ALL SELECT 'blacklist', CAST(count(*) AS BIGINT) FROM (SELECT c_custkey FROM bad UNION SELECT c_custkey FROM customer WHERE c_acctbal > 9900)""")
def purge_accounts(t):
    acc = t.customer.select("c_custkey", "c_acctbal")
    s = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    parts = D.purge_accounts(acc, s, s.where("o_orderstatus = 'F'"), acc.where("c_acctbal < -800").select("c_custkey", F.lit("low").alias("reason")),
                             acc.where("c_acctbal > 9900").select("c_custkey", F.lit("manual").alias("reason")), "c_custkey")
    out = None
    for name, df in parts.items():
        one = df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("import_existing", "D10", """SELECT conv_id, max(turn) AS checked_at, CAST(count(*) AS BIGINT) AS video_count_seen, CAST(count(DISTINCT text) AS BIGINT) AS confirmed
FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels) GROUP BY conv_id""")
def import_existing(t):
    parts = D.import_existing(t.conversations.select("conv_id", "turn", "text"), t.labels.select(F.col("doc_id").alias("conv_id")), "conv_id", "text", "turn")
    done = parts["items"].groupBy("conv_id").agg(F.count(F.lit(1)).alias("confirmed"))
    return parts["snapshots"].join(done, "conv_id").select("conv_id", "checked_at", "video_count_seen", "confirmed")
