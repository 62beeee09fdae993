"""Stream queries: events are live messages, the user is the room session."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import new_items as Ni, windows as Wi
from tidemark.plans.registry import query
from tidemark.session import rocksdb_state, scratch_path
from tidemark.streaming import messages as Me, rooms as Ro

METHODS = {"view": "WebcastChatMessage", "purchase": "WebcastGiftMessage", "signup": "WebcastMemberMessage",
           "click": "WebcastLikeMessage", "error": "WebcastControlMessage"}


def decoded(events):
    """Events in the shape of decoded room messages."""
    method = F.lit(None).cast("string")
    for k, m in METHODS.items():
        method = F.when(F.col("event_type") == k, m).otherwise(method)
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("user_id").alias("session_id"), F.when(k < 20, "").otherwise(F.col("event_id").cast("string")).alias("msg_id"), method.alias("method"),
        F.col("user_id").cast("string").alias("user_id"), F.concat(F.lit("user "), F.col("user_id")).alias("username"),
        F.concat(F.lit("note k"), k, F.lit(" and value v"), F.floor(F.col("value") / 50)).alias("content"), F.lit("rose").alias("gift_name"),
        k.alias("gift_id"), F.lit(1).alias("repeat_count"), (k % 4).alias("action"), F.col("ts").cast("timestamp").alias("ts"))


def event_stream(t):
    """The events table as a file stream."""
    return t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.path)


def finished(t, frame, label, shape=None, mode="append"):
    """Run a stream over the data that is there and read what it wrote."""
    path = scratch_path(t.spark, label)
    with rocksdb_state(t.spark):
        Me.write_batches(frame, f"{path}/out", f"{path}/checkpoint", shape, interval=None, mode=mode).awaitTermination()
    return t.spark.read.parquet(f"{path}/out")


MSG_SQL = """msg AS (SELECT user_id AS session_id, CASE WHEN k >= 20 THEN CAST(event_id AS VARCHAR) END AS msg_id,
  CASE event_type WHEN 'view' THEN 'chat' WHEN 'purchase' THEN 'gift' WHEN 'click' THEN 'like' ELSE CASE WHEN k % 4 = 1 THEN 'enter' ELSE 'leave' END END AS msg_type,
  CASE event_type WHEN 'view' THEN 'note k' || k || ' and value v' || CAST(floor(value / 50) AS BIGINT) WHEN 'purchase' THEN 'rose' WHEN 'signup' THEN CASE WHEN k % 4 NOT IN (1, 2) THEN 'action=' || (k % 4) END END AS content,
  CASE WHEN event_type = 'purchase' THEN '{"gift_id":' || k || ',"repeat_count":1}' END AS extra, ts
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) WHERE event_type <> 'error')"""


def wall(c):
    """Timestamps without a zone, as in the table."""
    return F.col(c).cast("timestamp_ntz").alias(c)


@query("normalized_messages", "R1", f"WITH {MSG_SQL} SELECT session_id, msg_id, msg_type, content, extra, ts AS timestamp FROM msg")
def normalized_messages(t):
    return Me.normalize_messages(decoded(t.events)).select("session_id", "msg_id", "msg_type", "content", "extra", wall("timestamp"))


@query("streamed_messages", "R1 R3", f"WITH {MSG_SQL} SELECT session_id, msg_id, msg_type, content, extra, ts AS timestamp FROM msg")
def streamed_messages(t):
    d = finished(t, Me.normalize_messages(decoded(event_stream(t))), "messages")
    return d.select("session_id", "msg_id", "msg_type", "content", "extra", wall("timestamp"))


def _twice(events):
    return events.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")


_DEDUP = f"""WITH {MSG_SQL} SELECT msg_type, CAST(sum(CASE WHEN msg_id IS NULL THEN 2 ELSE 1 END) AS BIGINT) AS n, CAST(count(DISTINCT msg_id) AS BIGINT) AS n_ids FROM msg GROUP BY msg_type"""


@query("deduplicated_messages", "R2", _DEDUP)
def deduplicated_messages(t):
    d = Me.dedup_messages(Me.normalize_messages(decoded(_twice(t.events))))
    return d.groupBy("msg_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("msg_id").alias("n_ids"))


@query("stream_dedup", "R2 R3", _DEDUP)
def stream_dedup(t):
    d = finished(t, Me.dedup_messages(Me.normalize_messages(decoded(_twice(event_stream(t))))), "dedup")
    return d.groupBy("msg_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("msg_id").alias("n_ids"))


_LIFE = """SELECT user_id AS session_id, min(ts) AS started_at, max(ts) AS last_at, CAST(count(*) AS BIGINT) AS n_messages, max(ts) FILTER (WHERE event_type = 'error' AND k % 4 = 3) AS ended_at,
  CASE WHEN count(*) FILTER (WHERE event_type = 'error' AND k % 4 = 3) > 0 THEN 'ended' ELSE 'live' END AS status FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) GROUP BY user_id"""


def _sessions(events):
    """A room ends with its control message; the status is the decoded action."""
    d = decoded(events).select("session_id", F.col("ts").alias("timestamp"), Me.ends_room(F.col("method"), F.col("action")).alias("ends"))
    return Me.session_lifecycle(d, ended=F.col("ends"))


def _shown(d):
    return d.select("session_id", wall("started_at"), wall("last_at"), "n_messages", wall("ended_at"), "status")


@query("session_lifecycle", "R4", _LIFE)
def session_lifecycle(t):
    return _shown(_sessions(t.events))


@query("streamed_sessions", "R4 R3", _LIFE)
def streamed_sessions(t):
    d = finished(t, _sessions(event_stream(t)), "sessions", mode="update")
    return _shown(d.groupBy("session_id").agg(F.max_by(F.struct("started_at", "last_at", "n_messages", "ended_at", "status"), "batch_id").alias("r")).select("session_id", "r.*"))


_WORDS = f"""{MSG_SQL}, w AS (SELECT session_id, time_bucket(INTERVAL 30 MINUTE, ts) AS start, unnest(regexp_extract_all(content, '[a-z0-9]{{2,}}')) AS word FROM msg WHERE msg_type = 'chat'),
c AS (SELECT session_id, start, start + INTERVAL 30 MINUTE AS "end", word, count(*) AS n FROM w WHERE word NOT IN ('and') GROUP BY ALL),
top AS (SELECT session_id, start, "end", word, CAST(n AS BIGINT) AS n, CAST(row_number() OVER (PARTITION BY session_id, start ORDER BY n DESC, word) AS BIGINT) AS rank FROM c QUALIFY rank <= 5)"""


def _chat_words(events):
    chat = Me.normalize_messages(decoded(events)).where("msg_type = 'chat'")
    return Me.window_words(chat, "session_id", "timestamp", "content", "[a-z0-9]{2,}", 30, stop_words=["and"])


@query("window_keywords", "W11", f"WITH {_WORDS} SELECT * FROM top")
def window_keywords(t):
    d = Me.window_keywords(_chat_words(t.events), "session_id")
    return d.select("session_id", wall("start"), wall("end"), "word", "n", "rank")


@query("live_topic_windows", "R5 W11", f"WITH {_WORDS} SELECT * FROM top")
def live_topic_windows(t):
    """All windows: those the watermark closed, and at the end of the stream those that were still open."""
    counts = finished(t, _chat_words(event_stream(t)), "topics", mode="update")
    d = Me.window_keywords(Me.latest_counts(counts, ["session_id", "start", "end", "word"]), "session_id")
    return d.select("session_id", wall("start"), wall("end"), "word", "n", "rank")


@query("tumbling_windows", "W10", """SELECT user_id, time_bucket(INTERVAL 5 MINUTE, ts) AS start, CAST(count(*) AS BIGINT) AS msg_count FROM events GROUP BY 1, 2""")
def tumbling_windows(t):
    e = t.events.select("user_id", F.window(F.col("ts").cast("timestamp"), "5 minutes").alias("w")).groupBy("user_id", "w").agg(F.count(F.lit(1)).alias("msg_count"))
    return e.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "msg_count")


_ANCHORED = """t AS (SELECT DISTINCT user_id, ts FROM events), s AS (SELECT user_id, min(ts) AS start FROM t GROUP BY 1
  UNION ALL SELECT s.user_id, (SELECT min(t.ts) FROM t WHERE t.user_id = s.user_id AND t.ts >= s.start + INTERVAL 12 HOUR) FROM s WHERE s.start IS NOT NULL),
w AS (SELECT user_id, start, lead(start) OVER (PARTITION BY user_id ORDER BY start) AS nxt FROM s WHERE start IS NOT NULL),
m AS (SELECT w.user_id, start, nxt, ts, event_type FROM w JOIN events e ON e.user_id = w.user_id AND e.ts >= start AND e.ts < start + INTERVAL 12 HOUR)"""


@query("anchored_windows", "W10", f"""WITH RECURSIVE {_ANCHORED}
SELECT user_id, start, coalesce(nxt, max(ts)) AS "end", CAST(count(*) AS BIGINT) AS msg_count FROM m GROUP BY user_id, start, nxt""")
def anchored_windows(t):
    d = Wi.anchored_windows(t.events, "user_id", "ts", minutes=720, chunk_minutes=2880)
    return d.select("user_id", wall("start"), wall("end"), "msg_count")


@query("anchored_keywords", "W11 W10", f"""WITH RECURSIVE {_ANCHORED} SELECT user_id, start, event_type AS word, CAST(count(*) AS BIGINT) AS n,
  CAST(row_number() OVER (PARTITION BY user_id, start ORDER BY count(*) DESC, event_type) AS BIGINT) AS rank FROM m GROUP BY user_id, start, event_type QUALIFY rank <= 5""")
def anchored_keywords(t):
    d = Wi.anchored_keywords(t.events.select("user_id", "ts", "event_type"), "user_id", "ts", "event_type", "[a-z]{2,}", minutes=720)
    return d.select("user_id", wall("start"), "word", "n", "rank")


@query("streamed_anchored_windows", "R5 W10 W11", f"""WITH RECURSIVE {_ANCHORED},
c AS (SELECT user_id, start, event_type, count(*) AS n FROM m GROUP BY ALL),
k AS (SELECT user_id, start, string_agg(event_type || ':' || n, ',' ORDER BY n DESC, event_type) AS words FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id, start ORDER BY n DESC, event_type) <= 3) GROUP BY ALL)
SELECT user_id, start, coalesce(nxt, max(ts)) AS "end", CAST(count(*) AS BIGINT) AS msg_count, any_value(words) AS words FROM m JOIN k USING (user_id, start) GROUP BY user_id, start, nxt""")
def streamed_anchored_windows(t):
    """Anchored windows while the rooms are live: the closed ones, and the others as they stand at the end of the stream."""
    e = event_stream(t).select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    d = finished(t, Ro.anchored_topics(e, "user_id", "ts", F.array("event_type"), minutes=720, k=3), "anchored")
    return Ro.latest_windows(d).select(F.col("session").alias("user_id"), wall("start"), wall("end"), "msg_count", "words")


@query("finished_sessions", "R4", """WITH m AS (SELECT user_id, ts, event_type = 'error' AND CAST(json_extract_string(props, '$.k') AS INT) % 4 = 3 AS ends FROM events
  WHERE ts <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)),
b AS (SELECT *, coalesce(lag(ends) OVER o, true) OR ts > lag(ts) OVER o + INTERVAL 24 HOUR AS opens FROM m WINDOW o AS (PARTITION BY user_id ORDER BY ts, ends)),
s AS (SELECT *, sum(opens::int) OVER (PARTITION BY user_id ORDER BY ts, ends ROWS UNBOUNDED PRECEDING) AS nr FROM b),
g AS (SELECT user_id, nr, min(ts) AS started_at, max(ts) AS last_at, CAST(count(*) AS BIGINT) AS n_messages, bool_or(ends) AS ended FROM s GROUP BY ALL)
SELECT user_id, started_at, last_at, n_messages, CASE WHEN ended THEN last_at ELSE last_at + INTERVAL 24 HOUR END AS ended_at, CASE WHEN ended THEN 'ended' ELSE 'timed_out' END AS status
FROM g WHERE ended OR last_at + INTERVAL 24 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)""")
def finished_sessions(t):
    """Sessions that their control message or a day of silence has ended, by the stream's last watermark."""
    e = decoded(event_stream(t)).select("session_id", "ts", Me.ends_room(F.col("method"), F.col("action")).alias("ends"))
    d = finished(t, Ro.room_sessions(e, "session_id", "ts", F.col("ends"), "24 hours"), "rooms")
    at = lambda c, name: F.timestamp_micros(c).cast("timestamp_ntz").alias(name)
    return d.select(F.col("session").alias("user_id"), at("started_us", "started_at"), at("last_us", "last_at"), "n_messages", at("ended_us", "ended_at"), "status")


# --- listings: a user's events of a day are what was seen of the account in that run -------------

_LIST = """l0 AS (SELECT user_id AS account, CAST(ts AS DATE) AS run, event_type || '-' || (CAST(json_extract_string(props, '$.k') AS INT) // 10) AS item, ts, event_id FROM events),
l1 AS (SELECT account, run, item, row_number() OVER (PARTITION BY account, run ORDER BY ts, event_id) - 1 AS pos FROM l0),
l AS (SELECT account, run, item, min(pos) AS pos FROM l1 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY account, item ORDER BY run) AS k FROM l),
f AS (SELECT account, item, max(run) FILTER (WHERE k = 1) AS first_run, CAST(max(pos) FILTER (WHERE k = 1) AS BIGINT) AS first_pos, max(run) FILTER (WHERE k = 2) AS second_run FROM r GROUP BY ALL),
b AS (SELECT account, min(run) AS base_run FROM l GROUP BY 1),
hd AS (SELECT account, item, first_run, first_pos, second_run, CASE WHEN first_run = base_run THEN 'baseline' WHEN first_pos >= 2 THEN 'deep_position' WHEN second_run IS NULL THEN 'queued' ELSE 'confirmed' END AS status FROM f JOIN b USING (account))"""


def listings(t):
    k = F.floor(F.get_json_object("props", "$.k").cast("int") / 10)
    e = t.events.select(F.col("user_id").alias("account"), F.to_date("ts").alias("run"), F.concat_ws("-", "event_type", k).alias("item"), "ts", "event_id")
    from pyspark.sql import Window as W

    pos = F.row_number().over(W.partitionBy("account", "run").orderBy("ts", "event_id")) - 1
    return e.select("account", "run", "item", pos.cast("long").alias("pos"))


@query("new_items_by_head", "R7", f"WITH {_LIST} SELECT * FROM hd")
def new_items_by_head(t):
    return Ni.detect_by_head(listings(t), head=2)


@query("stale_new_items", "R7 F14", f"""WITH {_LIST}, p AS (SELECT account, item, min(run) - CAST(account % 20 AS INT) AS published FROM l GROUP BY account, item)
SELECT hd.account, hd.item, first_run, first_pos, second_run, CASE WHEN status = 'confirmed' AND datediff('day', published, second_run) > 7 THEN 'stale' ELSE status END AS status FROM hd JOIN p USING (account, item)""")
def stale_new_items(t):
    ls = listings(t)
    pub = ls.groupBy("account", "item").agg(F.min("run").alias("r")).select("account", "item", F.date_sub("r", (F.col("account") % 20).cast("int")).alias("published"))
    return Ni.detect_by_head(ls, 2, pub)


@query("retry_backlog", "R8", f"""WITH {_LIST}, done AS (SELECT account, item, run AS done_run FROM r WHERE k = 3)
SELECT hd.account, hd.item, second_run AS first_open, max(rr.run) AS last_open, done_run IS NOT NULL AS arrived
FROM hd LEFT JOIN done ON done.account = hd.account AND done.item = hd.item JOIN (SELECT DISTINCT account, run FROM l) rr ON rr.account = hd.account
WHERE status = 'confirmed' AND rr.run >= second_run AND (done_run IS NULL OR rr.run <= done_run) GROUP BY hd.account, hd.item, second_run, done_run""")
def retry_backlog(t):
    ls = listings(t)
    from pyspark.sql import Window as W

    seen = ls.select("account", "item", "run").distinct()
    third = seen.withColumn("k", F.row_number().over(W.partitionBy("account", "item").orderBy("run"))).where("k = 3").drop("k")
    return Ni.retry_backlog(Ni.detect_by_head(ls, 2), third, ls.select("account", "run").distinct())


# one release in a run: the runs of an account are replayed with the list of the items released so far
_QUOTA = f"""WITH RECURSIVE {_LIST}, rn AS (SELECT account, run, row_number() OVER (PARTITION BY account ORDER BY run) AS k FROM (SELECT DISTINCT account, run FROM l)),
g AS (SELECT account, run, count(*) AS quota FROM l GROUP BY ALL),
fr AS (SELECT f.*, base_run, row_number() OVER (PARTITION BY f.account, first_run ORDER BY first_pos, f.item) <= CASE WHEN first_run > base_run THEN quota ELSE 0 END AS ok
  FROM f JOIN b USING (account) JOIN g ON g.account = f.account AND g.run = first_run),
c AS (SELECT l.account, k, l.run, l.item, pos FROM l JOIN fr ON fr.account = l.account AND fr.item = l.item AND ok AND l.run > first_run JOIN rn ON rn.account = l.account AND rn.run = l.run),
z AS (SELECT DISTINCT account, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS gone, CAST(NULL AS VARCHAR) AS item, CAST(NULL AS DATE) AS run FROM l
  UNION ALL SELECT z.account, rn.k, CASE WHEN min(c.item) IS NULL THEN z.gone ELSE list_append(z.gone, arg_min(c.item, (c.pos, c.item))) END, arg_min(c.item, (c.pos, c.item)), rn.run
  FROM z JOIN rn ON rn.account = z.account AND rn.k = z.k + 1 LEFT JOIN c ON c.account = z.account AND c.k = rn.k AND NOT list_contains(z.gone, c.item) GROUP BY z.account, rn.k, z.gone, rn.run)
SELECT fr.account, fr.item, first_run, first_pos, z.run AS released_run,
  CASE WHEN z.run IS NOT NULL THEN 'released' WHEN first_run = base_run THEN 'baseline' WHEN ok THEN 'queued' ELSE 'known' END AS status
FROM fr LEFT JOIN z ON z.account = fr.account AND z.item = fr.item"""


@query("new_items_by_quota", "R6", _QUOTA)
def new_items_by_quota(t):
    ls = listings(t)
    from pyspark.sql import Window as W

    per = ls.groupBy("account", "run").agg(F.countDistinct("item").alias("n"))
    totals = per.withColumn("total", F.sum("n").over(W.partitionBy("account").orderBy("run").rowsBetween(W.unboundedPreceding, 0))).drop("n")
    return Ni.detect_by_quota(ls, totals, F.trunc("run", "month"), limit=1)
