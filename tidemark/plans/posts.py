"""Post queries: an event is a post (value = likes, k = saves); documents carry titles, tags and bodies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import metrics as M, rules as R, text as T
from tidemark.operators import posts as P
from tidemark.plans.registry import query
from tidemark.session import write_through

POSTS = """posts AS (SELECT event_id, user_id, event_type, ts, value,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
VIRAL = POSTS + """, v AS (SELECT *, row_number() OVER (ORDER BY value + k * 3.0 DESC, event_id)
  <= greatest(1, (SELECT count(*) FROM posts) // 10) AS viral FROM posts)"""


def posts(t):
    return t.events.select("event_id", "user_id", "event_type", "ts", "value",
                           F.get_json_object("props", "$.k").cast("long").alias("k"))


def flagged(t):
    p = posts(t).withColumn("score", M.weighted_engagement({"value": 1, "k": 3}))
    return P.viral_flag(p, "score", "event_id")


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 9) for c in cols})


@query("viral_posts", "W1", f"WITH {VIRAL} SELECT event_id, viral FROM v")
def viral_posts(t):
    return flagged(t).select("event_id", "viral")


@query("engagement_ratios", "U14", f"""WITH {POSTS}
SELECT event_id, value + k + 1 + 2 AS total_engagement, round(k / greatest(value, 1), 9) AS comment_like_ratio,
  round(1 / greatest(value, 1), 9) AS share_like_ratio, round(2 / greatest(value, 1), 9) AS collect_like_ratio,
  round((value + k + 1 + 2) / greatest(user_id, 1), 9) AS engagement_per_follower FROM posts""")
def engagement_ratios(t):
    d = posts(t).withColumn("shares", F.lit(1)).withColumn("saves", F.lit(2))
    d = M.engagement_ratios(d, "value", "k", "shares", "saves", "user_id")
    return rounded(d.select("event_id", "total_engagement", "comment_like_ratio", "share_like_ratio",
                       "collect_like_ratio", "engagement_per_follower"),
              "comment_like_ratio", "share_like_ratio", "collect_like_ratio", "engagement_per_follower")


@query("metric_overview", "A12", """WITH m AS (
  SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS metric,
         unnest([l_quantity, l_extendedprice, l_discount]) AS value FROM lineitem)
SELECT metric, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total, CAST(floor(avg(value)) AS BIGINT) AS mean,
  round(median(value), 9) AS median, max(value) AS high FROM m GROUP BY metric""")
def metric_overview(t):
    o = P.overview(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])
    return o.withColumn("total", F.round("total", 2)).withColumn("median", F.round("median", 9))


PRICE_BOUNDS = [(1000, "<1k"), (5000, "1k-5k"), (20000, "5k-20k"), (50000, "20k-50k")]


@query("price_buckets", "A13", """SELECT CASE WHEN l_extendedprice < 1000 THEN '<1k' WHEN l_extendedprice < 5000 THEN '1k-5k'
  WHEN l_extendedprice < 20000 THEN '5k-20k' WHEN l_extendedprice < 50000 THEN '20k-50k' ELSE '50k+' END AS bucket,
  CAST(count(*) AS BIGINT) AS n, CAST(floor(avg(l_quantity)) AS BIGINT) AS avg_l_quantity,
  CAST(floor(avg(l_extendedprice)) AS BIGINT) AS avg_l_extendedprice FROM lineitem GROUP BY 1""")
def price_buckets(t):
    b = R.bucket_label(F.col("l_extendedprice"), PRICE_BOUNDS, "50k+")
    return P.bucket_stats(t.lineitem, b, ["l_quantity", "l_extendedprice"])


TAGS = r"\p{Lu}\p{Ll}{3,7}"


@query("tag_performance", "A14", f"""WITH x AS (SELECT unnest(regexp_extract_all(text, '{TAGS}')) AS tag, n_chars FROM documents)
SELECT tag, CAST(count(*) AS BIGINT) AS n, round(avg(n_chars), 9) AS avg_n_chars FROM x GROUP BY tag HAVING count(*) >= 3
ORDER BY avg(n_chars) DESC, tag LIMIT 50""")
def tag_performance(t):
    return rounded(P.tag_performance(t.documents, T.words(F.col("text"), TAGS), ["n_chars"], k=50), "avg_n_chars")


FEATURES = {"has_number": r"\d", "has_mark": "[|]", "has_license": "(?i)licen[sc]e", "has_mail": "@"}


@query("title_feature_stats", "A15", f"""WITH f AS ({' UNION ALL '.join(f"SELECT '{n}=' || CAST(regexp_matches(text, '{p}') AS VARCHAR) AS feature, n_chars FROM documents" for n, p in FEATURES.items())}
UNION ALL SELECT 'len_group=' || CASE WHEN length(string_split(text, chr(10))[1]) <= 60 THEN 'short'
  WHEN length(string_split(text, chr(10))[1]) <= 120 THEN 'medium' ELSE 'long' END, n_chars FROM documents)
SELECT feature, CAST(count(*) AS BIGINT) AS n, CAST(floor(avg(n_chars)) AS BIGINT) AS avg_n_chars FROM f GROUP BY feature""")
def title_feature_stats(t):
    title = F.get(F.split("text", "\n"), F.lit(0))
    feats = {n: R.matches(F.col("text"), p) for n, p in FEATURES.items()}
    feats["len_group"] = R.bucket_label(F.length(title), [(60, "short"), (120, "medium")], "long", "right")
    return P.title_feature_stats(t.documents, feats, ["n_chars"])


@query("viral_rate_by", "A16", f"""WITH {VIRAL}, d AS (
  SELECT 'type' AS dim, event_type AS value, viral FROM v UNION ALL SELECT 'weekday', dayname(ts), viral FROM v
  UNION ALL SELECT 'block', CAST(hour(ts) // 4 AS VARCHAR), viral FROM v
  UNION ALL SELECT 'saves', CASE WHEN k < 10 THEN '0-9' WHEN k < 50 THEN '10-49' ELSE '50+' END, viral FROM v)
SELECT dim, value, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE viral) AS BIGINT) AS n_viral,
  round(count(*) FILTER (WHERE viral) * 100.0 / count(*), 9) AS viral_rate FROM d GROUP BY 1, 2""")
def viral_rate_by(t):
    out = P.viral_rate_by(flagged(t), {
        "type": P.one(F.col("event_type")), "weekday": P.one(F.date_format("ts", "EEEE")),
        "block": P.one(F.floor(F.hour("ts") / 4)),
        "saves": P.one(R.bucket_label(F.col("k"), [(10, "0-9"), (50, "10-49")], "50+"))})
    return rounded(out, "viral_rate")


COMBO = {"mark": ["|", "***"], "money": ["$$$", "%%%"], "license": ["License"], "article": ["the ", "der "],
         "link": ["que ", "de "]}
DOCV = """dv AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id)
  <= greatest(1, (SELECT count(*) FROM documents) // 10) AS viral FROM documents)"""


def long_docs(t):
    return P.viral_flag(t.documents, "n_chars", "doc_id")


@query("tag_combo_viral", "A17", f"""WITH {DOCV}, c AS (SELECT viral, list_sort([x FOR x IN [
  {', '.join(f"CASE WHEN {' OR '.join(f'''contains(text, '{w}')''' for w in ws)} THEN '{n}' END" for n, ws in COMBO.items())}] IF x IS NOT NULL]) AS tags FROM dv)
SELECT array_to_string(tags, '+') AS combo, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE viral) AS BIGINT) AS n_viral,
  round(count(*) FILTER (WHERE viral) * 100.0 / count(*), 9) AS viral_rate FROM c WHERE len(tags) >= 2
GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, combo LIMIT 50""")
def tag_combo_viral(t):
    return rounded(P.tag_combos(long_docs(t), R.dictionary_labels(F.col("text"), COMBO)), "viral_rate")


@query("author_consistency", "A18", f"""WITH {VIRAL}, a AS (SELECT user_id, CAST(count(*) AS BIGINT) AS n,
  CAST(count(*) FILTER (WHERE viral) AS BIGINT) AS n_viral, round(avg(value), 9) AS avg_metric, max(value) AS max_metric,
  round(count(*) FILTER (WHERE viral) * 100.0 / count(*), 9) AS viral_rate FROM v GROUP BY user_id)
SELECT *, CASE WHEN n_viral >= 3 THEN 'steady' WHEN n_viral >= 1 THEN 'occasional' ELSE 'none' END AS label FROM a""")
def author_consistency(t):
    return rounded(P.author_consistency(flagged(t), "user_id", "value"), "avg_metric", "viral_rate")


@query("viral_against_normal", "A19", f"""WITH {VIRAL}, m AS (
  SELECT viral, unnest(['value', 'k']) AS metric, unnest([value, k]) AS x FROM v),
g AS (SELECT metric, avg(x) FILTER (WHERE viral) AS mean_viral, avg(x) FILTER (WHERE NOT viral) AS mean_normal,
  median(x) FILTER (WHERE viral) AS median_viral, median(x) FILTER (WHERE NOT viral) AS median_normal FROM m GROUP BY metric)
SELECT metric, round(mean_viral, 9) AS mean_viral, round(mean_normal, 9) AS mean_normal, round(median_viral, 9) AS median_viral,
  round(median_normal, 9) AS median_normal, round((mean_viral - mean_normal) * 100 / mean_normal, 9) AS diff_pct FROM g""")
def viral_against_normal(t):
    return rounded(P.viral_against_normal(flagged(t), ["value", "k"]), "mean_viral", "mean_normal", "median_viral",
              "median_normal", "diff_pct")


@query("word_lift", "A20", r"""WITH d AS (SELECT text, quality = 1 AS good FROM documents JOIN labels USING (doc_id)),
w AS (SELECT good, unnest(regexp_extract_all(text, '\p{L}{4,}')) AS word FROM d),
c AS (SELECT word, count(*) FILTER (WHERE good) AS n_on, count(*) FILTER (WHERE NOT good) AS n_off FROM w GROUP BY word),
s AS (SELECT count(*) FILTER (WHERE good) AS a, count(*) FILTER (WHERE NOT good) AS b FROM d)
SELECT word, CAST(n_on AS BIGINT) AS n_on, CAST(n_off AS BIGINT) AS n_off, round(n_on * 100.0 / a, 9) AS rate_on,
  round(n_off * 100.0 / b, 9) AS rate_off, round(n_on * 100.0 / a - n_off * 100.0 / b, 9) AS lift
FROM c, s WHERE n_on > 0 ORDER BY n_on DESC, word LIMIT 100""")
def word_lift(t):
    d = t.documents.select("doc_id", "text").join(t.labels.select("doc_id", (F.col("quality") == 1).alias("good")), "doc_id")
    return rounded(P.word_lift(d, "text", "good", r"\p{L}{4,}"), "rate_on", "rate_off", "lift")


@query("country_rollup", "A21", """WITH d AS (SELECT n_name, o_custkey, o_totalprice, o_orderstatus, o_totalprice / greatest(c_acctbal, 1) AS ratio
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
ty AS (SELECT n_name, o_orderstatus, row_number() OVER (PARTITION BY n_name ORDER BY count(*) DESC, o_orderstatus) AS r
  FROM d GROUP BY 1, 2)
SELECT n_name, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT o_custkey) AS BIGINT) AS n_authors,
  round(avg(o_totalprice), 4) AS avg_o_totalprice, round(median(ratio), 9) AS median_ratio,
  (SELECT string_agg(o_orderstatus, ',' ORDER BY r) FROM ty WHERE ty.n_name = d.n_name AND r <= 2) AS top_types
FROM d GROUP BY n_name""")
def country_rollup(t):
    d = (t.orders.select("o_custkey", "o_totalprice", "o_orderstatus")
         .join(t.customer.select("c_custkey", "c_nationkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"))
         .join(t.nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")))
    out = P.group_rollup(d, "n_name", "o_custkey", ["o_totalprice"], "o_orderstatus",
                         {"ratio": F.col("o_totalprice") / M.at_least_one(F.col("c_acctbal"))})
    return out.withColumn("avg_o_totalprice", F.round("avg_o_totalprice", 4)).withColumn(
        "median_ratio", F.round("median_ratio", 9))


@query("comment_report", "A22", """WITH c AS (SELECT conv_id, turn, text, length(text) AS likes FROM conversations),
g AS (SELECT conv_id, count(*) AS n, sum(likes) AS s, min_by({'t': text, 'l': likes}, (-likes, turn)) AS b FROM c GROUP BY conv_id)
SELECT conv_id, CAST(n AS BIGINT) AS n_comments, CAST(s AS BIGINT) AS sum_likes, b.t AS top_text, CAST(b.l AS BIGINT) AS top_likes,
  round(b.l / s, 9) AS top_share FROM g""")
def comment_report(t):
    c = t.conversations.select("conv_id", "turn", "text", F.length("text").cast("long").alias("likes"))
    return rounded(P.comment_report(c, "conv_id", "likes", "text", "turn"), "top_share")


@query("hot_comment_words", "A23", r"""SELECT word, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT unnest(regexp_extract_all(text, '\p{L}{2,4}')) AS word FROM conversations) GROUP BY word ORDER BY n DESC, word LIMIT 30""")
def hot_comment_words(t):
    return P.hot_comment_words(t.conversations, "text", r"\p{L}{2,4}")


@query("commented_effect", "A23", """SELECT doc_id IN (SELECT conv_id FROM conversations) AS commented, CAST(count(*) AS BIGINT) AS n,
  CAST(floor(avg(n_chars)) AS BIGINT) AS avg_metric FROM documents GROUP BY 1""")
def commented_effect(t):
    return P.commented_effect(t.documents.select("doc_id", "n_chars"),
                              t.conversations.select(F.col("conv_id").alias("doc_id")), "doc_id", "n_chars")


HOOKS = [("number", r"\d+"), ("list", r"[|]"), ("license", r"(?i)licen[sc]e"), ("the", r"(^| )the "), ("de", r"(^| )de "),
         ("und", r"(^| )und ")]


def _hook_sql(default):
    items = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in HOOKS)
    return f"[x FOR x IN [{items}] IF x IS NOT NULL]"


@query("title_hooks", "U7", f"""SELECT doc_id, CASE WHEN len(h) = 0 THEN 'none' ELSE array_to_string(h, ',') END AS hooks
FROM (SELECT doc_id, {_hook_sql('none')} AS h FROM documents)""")
def title_hooks(t):
    return t.documents.select("doc_id", F.array_join(R.all_labels(F.col("text"), HOOKS, "none"), ",").alias("hooks"))


@query("hook_pairs", "A27", f"""WITH h AS (SELECT doc_id, unnest(h) AS hook FROM (SELECT doc_id, {_hook_sql('')} AS h FROM documents)),
p AS (SELECT a.hook, b.hook AS partner, count(*) AS n FROM h a JOIN h b USING (doc_id) WHERE a.hook <> b.hook GROUP BY 1, 2),
s AS (SELECT hook, count(*) AS n_hook FROM h GROUP BY hook)
SELECT hook, partner, CAST(n AS BIGINT) AS n, CAST(n_hook AS BIGINT) AS n_hook, round(n / n_hook, 9) AS share,
  row_number() OVER (PARTITION BY hook ORDER BY n DESC, partner) = 1 AS is_best FROM p JOIN s USING (hook)""")
def hook_pairs(t):
    return rounded(P.hook_pairs(t.documents, R.all_labels(F.col("text"), HOOKS)), "share")


CTA, ASK, ROLES = r"(License|public)", r"[|]", ("the", "der", "que", "les")
TITLE_RULES = [("list", r"[|]"), ("number", r"\d"), ("the", r"(?i)^(the|der|la) "), ("long", r"^\S{9,}")]
DOCS_SQL = """docs AS (SELECT doc_id, source, lang, n_chars, split_part(text, chr(10), 1) AS title,
  substring(text, length(split_part(text, chr(10), 1)) + 2) AS body FROM documents)"""


def docs(t):
    title = F.regexp_extract("text", r"^([^\n]*)", 1)
    return t.documents.select("doc_id", "source", "lang", "n_chars", title.alias("title"),
                              F.substr(F.col("text"), F.length(title) + 2).alias("body"))


def _first_sql(cols, rules, default):
    arms = " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{n}'" for c in cols for n, p in rules)
    return f"CASE {arms} ELSE '{default}' END"


_STRUCT = f"""st AS (SELECT doc_id, source, lang, n_chars, title, body, {_first_sql(['title', 'substring(body, 1, 60)'], TITLE_RULES, 'plain')} AS hook,
  CAST(length(body) AS BIGINT) AS chars, [x FOR x IN regexp_split_to_array(body, '\\n+') IF regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> ''] AS ps,
  CASE WHEN regexp_matches(body, '{CTA}') THEN 'direct' WHEN regexp_matches(body, '{ASK}') THEN 'question' ELSE 'none' END AS cta,
  [x FOR x IN [{', '.join(f"CASE WHEN contains(body, '{r}') THEN '{r}' END" for r in ROLES)}] IF x IS NOT NULL] AS rt FROM docs)"""


@query("hook_type", "U8", f"""WITH {DOCS_SQL}
SELECT doc_id, {_first_sql(['title', 'substring(body, 1, 60)'], TITLE_RULES, 'plain')} AS hook FROM docs""")
def hook_type(t):
    return docs(t).select("doc_id", R.first_label([F.col("title"), F.substring("body", 1, 60)], TITLE_RULES, "plain").alias("hook"))


def structured(t):
    return P.structure_columns(docs(t), "title", "body", TITLE_RULES, "plain", CTA, ASK, ROLES)


@query("post_structure", "U12", f"""WITH {DOCS_SQL}, {_STRUCT}
SELECT doc_id, hook, chars, CAST(len(ps) AS BIGINT) AS paras,
  CAST(CASE WHEN len(ps) > 0 THEN round(chars / len(ps)) ELSE 0 END AS BIGINT) AS avg_para_len, cta,
  CASE WHEN len(rt) > 0 THEN array_to_string(rt[1:4], ',') ELSE '-' END AS role_terms FROM st""")
def post_structure(t):
    return structured(t).select("doc_id", "hook", "chars", "paras", "avg_para_len", "cta", "role_terms")


@query("structure_matrix", "A28", f"""WITH {DOCS_SQL}, {_STRUCT}, d AS (SELECT *, n_chars AS likes, len(ps) AS saves FROM st),
f AS (SELECT source, count(*) FILTER (WHERE hook = 'plain') * 1.0 / count(*) AS fs FROM d GROUP BY source)
SELECT source, hook, CAST(count(likes) AS BIGINT) AS n, round(median(likes), 9) AS median_likes,
  round(median(saves / likes), 9) AS median_save_ratio, round(fs, 9) AS fallback_share, fs > 0.3 AS alarm
FROM d JOIN f USING (source) GROUP BY source, hook, fs""")
def structure_matrix(t):
    d = structured(t).withColumnRenamed("n_chars", "likes").withColumnRenamed("paras", "saves")
    return rounded(P.structure_matrix(d, "source", "hook", "likes", "saves", "plain"), "median_likes", "median_save_ratio", "fallback_share")


@query("top_third_structure", "A28", f"""WITH {DOCS_SQL}, {_STRUCT}, r AS (SELECT *, len(ps) AS paras,
  row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS p, count(*) OVER (PARTITION BY source) AS n FROM st)
SELECT source, CAST(count(*) AS BIGINT) AS n_top, round(avg(chars), 9) AS avg_chars, round(avg(paras), 9) AS avg_paras
FROM r WHERE p <= greatest(1, n // 3) GROUP BY source""")
def top_third_structure(t):
    return rounded(P.top_third_structure(structured(t), "source", "n_chars", "doc_id", ["chars", "paras"]), "avg_chars", "avg_paras")


INFO = [("risk", r"(idiot|worthless|pathetic)"), ("data", r"\d"), ("compare", r"[|]"), ("science", r"(ción|tion)")]
MOTIF = [("licence", r"(?i)licen[sc]e"), ("money", r"[$%]{3}"), ("people", r"(ment|keit)"), ("place", r"(heit|ung)")]


@query("info_type_motif", "U11", f"""SELECT doc_id, {_first_sql(['text'], INFO, 'other')} AS info_type,
  {_first_sql(['text'], MOTIF, 'other')} AS motif FROM documents""")
def info_type_motif(t):
    return t.documents.select("doc_id", R.first_label(F.col("text"), INFO, "other").alias("info_type"),
                              R.first_label(F.col("text"), MOTIF, "other").alias("motif"))


TYPES = {"dense": ["the ", "of ", "and "], "romance": ["que ", "de ", "la "], "german": ["der ", "und ", "nicht "]}


@query("content_type", "U9", f"""WITH s AS (SELECT doc_id, {', '.join('(' + ' + '.join(f"CAST(contains(text, '{w}') AS INT)" for w in ws) + f') AS {n}' for n, ws in TYPES.items())} FROM documents)
SELECT doc_id, CASE WHEN greatest(dense, romance, german) <= 0 THEN 'other' {' '.join(f"WHEN {n} = greatest(dense, romance, german) THEN '{n}'" for n in TYPES)} END AS type FROM s""")
def content_type(t):
    return t.documents.select("doc_id", R.best_label(
        {n: R.count_words(F.col("text"), ws) for n, ws in TYPES.items()}, "other").alias("type"))


REGIONS = {"oua": "west", "ver": "east", "ció": "south"}
COUNTRIES = ("erthly", "keit", "mente", "tion")
CITIES = {"menttion": "mente", "keitver": "keit"}


@query("geo_unit", "U10", f"""WITH h AS (SELECT doc_id, regexp_matches(text, '(worthless|GNU)') AS gw,
  [x FOR x IN [{', '.join(f"CASE WHEN contains(text, '{k}') THEN '{v}' END" for k, v in REGIONS.items())}] IF x IS NOT NULL] AS rg,
  [x FOR x IN [{', '.join(f"CASE WHEN contains(text, '{c}') THEN '{c}' END" for c in COUNTRIES)}] IF x IS NOT NULL] AS co,
  [x FOR x IN [{', '.join(f"CASE WHEN contains(text, '{c}') THEN '{c}' END" for c in CITIES)}] IF x IS NOT NULL] AS ci,
  [x FOR x IN [{', '.join(f"CASE WHEN contains(text, '{c}') THEN '{v}' END" for c, v in CITIES.items())}] IF x IS NOT NULL] AS cc FROM documents),
x AS (SELECT *, list_distinct(list_concat(co, cc)) AS al FROM h)
SELECT doc_id, CASE WHEN gw THEN 'global' WHEN len(rg) > 0 AND len(al) >= 2 THEN 'region and many'
  WHEN len(rg) > 0 THEN 'region (' || list_sort(rg)[1] || ')' WHEN len(al) = 1 AND len(ci) > 0 THEN 'city (' || list_sort(ci)[1] || ')'
  WHEN len(al) = 1 THEN 'country (' || al[1] || ')' WHEN len(al) >= 2 THEN 'many' ELSE 'undetermined' END AS unit FROM x""")
def geo_unit(t):
    from tidemark.operators.accounts import geo_unit as unit

    return t.documents.select("doc_id", unit(F.col("text"), ["worthless", "GNU"], REGIONS, COUNTRIES, CITIES, labels={
        "global": "global", "region_many": "region and many", "region": "region", "city": "city",
        "country": "country", "many": "many", "none": "undetermined"}).alias("unit"))


@query("opportunity_board", "A29", f"""WITH {DOCS_SQL}, {_STRUCT}, b AS (SELECT source, median(n_chars) AS base FROM st GROUP BY source),
d AS (SELECT hook, {_first_sql(["title || ' ' || body"], INFO, 'other')} AS info, {_first_sql(["title || ' ' || body"], MOTIF, 'other')} AS motif,
  n_chars / base AS multiple, len(ps) / n_chars AS save_ratio FROM st JOIN b USING (source)),
v AS (SELECT 'hook' AS view, hook AS label, multiple, save_ratio FROM d UNION ALL SELECT 'hook x info', hook || ' | ' || info, multiple, save_ratio FROM d
  UNION ALL SELECT 'motif x info x hook', motif || ' | ' || info || ' | ' || hook, multiple, save_ratio FROM d)
SELECT view, label, CAST(count(*) AS BIGINT) AS n, round(median(multiple), 9) AS median_multiple, round(median(save_ratio), 9) AS median_save_ratio
FROM v GROUP BY 1, 2""")
def opportunity_board(t):
    from tidemark.operators.ordering import grouped_medians

    d, blob = structured(t), F.concat_ws(" ", "title", "body")
    # what the board needs of the texts is written, so they are read once and never shuffled
    d = write_through(d.select("source", "n_chars", "paras", "hook", R.first_label(blob, INFO, "other").alias("info"), R.first_label(blob, MOTIF, "other").alias("motif")), "posts")
    base = grouped_medians(d, ["source"], ["n_chars"]).select("source", F.col("median_n_chars").alias("base"))
    # a ratio of an empty text is NaN or infinite as in SQL, and no error
    over = lambda x, y: F.when(F.col(y) == 0, F.col(x) * float("inf")).otherwise(F.try_divide(x, y))
    d = d.join(base, "source").withColumns({"multiple": over("n_chars", "base"), "save_ratio": over("paras", "n_chars")})
    return rounded(P.opportunity_board(d, {"hook": ["hook"], "hook x info": ["hook", "info"],
                                      "motif x info x hook": ["motif", "info", "hook"]}, "multiple", "save_ratio"),
              "median_multiple", "median_save_ratio")


@query("opportunity_order", "T3", f"""WITH {DOCS_SQL}, {_STRUCT}, d AS (SELECT hook, cta, n_chars * 1.0 AS multiple, nullif(len(ps), 1) AS save_ratio FROM st),
v AS (SELECT 'hook' AS view, hook AS label, multiple, save_ratio FROM d UNION ALL SELECT 'hook x cta', hook || ' | ' || cta, multiple, save_ratio FROM d),
g AS (SELECT view, label, count(multiple) AS n, median(multiple) AS mm, median(save_ratio) AS ms FROM v GROUP BY 1, 2)
SELECT view, label, CAST(n AS BIGINT) AS n, round(mm, 9) AS median_multiple, round(ms, 9) AS median_save_ratio FROM g
ORDER BY coalesce(ms, 0) DESC, coalesce(mm, 0) DESC, n DESC, view, label LIMIT 8""")
def opportunity_order(t):
    d = structured(t).withColumn("multiple", F.col("n_chars") * 1.0).withColumn("save_ratio", F.nullif(F.col("paras"), F.lit(1)))
    b = P.opportunity_board(d, {"hook": ["hook"], "hook x cta": ["hook", "cta"]}, "multiple", "save_ratio")
    return rounded(P.order_opportunities(b, 8), "median_multiple", "median_save_ratio")


@query("track_vote", "A30", """WITH p AS (SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE regexp_matches(text, '(ción|keit)')) AS BIGINT) AS hits
  FROM documents GROUP BY source), r AS (SELECT *, hits * 1.0 / n AS rate FROM p),
x AS (SELECT *, CASE WHEN rate > 0.25 THEN 'geo_map' ELSE 'overseas_service' END AS track FROM r)
SELECT source, n, hits, round(rate, 9) AS rate, track, (SELECT CASE WHEN count(*) FILTER (WHERE track = 'geo_map') > count(*) FILTER (WHERE track <> 'geo_map')
  THEN 'geo_map' ELSE 'overseas_service' END FROM x) AS majority FROM x""")
def track_vote(t):
    return rounded(P.track_vote(t.documents, "source", F.col("text"), "(ción|keit)", 0.25), "rate")


@query("save_ratio_bands", "A36", """WITH r AS (SELECT l_quantity / nullif(l_extendedprice / 1000, 0) AS r FROM lineitem)
SELECT CASE WHEN r IS NULL THEN 'unknown' WHEN r < 0.06 THEN 'weak' WHEN r BETWEEN 0.20 AND 0.45 THEN 'list demand' WHEN r > 1.0 THEN 'directory demand'
  ELSE 'unbanded' END AS band, CAST(count(*) AS BIGINT) AS n, round(avg(r), 9) AS avg_ratio FROM r GROUP BY 1""")
def save_ratio_bands(t):
    d = t.lineitem.select("l_quantity", (F.col("l_extendedprice") / 1000).alias("likes"))
    return rounded(P.save_ratio_bands(d, "l_quantity", "likes"), "avg_ratio")


@query("title_flags", "U13", """SELECT doc_id, regexp_matches(text, '[|]') AS has_question, regexp_matches(text, '\\d+') AS has_number,
  regexp_matches(text, '[$]') AS has_exclamation, (contains(text, 'License') OR contains(text, 'GNU')) AS has_lexicon,
  CASE WHEN length(split_part(text, chr(10), 1)) <= 60 THEN 'short' WHEN length(split_part(text, chr(10), 1)) <= 120 THEN 'medium' ELSE 'long' END AS len_group
FROM documents""")
def title_flags(t):
    x = F.col("text")
    return t.documents.select(
        "doc_id", R.matches(x, "[|]").alias("has_question"), R.matches(x, r"\d+").alias("has_number"),
        R.matches(x, "[$]").alias("has_exclamation"), R.has_any(x, ["License", "GNU"]).alias("has_lexicon"),
        R.bucket_label(F.length(F.regexp_extract(x, r"^([^\n]*)", 1)), [(60, "short"), (120, "medium")], "long", "right").alias("len_group"))


@query("news_and_creators", "J13", f"""WITH {POSTS}, g AS (SELECT event_type = 'error' AS news, avg(value) AS a, avg(k) AS b, count(*) AS n FROM posts GROUP BY 1)
SELECT CAST(c.n AS BIGINT) AS n_creator, CAST(w.n AS BIGINT) AS n_news, round(c.a, 9) AS creator_value, round(w.a, 9) AS news_value,
  round(w.a / c.a, 9) AS ratio_value, round(c.b, 9) AS creator_k, round(w.b, 9) AS news_k, round(w.b / c.b, 9) AS ratio_k
FROM g c, g w WHERE NOT c.news AND w.news""")
def news_and_creators(t):
    news = F.col("event_type") == "error"
    d = posts(t).agg(F.count_if(~news).alias("n_creator"), F.count_if(news).alias("n_news"), *[
        F.avg(F.when(c, F.col(m))).alias(f"{n}_{m}") for m in ("value", "k") for n, c in (("creator", ~news), ("news", news))])
    for m in ("value", "k"):
        d = d.withColumn(f"ratio_{m}", F.try_divide(F.col(f"news_{m}"), F.col(f"creator_{m}")))
    return rounded(d, *[f"{n}_{m}" for m in ("value", "k") for n in ("creator", "news", "ratio")])


@query("comment_rate_board", "T7", f"""WITH {POSTS} SELECT event_id, user_id, round(k / value * 100, 9) AS rate FROM posts WHERE value > 0
ORDER BY k / value * 100 DESC, event_id LIMIT 100""")
def comment_rate_board(t):
    d = posts(t).where("value > 0").withColumn("rate", F.col("k") / F.col("value") * 100)
    return rounded(d.orderBy(F.desc("rate"), "event_id").limit(100).select("event_id", "user_id", "rate"), "rate")
