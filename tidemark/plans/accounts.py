"""Account and entity queries: parts are named things, customers and orders authors and posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import lexicons, metrics as M, parsing as Pa, rules as R, text as T
from tidemark.operators import accounts as A, entities as E, joins as J
from tidemark.operators.ordering import compute_once
from tidemark.plans.posts import docs, DOCS_SQL, rounded
from tidemark.plans.registry import query


@query("author_rollup", "A10", """WITH t AS (SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY o_orderpriority) AS tags FROM (
  SELECT * FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) <= 10) GROUP BY 1)
SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, max(o_orderkey) AS followers, CAST(sum(o_orderkey) AS BIGINT) AS sum_o_orderkey,
  CAST(floor(avg(o_orderkey)) AS BIGINT) AS avg_o_orderkey, any_value(tags) AS tags FROM orders JOIN t USING (o_custkey) GROUP BY o_custkey""")
def author_rollup(t):
    return A.author_rollup(t.orders, "o_custkey", "o_orderpriority", "o_orderkey", ["o_orderkey"])


_REL = """p AS (SELECT o_custkey, o_orderpriority AS c, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS m, max(o_orderkey) AS f,
  sum(o_orderkey) AS likes, sum(length(o_orderpriority)) AS comments, sum(o_custkey) AS shares FROM orders GROUP BY 1, 2),
rel AS (SELECT o_custkey, CAST(sum(n) AS BIGINT) AS n_posts, CAST(count(*) AS BIGINT) AS n_countries, string_agg(c, ',' ORDER BY c) AS countries,
  arg_min(c, (-n, c)) AS primary_country, CAST(max(n) AS BIGINT) AS primary_posts, round(sum(m) / sum(n), 9) AS relevance, max(f) AS followers,
  CAST(sum(likes) AS BIGINT) AS total_likes, CAST(sum(comments) AS BIGINT) AS total_comments, round((sum(likes) + sum(comments) + sum(shares)) / sum(n), 6) AS avg_engagement,
  round(sum(comments) / sum(likes), 9) AS comment_like_rate, round((sum(likes) + sum(comments) + sum(shares)) / sum(n) / max(f), 9) AS engagement_per_follower FROM p GROUP BY 1)"""


def relevance(t):
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus", F.length("o_orderpriority").cast("long").alias("c"))
    out = A.author_relevance(o, "o_custkey", "o_orderpriority", F.col("o_orderstatus") == "F",
                             {"followers": "o_orderkey", "likes": "o_orderkey", "comments": "c", "shares": "o_custkey"})
    return rounded(out.withColumn("avg_engagement", F.round("avg_engagement", 6)), "relevance", "comment_like_rate", "engagement_per_follower")


@query("author_relevance", "A11", f"WITH {_REL} SELECT * FROM rel")
def author_relevance(t):
    return relevance(t)


@query("account_tier", "X18", f"""WITH {_REL} SELECT o_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND (n_countries >= 3 OR relevance >= 0.5) THEN 'core region'
  WHEN c_mktsegment = 'MACHINERY' AND primary_posts >= 3 THEN 'core country' WHEN c_mktsegment = 'BUILDING' THEN 'region related' WHEN n_countries >= 5 THEN 'many countries'
  WHEN relevance >= 0.5 THEN 'related' ELSE 'touching' END AS tier FROM rel JOIN customer ON c_custkey = o_custkey""")
def account_tier(t):
    d = relevance(t).join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    seg = F.col("c_mktsegment")
    return A.account_tier(d, seg == "BUILDING", seg == "MACHINERY").select("o_custkey", "tier")


@query("tier_medians", "X18", """SELECT c_mktsegment AS tier, CAST(count(*) AS BIGINT) AS n_c_acctbal, round(median(c_acctbal), 6) AS median_c_acctbal FROM customer GROUP BY 1""")
def tier_medians(t):
    m = A.tier_medians(t.customer.withColumnRenamed("c_mktsegment", "tier"), "tier", ["c_acctbal"])
    return m.withColumn("median_c_acctbal", F.round("median_c_acctbal", 6))


SIG = A.Signals(
    identity={"media": [("nick", "license"), ("text", "general public")], "enterprise": [("nick", "^der "), ("nick", "^the ")],
              "personal": [("text", "idiot|pathetic"), ("text", "worthless")]},
    identity_weights={"media": {"license": 90, "general public": 65}, "enterprise": {"^der ": 50, "^the ": 60},
                      "personal": {"idiot|pathetic": 40, "worthless": 30}},
    whitelist=["that it.", "von."],
    domains={"finance": [(("$$$", "%%%"), 15), (("***",), 8)], "trade": [(("license", "under"), 15), (("| ",), 5)],
             "travel": [(("pour", "avec"), 15)], "military": [(("nicht", "auf"), 15)], "knowledge": [(("with", "from"), 15)],
             "lifestyle": [(("para", "los"), 10)]},
    by_field={"entertainment": (("que", "der"), 25, 10), "sports": (("und", "les"), 25, 10)},
    region_direct=("released", "gnu"), region_context=("mit", "con"), creator=("this", "that", "was"))


def _hits(col, ws, w):
    return " + ".join(f"CAST(contains({col}, '{x}') AS BIGINT) * {w}" for x in ws)


_FEAT = f"""f0 AS (SELECT doc_id, lower(title) AS n, lower(body) AS g, lower(title) || ' ' || lower(body) || ' ' AS t,
  lower(title) || ' ' || lower(body) AS s FROM docs),
f1 AS (SELECT doc_id,
  greatest(greatest(CASE WHEN regexp_matches(n, 'license') THEN 90 ELSE 0 END, CASE WHEN regexp_matches(t, 'general public') THEN 65 ELSE 0 END),
    CASE WHEN n IN ('that it.', 'von.') THEN 80 ELSE 0 END) AS media_score,
  CASE WHEN regexp_matches(n, '^der ') THEN 50 WHEN regexp_matches(n, '^the ') THEN 60 ELSE 0 END AS enterprise_score,
  CASE WHEN regexp_matches(t, 'idiot|pathetic') THEN 40 ELSE 0 END + CASE WHEN regexp_matches(t, 'worthless') THEN 30 ELSE 0 END
    + CASE WHEN ({_hits('s', SIG.creator, 1)}) >= 2 THEN 30 WHEN ({_hits('s', SIG.creator, 1)}) >= 1 THEN 15 ELSE 0 END AS personal_score,
  {', '.join('(' + ' + '.join(_hits('t', ws, w) for ws, w in lists) + f') AS {name}_score' for name, lists in SIG.domains.items())},
  {', '.join('(' + ' + '.join(f"CASE WHEN contains(n, '{x}') THEN {a} WHEN contains(g, '{x}') THEN {b} ELSE 0 END" for x in ws) + f') AS {name}_score' for name, (ws, a, b) in SIG.by_field.items())},
  {_hits('t', SIG.region_direct, 20)} + {_hits('t', SIG.region_context, 10)} AS region_score, ({_hits('s', SIG.creator, 1)}) >= 1 AS is_creator FROM f0)"""
SCORES = ["media", "enterprise", "personal", *SIG.domains, *SIG.by_field, "region"]


def features(t):
    return A.account_features(docs(t), "title", "body", None, SIG)


@query("account_features", "X16", f"""WITH {DOCS_SQL}, {_FEAT} SELECT doc_id, {', '.join(f'CAST({s}_score AS BIGINT) AS {s}_score' for s in SCORES)}, is_creator FROM f1""")
def account_features(t):
    return features(t).select("doc_id", *[F.col(f"{s}_score").cast("long").alias(f"{s}_score") for s in SCORES], "is_creator")


_DOM = ["entertainment", "sports", "travel", "military", "knowledge", "lifestyle"]
_CLASS = f"""f2 AS (SELECT *, finance_score + trade_score AS biz, greatest(finance_score + trade_score, {', '.join(d + '_score' for d in _DOM)}) AS top FROM f1),
cls AS (SELECT doc_id, CASE WHEN media_score >= 60 THEN 'media' WHEN enterprise_score >= 50 AND biz >= 20 THEN CASE WHEN region_score >= 20 THEN 'region_business' ELSE 'business' END
  WHEN region_score >= 40 THEN CASE WHEN travel_score >= 20 AND travel_score > biz THEN 'travel' WHEN biz >= 15 THEN 'region_business' ELSE 'region' END
  WHEN top >= 30 THEN CASE WHEN biz = top THEN CASE WHEN enterprise_score >= 30 THEN 'business' WHEN finance_score >= 20 THEN CASE WHEN region_score >= 10 THEN 'region_business' ELSE 'finance' END
      WHEN trade_score >= 20 THEN CASE WHEN region_score >= 10 THEN 'region_business' ELSE 'business' END WHEN is_creator AND biz < 40 THEN 'creator' ELSE 'business' END
    {' '.join(f"WHEN {d}_score = top THEN '{d}'" for d in _DOM)} END
  WHEN region_score >= 10 THEN 'region' WHEN biz >= 20 THEN CASE WHEN is_creator THEN 'creator' ELSE 'business' END
  WHEN travel_score >= 15 THEN 'travel' WHEN military_score >= 15 THEN 'military' WHEN knowledge_score >= 15 THEN 'knowledge'
  WHEN entertainment_score >= 15 THEN 'entertainment' WHEN sports_score >= 15 THEN 'sports' WHEN lifestyle_score >= 15 THEN 'lifestyle' ELSE 'none' END AS class FROM f2)"""
NAMES = {k: k for k in A.CLASSES}


@query("classify_account", "X17", f"WITH {DOCS_SQL}, {_FEAT}, {_CLASS} SELECT * FROM cls")
def classify_account(t):
    return A.classify_account(features(t), NAMES).select("doc_id", "class")


@query("class_distribution", "X17 T2", f"""WITH {DOCS_SQL}, {_FEAT}, {_CLASS}, r AS (SELECT class, doc_id, n_chars, row_number() OVER (PARTITION BY class ORDER BY n_chars DESC, doc_id) AS k,
  count(*) OVER (PARTITION BY class) AS n FROM cls JOIN documents USING (doc_id)) SELECT class, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, doc_id FROM r WHERE k <= 10""")
def class_distribution(t):
    from tidemark.operators.ordering import top_per_group

    c = A.classify_account(features(t), NAMES).select("class", "doc_id", "n_chars")
    top = top_per_group(c, ["class"], [F.desc("n_chars"), F.asc("doc_id")], 10, "k")
    return top.join(c.groupBy("class").agg(F.count(F.lit(1)).alias("n")), "class").select("class", "n", "k", "doc_id")


@query("account_roles", "X19", f"""WITH {DOCS_SQL} SELECT doc_id, CASE WHEN (length(regexp_extract(lang, '^([^(]*)', 1)) >= 3 AND contains(title || ' ' || body, lang)) OR regexp_matches(title || ' ' || body, '(?i)license') THEN 'official'
  WHEN regexp_matches(body, '[|]') OR regexp_matches(title || ' ' || body, '[$]') THEN 'tenant' WHEN regexp_matches(title || ' ' || body, 'idiot|worthless|ment') THEN 'personal' ELSE 'unknown' END AS role FROM docs""")
def account_roles(t):
    return docs(t).select("doc_id", A.role_of(F.col("title"), F.col("body"), F.col("lang"), "(?i)license", "[|]", "[$]", "idiot|worthless|ment").alias("role"))


@query("original_sound", "U27", """SELECT o_orderkey, contains('sound of @Customer#000000' || right(CAST(o_orderkey AS VARCHAR), 3), '@' || left(c_name, 15) || right(c_name, 3))
  OR o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 AS is_original
FROM orders JOIN customer ON o_custkey = c_custkey""")
def original_sound(t):
    """The title may name the customer or carry the fixed phrase; every fifth order has the customer as the sound's author."""
    d = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority").join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    title = F.concat(F.lit("sound of @Customer#000000"), F.expr("right(cast(o_orderkey as string), 3)"),
                     F.when(F.col("o_orderkey") % 7 == 0, lexicons.ORIGINAL_SOUND).otherwise(""))
    nick = F.concat(F.expr("left(c_name, 15)"), F.expr("right(c_name, 3)"))
    author = F.when(F.col("o_orderkey") % 5 == 0, F.concat("o_orderpriority", nick))
    return d.select("o_orderkey", A.original_sound(title, author, nick).alias("is_original"))


@query("normalized_names", "U19", r"""SELECT c_custkey, lower(regexp_replace(regexp_replace(regexp_replace(CAST(c_custkey AS VARCHAR) || c_name || '(' || c_mktsegment || ')', '^\d+(\.\d+)?', ''), '[(][^)]*[)]', '', 'g'), '[^A-Za-z0-9]+', '', 'g')) AS name FROM customer""")
def normalized_names(t):
    raw = F.concat(F.col("c_custkey").cast("string"), "c_name", F.lit("("), "c_mktsegment", F.lit(")"))
    return t.customer.select("c_custkey", T.normalize_name(raw, "A-Za-z0-9", lower=True).alias("name"))


LABELS = {"license": ["License", "Public"], "mark": ["|", "***"], "de": ["keit", "heit"], "es": ["ción"]}


@query("detected_labels", "U22", f"""SELECT doc_id, array_to_string([x FOR x IN [{', '.join(f"CASE WHEN {' OR '.join(f'''contains(text, '{w}')''' for w in ws)} THEN '{n}' END" for n, ws in LABELS.items())}] IF x IS NOT NULL], ',') AS labels FROM documents""")
def detected_labels(t):
    return t.documents.select("doc_id", F.array_join(R.dictionary_labels(F.col("text"), LABELS), ",").alias("labels"))


@query("extracted_projects", "U23", r"""WITH x AS (SELECT p_partkey, regexp_extract_all(p_name || ' in ' || p_type || p_brand, '([a-z]{1,6} (?:plate|gear|rod|ring))', 1) AS ps FROM part)
SELECT p_partkey, array_to_string([regexp_replace(p, '^(?:old|hot)', '') FOR p IN ps], ',') AS projects FROM x""")
def extracted_projects(t):
    text = F.concat("p_name", F.lit(" in "), "p_type", "p_brand")
    found = Pa.extract_projects(text, ["plate", "gear", "rod", "ring"], ["old", "hot"], "[a-z]{1,6} ")
    return t.part.select("p_partkey", F.array_join(found, ",").alias("projects"))


@query("clean_seeds", "U24", """SELECT p_partkey, CASE WHEN p_name <> 'red plate' AND NOT contains(p_name, 'old') THEN CASE WHEN regexp_matches(p_name, '(plate|gear|rod)') THEN
  regexp_extract(p_name, '((?:plate|gear|rod).*)$', 1) ELSE p_name END END AS seed FROM part""")
def clean_seeds(t):
    return t.part.select("p_partkey", Pa.clean_seed(F.col("p_name"), ["plate", "gear", "rod"], ["red plate"], ["old"]).alias("seed"))


@query("canonical_names", "G3", """WITH n AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part UNION SELECT DISTINCT p_name || ' ' || p_brand FROM part),
c AS (SELECT a.name, b.name AS long FROM n a JOIN n b ON a.name <> b.name AND contains(b.name, a.name) QUALIFY row_number() OVER (PARTITION BY a.name ORDER BY length(b.name) DESC, b.name) = 1)
SELECT n.name, coalesce(c.long, n.name) AS canonical FROM n LEFT JOIN c USING (name)""")
def canonical_names(t):
    p = t.part
    names = (p.select(F.col("p_name").alias("name")).unionByName(p.select(F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)).alias("name")))
             .unionByName(p.select(F.concat_ws(" ", "p_name", "p_brand").alias("name"))).distinct())
    return E.canonical_names(names)


@query("longest_key", "J8", """WITH k AS (SELECT DISTINCT p_name AS key FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part),
t AS (SELECT p_partkey, p_brand || ' ' || p_name || ' ' || p_type AS text FROM part)
SELECT p_partkey, key FROM t JOIN k ON contains(text, key) AND length(key) >= 3 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(key) DESC, key) = 1""")
def longest_key(t):
    p = t.part
    keys = p.select(F.col("p_name").alias("key")).unionByName(
        p.select(F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)).alias("key"))).distinct()
    return J.longest_contained(p.select("p_partkey", F.concat_ws(" ", "p_brand", "p_name", "p_type").alias("text")), "p_partkey", "text", keys, "key")


_PROJ = """acc AS (SELECT p_partkey AS account, p_name AS nickname, p_type || ' ' || p_brand AS sig, p_brand || ' ' || split_part(p_name, ' ', 2) AS project FROM part),
proj AS (SELECT p_brand || ' ' || split_part(p_name, ' ', 2) AS project, min(p_type) AS country FROM part GROUP BY 1),
refs AS (SELECT canonical, min(country) OVER (PARTITION BY canonical) AS country, key FROM (SELECT DISTINCT p_name AS canonical, p_type AS country, p_name AS key FROM part
  UNION SELECT DISTINCT p_name, p_type, split_part(p_name, ' ', 2) FROM part) GROUP BY canonical, country, key)"""


def project_frames(t):
    p = t.part
    noun = F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))
    project = F.concat_ws(" ", "p_brand", noun)
    acc = p.select(F.col("p_partkey").alias("account"), F.col("p_name").alias("nickname"),
                                        F.concat_ws(" ", "p_type", "p_brand").alias("sig"), project.alias("project"))
    proj = p.groupBy(project.alias("project")).agg(F.min("p_type").alias("country"))
    raw = (p.select(F.col("p_name").alias("canonical"), "p_type", F.col("p_name").alias("key"))
           .unionByName(p.select(F.col("p_name").alias("canonical"), "p_type", noun.alias("key"))))
    country = raw.groupBy("canonical").agg(F.min("p_type").alias("country"))
    return acc, proj, raw.select("canonical", "key").distinct().join(country, "canonical")


_REC = _PROJ + """, rk AS (SELECT DISTINCT canonical, country, key FROM refs),
nick AS (SELECT project, arg_min(canonical, (account, canonical)) AS c FROM acc JOIN rk ON contains(nickname, key) GROUP BY project),
pk AS (SELECT project, arg_min(canonical, (-length(key), canonical)) AS c FROM proj JOIN rk ON contains(project, key) GROUP BY project),
rc AS (SELECT DISTINCT canonical, country FROM rk),
j AS (SELECT proj.project, proj.country, CASE WHEN proj.project = 'Brand#11 gear' THEN 'by hand' END AS m, CASE WHEN contains(proj.project, '#13') AND contains(proj.country, 'L') THEN 'thirteen' END AS s,
  CASE WHEN contains(proj.country, r1.country) OR contains(r1.country, proj.country) THEN nick.c END AS n, CASE WHEN contains(proj.country, r2.country) OR contains(r2.country, proj.country) THEN pk.c END AS k
  FROM proj LEFT JOIN nick USING (project) LEFT JOIN rc r1 ON r1.canonical = nick.c LEFT JOIN pk ON pk.project = proj.project LEFT JOIN rc r2 ON r2.canonical = pk.c),
rec AS (SELECT project, country, coalesce(m, s, n, k) AS canonical, CASE WHEN m IS NOT NULL THEN 'manual' WHEN s IS NOT NULL THEN 'special' WHEN n IS NOT NULL THEN 'nickname' WHEN k IS NOT NULL THEN 'key'
  WHEN contains(project, '#2') THEN 'noise' ELSE 'lead' END AS via FROM j)"""


def reconciled(t):
    acc, proj, refs = project_frames(t)
    return E.reconcile(proj, acc, refs, {"Brand#11 gear": "by hand"}, [("#13", "L", "thirteen")], F.contains("project", F.lit("#2")))


@query("reconcile_entities", "G4", f"WITH {_REC} SELECT * FROM rec")
def reconcile_entities(t):
    return reconciled(t)


@query("country_conflicts", "G4", f"""WITH {_REC}, a AS (SELECT account, canonical, nickname || ' ' || sig AS tx FROM acc JOIN rec USING (project) WHERE canonical IS NOT NULL),
own AS (SELECT DISTINCT account FROM a JOIN rk USING (canonical) WHERE contains(tx, key)), w AS (SELECT unnest(['SMALL', 'LARGE', 'MEDIUM', 'ECONOMY', 'PROMO', 'STANDARD']) AS c)
SELECT account, canonical, coalesce(account NOT IN (SELECT account FROM own) AND NOT contains(tx, rc.country) AND EXISTS (SELECT 1 FROM w WHERE contains(tx, c) AND NOT (contains(rc.country, c) OR contains(c, rc.country))), false) AS conflict
FROM a LEFT JOIN rc USING (canonical)""")
def country_conflicts(t):
    acc, _, refs = project_frames(t)
    a = acc.join(reconciled(t).where("canonical is not null").select("project", "canonical"), "project")
    out = E.split_conflicts(a, F.concat_ws(" ", "nickname", "sig"), refs, ["SMALL", "LARGE", "MEDIUM", "ECONOMY", "PROMO", "STANDARD"])
    return out.select("account", "canonical", "conflict")


@query("reassigned_accounts", "G5", f"""WITH {_REC}, a AS (SELECT account, canonical, rec.country, nickname || ' ' || sig AS tx FROM acc JOIN rec USING (project) WHERE via IN ('nickname', 'key')),
h AS (SELECT account, a.canonical AS own, rk.canonical AS other, (contains(a.country, rk.country) OR contains(rk.country, a.country)) AS fits FROM a JOIN rk ON contains(tx, key)),
g AS (SELECT account, bool_or(own = other) AS has_own, min(other) FILTER (WHERE own <> other AND fits) AS mv FROM h GROUP BY account)
SELECT a.account, a.canonical, CASE WHEN NOT coalesce(has_own, false) THEN mv END AS moved_to, coalesce(CASE WHEN NOT coalesce(has_own, false) THEN mv END, a.canonical) AS final FROM a LEFT JOIN g USING (account)""")
def reassigned_accounts(t):
    acc, _, refs = project_frames(t)
    a = acc.join(reconciled(t).where("via in ('nickname', 'key')").select("project", "canonical", "country"), "project")
    a = a.select("account", "canonical", "country", F.concat_ws(" ", "nickname", "sig").alias("tx"))
    return E.reassign(a, "tx", refs).select("account", "canonical", "moved_to", "final")


def lead_frame(t):
    """Leads named by a word pair; an account stands behind all parts of one price."""
    p = t.part
    return p.select(F.concat_ws(" ", "p_name", "p_brand").alias("name"), F.floor(F.col("p_retailprice") * 10).alias("account")) \
        .unionByName(p.select(F.col("p_name").alias("name"), (-F.col("p_partkey")).alias("account")))


@query("merge_leads", "G6", """WITH RECURSIVE leads AS (SELECT p_name || ' ' || p_brand AS name, CAST(floor(p_retailprice * 10) AS BIGINT) AS account FROM part
  UNION SELECT p_name, -p_partkey FROM part),
n AS (SELECT DISTINCT name FROM leads), e AS (SELECT a.name AS s, b.name AS d FROM n a JOIN n b ON a.name <> b.name AND length(b.name) >= 4 AND contains(a.name, b.name)
  UNION SELECT a.name, b.name FROM leads a JOIN leads b USING (account) WHERE a.name <> b.name),
u AS (SELECT s, d FROM e UNION SELECT d, s FROM e), c(name, label) USING KEY (name) AS (SELECT name, name AS label FROM n
  UNION (SELECT u.s, min(c.label) FROM c JOIN u ON u.d = c.name JOIN recurring.c AS o ON o.name = u.s WHERE c.label < o.label GROUP BY u.s))
SELECT name, first_value(name) OVER (PARTITION BY label ORDER BY length(name) DESC, name) AS merged FROM c""")
def merge_leads(t):
    return E.merge_leads(lead_frame(t).distinct())


@query("leads_in_order", "G6", """WITH RECURSIVE leads AS (SELECT p_name || ' ' || p_brand AS name, CAST(floor(p_retailprice * 10) AS BIGINT) AS account FROM part
  UNION SELECT p_name, -p_partkey FROM part),
n AS (SELECT name, row_number() OVER (ORDER BY length(name) DESC, name) AS r FROM (SELECT DISTINCT name FROM leads)),
e AS (SELECT a.r AS s, b.r AS d, true AS part, true AS longer FROM n a JOIN n b ON a.r <> b.r AND length(b.name) >= 4 AND contains(a.name, b.name)
  UNION SELECT a.r, b.r, false, length(a.name) > length(b.name) FROM leads x JOIN leads y USING (account) JOIN n a ON a.name = x.name JOIN n b ON b.name = y.name AND a.r < b.r),
c(r, owner) USING KEY (r) AS (SELECT CAST(1 AS BIGINT) AS r, CAST(1 AS BIGINT) AS owner
  UNION SELECT x.r + 1, least(x.r + 1, coalesce(min(CASE WHEN part THEN CASE WHEN o.owner = s THEN s END WHEN o.owner <> s THEN o.owner WHEN longer THEN s END), x.r + 1))
  FROM c x LEFT JOIN e ON d = x.r + 1 LEFT JOIN recurring.c o ON o.r = s WHERE x.r < (SELECT count(*) FROM n) GROUP BY x.r)
SELECT n.name, m.name AS merged FROM c JOIN n USING (r) JOIN n m ON m.r = c.owner""")
def leads_in_order(t):
    return E.merge_leads_in_order(lead_frame(t).distinct())


@query("reference_status", "G7", f"""WITH {_REC}, m AS (SELECT canonical, count(*) AS n FROM acc JOIN rec USING (project) WHERE canonical IS NOT NULL GROUP BY 1)
SELECT DISTINCT canonical, CASE WHEN canonical IN (SELECT canonical FROM m) THEN 'with accounts' WHEN canonical IN (SELECT p_name FROM part WHERE p_size = 1) THEN 'searched' ELSE 'none' END AS status FROM rk""")
def reference_status(t):
    acc, _, refs = project_frames(t)
    m = acc.join(reconciled(t).where("canonical is not null").select("project", "canonical"), "project").groupBy("canonical").agg(F.count(F.lit(1)).alias("n_accounts"))
    return E.reference_status(refs, m, t.part.where("p_size = 1").select(F.col("p_name").alias("canonical")))


@query("backfill_accounts", "G8", """WITH e AS (SELECT p_name AS canonical, p_partkey AS account FROM part WHERE p_size > 40), f AS (SELECT p_name, p_partkey, p_type, p_brand FROM part)
SELECT canonical, account, CAST(NULL AS VARCHAR) AS role, false AS is_new FROM e UNION ALL
SELECT p_name, p_partkey, CASE WHEN regexp_matches(p_name || ' ' || p_type, 'LARGE') THEN 'official' WHEN regexp_matches(p_type, 'SMALL') OR regexp_matches(p_name || ' ' || p_type, 'rod') THEN 'tenant' WHEN regexp_matches(p_name || ' ' || p_type, 'red') THEN 'personal' ELSE 'unknown' END, true
FROM f WHERE p_partkey NOT IN (SELECT account FROM e)""")
def backfill_accounts(t):
    e = t.part.where("p_size > 40").select(F.col("p_name").alias("canonical"), F.col("p_partkey").alias("account"))
    f = t.part.select(F.col("p_name").alias("canonical"), F.col("p_partkey").alias("account"), F.col("p_type").alias("sig"))
    out = E.backfill(e, f, A.role_of(F.col("canonical"), F.col("sig"), None, "LARGE", "SMALL", "rod", "red"))
    return out.select("canonical", "account", "role", "is_new")


@query("project_registry", "A31", """WITH r AS (SELECT p_partkey, p_type, p_brand, p_retailprice, unnest(string_split(p_name, ' ')[1:2]) AS project FROM part),
h AS (SELECT project, p_partkey, row_number() OVER (PARTITION BY project ORDER BY p_retailprice DESC, p_partkey) AS k FROM r)
SELECT project, CAST(count(DISTINCT p_partkey) AS BIGINT) AS account_count, max(p_retailprice) AS top_followers, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS countries,
  string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS types, (SELECT string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY k) FROM h WHERE h.project = r.project AND k <= 8) AS head_accounts FROM r GROUP BY project""")
def project_registry(t):
    return E.project_registry(t.part, F.split("p_name", " "), "p_type", "p_brand", "p_retailprice", "p_partkey")


# --- parsing of metric text that Spark derives from the tables ---------------------------------

_COUNTS = """c AS (SELECT o_orderkey, CASE WHEN o_totalprice >= 100000 THEN printf('%.1f', floor(o_totalprice / 1000) / 10) || '万' WHEN o_orderstatus = 'P' THEN '-'
  ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS txt, floor(o_totalprice / 1000) * 1000 AS big, floor(o_totalprice) AS small, o_totalprice, o_orderstatus FROM orders)"""


def count_text(t):
    o = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    return o.withColumn("txt", F.when(F.col("o_totalprice") >= 100000, F.concat(F.format_string("%.1f", F.floor(F.col("o_totalprice") / 1000) / 10), F.lit("万")))
                        .when(F.col("o_orderstatus") == "P", "-").otherwise(F.floor("o_totalprice").cast("string")))


@query("parsed_counts", "U1", f"""WITH {_COUNTS}, v AS (SELECT o_orderkey, CAST(CASE WHEN o_totalprice >= 100000 THEN big WHEN o_orderstatus <> 'P' THEN small END AS BIGINT) AS v FROM c)
SELECT o_orderkey, v AS anchored, v AS searched, coalesce(v, 0) AS zeroed, v AS labelled FROM v""")
def parsed_counts(t):
    d, x = count_text(t), F.col("txt")
    return d.select("o_orderkey", M.parse_count(x, "anchored").alias("anchored"), M.parse_count(x).alias("searched"),
                    M.parse_count(x, "zero").alias("zeroed"), M.parse_count(F.concat(F.lit("likes "), x)).alias("labelled"))


@query("parsed_rates", "U2", """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN NULL ELSE round(l_discount, 9) END AS rate FROM lineitem""")
def parsed_rates(t):
    pct = F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%"))
    txt = F.when(F.col("l_returnflag") == "R", "-").when(F.col("l_returnflag") == "A", pct).otherwise(F.col("l_discount").cast("string"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(M.parse_rate(txt), 9).alias("rate"))


@query("formatted_counts", "U3", """SELECT o_orderkey, CASE WHEN o_totalprice * 1000 >= 100000000 THEN printf('%.1f', round(o_totalprice * 1000 / 1e7) / 10) || '亿' ELSE printf('%.1f', round(o_totalprice * 1000 / 1e3) / 10) || '万' END AS shown FROM orders
UNION ALL SELECT o_orderkey, regexp_replace(CAST(CAST(floor(o_totalprice / 100) AS BIGINT) AS VARCHAR), '(\\d)(\\d{3})$', '\\1,\\2') FROM orders""")
def formatted_counts(t):
    v, s = F.col("o_totalprice") * 1000, F.floor(F.col("o_totalprice") / 100)
    return (t.orders.select("o_orderkey", M.format_count(v).alias("shown"))
            .unionByName(t.orders.select("o_orderkey", M.format_count(s).alias("shown"))))


@query("duration_seconds", "U4", """SELECT event_id, CAST(minute(ts) * 60 + second(ts) AS BIGINT) AS seconds FROM events""")
def duration_seconds(t):
    return t.events.select("event_id", M.duration_seconds(F.date_format("ts", "mm:ss")).alias("seconds"))


@query("note_keys", "U20", """SELECT doc_id, CASE WHEN lang = 'en' THEN 'id:' || CAST(doc_id AS VARCHAR) ELSE 'h:' || substring(md5(trim(source) || '|' || trim(lang)), 1, 16) END AS note_key FROM documents""")
def note_keys(t):
    return t.documents.select("doc_id", M.note_key(F.when(F.col("lang") == "en", F.col("doc_id").cast("string")), F.col("source"), F.col("lang"), "md5").alias("note_key"))


@query("extracted_links", "U21", r"""SELECT page_id, coalesce(nullif(regexp_extract(url, '(https?://blog\.[a-z.]+/[a-z]+/\d+)', 1), ''), nullif(regexp_extract(url, '(https?://[a-z.\-]+/[a-z]{2}/\d+)', 1), '')) AS link,
  regexp_extract(url, '/(\d+)', 1) AS item_id FROM pages""")
def extracted_links(t):
    u = F.col("url")
    return t.pages.select("page_id", T.extract_links(u, [r"https?://blog\.[a-z.]+/[a-z]+/\d+", r"https?://[a-z.\-]+/[a-z]{2}/\d+"]).alias("link"),
                          F.regexp_extract(u, r"/(\d+)", 1).alias("item_id"))


@query("note_details", "U26", """SELECT CAST(event_id AS VARCHAR) AS note_id, event_type AS title, CAST(floor(value) * 1000 AS BIGINT) AS likes, CAST(json_extract_string(props, '$.k') AS BIGINT) AS collects,
  strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS publish_time, 'user ' || CAST(user_id AS VARCHAR) AS author, event_type || ',' || CAST(user_id AS VARCHAR) AS tags FROM events""")
def note_details(t):
    d = Pa.parse_note_detail(note_payloads(t), "payload")
    return d.select("note_id", "title", "likes", "collects", "publish_time", "author", "tags")


def note_payloads(t):
    e = t.events
    interact = F.struct(F.concat(F.format_string("%.1f", F.floor("value") / 10), F.lit("万")).alias("likedCount"), F.get_json_object("props", "$.k").alias("collectCount"))
    tag = F.array(F.struct(F.col("event_type").alias("name")), F.struct(F.col("user_id").cast("string").alias("name")))
    note = F.struct(F.col("event_id").cast("string").alias("noteId"), F.col("event_type").alias("title"), interact.alias("interactInfo"), tag.alias("tagList"),
                    F.unix_millis(F.col("ts").cast("timestamp")).alias("time"), F.struct(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("nickname")).alias("user"))
    return e.select("event_id", F.to_json(F.struct(note.alias("note"))).alias("payload"))


@query("deep_values", "U25", """SELECT event_id, 'user ' || CAST(user_id AS VARCHAR) AS author, json_extract_string(props, '$.k') AS saves FROM events""")
def deep_values(t):
    d = compute_once(note_payloads(t), doc=F.try_parse_json(F.col("payload")))
    return d.select("event_id", Pa.deep_get(F.col("doc"), ["nickName", "nickname"], ["user", "note.user"]).alias("author"),
                    Pa.deep_get(F.col("doc"), ["collectCount"], ["note", "note.interactInfo"]).alias("saves"))


@query("packed_descriptions", "U5", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE strftime(ts, '%M:%S') END AS duration, CAST(floor(value * 10) * 1000 AS BIGINT) AS play_count,
  event_type || ',' || 'k' || json_extract_string(props, '$.k') AS tags, 'u' || CAST(user_id AS VARCHAR) AS author, CAST(hour(ts) AS VARCHAR) || '小时前' AS publish_time, 'post of ' || event_type AS title FROM events""")
def packed_descriptions(t):
    k = F.get_json_object("props", "$.k")
    dur = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.date_format("ts", "mm:ss"), F.lit(" ")))
    text = F.concat(F.lit("合集 "), dur, F.format_string("%.1f", F.floor(F.col("value") * 10) / 10), F.lit("万 post of "), "event_type", F.lit(" #"), "event_type",
                    F.lit(" #k"), k, F.lit(" @u"), F.col("user_id").cast("string"), F.lit(" "), F.hour("ts").cast("string"), F.lit("小时前"))
    d = Pa.parse_desc(t.events.select("event_id", text.alias("raw")), "raw")
    return d.select("event_id", "duration", "play_count", F.array_join("tags", ",").alias("tags"), "author", "publish_time", "title")


@query("account_cards", "U6", """SELECT c_name AS nickname, 'id' || CAST(c_custkey AS VARCHAR) || 'x' AS account_id, CAST(CASE WHEN c_acctbal > 0 THEN floor(c_acctbal) * 10000 ELSE 0 END AS BIGINT) AS likes,
  CAST(c_nationkey * 100 AS BIGINT) AS followers, 'we make ' || lower(c_mktsegment) AS signature FROM customer""")
def account_cards(t):
    likes = F.when(F.col("c_acctbal") > 0, F.concat(F.floor("c_acctbal").cast("string"), F.lit("万"))).otherwise("12")
    card = F.concat(F.col("c_name"), F.lit("\n关注\n抖音号: id"), F.col("c_custkey").cast("string"), F.lit("x"), likes, F.lit("获赞"),
                    (F.col("c_nationkey") * 100).cast("string"), F.lit("粉丝\nhello\nwe make "), F.lower("c_mktsegment"))
    d = Pa.parse_account_card(t.customer.select(card.alias("card")), "card")
    return d.select("nickname", "account_id", "likes", "followers", "signature")
