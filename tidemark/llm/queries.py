"""The numbered queries: each applies one operator to its whole table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import conversations, decontaminate, html_text, licenses, line_dedup, ngram_join, packing, quality, resampling, secrets, sharding, tree_model, url_lists
from tidemark.operators.ordering import join_on

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

VOCABULARY = "word_bpe_49k.json"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query()
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    into = "secrets"
    d = secrets.find_secrets(table(spark, sf_dir, "documents"), into=into, keep=["doc_id"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    return d.select("doc_id", *[f"{into}.n_{k}" for k in secrets.KINDS[:3]],
                    F.sha2(listed(F.filter(f"{into}.spans", lambda s: s["kind"] != "novel")), 256).alias("base_sha256"),
                    listed(F.col(f"{into}.spans")).alias("spans"), f"{into}.n_novel")


# pairs of neighbouring lines, long lines, and stretches of blank lines with the lines with words around them; each stays where it stands first
@query(r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i, len(l) AS n FROM docs),
counted AS (SELECT doc_id, i, n, len(list_filter(string_split_regex(line, '[ \t-\r]+'), lambda x: x <> '')) AS words FROM lines),
told AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS word, lead(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL AS final, n FROM counted WHERE words > 0),
units AS (SELECT doc_id, i AS first, i AS last FROM counted WHERE words >= 50
  UNION SELECT a.doc_id, a.i, b.i FROM counted a JOIN counted b ON a.doc_id = b.doc_id AND b.i = a.i + 1 AND a.words + b.words > 0
  UNION SELECT doc_id, coalesce(word, 0), i FROM told WHERE i - coalesce(word, 0) > CASE WHEN word IS NULL THEN 1 ELSE 2 END
  UNION SELECT doc_id, i, n - 1 FROM told WHERE final AND n - 1 - i > 1),
placed AS (SELECT doc_id, first, last, row_number() OVER (PARTITION BY array_to_string(l[first + 1:last + 1], chr(10)), last - first ORDER BY doc_id, first) AS place FROM units JOIN docs USING (doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM placed WHERE place > 1)
SELECT doc_id, count(gone.i) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY lines.i) FILTER (WHERE gone.i IS NULL), '') AS text
FROM lines LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id""")
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text after line deduplication, and the number of lines removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_runs(docs, into="n_removed").select("doc_id", "n_removed", F.coalesce("text", F.lit("")).alias("text"))


@query()
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard and place; counts of shards differ by one at most."""
    d = sharding.shard_rows(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), "slot",
                    F.lit(None).cast("int").alias("grown_shard"))


# words by the folded class, as lists; windows as texts with the words joined by a space
_FOLDED = r"""list_filter(string_split_regex(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

_TEMPLATES = ", ".join(f"({i}, '{t.label}', {t.base}, '" + t.text.replace("'", "''") + "')" for i, t in enumerate(licenses.TEMPLATES))
_PAIRS = "unnest(list_transform(range(1, len(w)), lambda i: {'p': i - 1, 'g': w[i] || ' ' || w[i + 1]})) AS x"


@query(f"""
WITH tpl AS (SELECT template, label, base, {_FOLDED.format('text')} AS w FROM (VALUES {_TEMPLATES}) v(template, label, base, text)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_FOLDED.format('text')} AS w FROM documents),
tg AS (SELECT template, label, base, len(w) AS tlen, {_PAIRS} FROM tpl), dg AS (SELECT r, {_PAIRS} FROM docs),
hits AS (SELECT DISTINCT r, template, label, base, tlen, tg.x.p AS tpos, dg.x.p AS pos, dg.x.p - tg.x.p AS diagonal FROM dg JOIN tg ON dg.x.g = tg.x.g),
whole AS (SELECT r, label, diagonal AS start FROM hits WHERE base GROUP BY r, template, label, tlen, diagonal HAVING count(*) = tlen - 1),
jumps AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal, pos) > {licenses.NEAR}, true) AS jump FROM hits WHERE NOT base),
chains AS (SELECT *, sum(jump::int) OVER (PARTITION BY r, template ORDER BY diagonal, pos) AS chain FROM jumps),
bands AS (SELECT *, (diagonal - min(diagonal) OVER (PARTITION BY r, template, chain)) // tlen AS b FROM chains),
spans AS (SELECT r, label, least((count(DISTINCT tpos) + 1)::double / tlen, 1) AS score FROM (SELECT *, unnest(list_distinct([b, greatest(b - 1, 0)])) AS band FROM bands)
  GROUP BY r, template, label, tlen, chain, band HAVING least((count(DISTINCT tpos) + 1)::double / tlen, 1) >= CASE WHEN tlen < {licenses.SHORT} THEN 1 ELSE {licenses.COVERED}::double END),
found AS (SELECT r, label, start, 1::double AS score FROM whole UNION ALL SELECT r, label, NULL, score FROM spans),
per AS (SELECT r, count(start) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE start IS NOT NULL) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM found GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_base, 0) AS n_base, first_word::bigint AS first_word, last_word::bigint AS last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, coalesce(score, 0)::double AS score FROM docs LEFT JOIN per USING (r)""")
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document."""
    return licenses.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query(f"""
WITH items AS (SELECT cast(item_id AS varchar) AS item, {_FOLDED.format('text')} AS w FROM benchmark),
sized AS (SELECT item, w, least(len(w), 13) AS k FROM items WHERE len(w) > 0),
item_windows AS (SELECT DISTINCT item, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS win FROM sized),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_FOLDED.format('text')} AS w FROM documents),
doc_windows AS (SELECT r, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS win,
  unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM item_windows) WHERE len(w) >= k),
hits AS (SELECT d.r, d.i, d.k, x.item FROM doc_windows d JOIN item_windows x ON d.k = x.k AND d.win = x.win),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY r)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, cast(coalesce(len(items), 0) AS bigint) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN places USING (r) LEFT JOIN found USING (r)""")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    docs, into = table(spark, sf_dir, "documents"), "passages"
    found = decontaminate.find_passages(docs, table(spark, sf_dir, "benchmark"), into=into, keep=["doc_id"])
    return found.select("doc_id", f"{into}.n_words", f"{into}.n_hit", F.size(f"{into}.items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(f"{into}.items", ","), 256).alias("items_sha256"),
                        decontaminate.is_contaminated(into).alias("contaminated"))


@query(r"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
docs AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '[ \t-\r]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS l FROM base),
grams AS (SELECT r, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g,
  unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) >= 3),
many AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM many) GROUP BY r),
m AS (SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(length(regexp_replace(t, '[ \t-\r]', '', 'g')) AS bigint) AS word_chars,
  cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols,
  cast(len(l) - len(list_distinct(l)) AS bigint) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, cast(len(l) AS bigint) AS n_lines,
  len(list_filter(w, lambda x: length(x) > 1 AND x <> lower(x) AND x = upper(x))) AS n_shouts FROM docs LEFT JOIN covered USING (r)),
j AS (SELECT *, n_words < 50 AS f0, 100 * n_repeat_words > 50 * n_words AS f1, 10 * n_symbols > 3 * n_words AS f2, word_chars > 20 * n_words AS f3,
  2 * n_shouts > n_words AS f4, 2 * n_dup_lines > n_lines AND n_dup_lines > 3 AS f5 FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0 OR f1 AS base_failed, NOT (f0 OR f1 OR f2 OR f3 OR f4 OR f5) AS kept,
  cast(f0 AS bigint) + 2 * cast(f1 AS bigint) + 4 * cast(f2 AS bigint) + 8 * cast(f3 AS bigint) + 16 * cast(f4 AS bigint) + 32 * cast(f5 AS bigint) AS failed_bits
FROM j""")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and verdicts of every document."""
    d = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    bits = F.col("ledger.failed")
    return d.select("doc_id", *[f"ledger.{m}" for m in quality.MEASURES[:5]], quality.fails(bits, quality.POLICIES["base"]).alias("base_failed"),
                    (~quality.fails(bits, quality.POLICIES["v1"])).alias("kept"), bits.alias("failed_bits"))


@query()
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """List entries that the pages themselves give: every host is listed, removed and listed again, by its pages' ids.

    Hosts with a word of the trade are on ``spam``, others on ``review``; the first folder of each host is on ``folder``.
    """
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    entry = lambda name, pattern, action, n: F.struct(name.alias("list"), pattern.alias("pattern"), F.lit(action).alias("action"), day(n).alias("dated"))
    p = pages.select("page_id", html_text.host_of(F.col("url")).alias("host"), html_text.path_of(F.col("url")).alias("path")).where("host <> ''")
    hosts = p.groupBy("host").agg(F.min("page_id").alias("i"), F.count(F.lit(1)).alias("n"))
    name = F.when(F.col("host").rlike("spam|pills|casino|cheap|farm"), F.lit("spam")).otherwise(F.lit("review"))
    first, span = F.pmod(F.col("i") * 7, F.lit(300)), 20 + F.pmod(F.col("n"), F.lit(60))
    by_host = hosts.select(F.inline(F.array(entry(name, F.col("host"), "add", first), entry(name, F.col("host"), "remove", first + span),
                                            entry(name, F.col("host"), "add", first + span + 40))))
    folder = F.concat("host", F.lit("/"), F.get(F.split("path", "/"), F.lit(1)), F.lit("/"))
    folders = p.where(F.size(F.split("path", "/")) > 2).groupBy(folder.alias("pattern")).agg(F.min("page_id").alias("i"))
    start = F.pmod(F.col("i") * 11, F.lit(300))
    by_folder = folders.select(F.inline(F.array(entry(F.lit("folder"), F.col("pattern"), "add", start), entry(F.lit("folder"), F.col("pattern"), "remove", start + 45))))
    return by_host.unionByName(by_folder)


@query(r"""
WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
  regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, DATE '2024-01-01' + cast(page_id * 37 % 365 AS int) AS fetched FROM pages),
h AS (SELECT host, min(page_id) AS i, count(*) AS n FROM p WHERE host <> '' GROUP BY host),
hh AS (SELECT host, CASE WHEN regexp_matches(host, 'spam|pills|casino|cheap|farm') THEN 'spam' ELSE 'review' END AS list,
  DATE '2024-01-01' + cast(i * 7 % 300 AS int) AS d, cast(20 + n % 60 AS int) AS s FROM h),
f AS (SELECT host || '/' || string_split(path, '/')[2] || '/' AS pattern, min(page_id) AS i FROM p WHERE host <> '' AND len(string_split(path, '/')) > 2 GROUP BY 1),
ff AS (SELECT pattern, DATE '2024-01-01' + cast(i * 11 % 300 AS int) AS d FROM f),
v AS (SELECT list, host AS pattern, d AS since, d + s AS until FROM hh UNION ALL SELECT list, host, d + s + 40, DATE '9999-12-31' FROM hh
  UNION ALL SELECT 'folder', pattern, d, d + 45 FROM ff),
m AS (SELECT page_id, list_sort(list(DISTINCT list)) AS lists FROM p JOIN v ON fetched >= since AND fetched < until
  AND (host = pattern OR ends_with(host, '.' || pattern) OR (contains(pattern, '/') AND starts_with(host || path, pattern))) GROUP BY page_id)
SELECT page_id, url, fetched, coalesce(array_to_string(lists, ','), '') AS lists, cast(coalesce(len(lists), 0) AS bigint) AS n_lists,
  NOT coalesce(list_contains(lists, 'spam'), false) AS allowed FROM p LEFT JOIN m USING (page_id)""")
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, as a capture of some day of 2024, with the lists that held its URL on that day."""
    pages = table(spark, sf_dir, "pages")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int"))
    captures = pages.select("page_id", "url", fetched.alias("fetched"))
    d = url_lists.active_lists(captures, dated_entries(pages))
    return d.select("page_id", "url", "fetched", F.array_join("lists", ",").alias("lists"), F.size("lists").cast("long").alias("n_lists"),
                    (~F.array_contains("lists", "spam")).alias("allowed"))


@query()
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


@query(r"""
WITH RECURSIVE docs AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM docs),
grams AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM sets),
links AS (SELECT a.doc_id AS s, b.doc_id AS d FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
c(doc_id, label) USING KEY (doc_id) AS (SELECT doc_id, doc_id AS label FROM docs
  UNION (SELECT s, min(c.label) FROM c JOIN links ON d = c.doc_id JOIN recurring.c AS o ON o.doc_id = s WHERE c.label < o.label GROUP BY s))
SELECT doc_id, cast(len(g) AS bigint) AS n_shingles, label AS component_id FROM sets JOIN c USING (doc_id)""")
def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its set and its component."""
    return ngram_join.components(table(spark, sf_dir, "documents"))


# the 256 steps of CRC-32 by their rule, and the unsigned CRC of a text's UTF-8 bytes with them as ``t``
_CRC_STEPS = """SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
 FROM range(256) r(i)"""
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(strlen({0})), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::bigint)),
 lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"""


@query(f"""
WITH steps AS ({_CRC_STEPS}),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_FOLDED.format('text')} AS w FROM documents),
words AS (SELECT r, unnest(w) AS w FROM docs), items AS (SELECT unnest({_FOLDED.format('text')}) AS w FROM benchmark),
named AS (SELECT w, {_CRC.format('w')} % 10000 AS b FROM (SELECT w FROM words UNION SELECT w FROM items), steps),
s AS (SELECT b, count(*) AS s FROM words JOIN named USING (w) GROUP BY b), t AS (SELECT b, count(*) AS t FROM items JOIN named USING (w) GROUP BY b),
gains AS (SELECT b, cast(floor(1000 * ln((coalesce(t, 0)::double + 1) * ((SELECT count(*) FROM words)::double + 10000)
  / ((coalesce(s, 0)::double + 1) * ((SELECT count(*) FROM items)::double + 10000)))) AS bigint) AS gain FROM s FULL JOIN t USING (b)),
weights AS (SELECT r, cast(sum(gain) AS bigint) AS weight FROM words JOIN named USING (w) JOIN gains USING (b) GROUP BY r),
scored AS (SELECT r, doc_id, cast(len(w) AS bigint) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296::double))) AS bigint) AS score
  FROM docs LEFT JOIN weights USING (r)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS p FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= 20 AND p <= (SELECT count(*) FROM docs WHERE len(w) >= 20) * 10 // 100 THEN p END AS rank FROM placed""")
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight and score against the benchmark's distribution, and its rank if it is drawn."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# rows after damage with their codes (class of the initial, fault), then the cheapest edits of every suffix, from the last row back
@query(rf"""
WITH RECURSIVE steps AS ({_CRC_STEPS}),
places AS (SELECT DISTINCT coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS p FROM conversations),
damage AS (SELECT p, {_CRC.format('p')} % 20 AS k FROM places, steps),
raw AS (SELECT conv_id, turn, k, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text,
  CASE k WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role FROM conversations JOIN damage ON p = coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') WHERE k <> 0),
rows AS (SELECT conv_id, turn, role, text FROM raw UNION ALL SELECT conv_id, turn, role, text FROM raw WHERE k = 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(len(role) || ':' || role || text)) AS i FROM rows),
faults AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
  WHEN right(regexp_replace(text, '[ 	-
]+$', ''), 1) IN ('.', '!', '?') THEN '' ELSE 't' END AS f,
  CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS q FROM placed),
lists AS (SELECT conv_id, count(*) AS n, list(struct_pack(f := f, r := r, role := role, text := text) ORDER BY i) AS l,
  coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate,
  count(*) FILTER (f = 't') AS truncated, count(*) FILTER (i > 1 AND coalesce(q || left(role, 1), '') NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id),
-- states: n nothing yet, s, u, a; the best suffix of each as {{cost, audit}}, compared in that order
back AS (SELECT conv_id, l, n AS i, {{'c': 0, 'e': ''}} AS n_, {{'c': 6, 'e': 'II'}} AS s_, {{'c': 3, 'e': 'I'}} AS u_, {{'c': 0, 'e': ''}} AS a_ FROM lists
  UNION ALL
  SELECT conv_id, l, i - 1, least(bn, {{'c': iu.c + 3, 'e': 'I' || iu.e}}), least(bs, {{'c': iu.c + 3, 'e': 'I' || iu.e}}), iu, ia FROM (
   SELECT *, least(bu, {{'c': ba.c + 3, 'e': 'I' || ba.e}}) AS iu, least(ba, {{'c': bu.c + 3, 'e': 'I' || bu.e}}) AS ia FROM (
    SELECT conv_id, l, i,
     least({{'c': n_.c + 4, 'e': 'D' || n_.e}}, CASE WHEN g THEN {{'c': u_.c + 3 + t, 'e': 'R' || u_.e}} END, CASE WHEN g AND r = 's' THEN {{'c': s_.c + t, 'e': 'K' || s_.e}} END,
      CASE WHEN g AND r = 'u' THEN {{'c': u_.c + t, 'e': 'K' || u_.e}} END) AS bn,
     least({{'c': s_.c + 4, 'e': 'D' || s_.e}}, CASE WHEN g THEN {{'c': u_.c + 3 + t, 'e': 'R' || u_.e}} END, CASE WHEN g AND r = 'u' THEN {{'c': u_.c + t, 'e': 'K' || u_.e}} END) AS bs,
     least({{'c': u_.c + 4, 'e': 'D' || u_.e}}, CASE WHEN g THEN {{'c': a_.c + 3 + t, 'e': 'R' || a_.e}} END, CASE WHEN g AND r = 'a' THEN {{'c': a_.c + t, 'e': 'K' || a_.e}} END) AS bu,
     least({{'c': a_.c + 4, 'e': 'D' || a_.e}}, CASE WHEN g THEN {{'c': u_.c + 3 + t, 'e': 'R' || u_.e}} END, CASE WHEN g AND r = 'u' THEN {{'c': u_.c + t, 'e': 'K' || u_.e}} END) AS ba
    FROM (SELECT *, l[i].r AS r, l[i].f NOT IN ('b', 'd') AS g, CASE WHEN l[i].f = 't' THEN 3 ELSE 0 END AS t FROM back WHERE i > 0)))),
best AS (SELECT conv_id, l, n_.c AS cost, n_.e AS audit FROM back WHERE i = 0),
-- forward over the edits: p edits used, j rows used, s the last role initial
fore AS (SELECT conv_id, l, audit, 0 AS p, 0 AS j, '' AS s, NULL::varchar AS line, '' AS made FROM best
  UNION ALL
  SELECT conv_id, l, audit, p + 1, j + CASE e WHEN 'I' THEN 0 ELSE 1 END, CASE e WHEN 'D' THEN s WHEN 'K' THEN left(l[j + 1].role, 1) ELSE x END, NULL,
   made || CASE e WHEN 'D' THEN '' ELSE CASE WHEN s = '' THEN '' ELSE chr(10) END || CASE e WHEN 'K' THEN l[j + 1].role WHEN 'I' THEN y ELSE y END || ':' ||
    CASE e WHEN 'I' THEN '' ELSE l[j + 1].text END END
  FROM (SELECT *, audit[p + 1] AS e, CASE WHEN s = 'u' THEN 'a' ELSE 'u' END AS x, CASE WHEN s = 'u' THEN 'assistant' ELSE 'user' END AS y FROM fore WHERE p < len(audit))),
done AS (SELECT conv_id, made FROM fore WHERE p = len(audit))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, cast(coalesce(cost, 0) AS bigint) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(made, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN lists x ON c.conv_id IS NOT DISTINCT FROM x.conv_id
 LEFT JOIN best b ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN done d ON c.conv_id IS NOT DISTINCT FROM d.conv_id""")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with the faults of its damaged rows and its cheapest repair."""
    rows = table(spark, sf_dir, "conversations")
    fixed = conversations.repair(conversations.damaged(rows))
    ids = rows.select("conv_id").distinct()
    zeros = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return join_on(ids, fixed, ["conv_id"], how="left").select(
        "conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@query()
def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score under the tree model and under word counts."""
    return tree_model.score(table(spark, sf_dir, "documents"))
