"""Dictionary words and fitted weights: documents are texts, their short words the dictionary."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import segment as Sg
from tidemark.plans.registry import query

_RUNS = "runs AS (SELECT run, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS run FROM documents) GROUP BY run)"
#: Words of two to four letters that stand five times or more.
_EDGE = "CASE WHEN len(b) >= {0} THEN {{'c': d{0}.cost + b[{0}].c, 'l': -{0}, 'p': substr(run, i - 1, {0}) || ' ' || b[{0}].p}} END"


def short_words(t):
    words = t.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words.where(F.length("word").between(2, 4)).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")


@query("segmented_words", "A1 U15", f"""WITH RECURSIVE {_RUNS},
d0 AS (SELECT run AS word, n FROM runs WHERE length(run) BETWEEN 2 AND 4 AND n >= 5),
u AS (SELECT coalesce(sum(n), 1) AS total, CAST(floor(1000 * ln(coalesce(sum(n), 1)::double)) AS BIGINT) AS cost FROM d0),
d AS (SELECT word, CAST(floor(1000 * ln((SELECT total FROM u)::double / n)) AS BIGINT) AS cost FROM d0),
back AS (SELECT run, n, length(run) + 1 AS i, [{{'c': 0::bigint, 'l': 0, 'p': ''}}] AS b FROM runs
  UNION ALL
  SELECT run, n, i - 1, list_prepend(least({{'c': (SELECT cost FROM u) + b[1].c, 'l': -1, 'p': substr(run, i - 1, 1) || ' ' || b[1].p}},
    CASE WHEN d2.cost IS NOT NULL THEN {_EDGE.format(2)} END, CASE WHEN d3.cost IS NOT NULL THEN {_EDGE.format(3)} END, CASE WHEN d4.cost IS NOT NULL THEN {_EDGE.format(4)} END), b)[1:4]
  FROM back LEFT JOIN d d2 ON d2.word = substr(run, i - 1, 2) LEFT JOIN d d3 ON d3.word = substr(run, i - 1, 3) LEFT JOIN d d4 ON d4.word = substr(run, i - 1, 4) WHERE i > 1),
w AS (SELECT unnest(string_split(b[1].p, ' ')) AS word, n FROM back WHERE i = 1)
SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 2 AND word NOT IN ('the', 'und') GROUP BY word""")
def segmented_words(t):
    return Sg.segmented_frequency(t.documents, short_words(t), stop_words=["the", "und"])


@query("fitted_keywords", "X15", r"""WITH t AS (SELECT source, doc_id, unnest(regexp_extract_all(lower(text), '\p{L}{3,}')) AS word FROM documents),
f AS (SELECT word, ln((SELECT count(*) FROM documents WHERE doc_id % 2 = 0) / count(DISTINCT doc_id)) AS weight FROM t WHERE doc_id % 2 = 0 GROUP BY word),
m AS (SELECT l[len(l) // 2 + 1] AS weight FROM (SELECT list_sort(list(weight)) AS l FROM f)),
tf AS (SELECT source, word, count(*) AS n FROM t WHERE doc_id % 2 = 1 GROUP BY ALL), sz AS (SELECT source, sum(n) AS total FROM tf GROUP BY source),
w AS (SELECT source, word, n, f.weight IS NOT NULL AS known, CAST(floor(n / total * coalesce(f.weight, (SELECT weight FROM m)) * 1000000) AS BIGINT) AS weight FROM tf JOIN sz USING (source) LEFT JOIN f USING (word))
SELECT source, word, CAST(n AS BIGINT) AS n, weight, known, CAST(row_number() OVER (PARTITION BY source ORDER BY weight DESC, word) AS BIGINT) AS rank FROM w QUALIFY rank <= 30""")
def fitted_keywords(t):
    """Weights fitted on the documents with even ids score the others, which come later."""
    weights = Sg.fit_term_weights(t.documents.where("doc_id % 2 = 0"), "text", r"\p{L}{3,}", "even")
    return Sg.weighted_keywords(t.documents.where("doc_id % 2 = 1"), "source", "text", r"\p{L}{3,}", weights, "even")
