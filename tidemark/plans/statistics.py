"""Statistics queries on events (value = metric) and lineitem (numeric profiles)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import bootstrap as B, posts as P, stats as S
from tidemark.operators.ordering import order_statistics, quantile_position, truncated_position
from tidemark.plans.posts import POSTS, posts, rounded
from tidemark.plans.registry import query
from tidemark.session import write_through


def _cdf(x):
    t = f"(1 / (1 + 0.3275911 * (abs({x}) / sqrt(2.0))))"
    poly = f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))))"
    return f"(0.5 * (1 + (1 - {poly} * exp(-(abs({x}) / sqrt(2.0)) * (abs({x}) / sqrt(2.0))))))"


def compare_sql(source: str, least: str = "100") -> str:
    """DuckDB statement over ``source`` with columns key, side, value."""
    return f"""r AS (SELECT key, side, value, rank() OVER (PARTITION BY key ORDER BY value)
    + (count(*) OVER (PARTITION BY key, value) - 1) / 2.0 AS rk,
    row_number() OVER (PARTITION BY key, side ORDER BY value) - 1 AS pos, count(*) OVER (PARTITION BY key, side) AS ns FROM {source}
    WHERE side IS NOT NULL AND value IS NOT NULL),
g AS (SELECT key, count(*) FILTER (WHERE side = 'a') AS na, count(*) FILTER (WHERE side = 'b') AS nb,
    median(value) FILTER (WHERE side = 'a') AS ma, median(value) FILTER (WHERE side = 'b') AS mb,
    avg(value) FILTER (WHERE side = 'a') AS xa, avg(value) FILTER (WHERE side = 'b') AS xb,
    var_samp(value) FILTER (WHERE side = 'a') AS va, var_samp(value) FILTER (WHERE side = 'b') AS vb,
    sum(rk) FILTER (WHERE side = 'a') AS r1,
    {', '.join(f"max(value) FILTER (WHERE side = '{s}' AND pos = greatest(0, floor(ns / 2 - 0.98 * sqrt(ns)))) AS lo_{s}, max(value) FILTER (WHERE side = '{s}' AND pos = least(ns - 1, ceil(ns / 2 + 0.98 * sqrt(ns)))) AS hi_{s}" for s in 'ab')}
    FROM r GROUP BY key),
d AS (SELECT *, CASE WHEN na >= 2 AND nb >= 2 AND sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) > 0
      THEN (xa - xb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) ELSE 0.0 END AS cd,
    CASE WHEN na >= 3 AND nb >= 3 THEN (least(r1 - na * (na + 1) / 2.0, na * nb - (r1 - na * (na + 1) / 2.0)) - na * nb / 2.0)
      / sqrt(na * nb * (na + nb + 1) / 12.0) ELSE 0.0 END AS zz FROM g WHERE na > 0 AND nb > 0),
p AS (SELECT *, CASE WHEN na >= 3 AND nb >= 3 THEN 2 * (1 - {_cdf('zz')}) ELSE 1.0 END AS pv FROM d),
cmp AS (SELECT key, CAST(na AS BIGINT) AS n_a, CAST(nb AS BIGINT) AS n_b, round(ma, 9) AS median_a, round(mb, 9) AS median_b,
    round(CASE WHEN na < 5 THEN ma ELSE lo_a END, 9) AS ci_lo_a, round(CASE WHEN na < 5 THEN ma ELSE hi_a END, 9) AS ci_hi_a,
    round(CASE WHEN nb < 5 THEN mb ELSE lo_b END, 9) AS ci_lo_b, round(CASE WHEN nb < 5 THEN mb ELSE hi_b END, 9) AS ci_hi_b,
    round(ma - mb, 9) AS diff, round(cd, 9) AS cohens_d, round(zz, 9) AS z, round(pv, 5) AS p_value,
    CASE WHEN least(na, nb) < {least} THEN 'F' WHEN abs(cd) >= 0.5 AND pv < 0.01 THEN 'A' WHEN abs(cd) >= 0.3 AND pv < 0.05 THEN 'B' ELSE 'C' END AS grade,
    CASE WHEN pv < 0.001 THEN '***' WHEN pv < 0.01 THEN '**' WHEN pv < 0.05 THEN '*' ELSE 'ns' END AS significance FROM p)"""


def tidy(df, key):
    out = rounded(df, "median_a", "median_b", "ci_lo_a", "ci_hi_a", "ci_lo_b", "ci_hi_b", "diff", "cohens_d", "z")
    return out.withColumn("p_value", F.round("p_value", 5)).withColumnRenamed(key, "key")


TYPE_PAIRS = f"""{POSTS}, src AS (SELECT t AS key, CASE WHEN event_type = t THEN 'a' ELSE 'b' END AS side, value FROM posts,
  (SELECT unnest(['view', 'click', 'purchase']) AS t))"""


def type_flags(t):
    return posts(t).select("value", *[(F.col("event_type") == n).alias(n) for n in ("view", "click", "purchase")])


@query("compare_groups", "X1 X2 X3 X4 X6", f"WITH {TYPE_PAIRS}, {compare_sql('src')} SELECT * FROM cmp")
def compare_groups(t):
    return tidy(S.flag_tests(type_flags(t), ["view", "click", "purchase"], "value"), "feature")


@query("cohens_d", "X2", """SELECT round((avg(value) FILTER (WHERE event_type = 'view') - avg(value) FILTER (WHERE event_type <> 'view')) /
  sqrt(((count(*) FILTER (WHERE event_type = 'view') - 1) * var_samp(value) FILTER (WHERE event_type = 'view')
  + (count(*) FILTER (WHERE event_type <> 'view') - 1) * var_samp(value) FILTER (WHERE event_type <> 'view')) / (count(*) - 2)), 9) AS d FROM events""")
def cohens_d(t):
    on = F.col("event_type") == "view"
    v = F.col("value")
    one = t.events.agg(F.count_if(on).alias("na"), F.count_if(~on).alias("nb"), F.avg(F.when(on, v)).alias("ma"),
                       F.avg(F.when(~on, v)).alias("mb"), F.var_samp(F.when(on, v)).alias("va"), F.var_samp(F.when(~on, v)).alias("vb"))
    return one.select(F.round(S.cohens_d(*[F.col(c) for c in ("na", "nb", "ma", "mb", "va", "vb")]), 9).alias("d"))


@query("quality_grades", "X6", f"""WITH {TYPE_PAIRS}, {compare_sql('src', '(SELECT greatest(floor(count(*) * 0.03), 100) FROM posts)')}
SELECT key, grade, significance FROM cmp""")
def quality_grades(t):
    least = t.events.agg(S.min_sample(F.count(F.lit(1))).alias("m")).scalar()
    return tidy(S.flag_tests(type_flags(t), ["view", "click", "purchase"], "value", least), "feature").select("key", "grade", "significance")


@query("group_profile", "X4 X7", f"""WITH {POSTS}, r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS pos,
  count(*) OVER (PARTITION BY event_type) AS n FROM posts)
SELECT event_type, CAST(any_value(n) AS BIGINT) AS n, round(median(value), 9) AS median,
  round(max(value) FILTER (WHERE pos = greatest(0, floor(n / 2 - 0.98 * sqrt(n)))), 9) AS ci_lo,
  round(max(value) FILTER (WHERE pos = least(n - 1, ceil(n / 2 + 0.98 * sqrt(n)))), 9) AS ci_hi, any_value(n) >= 100 AS enough FROM r GROUP BY event_type""")
def group_profile(t):
    return rounded(S.group_profile(posts(t), "event_type", "value"), "median", "ci_lo", "ci_hi")


@query("bootstrap_medians", "X4", f"""WITH {POSTS} SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(median(value), 9) AS median, true AS ordered, true AS near_limit FROM posts GROUP BY event_type""")
def bootstrap_medians(t):
    """Medians with resampled intervals: their ends are around the median, at ranks near those of the large-sample limit."""
    p = posts(t)
    d = write_through(B.bootstrap_medians(p, ["event_type"], "value").withColumnRenamed("event_type", "key"), "intervals")
    below = p.join(d, F.col("event_type") == F.col("key")).groupBy("key").agg(F.count_if(F.col("value") < F.col("lo")).alias("a"), F.count_if(F.col("value") <= F.col("hi")).alias("b"),
                                                                      *[F.max(c).alias(c) for c in ("n", "median", "lo", "hi")])
    off = lambda c, sign: F.abs(F.col(c) - (F.col("n") / 2 + sign * 0.98 * F.sqrt("n"))) <= 0.25 * F.sqrt("n") + 2
    return below.select(F.col("key").alias("event_type"), "n", F.round("median", 9).alias("median"),
                        ((F.col("lo") <= F.col("median")) & (F.col("median") <= F.col("hi"))).alias("ordered"), (off("a", -1) & off("b", 1)).alias("near_limit"))


@query("multi_group", "X7", f"""WITH {POSTS}, m AS (SELECT event_type, median(value) AS md FROM posts GROUP BY 1),
b AS (SELECT event_type FROM m ORDER BY md DESC, event_type LIMIT 1),
src AS (SELECT o.event_type AS key, CASE WHEN p.event_type = o.event_type THEN 'b' ELSE 'a' END AS side, p.value FROM m o, b, posts p
  WHERE o.event_type <> b.event_type AND p.event_type IN (o.event_type, b.event_type)), {compare_sql('src')}
SELECT (SELECT event_type FROM b) AS best, key AS other, n_a AS n_best, n_b AS n_other, median_a AS median_best, median_b AS median_other,
  cohens_d, p_value, grade, significance FROM cmp""")
def multi_group(t):
    out = rounded(S.multi_group(posts(t), "event_type", "value"), "median_best", "median_other", "cohens_d")
    return out.withColumn("p_value", F.round("p_value", 5))


@query("percentiles", "X5", """SELECT round(quantile_cont(l_extendedprice, 0.05), 9) AS p5, round(quantile_cont(l_extendedprice, 0.25), 9) AS p25,
  round(quantile_cont(l_extendedprice, 0.9), 9) AS p90, round(quantile_cont(l_extendedprice, 0.95), 9) AS p95 FROM lineitem""")
def percentiles(t):
    s = order_statistics(t.lineitem, [], ["l_extendedprice"], {"p5": quantile_position(.05), "p25": .25, "p90": .9, "p95": .95})
    return s.select(*[F.round(f"{p}_l_extendedprice", 9).alias(p) for p in ("p5", "p25", "p90", "p95")])


@query("percentiles_truncated", "X5", """WITH r AS (SELECT l_returnflag, l_quantity, l_extendedprice,
  row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, max(l_extendedprice) FILTER (WHERE i = floor(n * 0.25)) AS p25, max(l_extendedprice) FILTER (WHERE i = floor(n * 0.95)) AS p95
FROM r GROUP BY l_returnflag""")
def percentiles_truncated(t):
    s = order_statistics(t.lineitem, ["l_returnflag"], ["l_extendedprice"],
                         {"p25": truncated_position(.25), "p95": truncated_position(.95)})
    return s.select("l_returnflag", F.col("p25_l_extendedprice").alias("p25"), F.col("p95_l_extendedprice").alias("p95"))


@query("pearson", "X8", """SELECT round(corr(l_quantity, l_extendedprice), 3) AS r_plain,
  round(corr(log10(l_quantity + 1), log10(l_extendedprice + 1)), 3) AS r_log FROM lineitem""")
def pearson(t):
    q, e = F.col("l_quantity"), F.col("l_extendedprice")
    return t.lineitem.agg(S.pearson(t.lineitem, q, e).alias("r_plain"),
                          S.pearson(t.lineitem, F.log10(q + 1), F.log10(e + 1)).alias("r_log"))


FIELDS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _rank_sql(expr):
    pairs = [(a, b) for i, a in enumerate(FIELDS) for b in FIELDS[i + 1:]]
    ranks = ", ".join(f"{expr.format(f=f)} AS r_{f}" for f in FIELDS)
    return f"WITH r AS (SELECT {ranks} FROM lineitem) " + " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round(corr(r_{a}, r_{b}), 3) AS rho FROM r" for a, b in pairs)


@query("spearman_matrix", "X9", _rank_sql("dense_rank() OVER (ORDER BY {f})"))
def spearman_matrix(t):
    return S.rank_matrix(t.lineitem, FIELDS)


@query("spearman_midrank", "X9", _rank_sql("(rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0)"))
def spearman_midrank(t):
    return S.rank_matrix(t.lineitem, FIELDS, ties="average")


@query("data_profile", "X10", f"""WITH m AS (SELECT unnest({[f for f in FIELDS]}) AS metric, unnest([{', '.join(FIELDS)}]) AS value FROM lineitem),
r AS (SELECT metric, value, row_number() OVER (PARTITION BY metric ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY metric) AS n FROM m),
q AS (SELECT metric, any_value(n) AS n, {', '.join(f"max(value) FILTER (WHERE i = floor(n * {q})) AS p{int(q * 100)}" for q in (.05, .25, .5, .75, .95))},
  min(value) AS low, max(value) AS high, avg(value) AS mean, stddev_samp(value) AS sd, count(*) FILTER (WHERE value = 0) AS zeros FROM r GROUP BY metric)
SELECT metric, CAST(n AS BIGINT) AS n, low, high, round(mean, 5) AS mean, round(sd, 5) AS sd, CAST(zeros AS BIGINT) AS zeros,
  (SELECT CAST(count(*) AS BIGINT) FROM m WHERE m.metric = q.metric AND m.value > q.p95) AS outliers, p5, p25, p50, p75, p95,
  round(mean / p50, 5) AS skew FROM q""")
def data_profile(t):
    p = S.data_profile(t.lineitem, FIELDS)
    return p.withColumns({c: F.round(c, 5) for c in ("mean", "sd", "skew")})


@query("outlier_rows", "X10", """WITH r AS (SELECT *, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem),
c AS (SELECT max(l_extendedprice) AS cut FROM r WHERE i = floor(n * 0.95))
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem, c WHERE l_extendedprice > cut
ORDER BY l_quantity, l_orderkey, l_linenumber LIMIT 50""")
def outlier_rows(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return S.outliers(li, "l_extendedprice", 0.95, 50, ["l_quantity", "l_orderkey", "l_linenumber"])


@query("coverage_balance", "X11", """WITH p AS (SELECT n_name, count(*) AS n, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)
SELECT CAST(count(*) AS BIGINT) AS n_groups, CAST(min(n) AS BIGINT) AS smallest, CAST(max(n) AS BIGINT) AS largest, round(avg(n), 9) AS mean_rows,
  round(stddev_samp(n), 9) AS sd_rows, min(a) AS first_ts, max(b) AS last_ts FROM p""")
def coverage_balance(t):
    d = (t.orders.select("o_custkey", "o_orderdate").join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
         .join(t.nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")))
    return rounded(S.coverage_balance(d, "n_name", "o_orderdate"), "mean_rows", "sd_rows")


FLAGS = {"morning": "hour(ts) < 12", "weekend": "dayofweek(ts) IN (0, 6)", "many_saves": "k >= 50"}
FLAG_SQL = f"""{POSTS}, src AS ({' UNION ALL '.join(f"SELECT '{n}' AS key, CASE WHEN {c} THEN 'a' ELSE 'b' END AS side, value FROM posts" for n, c in FLAGS.items())})"""


def flag_frame(t):
    return posts(t).withColumns({"morning": F.hour("ts") < 12, "weekend": F.dayofweek("ts").isin(1, 7), "many_saves": F.col("k") >= 50})


@query("binary_feature_tests", "X13", f"WITH {FLAG_SQL}, {compare_sql('src')} SELECT * FROM cmp")
def binary_feature_tests(t):
    return tidy(S.flag_tests(flag_frame(t), list(FLAGS), "value"), "feature")


@query("findings_board", "X12", f"""WITH {POSTS}, src AS (SELECT 'flag:' || f AS key, side, value FROM (
  {' UNION ALL '.join(f"SELECT '{n}' AS f, CASE WHEN {c} THEN 'a' ELSE 'b' END AS side, value FROM posts" for n, c in FLAGS.items())})
  UNION ALL SELECT 'type:' || t, CASE WHEN event_type = t THEN 'a' ELSE 'b' END, value FROM posts, (SELECT unnest(['view', 'click', 'purchase']) AS t)), {compare_sql('src')},
f AS (SELECT split_part(key, ':', 1) AS dimension, split_part(key, ':', 2) AS finding, cohens_d, p_value, grade FROM cmp),
b AS (SELECT dimension, min_by({{'f': finding, 'd': cohens_d, 'p': p_value, 'g': grade}}, (-abs(cohens_d), finding)) AS x FROM f WHERE grade <> 'F' GROUP BY 1)
SELECT dimension, {', '.join(f"CAST(count(*) FILTER (WHERE grade = '{g}') AS BIGINT) AS n_{g.lower()}" for g in 'ABCF')},
  any_value(x.f) AS best, any_value(x.d) AS best_d, any_value(x.p) AS best_p, any_value(x.g) AS best_grade FROM f LEFT JOIN b USING (dimension) GROUP BY dimension""")
def findings_board(t):
    parts = []
    for dim, frame, names in (("flag", flag_frame(t), list(FLAGS)), ("type", type_flags(t), ["view", "click", "purchase"])):
        c = tidy(S.flag_tests(frame, names, "value"), "feature")
        parts.append(c.select(F.lit(dim).alias("dimension"), F.col("key").alias("finding"), "cohens_d", "p_value", "grade"))
    return S.findings_board(parts[0].unionByName(parts[1]))


@query("factor_ranking", "X14", """SELECT factor, CAST(n AS BIGINT) AS n, CAST(avg_metric AS BIGINT) AS avg_metric FROM (
  SELECT 'price ' || CASE WHEN l_extendedprice < 20000 THEN 'low' WHEN l_extendedprice < 50000 THEN 'mid' ELSE 'high' END AS factor, count(*) AS n, floor(avg(l_quantity * 100)) AS avg_metric FROM lineitem GROUP BY 1
  UNION ALL SELECT 'flag ' || l_returnflag, count(*), floor(avg(l_quantity * 100)) FROM lineitem GROUP BY 1)""")
def factor_ranking(t):
    from tidemark.functions.rules import bucket_label

    li = t.lineitem.withColumn("m", F.col("l_quantity") * 100)
    price = bucket_label(F.col("l_extendedprice"), [(20000, "low"), (50000, "mid")], "high")
    parts = [P.bucket_stats(li, F.concat(F.lit(p), c), ["m"]).select(F.col("bucket").alias("factor"), "n", F.col("avg_m").alias("avg_metric"))
             for p, c in (("price ", price), ("flag ", F.col("l_returnflag")))]
    return P.factor_ranking(*parts)


@query("tier_extremes", "W13", f"""WITH c AS (SELECT c_mktsegment AS key, c_acctbal AS value, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) - 1 AS i,
  count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer),
src AS (SELECT key, value, CASE WHEN i >= 3 * n // 4 THEN 'a' WHEN i < n // 4 THEN 'b' END AS side FROM c WHERE n >= 10), {compare_sql('src')} SELECT * FROM cmp""")
def tier_extremes(t):
    return tidy(S.tier_extremes(t.customer, "c_mktsegment", "c_acctbal", "c_custkey"), "c_mktsegment")


@query("day_profile", "W12", f"""WITH {POSTS} SELECT dayname(ts) AS day, CAST(count(*) AS BIGINT) AS n, round(median(value), 9) AS median_value FROM posts GROUP BY 1""")
def day_profile(t):
    s = order_statistics(posts(t).withColumn("day", F.date_format("ts", "EEEE")), ["day"], ["value"], {"median": .5})
    return s.select("day", F.col("n_value").alias("n"), F.round("median_value", 9).alias("median_value"))


@query("hour_profile", "W12", f"""WITH {POSTS} SELECT CAST(hour(ts) AS BIGINT) AS hr, CAST(count(*) AS BIGINT) AS n, round(median(value), 9) AS median_value FROM posts GROUP BY 1""")
def hour_profile(t):
    s = order_statistics(posts(t).withColumn("hr", F.hour("ts").cast("long")), ["hr"], ["value"], {"median": .5})
    return s.select("hr", F.col("n_value").alias("n"), F.round("median_value", 9).alias("median_value"))


@query("best_and_worst_day", "W12", f"""WITH {POSTS}, m AS (SELECT dayname(ts) AS day, median(value) AS md FROM posts GROUP BY 1),
hi AS (SELECT day FROM m ORDER BY md DESC, day LIMIT 1), lo AS (SELECT day FROM m ORDER BY md, day LIMIT 1),
src AS (SELECT hi.day || ' vs ' || lo.day AS key, CASE dayname(ts) WHEN hi.day THEN 'a' WHEN lo.day THEN 'b' END AS side, value FROM posts, hi, lo), {compare_sql('src')}
SELECT * FROM cmp""")
def best_and_worst_day(t):
    d = posts(t).withColumn("day", F.date_format("ts", "EEEE"))
    return tidy(S.best_against_worst(d, "day", "value"), "comparison")


@query("period_segments", "W14", """SELECT CASE WHEN year(o_orderdate) <= 1996 THEN 'early' WHEN year(o_orderdate) <= 1998 THEN 'middle' ELSE 'recent' END AS period,
  CAST(count(*) AS BIGINT) AS n, round(median(o_totalprice), 9) AS median_price FROM orders GROUP BY 1""")
def period_segments(t):
    from tidemark.functions.rules import bucket_label

    d = t.orders.withColumn("period", bucket_label(F.year("o_orderdate"), [(1996, "early"), (1998, "middle")], "recent", "right"))
    s = order_statistics(d, ["period"], ["o_totalprice"], {"median": .5})
    return s.select("period", F.col("n_o_totalprice").alias("n"), F.round("median_o_totalprice", 9).alias("median_price"))
