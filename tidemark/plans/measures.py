"""Measurement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import measures as Me
from tidemark.plans.posts import rounded
from tidemark.plans.registry import query
from tidemark.plans.statistics import _cdf

_AB = f"""e AS (SELECT {{seg}} event_type AS variant, value > 60 AS conv FROM events), g AS (SELECT {{seg}} variant, count(*) AS n, count(*) FILTER (WHERE conv) AS c FROM e GROUP BY ALL),
b AS (SELECT {{seg}} n AS n0, c AS c0, c / n AS r0 FROM g WHERE variant = 'view'), j AS (SELECT g.*, n0, c0, r0, c / n AS rate, (c + c0) / (n + n0) AS pl FROM g JOIN b {{on}} WHERE variant <> 'view'),
z AS (SELECT *, coalesce((rate - r0) / nullif(sqrt(pl * (1 - pl) * (1.0 / n + 1.0 / n0)), 0), 0) AS zz, sqrt(rate * (1 - rate) / n + r0 * (1 - r0) / n0) AS f FROM j)
SELECT {{seg}} variant, CAST(n AS BIGINT) AS n, CAST(c AS BIGINT) AS conversions, round(rate, 9) AS rate, round(r0, 9) AS r0, round((rate - r0) / nullif(r0, 0), 9) AS lift, round(zz, 9) AS z,
  round(2 * (1 - {_cdf('zz')}), 6) AS p_value, round(rate - r0 - 1.96 * f, 9) AS ci_lo, round(rate - r0 + 1.96 * f, 9) AS ci_hi,
  least(n, n0) >= CASE WHEN r0 >= 0.10 THEN 3000 WHEN r0 >= 0.05 THEN 7000 WHEN r0 >= 0.03 THEN 12000 ELSE 39000 END AS enough FROM z"""


def _tidy(d):
    return rounded(d, "rate", "r0", "lift", "z", "ci_lo", "ci_hi").withColumn("p_value", F.round("p_value", 6))


@query("ab_readout", "M1", "WITH " + _AB.format(seg="", on="ON true"))
def ab_readout(t):
    d = t.events.withColumn("variant", F.col("event_type"))
    return _tidy(Me.ab_readout(d, "variant", F.col("value") > 60, "view"))


@query("ab_segments", "M1", "WITH " + _AB.format(seg="seg, ", on="USING (seg)").replace("SELECT seg,  event_type", "SELECT CAST(hour(ts) // 6 AS BIGINT) AS seg, event_type"))
def ab_segments(t):
    d = t.events.select(F.col("event_type").alias("variant"), "value", F.floor(F.hour("ts") / 6).alias("seg"))
    return _tidy(Me.ab_readout(d, "variant", F.col("value") > 60, "view", ["seg"]))


_ANS = {"too_cheap": 0.4, "cheap": 0.7, "expensive": 1.1, "too_expensive": 1.5}
_PRICE = f"""a AS ({' UNION ALL '.join(f"SELECT '{k}' AS kind, floor(o_totalprice * {f} / 5000) * 5000 AS price FROM orders" for k, f in _ANS.items())}),
g AS (SELECT price, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in _ANS)} FROM a GROUP BY price),
c AS (SELECT price, {', '.join(f"sum({k}) OVER (ORDER BY price ROWS BETWEEN " + ("CURRENT ROW AND UNBOUNDED FOLLOWING" if "cheap" in k else "UNBOUNDED PRECEDING AND CURRENT ROW") + f") / sum({k}) OVER () AS {k}" for k in _ANS)} FROM g)"""


def _curves(t):
    d = t.orders.select(*[(F.col("o_totalprice") * f).alias(k) for k, f in _ANS.items()])
    return Me.price_curves(d, {k: k for k in _ANS}, 5000)


@query("price_curves", "M2", f"WITH {_PRICE} SELECT CAST(price AS DOUBLE) AS price, {', '.join(f'round({k}, 9) AS {k}' for k in _ANS)} FROM c")
def price_curves(t):
    return rounded(_curves(t).withColumn("price", F.col("price").cast("double")), *_ANS)


@query("price_points", "M2", f"""WITH {_PRICE} SELECT CAST(min(price) FILTER (WHERE expensive >= too_cheap) AS DOUBLE) AS marginal_cheapness, CAST(min(price) FILTER (WHERE too_expensive >= cheap) AS DOUBLE) AS marginal_expensiveness,
  CAST(min(price) FILTER (WHERE too_expensive >= too_cheap) AS DOUBLE) AS optimal, CAST(min(price) FILTER (WHERE expensive >= cheap) AS DOUBLE) AS indifference FROM c""")
def price_points(t):
    p = Me.price_points(_curves(t))
    return p.select(*[F.col(c).cast("double").alias(c) for c in p.columns])


@query("utm_rollup", "M3", """SELECT coalesce(nullif(lower(regexp_extract(url, 'utm_source=([^&#]+)', 1)), ''), '(none)') AS source, coalesce(nullif(lower(regexp_extract(url, 'utm_medium=([^&#]+)', 1)), ''), '(none)') AS medium,
  CAST(count(*) AS BIGINT) AS n FROM pages GROUP BY 1, 2""")
def utm_rollup(t):
    return Me.utm_rollup(Me.utm_parse(t.pages.select("page_id", "url"), "url"))


@query("duplicate_events", "M4", """SELECT event_id, user_id, event_type, round(gap, 6) AS gap_seconds FROM (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id))) / 1e6 AS gap FROM events) WHERE gap <= 3600""")
def duplicate_events(t):
    d = Me.duplicate_events(t.events.select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "event_id", 3600, F.to_date("ts"))
    return d.select("event_id", "user_id", "event_type", F.round("gap_seconds", 6).alias("gap_seconds"))


@query("referral_reward_cap", "M5", """WITH p AS (SELECT c_mktsegment, c_custkey, sum(o_totalprice) AS ltv FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n_customers, round(avg(ltv), 3) AS ltv, round(avg(ltv) * 0.7 - 200, 3) AS reward_cap FROM p GROUP BY 1""")
def referral_reward_cap(t):
    d = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_totalprice").join(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey")
    r = Me.referral_reward_cap(d, "c_mktsegment", "c_custkey", "o_totalprice", 0.7, 200)
    return r.withColumns({c: F.round(c, 3) for c in ("ltv", "reward_cap")})
