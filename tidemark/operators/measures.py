"""Measurements of experiments, prices, campaigns and tracking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.operators.ordering import lag_in_chunks
from tidemark.operators.stats import two_sided_p

#: fixed values: rows per variant by baseline rate and relative lift
SAMPLE_SIZES = [(0.01, 150000, 39000, 6000), (0.03, 47000, 12000, 2000), (0.05, 27000, 7000, 1200), (0.10, 12000, 3000, 550)]


def required_rows(rate: Column, lift: float = 0.2) -> Column:
    """Rows per variant from the quick-reference table, by the closest baseline at or below the rate."""
    at = {0.1: 1, 0.2: 2, 0.5: 3}[lift]
    out = F.lit(SAMPLE_SIZES[0][at])
    for row in SAMPLE_SIZES[1:]:
        out = F.when(rate >= row[0], row[at]).otherwise(out)
    return out


def ab_readout(df: DataFrame, variant: str, converted: Column, control: str, segment: Sequence[str] = (), lift: float = 0.2) -> DataFrame:
    """Conversion per variant against the control: lift, two-proportion z, p, interval, sample flag."""
    seg = list(segment)
    per = df.groupBy(*seg, variant).agg(F.count(F.lit(1)).alias("n"), F.count_if(converted).alias("conversions"))
    per = per.withColumn("rate", F.col("conversions") / F.col("n"))
    base = per.where(F.col(variant) == control).select(*seg, F.col("n").alias("n0"), F.col("conversions").alias("c0"), F.col("rate").alias("r0"))
    d = per.where(F.col(variant) != control)
    d = d.join(base, seg) if seg else d.withColumn("_b", base.agg(F.first(F.struct("n0", "c0", "r0")).alias("b")).scalar()).select("*", "_b.*").drop("_b")
    pooled = (F.col("conversions") + F.col("c0")) / (F.col("n") + F.col("n0"))
    se = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n") + 1 / F.col("n0")))
    free = F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("n") + F.col("r0") * (1 - F.col("r0")) / F.col("n0"))
    diff = F.col("rate") - F.col("r0")
    d = d.withColumns({"lift": F.try_divide(diff, F.col("r0")), "z": F.coalesce(F.try_divide(diff, se), F.lit(0.0)),
                       "ci_lo": diff - 1.96 * free, "ci_hi": diff + 1.96 * free,
                       "enough": F.least("n", "n0") >= required_rows(F.col("r0"), lift)})
    return d.withColumn("p_value", two_sided_p(F.col("z"))).select(
        *seg, variant, "n", "conversions", "rate", "r0", "lift", "z", "p_value", "ci_lo", "ci_hi", "enough")


def price_curves(df: DataFrame, answers: Mapping[str, str], step: float) -> DataFrame:
    """Share of answers per price step: 'cheap' kinds count prices at or above, 'dear' ones at or below.

    ``answers``: too_cheap, cheap, expensive, too_expensive -> column. The grid is one row per step.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), (F.floor(F.col(c) / step) * step).alias("price"))
                                         for k, c in answers.items()])).alias("a")).select("a.*").where("price is not null")
    counts = long.groupBy("price").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in answers])
    up = W.orderBy("price").rowsBetween(W.unboundedPreceding, 0)
    down = W.orderBy("price").rowsBetween(0, W.unboundedFollowing)
    whole = W.orderBy("price").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return counts.select("price", *[
        (F.sum(k).over(down if k in ("too_cheap", "cheap") else up) / F.sum(k).over(whole)).alias(k) for k in answers])


def price_points(curves: DataFrame) -> DataFrame:
    """First price at which the rising curve reaches the falling one, for the four crossings."""
    pairs = {"marginal_cheapness": ("expensive", "too_cheap"), "marginal_expensiveness": ("too_expensive", "cheap"),
             "optimal": ("too_expensive", "too_cheap"), "indifference": ("expensive", "cheap")}
    return curves.agg(*[F.min(F.when(F.col(a) >= F.col(b), F.col("price"))).alias(n) for n, (a, b) in pairs.items()])


UTM = ("source", "medium", "campaign", "term", "content")


def utm_parse(df: DataFrame, url: str) -> DataFrame:
    """Lower-cased standard campaign parameters of an address."""
    clean = F.regexp_replace(F.col(url), r"\s", "%20")
    return df.withColumns({f"utm_{k}": F.lower(F.try_parse_url(clean, F.lit("QUERY"), F.lit(f"utm_{k}"))) for k in UTM})


def utm_rollup(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("utm_source", F.lit("(none)")).alias("source"), F.coalesce("utm_medium", F.lit("(none)")).alias("medium")).agg(
        F.count(F.lit(1)).alias("n"))


def duplicate_events(df: DataFrame, keys: Sequence[str], ts: str, row_id: str, seconds: float, chunk: Column) -> DataFrame:
    """Events that repeat the same user and type within the gap."""
    d = lag_in_chunks(df, keys, [ts, row_id], chunk, [ts])
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col(f"prev_{ts}").cast("timestamp"))) / 1e6
    return d.withColumn("gap_seconds", gap).where(F.col("gap_seconds") <= seconds).drop(f"prev_{ts}")


def referral_reward_cap(df: DataFrame, segment: str, customer: str, revenue: str, margin: float, target_cac: float) -> DataFrame:
    """Highest reward per segment: average lifetime revenue x margin - target acquisition cost."""
    per = df.groupBy(segment, customer).agg(F.sum(revenue).alias("_ltv"))
    return per.groupBy(segment).agg(F.count(F.lit(1)).alias("n_customers"), F.avg("_ltv").alias("ltv")) \
        .withColumn("reward_cap", F.col("ltv") * margin - target_cac)

