"""Two-group and many-group comparisons, correlations and profiles, in a few grouped jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.ordering import (long_metrics, number_rows, order_statistics, rank_values,
                                         truncated_position)
from tidemark.session import write_through

#: Least group size for a graded finding: 3% of all rows, at least 100.
MIN_SHARE, MIN_ROWS = 0.03, 100


def min_sample(total: Column) -> Column:
    return F.greatest(F.floor(total * MIN_SHARE), F.lit(MIN_ROWS))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution by a rational approximation of erf (absolute error < 1.5e-7)."""
    a = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * a)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-a * a)
    return F.when(x >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def two_sided_p(z: Column) -> Column:
    return 2 * (1 - normal_cdf(F.abs(z)))


def cohens_d(n_a, n_b, mean_a, mean_b, var_a, var_b) -> Column:
    pooled = F.sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2))
    return F.when((n_a >= 2) & (n_b >= 2) & (pooled > 0), (mean_a - mean_b) / pooled).otherwise(F.lit(0.0))


def mann_whitney_z(u1: Column, n_a: Column, n_b: Column) -> Column:
    """Normal approximation without tie correction; 0 for groups under three rows."""
    a, b = n_a.cast("double"), n_b.cast("double")
    u = F.least(u1, a * b - u1)
    sigma = F.sqrt(a * b * (a + b + 1) / 12)
    return F.when((n_a >= 3) & (n_b >= 3), (u - a * b / 2) / sigma).otherwise(F.lit(0.0))


def quality_grade(d: Column, p: Column, n: Column, least: Column) -> Column:
    return (F.when(n < least, "F").when((F.abs(d) >= 0.5) & (p < 0.01), "A")
            .when((F.abs(d) >= 0.3) & (p < 0.05), "B").otherwise("C"))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def _median_ci(n: Column) -> tuple[Column, Column]:
    """Ranks of the 95% interval of the median: the large-sample limit of the bootstrap."""
    half, spread = n / 2, 0.98 * F.sqrt(n)
    return (F.greatest(F.lit(0), F.floor(half - spread)),
            F.least(n - 1, F.ceil(half + spread)))


def _value_at(index: Column, before: str, n: str) -> Column:
    hit = (F.col(before) <= index) & (index < F.col(before) + F.col(n))
    return F.max(F.when(hit, F.col("value")))


def compare_groups(df: DataFrame, key: str, side: str, value: str, least: Column | None = None) -> DataFrame:
    """Compare side ``a`` with side ``b`` for every comparison named by ``key``.

    Sizes, medians and their intervals, difference, Cohen's d, Mann-Whitney z and p, grade, stars.
    Ranks come from a table of distinct values with two counts, so no group is sorted whole.
    """
    d = df.select(F.col(key), F.col(side).alias("side"), F.col(value).cast("double").alias("value")) \
        .where(F.col("side").isin("a", "b") & F.col("value").isNotNull())
    ranked = rank_values(d, [key], "value", {
        "a": F.count_if(F.col("side") == "a"), "b": F.count_if(F.col("side") == "b")})
    pos = []
    for s in "ab":
        n = F.col(f"{s}_total")
        lo, hi = _median_ci(n)
        for name, index in (("m1", F.floor((n - 1) / 2)), ("m2", F.ceil((n - 1) / 2)), ("lo", lo), ("hi", hi)):
            pos.append(_value_at(index, f"{s}_before", s).alias(f"{name}_{s}"))
    both = F.col("a_before") + F.col("b_before") + (F.col("a") + F.col("b") + 1) / 2
    by_rank = ranked.groupBy(key).agg(
        F.max("a_total").alias("n_a"), F.max("b_total").alias("n_b"),
        F.sum(F.col("a") * both).alias("r1"), *pos)
    moments = d.groupBy(key).agg(*[f(F.when(F.col("side") == s, F.col("value"))).alias(f"{n}_{s}")
                                   for s in "ab" for f, n in ((F.avg, "mean"), (F.var_samp, "var"))])
    na, nb = F.col("n_a"), F.col("n_b")
    med = {s: (F.col(f"m1_{s}") + F.col(f"m2_{s}")) / 2 for s in "ab"}
    ends = [F.when(F.col(f"n_{s}") < 5, med[s]).otherwise(F.col(f"{e}_{s}")).alias(f"ci_{e}_{s}")
            for s in "ab" for e in ("lo", "hi")]
    c = by_rank.join(moments, key).select(
        key, "n_a", "n_b", med["a"].alias("median_a"), med["b"].alias("median_b"), *ends,
        (med["a"] - med["b"]).alias("diff"),
        cohens_d(na, nb, F.col("mean_a"), F.col("mean_b"), F.col("var_a"), F.col("var_b")).alias("cohens_d"),
        mann_whitney_z(F.col("r1") - na * (na + 1) / 2, na, nb).alias("z"))
    return c.select("*", p_value(na, nb, F.col("z")).alias("p_value")).select("*", *verdict(na, nb, least))


def p_value(n_a: Column, n_b: Column, z: Column) -> Column:
    return F.when((n_a >= 3) & (n_b >= 3), two_sided_p(z)).otherwise(F.lit(1.0))


def verdict(n_a: Column, n_b: Column, least: Column | None) -> list[Column]:
    least = F.lit(MIN_ROWS) if least is None else least
    return [quality_grade(F.col("cohens_d"), F.col("p_value"), F.least(n_a, n_b), least).alias("grade"),
            stars(F.col("p_value")).alias("significance")]


def group_profile(df: DataFrame, group: str, value: str, least: Column | None = None) -> DataFrame:
    """Size, median, interval and sample-size flag of every group."""
    least = F.lit(MIN_ROWS) if least is None else least
    d = df.select(group, F.col(value).cast("double").alias("value"))
    s = order_statistics(d, [group], ["value"], {
        "median": 0.5, "lo": lambda n: _median_ci(n)[0], "hi": lambda n: _median_ci(n)[1]})
    few, n = F.col("n_value") < 5, F.col("n_value")
    return s.select(
        group, n.alias("n"), F.col("median_value").alias("median"),
        F.when(few, F.col("median_value")).otherwise(F.col("lo_value")).alias("ci_lo"),
        F.when(few, F.col("median_value")).otherwise(F.col("hi_value")).alias("ci_hi"),
        (n >= least).alias("enough"))


def multi_group(df: DataFrame, group: str, value: str, least: Column | None = None) -> DataFrame:
    """The group with the highest median against every other group.

    The rows are counted once to (group, value, n), and that table is written: medians, moments and ranks read it alone. The
    best group is ranked once in the common order of values; every other group reads its U statistic from the same ranks, so
    no row is copied per comparison. Rows without a group or a value stay out.
    """
    d = df.select(F.col(group).alias("grp"), F.col(value).cast("double").alias("value")).where("grp is not null and value is not null")
    counts = write_through(d.groupBy("grp", "value").agg(F.count(F.lit(1)).alias("n")), "value-counts")
    ranked = rank_values(counts, ["grp"], "value", {"n": F.sum("n")})
    last = F.col("n_total") - 1
    stat = ranked.groupBy("grp").agg(
        F.max("n_total").alias("n"), (F.sum(F.col("value") * F.col("n")) / F.max("n_total")).alias("mean"),
        _value_at(F.floor(last / 2), "n_before", "n").alias("_lo"), _value_at(F.ceil(last / 2), "n_before", "n").alias("_hi"))
    # deviations from the mean, not differences of squares, so large values keep their digits
    away = counts.withColumnRenamed("n", "_m").join(stat.select("grp", "mean"), "grp")
    spread = away.groupBy("grp").agg(F.sum(F.col("_m") * F.pow(F.col("value") - F.col("mean"), 2)).alias("_ss"))
    stat = write_through(stat.join(spread, "grp").select(
        "grp", "n", "mean", ((F.col("_lo") + F.col("_hi")) / 2).alias("median"), F.try_divide("_ss", F.col("n") - 1).alias("var")), "group-stats")
    top = stat.agg(F.min_by(F.struct("grp", "mean", "var", "n", "median"),
                            F.struct(-F.col("median"), F.col("grp"))).alias("t")).scalar()
    ranks = rank_values(counts.withColumn("_t", top), [], "value", {
        "best": F.coalesce(F.sum(F.when(F.col("grp") == F.col("_t.grp"), F.col("n"))), F.lit(0))})
    below = (counts.join(ranks.select("value", "best", "best_before"), "value").groupBy("grp")
             .agg(F.sum(F.col("n") * (F.col("best_before") + 0.5 * F.col("best"))).alias("below")))
    s = stat.join(below, "grp").withColumn("t", top).where(F.col("grp") != F.col("t.grp"))
    na, nb = F.col("n_best"), F.col("n_other")
    out = s.select(
        F.col("t.grp").alias("best"), F.col("grp").alias("other"), F.col("t.n").alias("n_best"), F.col("n").alias("n_other"),
        F.col("t.median").alias("median_best"), F.col("median").alias("median_other"),
        cohens_d(F.col("t.n"), F.col("n"), F.col("t.mean"), F.col("mean"), F.col("t.var"), F.col("var")).alias("cohens_d"),
        mann_whitney_z(F.col("t.n") * F.col("n") - F.col("below"), F.col("t.n"), F.col("n")).alias("z"))
    return out.select("*", p_value(na, nb, F.col("z")).alias("p_value")).select("*", *verdict(na, nb, least)).drop("z")


def best_against_worst(df: DataFrame, group: str, value: str, least: Column | None = None) -> DataFrame:
    """The group with the highest median against the one with the lowest."""
    med = order_statistics(df.select(group, F.col(value).cast("double").alias("value")), [group], ["value"],
                           {"median": 0.5})
    pick = med.agg(F.struct(F.min_by(group, F.struct(-F.col("median_value"), F.col(group))).alias("hi"),
                            F.min_by(group, F.struct(F.col("median_value"), F.col(group))).alias("lo"))
                   .alias("p")).scalar()
    d = (df.withColumn("_p", pick)
         .withColumn("side", F.when(F.col(group) == F.col("_p.hi"), "a").when(F.col(group) == F.col("_p.lo"), "b"))
         .withColumn("comparison", F.concat_ws(" vs ", "_p.hi", "_p.lo")))
    return compare_groups(d.where("side is not null"), "comparison", "side", value, least)


def flag_tests(df: DataFrame, flags: Sequence[str], value: str, least: Column | None = None) -> DataFrame:
    """Yes against no for every flag column; unknown (NULL) flags stay out."""
    long = df.select(F.col(value).alias("value"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).alias("on")) for f in flags])).alias("_f")).select(
        "value", "_f.feature", F.when(F.col("_f.on"), "a").when(~F.col("_f.on"), "b").alias("side"))
    return compare_groups(long, "feature", "side", "value", least)


def tier_extremes(df: DataFrame, tier: str, value: str, row_id: str, least_rows: int = 10,
                  least: Column | None = None) -> DataFrame:
    """Highest against lowest quarter by position inside every tier with enough rows."""
    numbered = number_rows(df.select(tier, value, row_id), F.col(value), row_id, "_pos", [tier])
    sizes = df.groupBy(tier).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least_rows)
    n, i = F.col("_n"), F.col("_pos") - 1
    sided = (numbered.join(sizes, tier)
             .withColumn("side", F.when(i >= F.floor(3 * n / 4), "a").when(i < F.floor(n / 4), "b")))
    return compare_groups(sided, tier, "side", value, least)


def pearson(df: DataFrame, x: Column, y: Column, digits: int = 3) -> Column:
    """Correlation with a zero-variance guard, as an aggregate."""
    return F.round(F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0) & (F.count(F.lit(1)) >= 3),
                          F.corr(x, y)).otherwise(F.lit(0.0)), digits)


def rank_matrix(df: DataFrame, fields: Sequence[str], ties: str = "dense", digits: int = 3) -> DataFrame:
    """Correlation of ranks for every pair of fields.

    ``dense`` numbers distinct values (ties share a rank, the next value gets the next number);
    ``average`` is the textbook mid-rank.
    """
    base = df.select(*[F.col(f).cast("double").alias(f) for f in fields]).where(
        " and ".join(f"{f} is not null" for f in fields))
    d = base
    for f in fields:
        if ties == "dense":
            r = rank_values(base, [], f, {"n": F.max(F.lit(1))}).select(f, (F.col("n_before") + 1).alias(f"r_{f}"))
        else:
            r = rank_values(base, [], f).select(f, (F.col("n_before") + (F.col("n") + 1) / 2).alias(f"r_{f}"))
        d = d.join(r, f)
    pairs = [(a, b) for i, a in enumerate(fields) for b in fields[i + 1:]]
    one = d.agg(*[pearson(d, F.col(f"r_{a}").cast("double"), F.col(f"r_{b}").cast("double"), digits)
                  .alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"),
                                                   F.col(f"`{a}|{b}`").alias("rho")) for a, b in pairs]))
                      .alias("p")).select("p.*")


def data_profile(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Index-truncated percentiles, mean, deviation, zeros, skew and number of outliers per metric."""
    long = long_metrics(df, [], metrics)
    ranked = rank_values(long, ["metric"], "value", by="metric")
    n, before, size = F.col("n_total"), F.col("n_before"), F.col("n")
    places = {"low": F.lit(0), "high": n - 1,
              **{f"p{int(q * 100)}": truncated_position(q)(n) for q in (0.05, 0.25, 0.5, 0.75, 0.95)}}
    found = ranked.groupBy("metric").agg(
        F.max("n_total").alias("n"), *[_value_at(i, "n_before", "n").alias(s) for s, i in places.items()],
        (F.sum(F.col("value") * size) / F.max("n_total")).alias("mean"),
        F.coalesce(F.sum(F.when(F.col("value") == 0, size)), F.lit(0)).alias("zeros"),
        F.max(F.when((before <= places["p95"]) & (places["p95"] < before + size), n - before - size)).alias("outliers"))
    sd = long.groupBy("metric").agg(F.stddev_samp("value").alias("sd"))
    return found.join(sd, "metric").withColumn("skew", F.try_divide(F.col("mean"), F.col("p50")))


def outliers(df: DataFrame, metric: str, q: float = 0.95, k: int = 5, order: Sequence[Column] = ()) -> DataFrame:
    """Rows above the index-truncated percentile, first k of the given order."""
    cut = order_statistics(df, [], [metric], {"cut": truncated_position(q)}) \
        .select(f"cut_{metric}").scalar()
    return df.withColumn("_cut", cut).where(F.col(metric) > F.col("_cut")).drop("_cut").orderBy(*order).limit(k)


def coverage_balance(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Spread of the group sizes and the time span of the table."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("a"), F.max(ts).alias("b"))
    return per.agg(F.count(F.lit(1)).alias("n_groups"), F.min("n").alias("smallest"), F.max("n").alias("largest"),
                   F.avg("n").alias("mean_rows"), F.stddev_samp("n").alias("sd_rows"),
                   F.min("a").alias("first_ts"), F.max("b").alias("last_ts"))


def findings_board(findings: DataFrame) -> DataFrame:
    """Best graded finding per dimension and the number of findings per grade."""
    graded = F.when(F.col("grade") != "F", F.struct(-F.abs("cohens_d"), F.col("finding")))
    return findings.groupBy("dimension").agg(
        *[F.count_if(F.col("grade") == g).alias(f"n_{g.lower()}") for g in "ABCF"],
        F.min_by(F.struct("finding", "cohens_d", "p_value", "grade"), graded).alias("b")).select(
        "dimension", "n_a", "n_b", "n_c", "n_f", F.col("b.finding").alias("best"),
        F.col("b.cohens_d").alias("best_d"), F.col("b.p_value").alias("best_p"), F.col("b.grade").alias("best_grade"))

