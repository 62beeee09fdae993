"""Exact ranks, order statistics, running sums and lags that never need one task per group.

A group (account, session, metric) may hold a third of all rows, so none of these sort a whole
group in one task. Values are cut into ranges at approximate quantiles; the sketch only balances
the ranges, every range is then ranked exactly and shifted by the size of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.session import shuffle_width

_BEFORE = (W.unboundedPreceding, -1)


def _cut_points(df: DataFrame, value: Column, by: str | None) -> Column:
    """Scalar subquery with the cut points of ``value`` (one array per ``by`` label).

    The labels are metric or comparison names fixed by the caller, so the map stays small.
    """
    cuts = _cuts(df, value)
    if by is None:
        return df.agg(cuts.alias("c")).scalar()
    per = df.groupBy(by).agg(cuts.alias("c"))
    return per.agg(F.map_from_entries(F.collect_list(F.struct(by, "c")))).scalar()[F.col(by)]


def _cuts(df: DataFrame, value: Column) -> Column:
    k = shuffle_width(df.sparkSession)
    probs = F.array(*[F.lit(i / k) for i in range(1, k)])
    return F.percentile_approx(value.cast("double"), probs, F.lit(20 * k))


def _below(cuts: str, value: Column, spark) -> Column:
    """Number of cut points below the value, by binary search; never NULL, so that joins on it push no filter down."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(shuffle_width(spark).bit_length()))])
    return F.coalesce(F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(F.col(cuts), at + step - 1) < value, step).otherwise(0)), F.lit(0))


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], plain: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Join on columns of one name, where NULL keys meet NULL keys; ``plain`` columns are never NULL."""
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in [*keys, *plain]})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys] + [F.col(k) == F.col(f"_r_{k}") for k in plain]
    return left.join(r, on, how).drop(*[f"_r_{k}" for k in [*keys, *plain]])


def rank_values(df: DataFrame, keys: Sequence[str], value: str,
                counts: Mapping[str, Column] | None = None, by: str | None = None) -> DataFrame:
    """One row per (keys, value) with its counts, the count before it and the group total.

    ``counts`` names aggregates to carry (default ``n`` = rows). For each name ``c`` the result has
    ``c``, ``c_before`` (sum over smaller values of the group) and ``c_total``. A NULL key is a group;
    NULL values are left out, as in any order statistic.
    """
    keys = list(keys)
    counts = dict(counts or {"n": F.count(F.lit(1))})
    grouped = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(*[c.alias(n) for n, c in counts.items()])
    # The cut points read the counts too: the same shuffled table then serves all three uses of it.
    used = F.when(sum((F.col(n) for n in counts), F.lit(0)) >= 0, F.col(value))
    cut = (grouped.select("*", _cut_points(grouped, used, by).alias("_cuts"))
           .select(*keys, value, *counts, _below("_cuts", F.col(value).cast("double"), df.sparkSession).alias("_range")))
    sizes = cut.groupBy(*keys, "_range").agg(*[F.sum(n).alias(f"_{n}") for n in counts])
    over_ranges = W.partitionBy(*(keys or [F.lit(0)]))
    offsets = sizes.select(
        *keys, "_range",
        *[F.coalesce(F.sum(f"_{n}").over(over_ranges.orderBy("_range").rowsBetween(*_BEFORE)),
                     F.lit(0)).alias(f"_{n}_off") for n in counts],
        *[F.sum(f"_{n}").over(over_ranges).alias(f"{n}_total") for n in counts])
    inside = W.partitionBy(*keys, "_range").orderBy(value).rowsBetween(*_BEFORE)
    return join_on(cut, offsets, keys, ["_range"]).select(
        *keys, value, *counts,
        *[(F.col(f"_{n}_off") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"{n}_before") for n in counts],
        *[f"{n}_total" for n in counts])


def long_metrics(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Unpivot numeric columns to (keys, metric, value)."""
    return df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
        for m in metrics])).alias("_mv")).select(*keys, "_mv.metric", "_mv.value")


#: Position of an order statistic for ``n`` values, 0-based; fractional positions interpolate.
def quantile_position(q: float):
    return lambda n: (n - 1) * F.lit(float(q))


def upper_middle(n: Column) -> Column:
    return F.floor(n / 2)


def truncated_position(q: float):
    return lambda n: F.least(F.floor(n * F.lit(float(q))), n - 1)


def order_statistics(df: DataFrame, keys: Sequence[str], metrics: Sequence[str],
                     stats: Mapping[str, object], means: bool = False) -> DataFrame:
    """Exact order statistics per group, in one pass for all metrics.

    ``stats`` maps a name to a quantile in [0, 1] or to a function of the group size giving a
    0-based position. Output: keys, ``n_<metric>``, ``<stat>_<metric>`` and, on request,
    ``mean_<metric>`` from the same table of distinct values.
    """
    keys = list(keys)
    ranked = rank_values(long_metrics(df, keys, metrics),
                         [*keys, "metric"], "value", by="metric")
    pos = {s: (p if callable(p) else quantile_position(p)) for s, p in stats.items()}
    n, lo_row = F.col("n_total"), F.col("n_before")

    def at(index: Column, metric: str) -> Column:
        hit = (F.col("metric") == metric) & (lo_row <= index) & (index < lo_row + F.col("n"))
        return F.max(F.when(hit, F.col("value")))

    aggs = []
    for m in metrics:
        aggs.append(F.max(F.when(F.col("metric") == m, n)).alias(f"n_{m}"))
        if means:
            aggs.append(F.sum(F.when(F.col("metric") == m, F.col("value") * F.col("n"))).alias(f"_sum_{m}"))
        for s, p in pos.items():
            aggs.append(at(F.floor(p(n)), m).alias(f"_lo_{s}_{m}"))
            aggs.append(at(F.ceil(p(n)), m).alias(f"_hi_{s}_{m}"))
    out = ranked.groupBy(*keys).agg(*aggs)
    cols = []
    for m in metrics:
        cols.append(F.coalesce(F.col(f"n_{m}"), F.lit(0)).alias(f"n_{m}"))
        if means:
            cols.append((F.col(f"_sum_{m}") / F.col(f"n_{m}")).alias(f"mean_{m}"))
        for s, p in pos.items():
            lo, hi, size = F.col(f"_lo_{s}_{m}"), F.col(f"_hi_{s}_{m}"), F.col(f"n_{m}")
            frac = p(size) - F.floor(p(size))
            cols.append((lo + (hi - lo) * frac).alias(f"{s}_{m}"))
    return out.select(*keys, *cols)


def number_rows(df: DataFrame, lead: Column, tie: str, name: str = "row_no",
                keys: Sequence[str] = ()) -> DataFrame:
    """1-based row number by (lead, tie) inside each group, without sorting a group in one task.

    ``lead`` is numeric and ``tie`` unique. A lead value that fills a whole range on its own is cut
    further by a numeric ``tie``. To number texts, lead with ``text_code`` and tie with the text. A NULL key
    is a group, and a NULL lead comes first.
    """
    keys = list(keys)
    d = df.withColumns({"_lead": lead.cast("double"), "_tie": F.col(tie).try_cast("double")})
    both = d.agg(F.struct(_cuts(d, F.col("_lead")).alias("lead"), _cuts(d, F.col("_tie")).alias("tie")).alias("c")).scalar()
    d = d.select("*", both.alias("_c")).select("*", F.col("_c.lead").alias("_lc"), F.col("_c.tie").alias("_tc"))
    on_cut = F.coalesce(F.array_contains("_lc", F.col("_lead")), F.lit(False))
    d = d.select(*df.columns, "_lead", "_tie", (_below("_lc", F.col("_lead"), df.sparkSession) * 2 + on_cut.cast("int")).alias("_r"),
                 F.when(on_cut, _below("_tc", F.col("_tie"), df.sparkSession)).otherwise(F.lit(0)).alias("_s"))
    sizes = d.groupBy(*keys, "_r", "_s").agg(F.count(F.lit(1)).alias("_n"))
    ahead = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_r", "_s").rowsBetween(*_BEFORE)
    offsets = sizes.select(*keys, "_r", "_s",
                           F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_off"))
    inside = W.partitionBy(*keys, "_r", "_s").orderBy("_lead", tie)
    return join_on(d, offsets, keys, ["_r", "_s"]).select(
        *df.columns, (F.col("_off") + F.row_number().over(inside)).cast("long").alias(name))


def text_code(col: Column, skip: int = 0) -> Column:
    """Number that follows the binary order of texts, from six bytes after a common beginning."""
    return F.conv(F.rpad(F.hex(F.substr(F.encode(col, "UTF-8"), F.lit(skip + 1), F.lit(6))), 12, "0"), 16, 10).cast("double")


def lag_in_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
                  cols: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """``lag`` per key with the key's history cut into chunks of the order (a month, an hour).

    Every chunk is sorted on its own; only the last row of each chunk is carried to the next one.
    ``chunk`` must not decrease along ``order``. A NULL key is a history of its own, and rows of a NULL
    chunk come before all others.
    """
    keys, order, cols = list(keys), list(order), list(cols)
    d = df.withColumn("_chunk", chunk)
    ends = d.groupBy(*keys, "_chunk").agg(
        F.max_by(F.struct(*cols), F.struct(*order)).alias("_end"))
    carried = ends.select(*keys, "_chunk", F.lag("_end").over(
        W.partitionBy(*keys).orderBy("_chunk")).alias("_carry"))
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order)
    d = d.withColumns({"_first": F.row_number().over(inside) == 1,
                       **{f"_lag_{c}": F.lag(c).over(inside) for c in cols}})
    return join_on(d, carried, [*keys, "_chunk"]).select(*df.columns, *[
        F.when(F.col("_first"), F.col(f"_carry.{c}")).otherwise(F.col(f"_lag_{c}")).alias(prefix + c)
        for c in cols])


def compute_once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add costly columns that later filters must not evaluate again.

    A filter on a projected column is pushed below the projection and repeats its expression for
    every reference; a filter on generated columns is not.
    """
    row = F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))
    return df.select("*", F.inline(row))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                  name: str = "rank") -> DataFrame:
    """First k rows of each group; the rank filter is applied before the shuffle too."""
    w = W.partitionBy(*keys).orderBy(*order)
    # The filter is on the bare rank: a cast before it would keep Spark from limiting map-side.
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k).withColumn(name, F.col(name).cast("long"))


def grouped_medians(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return order_statistics(df, keys, metrics, {"median": 0.5})
