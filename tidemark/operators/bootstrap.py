"""Seeded bootstrap intervals of medians, from distinct values and counts.

The median of a resample of N rows depends on one or two order statistics of N uniform draws, whose law is a beta distribution. So a
replicate is one draw for its group, not N draws of rows: the places it picks are looked up among the group's ranked values. Draws depend on
the seed and the group's name alone, so every run, and every retry, has the same ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.operators.ordering import join_on, long_metrics, rank_values
from tidemark.session import write_through

REPLICATES, SEED, FEWEST = 1000, 7, 5


def places(n: int, name: str, replicates: int = REPLICATES, seed: int = SEED) -> np.ndarray:
    """The two middle places (from 0, in the order of values; equal for odd ``n``) of every resample of ``n`` rows."""
    rng = np.random.default_rng([seed, zlib.crc32(name.encode())])
    k = (n + 1) // 2
    low = rng.beta(k, n - k + 1, replicates)
    high = low if n % 2 else 1 - (1 - low) * rng.random(replicates) ** (1 / (n - k))  # the least of the draws above
    return np.minimum((np.stack([low, high], 1) * n).astype(np.int64), n - 1)


def bootstrap_medians(df: DataFrame, keys: Sequence[str], value: str, percent: float = 95, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """One row per group: keys, n, median, lo and hi, the ends of the middle ``percent`` of the resampled medians.

    Of the sorted medians, ``lo`` is number floor(replicates * (100 - percent) / 200) and ``hi`` the one before its counterpart. Groups below five rows
    have the median three times. NULL values are left out, a NULL key is a group. A value that fills half a group is one row here.
    """
    if not keys:
        return bootstrap_medians(df.withColumn("_all", F.lit("")), ["_all"], value, percent, replicates, seed).drop("_all")
    keys = list(keys)
    ranked = write_through(rank_values(long_metrics(df, keys, [value]).select(*keys, "value"), keys, "value"), "ranks")
    groups = ranked.groupBy(*keys).agg(F.max("n_total").alias("n"))
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                n = int(row["n"])
                own = places(n, row["_name"], replicates, seed) if n >= FEWEST else np.zeros((0, 2), np.int64)
                own = np.concatenate([[[(n - 1) // 2, n // 2]], own])  # first the median itself
                yield pd.DataFrame({**{k: [row[k]] * len(own) for k in keys}, "draw": np.arange(len(own)), "a": own[:, 0], "b": own[:, 1]})

    named = groups.withColumn("_name", F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))
    drawn = named.mapInPandas(draw, f"{kinds}, draw long, a long, b long")
    wanted = drawn.select(*keys, "draw", F.explode(F.array("a", "b")).alias("place"))
    # a place meets the values of its stretch of places; a stretch is short against the spread of the medians
    wide = lambda n: F.greatest(F.lit(1), F.floor(F.sqrt(n) / 8))
    span = drawn.groupBy(*keys).agg(F.min("a").alias("_from"), F.max("b").alias("_to"))
    near = join_on(ranked, span, keys).where("n_before <= _to and n_before + n > _from")
    near = near.select(*keys, "value", "n_before", "n", F.explode(F.sequence(
        F.floor(F.greatest("n_before", "_from") / wide(F.col("n_total"))), F.floor(F.least(F.col("n_before") + F.col("n") - 1, "_to") / wide(F.col("n_total"))))).alias("stretch"))
    asked = join_on(wanted, groups.withColumnRenamed("n", "_n"), keys).withColumn("stretch", F.floor(F.col("place") / wide(F.col("_n"))))
    met = join_on(asked, near, keys, ["stretch"]).where("place >= n_before and place < n_before + n")
    medians = met.groupBy(*keys, "draw").agg(F.max("_n").alias("n"), (F.sum("value") / 2).alias("m"))
    lo = int(replicates * (100 - percent) / 200)
    hi = max(lo, int(replicates * (100 + percent) / 200) - 1)
    made = medians.groupBy(*keys).agg(F.max("n").alias("n"), F.max(F.when(F.col("draw") == 0, F.col("m"))).alias("median"),
                                      F.sort_array(F.collect_list(F.when(F.col("draw") > 0, F.col("m")))).alias("_m"))  # one number a replicate
    end = lambda i: F.coalesce(F.get("_m", F.lit(i)), F.col("median"))
    return made.select(*keys, "n", "median", end(lo).alias("lo"), end(hi).alias("hi"))
