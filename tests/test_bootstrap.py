from __future__ import annotations

import random
from statistics import median

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import bootstrap as B


def test_intervals_equal_a_resampling_with_the_same_draws(spark):
    rnd = random.Random(1)
    groups = {"odd": [rnd.gauss(0, 1) for _ in range(301)], "even": [float(rnd.randint(0, 9)) for _ in range(500)], "hot": [5.0] * 400 + [rnd.random() for _ in range(99)],
              "few": [3.0, 1.0, 2.0, 9.0], "five": [1.0, 2.0, 3.0, 4.0, 10.0], None: [1.0, 2.0, 4.0, 8.0, 16.0, 32.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("odd", None)] * 5
    rnd.shuffle(rows)
    d = B.bootstrap_medians(spark.createDataFrame(rows, "grp string, v double").repartition(4), ["grp"], "v", replicates=200, seed=3)
    got = {r.grp: tuple(r)[1:] for r in d.collect()}
    want = {}
    for g, vs in groups.items():
        vs = sorted(vs)
        made = sorted((vs[a] + vs[b]) / 2 for a, b in B.places(len(vs), g or "", 200, 3)) if len(vs) >= 5 else [median(vs)] * 200
        want[g] = (len(vs), median(vs), made[5], made[194])
    assert got == want
    assert B.bootstrap_medians(spark.createDataFrame([], "grp string, v double"), ["grp"], "v").count() == 0


def test_places_have_the_law_of_resampled_medians():
    rng = np.random.default_rng(5)
    for n in (7, 10, 40):
        drawn = B.places(n, "x", 40_000).mean(1)
        rows = np.sort(rng.integers(0, n, (40_000, n)), axis=1)
        rows = (rows[:, (n - 1) // 2] + rows[:, n // 2]) / 2
        for q in (0.025, 0.25, 0.5, 0.75, 0.975):
            assert abs(np.quantile(drawn, q) - np.quantile(rows, q)) <= 1
        assert abs(drawn.mean() - rows.mean()) < 0.02 * n and abs(drawn.std() / rows.std() - 1) < 0.03


def test_ends_approach_the_order_statistics_of_the_limit(spark):
    n = 20_001
    r = B.bootstrap_medians(spark.range(n).select(F.col("id").cast("double").alias("v")), [], "v").first()
    half = 0.98 * n ** 0.5
    assert r.median == n // 2 and abs(r.lo - (n / 2 - half)) < 0.25 * half and abs(r.hi - (n / 2 + half)) < 0.25 * half
