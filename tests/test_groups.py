from __future__ import annotations

import math
import random
import statistics

import pytest

from tidemark.operators import stats as S


def effect(a, b):
    """Cohen's d and the Mann-Whitney p of two lists, pair by pair."""
    na, nb = len(a), len(b)
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    z = (min(u, na * nb - u) - na * nb / 2) / math.sqrt(na * nb * (na + nb + 1) / 12)
    pooled = math.sqrt(((na - 1) * statistics.variance(a) + (nb - 1) * statistics.variance(b)) / (na + nb - 2))
    return (statistics.fmean(a) - statistics.fmean(b)) / pooled, math.erfc(abs(z) / math.sqrt(2))


@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_multi_group_equals_pairs_of_rows(spark, offset):
    rnd = random.Random(7)
    sizes = {"hot": 400, "mid": 60, "few": 4, "one": 1}
    rows = [(g, offset + rnd.randint(0, 9) + (3 if g == "mid" else 0)) for g, n in sizes.items() for _ in range(n)]
    rows += [(None, offset + 1000.0)] * 50 + [("hot", None)] * 20
    got = {r.other: r for r in S.multi_group(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    groups = {g: [v for h, v in rows if h == g and v is not None] for g in sizes}
    best = min(groups, key=lambda g: (-statistics.median(groups[g]), g))
    assert set(got) == set(groups) - {best}
    for g, r in got.items():
        assert (r.best, r.n_best, r.n_other) == (best, len(groups[best]), len(groups[g]))
        assert (r.median_best, r.median_other) == (statistics.median(groups[best]), statistics.median(groups[g]))
        if len(groups[g]) >= 3 and len(groups[best]) >= 3:
            d, p = effect(groups[best], groups[g])
            assert r.cohens_d == pytest.approx(d, abs=1e-6) and r.p_value == pytest.approx(p, abs=1e-5)


def test_multi_group_of_nothing(spark):
    assert S.multi_group(spark.createDataFrame([], "g string, v double"), "g", "v").count() == 0
    assert S.multi_group(spark.createDataFrame([("a", 1.0), ("a", 2.0)], "g string, v double"), "g", "v").count() == 0
