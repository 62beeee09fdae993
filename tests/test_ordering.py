"""Range-split ranks, statistics, numbering and lags against plain Python on skewed data."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordering as O, posts as P, stats as S


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(5)
    data = []
    for i in range(1200):
        key = "hot" if rnd.random() < 0.4 else f"k{rnd.randrange(6)}"
        value = 7.0 if rnd.random() < 0.35 else round(rnd.expovariate(0.02), 2)
        data.append((i, key, value if rnd.random() > 0.02 else None))
    return data, spark.createDataFrame(data, "id long, key string, value double").repartition(6)


def test_rank_values(skewed):
    data, df = skewed
    got = {(r["key"], r["value"]): (r["n"], r["n_before"], r["n_total"]) for r in O.rank_values(df, ["key"], "value").collect()}
    for (k, v), (n, before, total) in got.items():
        vals = [x for _, key, x in data if key == k and x is not None]
        assert (n, before, total) == (vals.count(v), sum(x < v for x in vals), len(vals))
    assert len(got) == len({(k, v) for _, k, v in data if v is not None})


def test_order_statistics(skewed):
    data, df = skewed
    got = O.order_statistics(df, ["key"], ["value"], {"median": 0.5, "p90": 0.9, "upper": O.upper_middle}, means=True).collect()
    assert len(got) == 7
    for r in got:
        vals = sorted(x for _, key, x in data if key == r["key"] and x is not None)
        assert r["n_value"] == len(vals)
        assert r["median_value"] == pytest.approx(statistics.median(vals))
        assert r["upper_value"] == vals[len(vals) // 2]
        assert r["mean_value"] == pytest.approx(statistics.fmean(vals))
        pos = 0.9 * (len(vals) - 1)
        lo = int(pos)
        assert r["p90_value"] == pytest.approx(vals[lo] + (vals[min(lo + 1, len(vals) - 1)] - vals[lo]) * (pos - lo))


def test_number_rows_with_a_value_that_fills_ranges(skewed):
    data, df = skewed
    df = df.where("value is not null")
    got = {r["id"]: r["row_no"] for r in O.number_rows(df, -F.col("value"), "id", keys=["key"]).collect()}
    for key in {k for _, k, _ in data}:
        want = [i for _, i in sorted((-v, i) for i, k, v in data if k == key and v is not None)]
        assert [got[i] for i in want] == list(range(1, len(want) + 1))


def test_lag_in_chunks(spark):
    data = [("a" if i % 3 else "b", i, i * i if i % 5 else None) for i in range(90)]
    df = spark.createDataFrame(data, "k string, t long, v long").repartition(5)
    got = {(r["k"], r["t"]): r["prev_v"] for r in O.lag_in_chunks(df, ["k"], ["t"], F.floor(F.col("t") / 17), ["v"]).collect()}
    for key in "ab":
        seq = sorted((t, v) for k, t, v in data if k == key)
        assert [got[(key, t)] for t, _ in seq] == [None] + [v for _, v in seq[:-1]]


@pytest.mark.parametrize("n", [1, 9, 25, 400])
def test_viral_flag_takes_exactly_a_tenth(spark, n):
    rnd = random.Random(n)
    data = [(i, float(rnd.choice([1, 2, 2, 2, 3]))) for i in range(n)]
    df = P.viral_flag(spark.createDataFrame(data, "id long, s double"), "s", "id")
    want = {i for i, _ in sorted(data, key=lambda x: (-x[1], x[0]))[:max(1, n // 10)]}
    assert {r["id"] for r in df.where("viral").collect()} == want


def test_compare_groups_small_and_equal(spark):
    data = [("x", "a", 1.0), ("x", "b", 2.0)] + [("y", s, 5.0) for s in "aaaabbbb"]
    got = {r["c"]: r for r in S.compare_groups(spark.createDataFrame(data, "c string, side string, v double"), "c", "side", "v").collect()}
    assert (got["x"]["p_value"], got["x"]["cohens_d"], got["x"]["grade"]) == (1.0, 0.0, "F")
    assert got["y"]["z"] == 0 and got["y"]["significance"] == "ns" and got["y"]["cohens_d"] == 0


def test_baseline_modes(spark):
    from tidemark.operators import monitor as Mo

    d = spark.createDataFrame([("u", i, float(v)) for i, v in enumerate([100, 200, 300, 400, 5000])], "u string, i int, likes double")
    base = Mo.recent_baseline(d, "u", ["i"], "likes", None)
    assert base.first()["baseline"] == 300
    top = Mo.breakouts(d.withColumn("saves", F.lit(1000)), base, "u", "likes", "saves").orderBy(F.desc("multiple")).first()
    assert round(top["multiple"], 1) == 16.7 and top["save_ratio"] == pytest.approx(0.2)
    assert Mo.recent_baseline(d, "u", ["i"], "likes", 4).first()["baseline"] == 400  # upper middle of the last four


def test_batches_and_ids_of_text_keys(spark):
    from tidemark.operators import dedup as D, monitor as Mo

    urls = [f"https://x/{i * 7919 % 100003:06d}" for i in range(300)]
    d = spark.createDataFrame([(u, "A" if i % 3 else "B") for i, u in enumerate(urls)], "url string, code string").repartition(4)
    got = {r["url"]: (r["row_no"], r["batch"]) for r in Mo.batch_numbers(d.select("url"), "url", 10).collect()}
    assert got == {u: (i + 1, i // 10 + 1) for i, u in enumerate(sorted(urls))}
    ledger = spark.createDataFrame([(urls[0], "B", "SRC-B-007"), ("gone", "A", "SRC-A-002")], "url string, code string, source_id string")
    ids = {r["url"]: r["source_id"] for r in D.allocate_ids(d, ledger, "url", "code", "url").collect()}
    new_b = sorted(u for i, u in enumerate(urls) if i % 3 == 0 and i)
    assert ids[urls[0]] == "SRC-B-007" and [ids[u] for u in new_b[:2]] == ["SRC-B-008", "SRC-B-009"]
    assert len(set(ids.values())) == 300 and min(v for v in ids.values() if "-A-" in v) == "SRC-A-003"


def test_long_change_feed_is_cut_into_parts(spark):
    from tidemark.operators import monitor as Mo

    d = spark.createDataFrame([("a", 1, f"v{i}") for i in range(25)] + [("b", 1, "v1")], "u string, run int, item string").withColumn("likes", F.lit(1))
    feed = Mo.change_feed(d, ["u", "run"], "item", ["likes"], part_size=10).collect()
    assert sorted((r["u"], r["n_items"]) for r in feed) == [("a", 5), ("a", 10), ("a", 10), ("b", 1)]
    assert {x["item"] for r in feed if r["u"] == "a" for x in r["items"]} == {f"v{i}" for i in range(25)}


def test_null_keys_are_groups(spark):
    """No row and no group is lost when its key is NULL, and NULL does not merge with a text key."""
    rows = [(None if i % 4 == 0 else "unknown" if i % 4 == 1 else f"k{i % 4}", float(i % 7), i) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, v double, id long")
    numbered = O.number_rows(df, F.col("v"), "id", "no", ["k"]).collect()
    assert len(numbered) == 40
    for key in {r[0] for r in rows}:
        assert sorted(r.no for r in numbered if r.k == key) == list(range(1, 11))
    stat = O.order_statistics(df, ["k"], ["v"], {"median": 0.5}).collect()
    assert {r.k for r in stat} == {r[0] for r in rows} and all(r.n_v == 10 for r in stat)
    lagged = O.lag_in_chunks(df, ["k"], ["id"], F.floor(F.col("id") / 10), ["id"]).collect()
    assert len(lagged) == 40 and all(r.prev_id == (r.id - 4 if r.id >= 4 else None) for r in lagged)


def test_urls_and_hot_values_are_numbered(spark):
    rows = [(f"https://example.org/common/path/{i:05d}", 7.0 if i % 3 else float(i), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "url string, v double, id long")
    by_url = O.number_rows(df, O.text_code(F.col("url")), "url", "no").orderBy("no").collect()
    assert [r.url for r in by_url] == sorted(r[0] for r in rows) and [r.no for r in by_url] == list(range(1, 3001))
    by_value = O.number_rows(df, F.col("v"), "id", "no").orderBy("no").collect()
    assert [r.id for r in by_value] == [i for _, _, i in sorted(rows, key=lambda r: (r[1], r[2]))]
