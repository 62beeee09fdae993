from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import new_items as Ni, windows as Wi
from tidemark.session import scratch_path
from tidemark.streaming import messages as Me
from tidemark.streaming.new_items import detect_new_items

T0 = dt.datetime(2024, 1, 1)


def anchored(times, minutes):
    starts = []
    for t in sorted(times):
        if not starts or t >= starts[-1] + dt.timedelta(minutes=minutes):
            starts.append(t)
    return starts


def test_anchored_windows_match_a_replay(spark):
    rnd = random.Random(1)
    data = []
    for s in range(5):
        t = T0
        for _ in range(300 if s else 900):
            t += dt.timedelta(seconds=rnd.choice([0, 1, 30, 60, 299, 300, 301, 2000]))
            data.append((s, t))
    df = spark.createDataFrame(data, "s long, t timestamp")
    got = {}
    for r in Wi.anchored_windows(df, "s", "t", 5, 60).collect():
        got.setdefault(r["s"], []).append((r["start"], r["end"], r["msg_count"]))
    for s in range(5):
        times = [t for k, t in data if k == s]
        starts = anchored(times, 5)
        ends = [*starts[1:], max(times)]
        want = [(a, e, sum(a <= t < a + dt.timedelta(minutes=5) for t in times)) for a, e in zip(starts, ends)]
        assert sorted(got[s]) == want


RUNS = [(1, [f"o{i}" for i in range(10)]), (2, [f"n{i}" for i in range(10)]), (3, [f"n{i}" for i in range(10)]), (4, ["z", "n0"]), (5, ["z", "n0"])]


def listing_rows(runs, total=None):
    return [("acc", run, item, pos, total[run] if total else None, "listing") for run, items in runs for pos, item in enumerate(items)]


SCHEMA = "account string, run bigint, item string, pos bigint, total bigint, kind string"


def test_head_window_cases(spark):
    df = spark.createDataFrame(listing_rows(RUNS), SCHEMA)
    got = {r["item"]: (r["status"], r["second_run"]) for r in Ni.detect_by_head(df).collect()}
    assert {got[f"o{i}"][0] for i in range(10)} == {"baseline"}
    assert {got[f"n{i}"] for i in range(8)} == {("confirmed", 3)}
    assert {got[f"n{i}"][0] for i in (8, 9)} == {"deep_position"}
    assert got["z"] == ("confirmed", 5)
    wide = {r["status"] for r in Ni.detect_by_head(df, head=30).where("first_run = 2").collect()}
    assert wide == {"confirmed"}


def test_stale_items_are_suppressed(spark):
    df = spark.createDataFrame(listing_rows(RUNS), SCHEMA).withColumn("run", F.date_add(F.lit("2024-03-01"), F.col("run").cast("int")))
    pub = spark.createDataFrame([("acc", "n0", "2023-12-01"), ("acc", "n1", None)], "account string, item string, published string").withColumn("published", F.to_date("published"))
    got = {r["item"]: r["status"] for r in Ni.detect_by_head(df, published=pub).collect()}
    assert (got["n0"], got["n1"], got["n2"]) == ("stale", "confirmed", "confirmed")


def replay_quota(rows, totals, limit):
    known, released, base = {}, {}, set()
    prev = None
    for run in sorted({r for _, r, _, _ in rows}):
        seen = sorted((p, i) for _, r, i, p in rows if r == run)
        quota = max(0, totals[run] - prev) if prev is not None and totals[run] is not None else 0
        first = not base
        n = out = 0
        for _, item in seen:
            if item not in known:
                if not first and n < quota:
                    known[item], n = "queued", n + 1
                else:
                    known[item] = "baseline" if first else "known"
            elif known[item] == "queued" and item not in released and out < limit:
                released[item], out = run, out + 1
        base.add(run)
        prev = totals[run]
    return {i: ("released" if i in released else s, released.get(i)) for i, s in known.items()}


@pytest.mark.parametrize("limit", [1, 2, 5])
def test_quota_matches_a_replay(spark, limit):
    rnd = random.Random(limit)
    rows, totals = [], {}
    total, items = 10, [f"i{k}" for k in range(12)]
    for run in range(1, 12):
        grow = rnd.choice([0, 0, 1, 3])
        total += grow
        items = [f"r{run}_{k}" for k in range(grow + rnd.choice([0, 0, 2]))] + items
        totals[run] = None if run == 5 else total
        rows += [("a", run, i, p) for p, i in enumerate(items[:14])]
    df = spark.createDataFrame(rows, "account string, run bigint, item string, pos bigint")
    tot = spark.createDataFrame([("a", r, t) for r, t in totals.items()], "account string, run bigint, total bigint")
    got = {r["item"]: (r["status"], r["released_run"]) for r in Ni.detect_by_quota(df, tot, F.floor(F.col("run") / 4), limit).collect()}
    assert got == replay_quota(rows, totals, limit)


@pytest.mark.parametrize("limit", [1, 3])
def test_crowded_accounts_are_released_in_rounds(spark, limit):
    rnd = random.Random(40 + limit)
    rows, totals = [], []
    for account, n_runs, growth in (("hot", 9, 8), ("a", 5, 3), ("quiet", 3, 0)):
        items, total = [f"{account}{k}" for k in range(3)], 3
        for run in range(1, n_runs):
            new = rnd.randint(0, growth)
            items, total = [f"{account}r{run}_{k}" for k in range(new)] + items, total + new
            totals.append((account, run, total))
            seen = [i for i in items if rnd.random() < 0.6]
            rnd.shuffle(seen)
            rows += [(account, run, i, p // 2) for p, i in enumerate(seen)] + [(account, run, i, 90) for i in seen[:2]]
    df = spark.createDataFrame(rows, "account string, run bigint, item string, pos bigint")
    tot = spark.createDataFrame(totals, "account string, run bigint, total bigint")
    one = lambda most: {(r["account"], r["item"]): (r["status"], r["released_run"]) for r in
                        Ni.detect_by_quota(df, tot, F.floor(F.col("run") / 4), limit, most).collect()}
    want = {}
    for account in ("hot", "a", "quiet"):
        best = {}
        for a, run, i, p in rows:
            if a == account:
                best[run, i] = min(p, best.get((run, i), p))
        # the replay numbers runs by their rows, so a run in which nothing was seen keeps its total for the next
        got = replay_quota([(a, r, i, p) for (r, i), p in best.items() for a in [account]], {r: t for a, r, t in totals if a == account}, limit)
        want |= {(account, i): v for i, v in got.items()}
    assert one(0) == one(20) == want


def file_stream(spark, batches, schema, label):
    path = scratch_path(spark, label)
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").json(f"{path}/in")
        import os
        import time
        stamp = time.time() - 1000 + i * 10
        for f in os.listdir(f"{path}/in"):
            full = f"{path}/in/{f}"
            if f.endswith(".json") and os.path.getmtime(full) > time.time() - 500:
                os.utime(full, (stamp, stamp))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{path}/in"), path


def run_stream(spark, frame, path, mode="append", shape=None):
    q = Me.write_batches(frame, f"{path}/out", f"{path}/check", shape, interval=None, mode=mode)
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def test_stream_dedup_over_batches(spark):
    at = lambda m: (T0 + dt.timedelta(minutes=m)).isoformat()
    b1 = [(1, "m1", at(0)), (1, "m1", at(0)), (1, "", at(0)), (1, "", at(0))]
    b2 = [(1, "m1", at(5)), (1, "m2", at(5)), (2, "m1", at(5))]
    frame, path = file_stream(spark, [b1, b2], "session_id long, msg_id string, ts string", "t-dedup")
    d = Me.dedup_messages(frame.withColumn("timestamp", F.to_timestamp("ts")))
    got = sorted((r["session_id"], r["msg_id"]) for r in run_stream(spark, d, path).collect())
    assert got == [(1, ""), (1, ""), (1, "m1"), (1, "m2"), (2, "m1")]


@pytest.mark.parametrize("mode", ["head", "quota"])
def test_stateful_new_items_over_batches(spark, mode):
    totals = {1: 10, 2: 13, 3: 13, 4: 14, 5: 14}
    batches = [[r for r in listing_rows(RUNS, totals) if r[1] == run] for run, _ in RUNS]
    batches[2] += [r for r in batches[1]]  # a replayed run changes nothing
    frame, path = file_stream(spark, batches, SCHEMA, f"t-new-{mode}")
    ev = [(r["run"], r["item"], r["event"]) for r in run_stream(spark, detect_new_items(frame, mode), path).collect()]
    at = lambda run, event: {i for r, i, e in ev if (r, e) == (run, event)}
    assert len(at(1, "baseline")) == 10
    n = 8 if mode == "head" else 3
    assert at(2, "queued") == {f"n{i}" for i in range(n)}
    assert at(3, "ready") == {f"n{i}" for i in range(n)}
    assert at(4, "queued") == {"z"} and "z" in at(5, "ready")
    if mode == "head":  # nothing was reported, so confirmed items stay ready
        assert {f"n{i}" for i in range(8)} <= at(5, "ready")


@pytest.mark.parametrize("mode", ["head", "quota"])
def test_a_run_in_two_batches_loses_nothing(spark, mode):
    """The second part of a run is not a replay: of the baseline too."""
    totals = {1: 10, 2: 13, 3: 13, 4: 14, 5: 14}
    rows = {run: [r for r in listing_rows(RUNS, totals) if r[1] == run] for run, _ in RUNS}
    whole = [rows[run] for run, _ in RUNS]
    split = [part for run, _ in RUNS for part in (rows[run][:4], rows[run][4:] + rows[run][:2])]
    events = []
    for label, batches in (("whole", whole), ("split", split)):
        frame, path = file_stream(spark, batches, SCHEMA, f"t-{label}-{mode}")
        events.append(sorted((r["run"], r["item"], r["event"]) for r in run_stream(spark, detect_new_items(frame, mode), path).collect()))
    if mode == "quota":
        assert events[0] == events[1]
    else:  # an open item of a later part is reported as open by the first part, once
        assert events[0] == events[1] and len(set(events[1])) == len(events[1])


def test_late_rows_are_counted(spark):
    at = lambda m: (T0 + dt.timedelta(minutes=m)).isoformat()
    batches = [[(1, "early words", at(0)), (1, "later words", at(90))], [(1, "open words", at(95))], [(1, "late words", at(1)), (1, "open words", at(96))]]
    frame, path = file_stream(spark, batches, "session_id long, content string, ts string", "t-late")
    words = Me.window_words(frame.withColumn("ts", F.to_timestamp("ts")), "session_id", "ts", "content", "[a-z]+", 5)
    q = Me.write_batches(words, f"{path}/out", f"{path}/check", interval=None, mode="update")
    q.awaitTermination()
    assert Me.late_rows(q) == 2
    counts = {(r["start"].minute, r["word"]): r["n"] for r in Me.latest_counts(spark.read.parquet(f"{path}/out"), ["start", "word"]).collect()}
    assert counts[0, "early"] == 1 and (0, "late") not in counts and counts[35, "open"] == 2


def test_done_items_leave_the_backlog(spark):
    batches = [[r for r in listing_rows(RUNS[:3]) if r[1] == run] for run in (1, 2, 3)]
    batches.append([("acc", 4, "n0", 0, None, "done"), ("acc", 4, "n1", 0, None, "listing")])
    frame, path = file_stream(spark, batches, SCHEMA, "t-done")
    ev = {(r["run"], r["item"], r["event"]) for r in run_stream(spark, detect_new_items(frame), path).collect()}
    assert (4, "n0", "reported") in ev and (4, "n0", "ready") not in ev and (4, "n5", "ready") in ev


def test_retried_batch_replaces_itself(spark):
    frame, path = file_stream(spark, [[(1,)], [(2,)]], "x long", "t-sink")
    q = Me.write_batches(frame, f"{path}/out", f"{path}/check", interval=None)
    q.awaitTermination()
    q = Me.write_batches(frame, f"{path}/out", f"{path}/check2", interval=None)  # the same batches once more
    q.awaitTermination()
    assert sorted(r["x"] for r in spark.read.parquet(f"{path}/out").collect()) == [1, 2]


def test_replay_of_many_runs_is_one_walk():
    """An account with 100,000 runs: equal to the rule run by run, without a frame for each run."""
    import random
    import time

    import pandas as pd

    from tidemark.operators import new_items as N

    rnd = random.Random(3)
    rows = sorted({(r, f"i{rnd.randrange(60_000)}") for r in range(100_000) for _ in range(2)})
    pdf = pd.DataFrame([("a", i, r, rnd.randrange(9)) for r, i in rows], columns=["account", "item", "run", "pos"])
    start = time.process_time()
    got = N._release_in_order(2)(pdf.sample(frac=1, random_state=1))
    assert time.process_time() - start < 4
    gone, want = set(), []
    per = {}
    for i, r, p in zip(pdf["item"], pdf["run"], pdf["pos"]):
        per.setdefault(r, []).append((p, i))
    for r in sorted(per):
        new = [i for _, i in sorted(per[r]) if i not in gone][:2]
        gone.update(new)
        want += [("a", i, r) for i in new]
    assert [tuple(x) for x in got.itertuples(index=False)] == want
