from __future__ import annotations

import datetime as dt
import os
import random
import subprocess
import sys
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidemark.streaming import messages as Me, rooms as Ro
from tidemark.streaming.new_items import NewItemProcessor

BASE = dt.datetime(2024, 5, 1)


@pytest.fixture
def live(spark, tmp_path):
    """Messages of six rooms in five files, out of order within ten minutes, and one file that only moves the watermark."""
    rnd, rows = random.Random(6), []
    for room in range(6):
        at = 0
        for _ in range(rnd.randint(1, 60)):
            at += rnd.choice([0, 5, 40, 200, 400, 2500])
            rows.append((room, BASE + dt.timedelta(seconds=at, microseconds=room), " ".join(rnd.choice("red blue green sun".split()) for _ in range(rnd.randint(0, 3))), rnd.random() < 0.05))
    rows.sort(key=lambda r: r[1] + dt.timedelta(seconds=rnd.randint(0, 250)))
    folder = tmp_path / "in"
    schema = "room long, ts timestamp, text string, ends boolean"
    cuts = [0, 20, 21, 60, 120, len(rows)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(str(folder))
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return rows, source, tmp_path


def run(spark, frame, path):
    q = Me.write_batches(frame, f"{path}/out", f"{path}/checkpoint", interval=None)
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == 5
    return spark.read.parquet(f"{path}/out"), q


def test_windows_of_a_stream_equal_those_of_the_table(spark, live):
    rows, source, path = live
    words = F.filter(F.split("text", " "), lambda w: w != "")
    out, q = run(spark, Ro.anchored_topics(source(), "room", "ts", words, minutes=5, k=2), path)
    got = {(r.session, r.start): (r.end, r.msg_count, r.words) for r in Ro.latest_windows(out).collect()}
    want, late = {}, Me.late_rows(q)
    for room in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == room), key=lambda r: r[1])
        while own:
            start = own[0][1]
            inside = [r for r in own if r[1] < start + dt.timedelta(minutes=5)]
            own = own[len(inside):]
            n = Counter(w for r in inside for w in r[2].split())
            top = sorted(n.items(), key=lambda x: (-x[1], x[0]))[:2]
            want[room, start] = (own[0][1] if own else inside[-1][1], len(inside), ",".join(f"{w}:{k}" for w, k in top))
    assert late == 0 and got == want
    assert out.where("closed").groupBy("session", "start_us").count().where("count > 1").count() == 0


def test_sessions_end_by_message_or_silence(spark, live):
    rows, source, path = live
    out, q = run(spark, Ro.room_sessions(source(), "room", "ts", F.col("ends"), "30 minutes"), path)
    mark = max(r[1] for r in rows) - dt.timedelta(minutes=10)
    mark = mark.replace(microsecond=mark.microsecond // 1000 * 1000)
    want, open_rooms = set(), 0
    for room in {r[0] for r in rows}:
        own, part = sorted(((r[1], r[3]) for r in rows if r[0] == room and r[1] <= mark)), []
        for i, (ts, ends) in enumerate(own):
            part.append(ts)
            following = own[i + 1][0] if i + 1 < len(own) else None
            silent = ts + dt.timedelta(minutes=30)
            if ends or (silent < following if following else silent <= mark):
                want.add((room, part[0], part[-1], len(part), ts if ends else silent, "ended" if ends else "timed_out"))
                part = []
        open_rooms += bool(part) or any(r[0] == room and r[1] > mark for r in rows)
    micros = lambda c: F.timestamp_micros(c)
    got = [tuple(r) for r in out.select("session", micros("started_us"), micros("last_us"), "n_messages", micros("ended_us"), "status").collect()]
    assert len(got) == len(set(got)) and set(got) == want and {r[-1] for r in want} == {"ended", "timed_out"}
    state = q.recentProgress[-1]["stateOperators"][0]
    assert state["numRowsTotal"] <= 12 * open_rooms + 12  # finished rooms keep nothing


def test_processors_start_without_the_package_on_the_path():
    # Spark starts them in a process beside the driver, whose path has only Spark's own packages
    load = "import pickle, sys; [pickle.load(sys.stdin.buffer).init for _ in range(3)]"
    sent = b"".join(cloudpickle.dumps(p) for p in (Ro.AnchoredTopics(60, 2), Ro.RoomSessions(60), NewItemProcessor()))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", load], input=sent, cwd=os.path.sep, env=env, capture_output=True)
    assert done.returncode == 0, done.stderr.decode()
