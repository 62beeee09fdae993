from __future__ import annotations

import json

from tidemark.sources import files
from tidemark.streaming import messages as Me


def test_files_of_two_runs_are_read_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def add(name, text):
        (source / name).write_text(text)

    def run():
        q = Me.write_batches(files.stream_video_dumps(spark, str(source), files_per_batch=1), f"{tmp_path}/out", f"{tmp_path}/checkpoint", interval=None)
        q.awaitTermination()
        return sum(p["numInputRows"] for p in q.recentProgress)

    def video(i):
        return {"desc": f"d{i}", "_raw": {"aweme_id": str(i), "create_time": 1}}

    add("de_cats.json", json.dumps({"videos": [video(1), video(2)]}))
    add("fr_dogs.json", "{broken")
    assert run() == 2
    add("it_birds.json", json.dumps({"country": "IT", "videos": [video(3)]}))
    assert run() == 1 and run() == 0
    streamed = spark.read.parquet(f"{tmp_path}/out").drop("batch_id")
    batch = files.read_video_dumps(spark, str(source))
    rows = lambda d: sorted((r.file, r.bad, r.country, r.keyword, r.desc or "", r._raw and r._raw.aweme_id) for r in d.collect())
    assert rows(streamed) == rows(batch) and [r[2] for r in rows(streamed) if not r[1]] == ["de", "de", "IT"] and sum(r[1] for r in rows(streamed)) == 1
