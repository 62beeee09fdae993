from __future__ import annotations

import os

from tidemark import session as S


def test_scratch_lies_in_one_folder_and_can_be_cleared(spark, monkeypatch):
    root = S.scratch_root(spark)
    assert S.scratch_path(spark, "x").startswith(root + "/x-")
    monkeypatch.setattr(S, "scratch_root", lambda s: f"{root}/own")  # leave what other tests wrote
    df = S.write_through(spark.range(5), "numbers")
    assert df.count() == 5 and os.listdir(f"{root}/own")
    S.clear_scratch(spark)
    assert not os.path.exists(f"{root}/own")


def test_streams_get_the_state_store_of_their_processors(spark):
    from tidemark.session import ROCKSDB, STATE_STORE, rocksdb_state

    own = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with rocksdb_state(spark):
            assert spark.conf.get(STATE_STORE) == ROCKSDB
        assert "HDFSBacked" in spark.conf.get(STATE_STORE)
    finally:
        spark.conf.set(STATE_STORE, own)
