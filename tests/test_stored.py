from __future__ import annotations

import pytest
from pyspark.sql import functions as F, types as T

from tidemark.operators import joins as J
from tidemark.sources.stored import StoredTable

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def replace(old, new):
    return J.replace_rows(old, new, ["k"])


def test_batches_rewrite_only_the_buckets_of_their_keys(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], 16)
    assert t.read().count() == 0 and t.folders() == (0, {})
    assert t.merge(table(spark, [(i, "a") for i in range(200)]), "one", replace)
    before = set(t.read().inputFiles())
    assert t.merge(table(spark, [(7, "b"), (500, "b")]), "two", replace)
    after, want = set(t.read().inputFiles()), {i: "a" for i in range(200)} | {7: "b", 500: "b"}
    assert {r.k: r.v for r in t.read().collect()} == want and 1 <= len(before - after) <= 2 and len(before & after) >= 14
    # the same batch again, and one of no rows, change nothing
    assert not t.merge(table(spark, [(7, "c")]), "two", replace) and t.merge(table(spark, []), "three", replace)
    assert set(t.read().inputFiles()) == after and not t.merge(table(spark, [(1, "d")]), "three", replace) and t.folders()[0] == 3


def test_a_lost_batch_is_sent_again(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], 4)
    t.merge(table(spark, [(i, "a") for i in range(40)]), "one", replace)

    def broken(old, new):
        return replace(old, new).withColumn("v", F.when(F.col("k") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))

    with pytest.raises(Exception, match="lost"):
        t.merge(table(spark, [(3, "b"), (4, "b")]), "two", broken)
    assert {r.v for r in t.read().collect()} == {"a"} and t.folders()[0] == 1
    assert t.merge(table(spark, [(3, "b"), (4, "b")]), "two", replace)
    assert {r.k for r in t.read().where("v = 'b'").collect()} == {3, 4} and t.read().count() == 40


def test_merge_may_empty_a_bucket(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], 2)
    t.merge(table(spark, [(1, "a"), (2, "a"), (None, "n")]), "one", replace)
    t.merge(table(spark, [(i, "gone") for i in range(50)]), "two", lambda old, new: old.join(new.select("k"), "k", "left_anti"))
    assert [(r.k, r.v) for r in t.read().collect()] == [(None, "n")]
