from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import resampling as R

DOCS = "doc_id long, text string"
WORDS = ["river", "Stone", "naïve", "a1", "É", "x" * 70, "中文", "the", "of"]


def texts(seed):
    rnd = random.Random(seed)
    piece = lambda: rnd.choice(WORDS) + rnd.choice([" ", "  ", ",", "\n", "--", " \x00"])
    docs = [(i, "".join(piece() for _ in range(rnd.choice([0, 1, 5, 30, 60])))) for i in range(80)]
    docs += [(200, None), (200, ""), (None, "the of " * 30), (5, "river stone " * 11), (5, "river stone " * 11)]
    return docs, [(i, "".join(rnd.choice(WORDS[:4]) + " " for _ in range(20))) for i in range(5)] + [(9, None)]


def resampled(docs, target, orders, buckets, percent):
    def features(text):
        w = [x.encode() for x in brute.folded(text)]
        return len(w), [zlib.crc32(b" ".join(w[i:i + k])) % buckets for k in range(1, orders + 1) for i in range(len(w) - k + 1)]

    s, t = (Counter(b for _, text in rows for b in features(text)[1]) for rows in (docs, target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        n, found = features(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append((n, (i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))))
    able = sorted((r for n, r in rows if n >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    drawn = percent * len(able) // 100
    return Counter([(*r, k if k <= drawn else None) for k, r in enumerate(able, 1)] + [(*r, None) for n, r in rows if n < 20])


@pytest.mark.parametrize("orders,dictionary", [(1, 0), (1, 1000), (3, 3), (3, 1000)])
def test_draw_equals_brute_force(spark, monkeypatch, orders, dictionary):
    docs, target = texts(orders)
    monkeypatch.setattr(R, "DICTIONARY_WORDS", dictionary)
    d = spark.createDataFrame(docs, DOCS).repartition(5).withColumns({"_text": F.lit(1), "f": F.lit(2), "row_no": F.lit(3), "score": F.lit(4)})
    got = R.resample(d, spark.createDataFrame(target, "item_id long, text string"), orders=orders, buckets=50, percent=30)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == resampled(docs, target, orders, 50, 30)


def test_composed_payloads_are_the_checksums_of_the_joined_words():
    shift, words = R.Shift(R.WORD_BYTES), [b"", b"a", b"of the", b"y" * 64, b"z" * 200]
    for a in words:
        crc = np.full(len(words), zlib.crc32(a), np.uint32)
        moved = shift(crc, np.array([len(b) for b in words]))
        assert [int(m) ^ zlib.crc32(b) for m, b in zip(moved, words)] == [zlib.crc32(a + b) for b in words]


def test_empty_tables_and_long_texts(spark):
    none, target = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "of")], DOCS)
    assert R.resample(none, target).count() == 0
    rows = [(1, "of the " * 400_000), (2, "of the " * 10), (3, None)]
    got = {r.doc_id: r for r in R.resample(spark.createDataFrame(rows, DOCS), none, percent=50).collect()}
    assert [got[i].n_features for i in (1, 2, 3)] == [800_000, 20, 0] and sorted(r.rank for r in got.values() if r.rank) == [1]
    with pytest.raises(ValueError):
        R.weighted(spark.createDataFrame(rows, DOCS).withColumn("features", F.lit(1)), target)
