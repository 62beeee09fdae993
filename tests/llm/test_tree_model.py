from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import tree_model as M

DOCS = "doc_id long, text string"


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def decisions(text):
    """(context bytes, nearest last; bits before; bit) of a text and its end."""
    data = [255] * 5 + list(brute.lower(text).encode()) + [255]
    for i in range(5, len(data)):
        bits = f"{data[i]:08b}"
        for j in range(8):
            yield tuple(data[i - 5:i]), bits[:j], int(bits[j])


def tree_scores(docs):
    """Log10 probabilities by the recursion over trees of decisions, one tree for each string of bits before."""
    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)
    for i, text in docs:
        if not held(i):
            for context, bits, bit in decisions(text):
                for d in range(6):
                    counts[bits, context[5 - d:]][bit] += 1
                    if d:
                        children[bits, context[6 - d:]].add(context[5 - d:])

    def estimate(a, b):
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @lru_cache(None)
    def node(bits, context):
        """(estimate, product of the children, weighted probability) in logs."""
        e = estimate(*counts[bits, context]) if (bits, context) in counts else 0.0
        if len(context) == 5:
            return e, None, e
        inner = sum(node(bits, c)[2] for c in children.get((bits, context), ()))
        high = max(e, inner)
        return e, inner, high + math.log((math.exp(e - high) + math.exp(inner - high)) / 2)

    @lru_cache(None)
    def one(bits, context):
        chance = None
        for d in range(5, -1, -1):
            suffix = context[5 - d:]
            a, b = counts[bits, suffix] if (bits, suffix) in counts else (0, 0)
            own = (b + .5) / (a + b + 1)
            e, inner, _ = node(bits, suffix)
            if d == 5:
                chance = own
            else:
                ratio = math.exp(min(e - inner, 600))
                chance = (ratio * own + chance) / (ratio + 1)
        return chance

    return [sum(math.log10(p if bit else 1 - p) for context, bits, bit in decisions(text) for p in [one(bits, context)]) for _, text in docs]


def base_scores(docs):
    tokens = [[*brute.spaced(brute.lower(t)), None] for _, t in docs]
    c = Counter(w for (i, _), ws in zip(docs, tokens) if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + .1) / (n + .1 * (v + 1))) for w in ws)) for (i, _), ws in zip(docs, tokens)]


def some_docs():
    rnd = random.Random(2)
    words = ["stone", "River", "ash", "é", "light", "中", "a\x1cb"]
    docs = [(i, " ".join(rnd.choice(words) + rnd.choice(["", "", str(rnd.randint(0, 40))]) for _ in range(rnd.randint(0, 25)))) for i in range(50)]
    return docs + [(100, None), (100, ""), (None, "ash ash"), (7, "twice\none"), (7, "twice\none"), (7, "other"), (101, "\x00 \x7f")]


@pytest.mark.parametrize("block,head,chunk", [(4_000_000, 262_144, 200_000), (300, 3, 50)])
def test_scores_equal_the_recursion(spark, monkeypatch, block, head, chunk):
    monkeypatch.setattr(M, "BLOCK_ROWS", block)
    monkeypatch.setattr(M, "HEAD_WORDS", head)
    monkeypatch.setattr(M, "CHUNK", chunk)
    monkeypatch.setattr(M, "HELD", 2 * chunk)
    docs = some_docs()
    d = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit(1) for c in ("body", "lp", "w", "training", "key", "_text", "n")}).repartition(4)
    got = sorted(M.score(d).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.score))
    want = sorted(((i, *b, s, len(brute.lower(t).encode())) for (i, t), b, s in zip(docs, base_scores(docs), tree_scores(docs))), key=lambda r: (r[0] is None, r[0] or 0, r[2], r[6]))
    assert [tuple(r)[:5] for r in got] == [w[:5] for w in want] and [r.n_bytes for r in got] == [w[7] for w in want]
    assert np.allclose([r.base_score for r in got], [w[5] for w in want], rtol=1e-9, atol=1e-9)
    assert np.allclose([r.score for r in got], [w[6] for w in want], rtol=1e-9, atol=1e-9)


def test_estimates_and_large_counts():
    a = np.array([0, 1, 5, 300, 600, 10**5], float)
    assert np.allclose(M.kt(a, a[::-1]), [math.lgamma(x + .5) + math.lgamma(y + .5) - math.lgamma(x + y + 1) - math.log(math.pi) for x, y in zip(a, a[::-1])], rtol=1e-9)
    zeros = 10**9  # the next one's chance keeps its digits
    assert M.kt(np.array([zeros + 1.0]), np.array([0.0]))[0] - M.kt(np.array([float(zeros)]), np.array([0.0]))[0] == pytest.approx(math.log((zeros + .5) / (zeros + 1)), abs=1e-8)


def test_held_out_texts_cost_less_than_without_learning(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("aeioustrn") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(120))) for i in range(400)]
    rows = [r for r in M.score(spark.createDataFrame(docs, DOCS)).collect() if r.held_out]
    bits = -sum(r.score for r in rows) * math.log2(10) / sum(r.n_bytes for r in rows)
    assert len(rows) > 20 and bits < 2.6


def test_empty_tables_long_texts_and_no_training(spark):
    assert M.score(spark.createDataFrame([], DOCS)).count() == 0
    out = next(i for i in range(100) if held(i))
    only = M.score(spark.createDataFrame([(out, "ab"), (None, None)], DOCS)).orderBy("n_bytes").collect()
    assert [(r.train_tokens, r.n_known, r.base_score) for r in only] == [(0, 0, 0.0)] * 2
    assert [r.score for r in only] == pytest.approx([-8 * math.log10(2), -24 * math.log10(2)])
    long = M.score(spark.createDataFrame([(1, "word " * 700_000), (2, "x" * 3_000_000)], DOCS)).orderBy("doc_id").collect()
    assert [r.n_tokens for r in long] == [700_001, 2] and all(r.score < 0 for r in long)
