from __future__ import annotations

import random

import pytest

from tests.llm import brute
from tidemark.llm import ngram_join as Nj

DOCS = "doc_id long, text string"


def shingles(text, size):
    w = brute.spaced(brute.lower(text))
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def near_docs(seed):
    rnd = random.Random(seed)
    docs = []
    for _ in range(25):
        base = [f"w{rnd.randint(0, 400)}" for _ in range(rnd.choice([2, 5, 12, 60, 150]))]
        for _ in range(rnd.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 2, 4])):
                copy[rnd.randrange(len(copy))] = f"new{rnd.randint(0, 99)}"
            docs.append(" ".join(copy))
    return list(enumerate(docs))


@pytest.mark.parametrize("size,percent", [(5, 80), (3, 80), (5, 60)])
def test_components_of_any_size_and_percent_equal_brute_force(spark, size, percent):
    docs = near_docs(size * percent)
    sets = [shingles(t, size) for _, t in docs]
    linked = lambda i, j: 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    head = brute.groups(len(docs), linked)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in Nj.components(spark.createDataFrame(docs, DOCS).repartition(3), percent=percent, size=size).collect()}
    assert got == {i: (len(sets[i]), head[i]) for i, _ in docs}


def test_the_stage_drops_copies_of_five_words_and_four_fifths(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(100)]
    near = words[:50] + ["other"] + words[51:]  # 5 words: 91 of 101 shingles, 3 words: 95 of 101
    near = near[:20] + ["more"] + near[21:]  # 5 words: 86 of 106, 3 words: 92 of 104
    far = words[:20] + ["x"] + words[21:40] + ["y"] + words[41:60] + ["z"] + words[61:]  # 5 words: 81 of 111
    a, b, c = (shingles(" ".join(x), 5) for x in (words, near, far))
    assert 0.8 <= len(a & b) / len(a | b) and not brute.similar(brute.shingles(" ".join(words)), brute.shingles(" ".join(near))) and len(a & c) / len(a | c) < 0.8
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))], DOCS)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 3}
