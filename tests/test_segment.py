from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from tidemark.operators import segment as Sg


def cheapest(text, costs):
    """The least cost over all cuts, the next longest words first among equals, by trying every cut."""
    if not text:
        return 0, []
    found = []
    for k in range(1, len(text) + 1):
        cost = costs.get(text[:k], costs[""] if k == 1 else None)
        if cost is not None:
            rest = cheapest(text[k:], costs)
            found.append((cost + rest[0], -k, [text[:k], *rest[1]]))
    best = min(found, key=lambda f: f[:2])
    return best[0], best[2]


@pytest.fixture(scope="module")
def words():
    rnd = random.Random(3)
    out = {"".join(rnd.choice("abc中") for _ in range(rnd.randint(1, 4))): rnd.choice([1, 2, 8, 8, 50]) for _ in range(25)}
    return out


@pytest.mark.parametrize("sent_bytes", [Sg.SENT_BYTES, 0])
def test_paths_equal_an_exhaustive_search(spark, words, sent_bytes):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abcd中") for _ in range(rnd.randint(1, 9))) for _ in range(150)] + ["", None, "a", "a"]
    total = sum(words.values())
    costs = {w: math.floor(1000 * math.log(total / n)) for w, n in words.items()} | {"": math.floor(1000 * math.log(total))}
    dictionary = [(w, n) for w, n in words.items()] + [(None, 5), ("", 5), ("zz", 0)]
    d = Sg.segmented(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, run string").repartition(3),
                     spark.createDataFrame(dictionary, "word string, n long"), sent_bytes=sent_bytes)
    assert {r.id: r.words for r in d.collect()} == {i: cheapest(t or "", costs)[1] for i, t in enumerate(texts)}


def test_frequency_counts_every_run(spark, words):
    texts = [("ab ca! ab中",), ("AB",), (None,), ("",)] * 3
    dictionary = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: r.n for r in Sg.segmented_frequency(spark.createDataFrame(texts, "text string"), dictionary, shortest=1).collect()}
    total = sum(words.values())
    costs = {w: math.floor(1000 * math.log(total / n)) for w, n in words.items()} | {"": math.floor(1000 * math.log(total))}
    want = Counter(w for run, k in (("ab", 9), ("ca", 3)) for w in cheapest(run, costs)[1] * k)
    assert got == want
    none = Sg.segmented_frequency(spark.createDataFrame(texts, "text string"), dictionary.limit(0), shortest=1)
    assert {r.word: r.n for r in none.collect()} == {"a": 12, "b": 9, "c": 3}


def test_weights_are_fitted_once(spark):
    fit = spark.createDataFrame([("red blue",), ("red green",), ("red",), (None,)], "text string")
    w = Sg.fit_term_weights(fit, "text", "[a-z]+", "v1").unionByName(Sg.fit_term_weights(fit.limit(1), "text", "[a-z]+", "v2"))
    have = {(r.version, r.word): round(r.weight, 9) for r in w.collect()}
    assert have["v1", "red"] == round(math.log(4 / 3), 9) and have["v1", "blue"] == have["v1", ""] == round(math.log(4), 9) and have["v2", ""] == 0
    later = spark.createDataFrame([("g", "red red new"), ("g", "blue"), ("h", "blue")], "grp string, text string")
    got = {(r.grp, r.word): (r.n, r.weight, r.known, r["rank"]) for r in Sg.weighted_keywords(later, "grp", "text", "[a-z]+", w, "v1", 2).collect()}
    assert got == {("g", "blue"): (1, math.floor(math.log(4) / 4 * 1e6), True, 1), ("g", "new"): (1, math.floor(math.log(4) / 4 * 1e6), False, 2), ("h", "blue"): (1, math.floor(math.log(4) * 1e6), True, 1)}


def test_weighted_keywords_count_a_long_text_once(spark):
    """Words of a text are not compared with all words of the text: no array is searched for each of them."""
    text = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(300)) + " worda worda"
    docs = spark.createDataFrame([("s", text), ("s", None), (None, "worda")], "source string, text string")
    weights = spark.createDataFrame([("v", "worda", 1.0), ("v", "", 0.5)], "version string, word string, weight double")
    out = Sg.weighted_keywords(docs, "source", "text", r"\p{L}{3,}", weights, "v", 1000)
    got = {(r.source, r.word): r.n for r in out.where("source is not null").collect()}
    assert got == {("s", w): text.split().count(w) for w in set(text.split())}


def test_weighted_keywords_write_no_array_searches(spark, monkeypatch):
    plans, write = [], Sg.write_through
    monkeypatch.setattr(Sg, "write_through", lambda df, label: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df, label))[1])
    docs = spark.createDataFrame([("s", "aaa bbb aaa")], "source string, text string")
    weights = spark.createDataFrame([("v", "", 0.5)], "version string, word string, weight double")
    Sg.weighted_keywords(docs, "source", "text", r"\p{L}{3,}", weights, "v").collect()
    assert plans and not any("array_remove" in p or "filter(" in p for p in plans)
