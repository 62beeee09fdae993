from __future__ import annotations

import datetime as dt
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import html_text as H, packing as P, quality as Q, sharding as Sh, url_lists as U

DOCS = "doc_id long, text string"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


# --- sharding --------------------------------------------------------------------

def test_shards_are_exact_and_gapless(spark):
    rows = [(i if i % 5 else 7, f"text {i % 9}" if i % 4 else None) for i in range(1003)] + [(1, "same")] * 400
    docs = spark.createDataFrame(rows, DOCS).withColumns({"slot": F.lit(1), "_block": F.lit(2), "_number": F.lit(3)})
    got = Sh.shard_rows(docs).collect()
    by = Counter(r.shard for r in got)
    assert len(got) == 1403 and set(by) == set(range(16)) and max(by.values()) - min(by.values()) <= 1
    for s in by:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(by[s]))
    assert all(r.size >= 1 and 0 <= r.text_crc32 < 2**32 for r in got)
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((i, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Sh.shard_rows(docs.limit(0)).count() == 0


def test_matrix_has_the_given_sums_and_law():
    total = np.zeros((3, 2))
    for seed in range(3000):
        m = Sh.communication_matrix([3, 5, 2], [6, 4], seed)
        assert [sum(r) for r in m] == [3, 5, 2] and [sum(c) for c in zip(*m)] == [6, 4]
        total += np.array(m)
    assert np.abs(total / 3000 - np.outer([3, 5, 2], [0.6, 0.4])).max() < 0.06
    one = Counter(Sh.communication_matrix([3, 7], [6, 4], s)[0][0] for s in range(6000))
    want = {0: 4 / 120, 1: 36 / 120, 2: 60 / 120, 3: 20 / 120}  # C(6, k) C(4, 3 - k) / C(10, 3)
    assert all(abs(one[k] / 6000 - p) < 0.03 for k, p in want.items())


def test_large_draws_follow_the_law():
    rng = np.random.default_rng(1)
    good, bad, n = 6 * 10**9, 4 * 10**9, 10**6
    x = np.array([Sh.hypergeometric(rng, good, bad, n) for _ in range(400)])
    assert abs(x.mean() - 0.6 * n) < 5 * (0.24 * n) ** 0.5 / 20 and 0.8 < x.std() / (0.24 * n) ** 0.5 < 1.2
    assert Sh.hypergeometric(rng, 10**10, 5, 10) in range(5, 11) and Sh.hypergeometric(rng, 10**10, 10**10, 0) == 0


def test_every_row_may_go_anywhere(spark):
    rows = spark.createDataFrame([(i,) for i in range(32)], "doc_id long")
    seen = Counter()
    for seed in range(12):
        seen.update((r.doc_id, r.shard) for r in Sh.assign(rows, 2, seed, blocks=4).collect())
    per = [seen[i, 0] for i in range(32)]
    assert sum(per) == 12 * 16 and 1 <= min(per) and max(per) <= 11


def test_written_shards_hold_their_rows(spark, tmp_path):
    Sh.write_shards(spark.createDataFrame([(i, "x") for i in range(40)], DOCS), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.doc_id for r in back) == list(range(40)) and Counter(r.shard for r in back) == {s: 10 for s in range(4)}


def test_own_columns_named_like_helpers_stay(spark, tmp_path):
    own = {c: F.lit(7) for c in ("shard", "slot", "_shard", "_before", "_ends", "_at", "_part", "_number", "count")}
    docs = spark.createDataFrame([(i, "x") for i in range(40)], DOCS).withColumns(own)
    d = Sh.assign(docs, 4)
    shard, slot = Sh.shard_columns(docs)
    rows = d.collect()
    assert d.columns == [*docs.columns, shard, slot] and all(r[c] == 7 for r in rows for c in own) and Counter(r[shard] for r in rows) == {s: 10 for s in range(4)}
    Sh.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert Counter(r[shard] for r in back) == {s: 10 for s in range(4)} and all(r["shard"] == 7 for r in back)


# --- packing -----------------------------------------------------------------------

def test_packing_is_an_exact_round_trip(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(VOCABULARY)
    rnd = random.Random(3)
    words = ["River", "naïve", "über-all", "it's", "x9,", "中文", "😀", "a\x1cb", "don't.", "É́", "<|endoftext|>", "İx", "water!!", "&&&"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 30, 400])))) for i in range(60)] + [(100, None), (101, ""), (101, ""), (102, "water river " * 6000)]
    got = P.pack(spark.createDataFrame(docs, DOCS).withColumn("length", F.lit(1)), VOCABULARY).collect()
    want = Counter()
    for i, t in docs:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        want.update((i, p, s, len(ids[s:s + 4096]), zlib.crc32(np.array(ids[s:s + 4096], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 4096)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) == -(-sum(r.length for r in got) // 4096)
    assert P.pack(spark.createDataFrame([], DOCS), VOCABULARY).count() == 0


def test_bin_completion_reaches_the_optimum():
    def least(items, cap):
        best = len(items)

        def go(i, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if i == len(items):
                best = len(rooms)
                return
            for j in {r: j for j, r in enumerate(rooms) if r >= items[i]}.values():
                rooms[j] -= items[i]
                go(i + 1, rooms)
                rooms[j] += items[i]
            go(i + 1, [*rooms, cap - items[i]])

        go(0, [])
        return best

    rnd, better = random.Random(1), 0
    for _ in range(200):
        items = sorted((rnd.randint(15, 55) for _ in range(rnd.randint(1, 10))), reverse=True)
        bins = P.complete_bins(Counter(items), 100)
        assert Counter(x for b in bins for x in b) == Counter(items) and all(sum(b) <= 100 for b in bins)
        assert len(bins) == least(items, 100)
        better += len(P.best_fit(Counter(items), 100)) > len(bins)
    assert better and P.complete_bins(Counter(), 100) == []


# --- pages ---------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><article>no</article>";</script><style>p{{}}</style></head><body class="no-sidebar">
<header>Head</header><nav><ul><li>Menu</li></ul></nav><div class="cookie-notice">Cookies<div>inner</div></div><div class="ad">Buy</div>
{body}<aside>Side</aside><section id="comments"><article>reader</article></section><form>Form <input></form><footer>&copy; foot</footer></body></html>"""


@pytest.mark.parametrize("body,text", [
    ("<article><h1>A &amp; B</h1><p><b>one.<br><p>two\n\t three</p><!-- x --><div class='ad'>no</div><p>fi<i>ve</i>&nbsp;six</article>", "A & B one. two three five six"),
    ("<main><p>in main</p><div class=comment>no</div></main><div>outside</div>", "in main"),
    ("<div><p>plain one<p>plain two</div>", "plain one plain two"),
    ("<article></article>", ""), ("<article><p>a &lt; b &am</article>", "a < b &am"),
])
def test_markup(body, text):
    assert H.main_text(H.lines(PAGE.format(body=body)), None)[0] == text


def test_lines_shared_with_the_neighbour_go(spark):
    frame = "<div>Site {0}</div><div>All news</div><div>{1}</div><div>Imprint</div>"
    rows = [(i, f"http://h{i % 3}.org/a/{i:03d}?q={i}", frame.format(i % 3, f"own text {i}")) for i in range(60)]
    rows += [(100, "http://alone.org/x", "<p>only page</p>"), (101, None, "<p>no url</p>"), (102, "http://h0.org/a/000", None), (103, "http://h1.org/", ""), (104, "not a url", "<p>no host</p>")]
    got = {r.page_id: r for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()}
    assert all(got[i].text == f"own text {i}" and got[i].n_shared == 3 and got[i].n_chars == len(got[i].text) for i in range(1, 60))
    assert [got[i].text for i in range(100, 105)] == ["only page", "no url", "", "", "no host"] and got[101].url is None
    copies = H.extract(spark.createDataFrame([rows[5]] * 3, "page_id long, url string, html string")).collect()
    assert [(r.text, r.n_shared) for r in copies] == [("Site 2 All news own text 5 Imprint", 0)] * 3
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_common_is_a_longest_subsequence():
    rnd = random.Random(1)
    for _ in range(600):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 11))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found, rest = sorted(H.common(a, b)), iter(b)
        assert len(found) == table[-1][-1] and all(a[i] in rest for i in found)


# --- URL lists -------------------------------------------------------------------------

ENTRIES = "list string, pattern string, action string, dated date"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_active_lists_equal_a_replay(spark):
    rnd = random.Random(5)
    patterns = ["a.org", "x.a.org", "b.net", "x.a.org/", "x.a.org/p/", "b.net/p/q/", "org"]
    entries = [(rnd.choice(["l1", "l2", "l3"]), rnd.choice(patterns), rnd.choice(["add", "add", "remove"]), day(rnd.randint(0, 120))) for _ in range(60)]
    entries += entries[:5] + [(None, "a.org", "add", day(1)), ("l1", None, "add", day(1)), ("l1", "a.org", "add", None), ("l1", "a.org", "other", day(1))]
    urls = ["http://x.a.org/p/1", "https://a.org", "http://b.net/p/q/r?x=/y/", "http://u@X.A.org:80/p", "ftp://c.de/", None, "junk"]
    captures = [(i, rnd.choice(urls), day(rnd.randint(-5, 140)) if i % 11 else None) for i in range(300)]

    def held(url, when):
        if url is None or when is None or "://" not in url:
            return []
        rest = url.split("://")[1]
        host = rest.split("/")[0].split("@")[-1].split(":")[0].lower()
        path = ("/" + rest.split("/", 1)[1] if "/" in rest else "").split("?")[0]
        keys = {host} | {".".join(host.split(".")[i:]) for i in range(1, host.count("."))} | {host + path[:k + 1] for k, c in enumerate(path) if c == "/"}
        out = set()
        for name in ("l1", "l2", "l3"):
            for p in keys:
                past = [(d, a == "add") for x, y, a, d in entries if x == name and y == p and d is not None and a in ("add", "remove") and d <= when]
                if past and max(past)[1]:
                    out.add(name)
        return sorted(out)

    d = U.active_lists(spark.createDataFrame(captures, "id long, url string, fetched date").withColumn("pattern", F.lit(1)), spark.createDataFrame(entries, ENTRIES))
    assert {r.id: r.lists for r in d.collect()} == {i: held(u, w) for i, u, w in captures}


def test_allowed_and_empty_lists(spark):
    caps = spark.createDataFrame([(1, "http://a.org/", day(3)), (2, "http://a.org/", day(9)), (3, None, day(3))], "id long, url string, fetched date")
    block = spark.createDataFrame([("bad", "a.org", "add", day(2)), ("bad", "a.org", "remove", day(5))], ENTRIES)
    assert sorted(r.id for r in U.allowed(caps, block, ["bad"]).collect()) == [2, 3]
    assert U.allowed(caps, block.limit(0), ["bad"]).count() == 3 and U.allowed(caps.limit(0), block, ["bad"]).count() == 0


def test_captures_keep_columns_named_like_helpers(spark):
    own = {c: F.lit(7) for c in ("_url", "_day", "lists", "_lists", "pattern", "month", "since", "until", "_a", "_b")}
    caps = spark.createDataFrame([(1, "http://a.org/", day(3)), (2, "http://b.org/", day(3))], "id long, url string, fetched date").withColumns(own)
    block = spark.createDataFrame([("bad", "a.org", "add", day(2))], ENTRIES)
    d = U.active_lists(caps, block)
    assert d.columns[:-1] == caps.columns and {r.id: r[d.columns[-1]] for r in d.collect()} == {1: ["bad"], 2: []}
    left = U.allowed(caps, block, ["bad"])
    assert left.columns == caps.columns and [tuple(r)[3:] for r in left.collect()] == [(7,) * len(own)]


def test_ledger_keeps_a_column_of_its_name(spark):
    d = Q.ledger(spark.createDataFrame([(1, "a b c")], DOCS).withColumn("ledger", F.lit(7)))
    assert d.columns == ["doc_id", "text", "ledger", "_ledger"] and tuple(d.select("ledger", "_ledger.n_words").first()) == (7, 3)


# --- the pipeline -------------------------------------------------------------------------

@pytest.fixture
def folder(spark, tmp_path):
    rnd = random.Random(12)
    words = [f"{a}{b}" for a in ("stone", "river", "light", "cloud", "field", "ash") for b in ("", "s", "y", "ing", "ed", "land", "er")]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\n"]) for _ in range(n)).strip()
    bench = [(k, text(20)) for k in range(4)]
    passage = " ".join(f"{rnd.choice(words)}{i}" for i in range(60))
    docs = [(i, text(rnd.randint(60, 160))) for i in range(60)]
    docs += [(100 + i, docs[i][1]) for i in range(5)] + [(110 + i, docs[i][1] + "\nsome last words") for i in range(5)]
    docs += [(150 + i, " ".join([*t.split()[:-2], "other", "end"])) for i in range(5) for t in [docs[20 + i][1]]]
    docs += [(120 + i, f"{text(70)}\n{passage}\n{text(70)}") for i in range(4)]
    docs += [(130 + i, " ".join(bench[i][1].split()) + " " + text(60)) for i in range(4)]
    docs += [(140, "few words"), (141, "so so so " * 40), (142, None), (143, " ".join("A%% b$$ c##" for _ in range(50)))]
    path = str(tmp_path / "sf")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, bench


def test_pipeline_equals_brute_force(spark, folder):
    import corpus_pipeline

    path, docs, bench = folder
    kept = []
    for i, t in docs:
        n, _, symbols, _, repeated = brute.quality(t)
        if n >= 50 and 100 * repeated <= 50 * n and 10 * symbols <= 3 * n:
            kept.append((i, t))
    assert not {140, 141, 142, 143} & {i for i, _ in kept}
    cut = brute.without_runs(kept)
    kept = [(i, cut[i][0]) for i, _ in sorted(kept) if not cut[i][1] or cut[i][0].strip()]
    assert not set(range(100, 105)) & {i for i, _ in kept}  # exact copies
    sets = [brute.shingles(t, 5) for _, t in kept]
    head = brute.groups(len(kept), lambda i, j: brute.similar(sets[i], sets[j], 80))
    assert {k for k, h in enumerate(head) if h != k} >= {k for k, (i, _) in enumerate(kept) if 150 <= i < 155}  # near copies
    kept = [d for k, d in enumerate(kept) if head[k] == k]
    clean = []
    for i, t in kept:
        n, hit, _ = brute.contamination(t, bench)
        if not (hit and 20 * hit >= n):
            clean.append((i, t))
    assert not set(range(130, 134)) & {i for i, _ in clean}
    rows = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in clean}
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(VOCABULARY)
    assert {r.doc_id: r.ids_crc32 for r in rows} == {i: zlib.crc32(np.array([*whole.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in clean}


def test_stages_return_documents_and_take_empty_tables(spark, folder):
    import corpus_pipeline

    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumn("_ledger", F.lit(1))
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
        assert stage(spark, docs.limit(0), path).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), path).count() == 0
