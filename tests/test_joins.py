from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tests.test_odd_tables import differing
from tidemark.operators import corpus as Co, entities as E, joins as J
from tidemark.plans import all_queries


def test_contains_pairs_is_brute_force(spark):
    rnd = random.Random(3)
    texts = [(i, "".join(rnd.choice("abc ") for _ in range(40))) for i in range(60)]
    names = sorted({"".join(rnd.choice("abc ") for _ in range(rnd.randrange(2, 7))) for _ in range(60)})
    pairs = J.contains_pairs(spark.createDataFrame(texts, "k long, t string"), "k", "t",
                             spark.createDataFrame([(n,) for n in names], "name string"), "name")
    got = [tuple(r) for r in pairs.collect()]
    want = {(k, n) for k, t in texts for n in names if len(n) >= 3 and n in t}
    assert set(got) == want and len(got) == len(want)


def test_merge_keeps_known_values(spark):
    old = spark.createDataFrame([("n1", 5000, 800, "title", "2024-01-01"), ("n2", 1, None, "", None)], "id string, likes int, saves int, title string, day string")
    new = spark.createDataFrame([("n1", None, None, "", None, 1), ("n1", None, 900, None, None, 2), ("n2", 3, None, "t2", None, 1), ("n3", 9, 9, "x", "d", 1)],
                                "id string, likes int, saves int, title string, day string, at int")
    got = {r["id"]: tuple(r)[1:] for r in J.merge_known(old, new, ["id"], ["at"]).collect()}
    assert got == {"n1": (5000, 900, "title", "2024-01-01"), "n2": (3, None, "t2", None), "n3": (9, 9, "x", "d")}


def test_recent_before_looks_back_five_days(spark):
    d = spark.createDataFrame([("a", "2024-01-01", 1), ("a", "2024-01-06", 2), ("a", "2024-01-13", 3)], "k string, day string, v int").withColumn("day", F.to_date("day"))
    got = {str(r["day"]): r["base_v"] for r in J.recent_before(d, d, ["k"], "day", "v", 5).collect()}
    assert got == {"2024-01-01": None, "2024-01-06": 1, "2024-01-13": None}


def test_canonical_chain(spark):
    d = spark.createDataFrame([("世纪城",), ("安哥拉世纪城",), ("非洲安哥拉世纪城",), ("中国城",)], "name string")
    got = dict(map(tuple, E.canonical_names(d).collect()))
    assert got == {"世纪城": "非洲安哥拉世纪城", "安哥拉世纪城": "非洲安哥拉世纪城", "非洲安哥拉世纪城": "非洲安哥拉世纪城", "中国城": "中国城"}


def test_components_of_a_long_chain(spark):
    n = 40
    nodes = spark.createDataFrame([(i,) for i in range(n + 3)], "node long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(n, n + 1)], "src long, dst long")
    got = dict(map(tuple, E.connected_components(nodes, edges).collect()))
    assert {got[i] for i in range(n)} == {0} and got[n] == got[n + 1] == n and got[n + 2] == n + 2


def merged_one_by_one(rows, n=4):
    accounts = {}
    for name, account in rows:
        if name is not None:
            accounts.setdefault(name, set()).update([] if account is None else [account])
    order, owner = sorted(accounts, key=lambda x: (-len(x), x)), {}
    for taker in order:
        if taker in owner:
            continue
        owner[taker], held = taker, set(accounts[taker])
        for other in order:
            if other not in owner and len(other) < len(taker) and (len(other) >= n and other in taker or held & accounts[other]):
                owner[other] = taker
                held |= accounts[other]
    return owner


@pytest.mark.parametrize("seed,n_accounts", [(0, 60), (1, 12)])
def test_leads_merge_in_order(spark, seed, n_accounts):
    rnd = random.Random(seed)
    rows = [("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9))), rnd.choice([None, *range(n_accounts)])) for _ in range(50)]
    rows += rows[:5] + [(None, 1), ("é" * 5, 0), ("", None)]
    d = E.merge_leads_in_order(spark.createDataFrame(rows, "name string, account long"))
    got = [tuple(r) for r in d.collect()]
    assert dict(got) == merged_one_by_one(rows) and len(got) == len(dict(got))
    assert E.merge_leads_in_order(spark.createDataFrame([], "name string, account long")).count() == 0


@pytest.mark.parametrize("replayed", [2000, 60])
def test_long_chains_of_leads_take_few_rounds(spark, monkeypatch, replayed):
    # neighbours share an account, and names are equally long in fours, so a round settles a handful at the old end
    names = [chr(97 + i % 4) + "x" * (40 - i // 4) + chr(97 + i * 7 % 26) for i in range(120)]
    rows = [(n, i // 2) for i, n in enumerate(names)] + [(n, 1000 + (i + 1) // 2) for i, n in enumerate(names)]
    rounds, write = [], E.write_through
    monkeypatch.setattr(E, "write_through", lambda d, label: rounds.append(label) or write(d, label))
    got = E.merge_leads_in_order(spark.createDataFrame(rows, "name string, account long"), replayed=replayed).collect()
    assert dict(map(tuple, got)) == merged_one_by_one(rows)
    assert rounds.count("leads") <= 3 + 2 * len(names) // replayed


def test_a_taken_lead_takes_none(spark):
    # the middle lead goes to the long one by its account, so the short one that only the middle one contains stays
    rows = [("long name here", 1), ("middle one", 1), ("middle", 2), ("short", 1)]
    got = dict(map(tuple, E.merge_leads_in_order(spark.createDataFrame(rows, "name string, account long")).collect()))
    assert got == {"long name here": "long name here", "middle one": "long name here", "middle": "middle", "short": "long name here"}


def test_duplicate_candidates_is_brute_force(spark):
    rnd = random.Random(8)
    pick = lambda words, p: [w for w in words if rnd.random() < p]
    units = [(i, rnd.choice("QO"), "".join(rnd.choice("甲乙丙丁戊己庚辛壬癸ab") for _ in range(rnd.randrange(0, 7))), pick(["t1", "t2"], .3),
              pick(["k1", "k2", "k3"], .3), pick(["s1", "s2"], .3)) for i in range(90)]
    df = spark.createDataFrame(units, "unit_id long, type string, title string, themes array<string>, keywords array<string>, sources array<string>")
    want = {}
    for a, b in itertools.combinations(units, 2):
        if a[1] != b[1]:
            continue
        t, k, s = (len(set(x) & set(y)) for x, y in zip(a[3:], b[3:]))
        ca, cb = set(a[2]), set(b[2])
        sim = len(ca & cb) / max(len(ca), len(cb)) if ca and cb else 0.0
        if (t and k) or (s and (t or k)) or (sim >= 0.35 and (t or k or s)):
            want[(a[0], b[0])] = 3 * t + 2 * k + 2 * s + int(sim * 10 + 0.5)
    got = {(r["a"], r["b"]): r["score"] for r in Co.duplicate_candidates(df).collect()}
    assert got == want


def test_copies_of_a_unit_meet_once(spark):
    # 23 equal units, 9 that share their theme and source, and one of another type
    units = [(i, "Q", "abc", ["t"], ["k"], ["s"]) for i in range(0, 46, 2)] + [(i, "Q", "xyz", ["t"], [], ["s"]) for i in range(1, 19, 2)] + [(99, "O", "abc", ["t"], ["k"], ["s"])]
    df = spark.createDataFrame(units, "unit_id long, type string, title string, themes array<string>, keywords array<string>, sources array<string>")
    got = [(r.a, r.b) for r in Co.duplicate_candidates(df, most=5).collect()]
    assert len(got) == len(set(got)) and set(got) == set(itertools.combinations(sorted(u[0] for u in units[:-1]), 2))


def test_counts_of_manual_pairs_are_those_of_the_pairs(spark, monkeypatch):
    rnd = random.Random(5)
    kinds = [(rnd.choice("QO"), t, th, kw, so) for t in ("abc", "abd", "") for th in (["t"], []) for kw in (["k"], []) for so in (["s"],)]
    units = spark.createDataFrame([(i, *rnd.choice(kinds)) for i in range(60)], "unit_id long, type string, title string, themes array<string>, keywords array<string>, sources array<string>")
    some = lambda k: [(rnd.randrange(62), rnd.randrange(62)) for _ in range(k)]
    manual = spark.createDataFrame(some(200), "a long, b long")
    reviews = spark.createDataFrame([(a, b, "kept", "n") for a, b in some(300)], "a long, b long, status string, note string")
    pairs = Co.with_manual_pairs(Co.duplicate_candidates(units), units, manual, reviews)
    want = pairs.groupBy("candidate_type", "status").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top_score")).collect()
    monkeypatch.setattr(Co, "duplicate_candidates", None)  # no pair of units is made
    got = Co.manual_pair_counts(units, manual, reviews).collect()
    assert len(want) > 4 and {tuple(r) for r in got} == {tuple(r) for r in want} and len(got) == len(want)


def test_lists_in_several_blocks_meet_once(spark, monkeypatch):
    # more than 64 characters, blocks of a few lists, a pair at a time, NULLs, and rows that come twice
    rnd = random.Random(11)
    signs = [chr(0x4E00 + i) for i in range(90)] + list("abcXYZ019")
    pick = lambda words, p: [w for w in words if rnd.random() < p]
    units = [(i, rnd.choice(["Q", "O", None]), "".join(rnd.choice(signs) for _ in range(rnd.choice([0, 3, 40, 120]))), pick(["t1", "t2", None], .3),
              pick(["k1", "k2", "k3"], .3), pick(["s1", "s2", None], .3)) for i in range(70)]
    df = spark.createDataFrame(units + units[:9], "unit_id long, type string, title string, themes array<string>, keywords array<string>, sources array<string>")
    want = {}
    for a, b in itertools.combinations(units, 2):
        th, kw, so = ({*x} & {*y} - {None} for x, y in zip(a[3:], b[3:]))
        ca, cb = set(a[2]), set(b[2])
        sim = len(ca & cb) / max(len(ca), len(cb)) if ca and cb else 0.0
        if a[1] == b[1] and ((th and kw) or (so and (th or kw)) or (sim >= 0.35 and (th or kw or so))):
            label = "synonym" if so and th and (kw or sim >= 0.45) else "near"
            want[a[0], b[0]] = (a[1], *(" | ".join(sorted(x)) for x in (th, kw, so)), sim, 3 * len(th) + 2 * len(kw) + 2 * len(so) + int(sim * 10 + 0.5), label)
    monkeypatch.setattr(Co, "PAIR_CELLS", 64)
    monkeypatch.setattr(Co, "PAIR_ROWS", 5)
    got = [tuple(r) for r in Co.duplicate_candidates(df, labels=("near", "synonym"), block_bytes=3000).collect()]
    assert {r[:2]: r[2:] for r in got} == want and len(got) == len(want) > 100


#: Texts of one type whose first lines begin differently, with and without a shared source, theme and long word.
DOCUMENTS = """SELECT i AS doc_id, 'en' AS lang, 'src' || (i % 3) AS source, 9::BIGINT AS n_chars,
  ['Alpha ', 'beta and ', 'Of gamma the ', 'x'][1 + i % 4] || ['something else', 'License of shops', 'abc', 'qrstuvwxyz'][1 + i // 4 % 4] || chr(10) || ['GNU', 'plain', 'idiot', 'a | b'][1 + i // 5 % 4] AS text FROM range(40) t(i)"""


def test_pairs_whose_titles_begin_differently(spark, tmp_path):
    assert differing(spark, tmp_path, "duplicate_candidates", documents=DOCUMENTS) == []
    titles = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    rows = all_queries()[0]["duplicate_candidates"](spark, str(tmp_path)).where("shared_sources <> '' and shared_themes <> ''").collect()
    assert any(titles[r.a][:12] != titles[r.b][:12] for r in rows) and {r.shared_sources for r in rows} == {"src0", "src1", "src2"}


def test_counted_pairs_whose_titles_begin_differently(spark, tmp_path):
    tables = {"documents": DOCUMENTS, "conversations": "SELECT i % 20 AS conv_id, i AS turn, 'user' AS role, 't' AS text FROM range(50) t(i)",
              "labels": "SELECT i AS doc_id, 1 AS quality, 0 AS toxic FROM range(0, 30, 3) t(i)"}
    assert differing(spark, tmp_path, "manual_pairs", **tables) == []
    pairs = all_queries()[0]["duplicate_candidates"](spark, str(tmp_path)).groupBy("candidate_type").count().collect()
    counts = all_queries()[0]["manual_pairs"](spark, str(tmp_path)).where("candidate_type <> 'by hand'").groupBy("candidate_type").sum("n").collect()
    assert {tuple(r) for r in counts} == {tuple(r) for r in pairs}


def test_salted_pairs_lose_nothing(spark):
    d = spark.createDataFrame([("hot", i) for i in range(60)] + [("cold", i) for i in range(60, 64)], "key string, i long")
    got = {tuple(r) for r in Co.salted_pairs(d, "key", "i", most=7).collect()}
    assert got == set(itertools.combinations(range(60), 2)) | set(itertools.combinations(range(60, 64), 2))


def test_rewrite_links_leaves_fences_alone(spark):
    d = spark.createDataFrame([(1, "see QST-001 and ```QST-001``` end QST-0011")], "i long, t string")
    links = spark.createDataFrame([("QST-001", "[[QST-001_x]]")], "id string, link string")
    r = Co.rewrite_links(d, "i", "t", links, r"QST-\d+").first()
    assert r["rewritten"] == "see [[QST-001_x]] and ```QST-001``` end QST-0011"


def test_pair_audit(spark):
    c = spark.createDataFrame([(1, 2, "x", "x", "conflict"), (3, 4, "x", "x", "conflict"), (5, 6, "q", "q", "layered"), (7, 8, "c", "o", "layered"), (9, 10, "c", "o", "layered")],
                              "a long, b long, a_type string, b_type string, status string")
    e = spark.createDataFrame([(1, 2, "conflict", "n"), (2, 1, "conflict", "n"), (3, 4, "conflict", "n"), (4, 3, "conflict", ""), (10, 9, "explains", "")], "src long, dst long, type string, note string")
    got = {r["a"]: r["audit"] for r in Co.pair_audit(c, e, exempt=[("q", "q")]).collect()}
    assert got == {1: "pass", 3: "missing", 5: "not required", 7: "missing", 9: "pass"}


def test_assemble_prefers_linked_units(spark):
    d = spark.createDataFrame([(1, "question", "a", ["t"], [0], 10), (2, "question", "b", ["u"], [0], 9), (3, "opinion", "c", ["t"], [1], 1), (4, "opinion", "d", ["z"], [0], 12)],
                              "unit_id long, type string, title string, themes array<string>, targets array<long>, score long")
    got = {(r["type"], r["unit_id"]): (r["is_main"], r["final_score"]) for r in Co.assemble(d, ["question", "opinion"], 2).collect()}
    assert got == {("question", 1): (True, 10), ("question", 2): (False, 12), ("opinion", 3): (True, 25), ("opinion", 4): (False, 15)}
