from __future__ import annotations

import random

import pytest
import xxhash

from tests.llm import brute
from tidemark.llm import line_dedup as Ld, queries

DOCS = "doc_id long, text string"


def run_docs(seed):
    rnd = random.Random(seed)
    lines = [" ".join(rnd.choice("stone river light ash".split()) + str(rnd.randint(0, 9)) for _ in range(rnd.choice([1, 4, 9, 60]))) for _ in range(30)]
    docs = []
    for i in range(30):
        text = [f"{rnd.choice(lines)} {i} {j}" for j in range(rnd.randint(0, 6))]
        for _ in range(rnd.randint(0, 3)):
            at, first = rnd.randint(0, len(text)), rnd.randrange(len(lines))
            text[at:at] = lines[first:first + rnd.randint(1, 8)]
        docs.append((i, "\n".join(text)))
    return docs + [(100 + i, docs[i][1]) for i in range(6)] + [(110, "a\nb\nc"), (111, "b\nc\nd\n"), (112, "c\nd\na\nb"), (113, "x\nx\nx\nx"), (114, "b"), (115, "")]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hashed", [xxhash.xxh3_64_intdigest, lambda x: xxhash.xxh3_64_intdigest(x) >> 60])
def test_every_repeated_run_goes_whole(spark, seed, hashed):
    docs = run_docs(seed)
    got = {r.doc_id: (r.text, r.n) for r in Ld.dedup_runs(spark.createDataFrame(docs, DOCS).repartition(3), into="n", hashed=hashed).collect()}
    assert got == brute.without_runs(docs)


def test_op2_removes_short_lined_passages_and_copies(spark, tmp_path):
    passage = "\n".join(f"passage line {i} of seven words here" for i in range(9))
    docs = [(i, f"start {i}\n{passage}\nend {i}") for i in range(20)] + [(20 + i, f"start {i}\n{passage}\nend {i}") for i in range(20)] + [(50, "passage line 3 of seven words here")]
    spark.createDataFrame(docs + [(60, None)], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.text, r.n_removed) for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert got[0] == (docs[0][1], 0) and got[50] == (docs[40][1], 0) and got[60] == ("", 0)
    assert all(got[i] == (f"start {i}\nend {i}", 9) and got[20 + i] == ("", 11) for i in range(1, 20)) and got[20] == ("", 11)


def test_copies_go_with_their_blank_lines(spark):
    texts = ["one of these\n\n\n\n\nand two\n \n\nthree\n\n\n", "\n\n\nfour words of text\nfive\n\n", "\n\n\n", "six\n\n\n\n"]
    docs = [(i, t) for i, t in enumerate(texts * 2)]
    got = {r.doc_id: (r.text, r.n) for r in Ld.dedup_runs(spark.createDataFrame(docs, DOCS), into="n").collect()}
    assert got == {i: (t, 0) for i, t in enumerate(texts)} | {4 + i: ("", t.count("\n") + 1) for i, t in enumerate(texts)} | {6: (texts[2], 0)}


def test_pipeline_drops_exact_copies_of_several_lines(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(5)
    text = lambda: "\n".join(" ".join(f"{rnd.choice(['stone', 'river', 'light'])}{rnd.randint(0, 999)}" for _ in range(rnd.choice([3, 9, 20]))) for _ in range(20))
    docs = [(i, text()) for i in range(12)]
    docs += [(100 + i, t) for i, t in docs[:8]]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "nothing of the texts")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(12))


def test_units_inside_copied_chunks_are_not_looked_up(spark, monkeypatch):
    """The chunks of the rolling hash find a copied text; line by line only what crosses their boundaries is looked up."""
    text = [f"line {i} of seven words in all" for i in range(40)]
    seen, plain = [], Ld._later_places
    monkeypatch.setattr(Ld, "_later_places", lambda rows: (seen.append({(r.id, r.first, r.last) for r in rows.collect()}), plain(rows))[1])
    docs = spark.createDataFrame([(0, "\n".join(text)), (1, "\n".join(text[:20] + ["inserted"] + text[20:]))], DOCS)
    got = {r.doc_id: r.n for r in Ld.dedup_runs(docs, into="n").collect()}
    assert got == {0: 0, 1: 40}
    chunks, grown = seen
    ends = [(a, b) for a, b, _, _ in Ld.chunks("\n".join(text)) if b - a > 1]
    assert {(a, b) for i, a, b in chunks if i == 0} >= {(a, b) for a, b in ends if not a <= 20 <= b}
    copied = {(a, b) for i, a, b in chunks if i == 1}
    assert copied and not any(a <= x and y <= b for a, b in copied for i, x, y in grown if i == 1)
    assert {x for i, x, _ in grown if i == 0} == set(range(39)) - {19}  # the owner's pairs stay, as later texts may share them alone


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_chunks_with_blank_lines_equal_the_sql(spark, tmp_path, seed):
    import duckdb

    rnd = random.Random(seed)
    lines = ["", " ", "", "a", "b c", "d", "e f g", " ".join("w" * i for i in range(1, 53))]
    docs = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randint(0, 14)))) for i in range(60)]
    docs += [(100 + i, f"{rnd.choice(lines)}\n{docs[i][1]}\n{rnd.choice(lines)}") for i in range(0, 60, 3)] + [(200, None)]
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, text, n_removed FROM ({queries.ORACLE['op2_line_dedup']})").fetchall()}
    got = {r.doc_id: (r.text, r.n_removed) for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert got == want and sum(n for _, n in got.values()) > 50
