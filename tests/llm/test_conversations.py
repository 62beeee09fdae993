from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations as C, queries

ROWS = "conv_id long, turn long, role string, text string"
KEEPS = re.compile("(s?(ua)+)?")


def faults(rows):
    """(role, text, fault) of the rows of one conversation in order."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows),
                  key=lambda v: (v[0] is not None, v[0] or 0, hashlib.md5(f"{len(v[1])}:{v[1]}{v[2]}".encode()).hexdigest()))
    out, seen = [], set()
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        out.append((role, text, "b" if not body.strip(" \t\n\x0b\f\r") else "d" if (role, text) in seen else "" if body[-1] in ".!?" else "t"))
        seen.add((role, text))
    return out


def repaired(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) by the best suffix for every row and string of roles so far."""
    found = faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    kinds = [f for _, _, f in found]
    illegal = sum((a[:1] + b[:1]) not in ("su", "ua", "au") for (a, _, _), (b, _, _) in zip(found, found[1:]))

    @lru_cache(None)
    def best(i, state, inserted):  # state: last two role initials are enough to tell how the expression may go on
        options = []
        if i == len(found):
            if state in ("", "a"):
                options.append((0, "", ()))
        else:
            role, text, f = found[i]
            c, e, out = best(i + 1, state, 0)
            options.append((c + 4, "D" + e, out))
            if f not in ("b", "d"):
                more = 3 if f == "t" else 0
                for to in ("user", "assistant"):
                    if legal(state, to[0]):
                        c, e, out = best(i + 1, to[0], 0)
                        options.append((c + 3 + more, "R" + e, ((to, text), *out)))
                if legal(state, role[:1]):
                    c, e, out = best(i + 1, role[:1], 0)
                    options.append((c + more, "K" + e, ((role, text), *out)))
        if inserted < 3:
            for to in ("user", "assistant"):
                if legal(state, to[0]):
                    c, e, out = best(i, to[0], inserted + 1)
                    options.append((c + 3, "I" + e, ((to, ""), *out)))
        return min(options, key=lambda o: o[:2])if options else (10**9, "", ())

    def legal(state, role):
        return role == "s" and state == "" or role == "u" and state in ("", "s", "a") or role == "a" and state == "u"

    cost, audit, out = best(0, "", 0)
    assert KEEPS.fullmatch("".join(r[:1] for r, _ in out))
    sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, audit, sha), out


def random_rows(rnd, conv, n):
    texts = ["One.", "Two!", "three", "Four? ", " ", "", "\x0b", "five\x1c", None, "Six. \n"]
    return [(conv, rnd.choice([None, *range(2 * n)]) if rnd.random() < 0.3 else i, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "u", None]),
             rnd.choice(texts) if rnd.random() < 0.5 else f"Text {rnd.randint(0, 99)}{rnd.choice(['.', ''])}") for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    out = [r for c in range(60) for r in random_rows(rnd, c, rnd.randint(1, 9))] + random_rows(rnd, None, 5) + [(77, None, "user", None)]
    hot = random_rows(rnd, 500, 150) + [(500, 7, "user", "The same.")] * 80  # a third of all rows, with many equal ones
    out += hot
    rnd.shuffle(out)
    return out


def test_repair_equals_an_exhaustive_search(spark, rows):
    d = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit(1) for c in ("conv", "part", "key", "kind", "code", "n")}).repartition(4)
    got = {r[0]: tuple(r[1:]) for r in C.repair(d).collect()}
    by = {}
    for c, *rest in rows:
        by.setdefault(c, []).append(tuple(rest))
    assert got == {c: repaired(v)[0] for c, v in by.items()}
    lines = {}
    for r in sorted(C.repaired_rows(d).collect(), key=lambda r: r.place):
        lines.setdefault(r.conv_id, []).append((r.role, r.text))
    assert lines == {c: out for c, v in by.items() if (out := list(repaired(v)[1]))}


def test_a_long_conversation_is_cut_into_segments(spark, rows):
    n = C.segments(C._narrow(spark.createDataFrame(rows, ROWS), "conv_id", "turn", "role", "text")).where("conv = 500").count()
    assert n > 2


@pytest.mark.parametrize("seed", range(5))
def test_walk_and_carried_costs_agree_for_any_cut(seed):
    rnd = random.Random(seed)
    codes = bytes(rnd.randrange(12) for _ in range(200))
    whole = C.walk(codes, C.END, C.NOTHING, True)[0]
    cut = rnd.randrange(1, 199)
    after = C.carried(codes[cut:], C.END)
    first, state = C.walk(codes[:cut], after, C.NOTHING, False)
    assert first + C.walk(codes[cut:], C.END, state, True)[0] == whole
    assert C.carried(codes, C.END) == C.carried(codes[:cut], after)


def test_query_damages_and_keeps_every_id(spark, tmp_path):
    rnd = random.Random(9)
    rows = [r for c in range(80) for r in random_rows(rnd, c, rnd.randint(1, 6))] + random_rows(rnd, None, 3)
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    by = {c: [] for c, *_ in rows}
    for c, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text, role = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text, "user" if kind == 4 else role
        by[c] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    got = queries.op12_conversation_repair(spark, str(tmp_path)).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == {c: repaired(v)[0] for c, v in by.items()} and len(got) == len(by)


def test_empty_table_and_a_long_text(spark):
    none = spark.createDataFrame([], ROWS)
    assert C.repair(none).count() == 0 and C.repaired_rows(none).count() == 0
    got = C.repair(spark.createDataFrame([(1, 1, "user", "x" * 3_000_000 + "."), (1, 2, "assistant", "y.")], ROWS)).collect()[0]
    assert (got.cost, got.audit) == (0, "KK")
