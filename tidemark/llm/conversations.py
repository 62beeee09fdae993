"""Conversation repair: the cheapest edits that leave well-formed roles, by a square-root checkpointed dynamic program.

A conversation's rows are cut into segments (the ranges of one global sort), so a conversation of any length is worked off by many tasks.
A row is one code: the class of its role and its fault. Backward over the codes go vectors with the least cost from each of four
states (nothing yet, after a system row, after a user row, after an assistant row). A segment tells how it carries such a vector from its
end to its begin; going backward over the segments gives the vector at every segment's end. Inside a segment, vectors are
stored at checkpoints, a square root of its rows apart, and the blocks between are computed again while the walk goes forward and takes the
least of the tight edits in ASCII order. Only the last step, a hash of the whole repaired conversation, reads a conversation in one
task, as a stream in order, because the hash is defined in sequence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.words import fresh
from tidemark.operators.ordering import join_on
from tidemark.session import shuffle_width, write_through

SPACE = " \t\n\x0b\f\r"
#: Costs of the edits; a truncated row that stays costs TRUNCATED more.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Classes of role initials; states are the class of the row before, and NOTHING.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
NOTHING = 3
SOUND, CUT, MUST_GO = range(3)
FAR = 1 << 40
#: Costs after the last row, by state: an unfinished conversation is completed by insertions.
END = (2 * INSERT, INSERT, 0, 0)


def _next(state: int) -> int:
    return ASSISTANT if state == USER else USER


def _kept(role: int, state: int) -> bool:
    return role == SYSTEM and state == NOTHING or role in (USER, ASSISTANT) and role == _next(state)


@lru_cache(8192)
def _before(code: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """Costs before a row from those after it, less their least, and that least. Differences are small, so the calls repeat."""
    role, fault = divmod(code, 3)
    more, out = TRUNCATED * (fault == CUT), []
    for state in range(4):
        best = DELETE + after[state]
        if fault != MUST_GO:
            best = min(best, REROLE + more + after[_next(state)])
            if _kept(role, state):
                best = min(best, more + after[role])
        out.append(best)
    out[USER], out[ASSISTANT] = min(out[USER], INSERT + out[ASSISTANT]), min(out[ASSISTANT], INSERT + out[USER])
    for state in (SYSTEM, NOTHING):
        out[state] = min(out[state], INSERT + out[USER])
    least = min(out)
    return tuple(min(FAR, c - least) if c < FAR else FAR for c in out), least


@lru_cache(32768)
def _edits(code: int, after: tuple[int, ...], state: int) -> tuple[str, int]:
    """The ASCII-least tight edits up to and with one row, and the state after it."""
    costs, least = _before(code, after)
    role, fault = divmod(code, 3)
    more, made = TRUNCATED * (fault == CUT), ""
    while True:
        here = costs[state] + least
        if DELETE + after[state] == here:
            return made + "D", state
        if INSERT + costs[_next(state)] + least == here:
            made, state = made + "I", _next(state)
        elif _kept(role, state) and more + after[role] == here:
            return made + "K", role
        else:
            return made + "R", _next(state)


def carried(codes: bytes, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before the rows from the costs after them."""
    total = 0
    for code in reversed(codes):
        after, least = _before(code, after)
        total += least
    return tuple(min(FAR, c + total) for c in after)


def walk(codes: bytes, after: tuple[int, ...], state: int, last: bool) -> tuple[str, int]:
    """Edits of a segment that is entered in ``state``, and the state it is left in. Vectors are kept at checkpoints only."""
    step = isqrt(len(codes)) + 1
    vector, checkpoints = tuple(c - min(after) for c in after), {}
    for at in range(len(codes), 0, -1):
        if at % step == 0 or at == len(codes):
            checkpoints[at] = vector
        vector, _ = _before(codes[at - 1], vector)
    made: list[str] = []
    for first in range(0, len(codes), step):
        end = min(first + step, len(codes))
        block = [checkpoints[end]]
        for at in range(end - 1, first, -1):
            block.append(_before(codes[at], block[-1])[0])
        for at in range(first, end):
            edits, state = _edits(codes[at], block[end - 1 - at], state)
            made.append(edits)
    while last and after[state]:
        made.append("I")
        state = _next(state)
    return "".join(made), state


def _grouped(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Runs of rows that agree in their first ``width`` columns; rows are read as they are asked for."""
    rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns]))
    row = next(rows, None)
    while row is not None:
        head = row[:width]

        def run():
            nonlocal row
            while row is not None and row[:width] == head:
                yield row
                row = next(rows, None)

        one = run()
        yield head, one
        for _ in one:  # what the caller has left
            pass


def _batches(rows: Iterator[tuple], schema: T.StructType, size: int = 2000) -> Iterator[pa.RecordBatch]:
    kinds, held = [to_arrow_type(f.dataType) for f in schema.fields], []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], schema.names)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield made()
            held = []
    if held:
        yield made()


def _mapped(df: DataFrame, fields: str, rows) -> DataFrame:
    """mapInArrow with a generator of tuples; ``conv`` keeps its type."""
    schema = T.StructType([df.schema["conv"], *T._parse_datatype_string(fields).fields])
    return df.mapInArrow(lambda batches: _batches(rows(batches), schema), schema)


def _narrow(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, key, role, text): the five things a row is; ``key`` orders the rows of one turn and names equal rows."""
    one = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    d = rows.select(F.col(f"`{conv_id}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), one(role).alias("role"), one(text).alias("text"))
    return d.withColumn("key", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))


def segments(d: DataFrame) -> DataFrame:
    """One row for every conversation and range of the global sort: row codes, turns and counts; ``d`` as from ``_narrow``."""
    blank, first = F.btrim("text", F.lit(SPACE)) == "", F.substring("role", 1, 1)
    kind = F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(OTHER)
    ended = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1).isin(".", "!", "?")
    d = d.select("conv", "turn", "key", kind.alias("kind"), blank.alias("blank"), ended.alias("ended"))
    # equal rows are told apart by a number, so that many of them are no single range
    ranged = (d.withColumn("n", F.monotonically_increasing_id()).repartitionByRange(shuffle_width(d.sparkSession), "conv", "turn", "key", "n")
              .sortWithinPartitions("conv", "turn", "key").drop("n"))

    def numbered(batches):
        part, at = TaskContext.get().partitionId(), 0
        for (conv,), rows in _grouped(batches, 1):
            seen = set()
            for _, turn, key, *rest in rows:
                yield conv, part, at, turn, key, *rest, key in seen
                seen.add(key)
                at += 1

    n = write_through(_mapped(ranged, "part int, at long, turn long, key string, kind int, blank boolean, ended boolean, again boolean", numbered), "turns")
    first = n.where("not again").groupBy("conv", "key").agg(F.min("part").alias("owner"), F.max("part").alias("other")).where("owner < other").drop("other")
    own = join_on(n.where("not again"), first, ["conv"], ["key"], "left").withColumn("again", F.coalesce(F.col("part") > F.col("owner"), F.lit(False))).drop("owner")
    fault = F.when(F.col("blank") | F.col("again"), MUST_GO).when(F.col("ended"), SOUND).otherwise(CUT)
    rows = own.unionByName(n.where("again")).select("conv", "part", "at", "turn", "kind", "blank", (F.col("kind") * 3 + fault).alias("code"))
    rows = rows.repartition("conv", "part").sortWithinPartitions("conv", "part", "at")

    def summed(batches):
        for (conv, part), found in _grouped(batches, 2):
            codes, turns, n_turns, n_blank, illegal, before = bytearray(), [None, None], 0, 0, 0, None
            for _, _, _, turn, kind, blank, code in found:
                codes.append(code)
                n_blank += blank
                if before is not None:
                    illegal += not _legal(before, kind)
                before = kind
                if turn is not None and turn != turns[1]:
                    n_turns += 1
                    turns = [turn if turns[0] is None else turns[0], turn]
            codes = bytes(codes)
            faults = [c % 3 for c in codes]
            yield (conv, part, codes, *turns, n_turns, n_blank, faults.count(MUST_GO) - n_blank, faults.count(CUT), illegal,
                   [c for f in range(4) for c in carried(codes, tuple(0 if f == g else FAR for g in range(4)))])

    return write_through(_mapped(rows, "part int, codes binary, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, "
                                       "illegal long, passage array<long>", summed), "segments")


def _legal(a: int, b: int) -> bool:
    return (a, b) in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))


def audits(segs: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost and audit."""

    def ends(batches):
        for (conv,), rows in _grouped(batches, 1):  # from the last segment to the first
            after, last = END, True
            for _, minus, passage in rows:
                yield conv, -minus, list(after), last
                last = False
                after = tuple(min(FAR, *(passage[4 * f + g] + after[f] for f in range(4))) for g in range(4))

    order = segs.select("conv", (-F.col("part")).alias("minus"), "passage").repartition("conv").sortWithinPartitions("conv", "minus")
    known = _mapped(order, "part int, after array<long>, last boolean", ends)
    whole = join_on(segs.drop("passage"), known, ["conv"], ["part"])
    lowest = segs.groupBy("conv").agg(F.min("part").alias("lowest"))
    whole = join_on(whole, lowest, ["conv"]).select("conv", "part", "codes", "after", "last", (F.col("part") == F.col("lowest")).alias("opens"),
                                                    "first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal")

    def walked(batches):
        for conv, part, codes, after, last, opens, *counts in (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns])):
            ways = [walk(codes, tuple(after), s, last) if s == NOTHING or not opens else ("", s) for s in range(4)]
            yield conv, part, [w for w, _ in ways], [s for _, s in ways], carried(codes, tuple(after))[NOTHING], codes[0] // 3, codes[-1] // 3, *counts

    fields = "first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long"
    ways = _mapped(whole, f"part int, ways array<string>, left array<int>, cost long, first_kind int, last_kind int, {fields}", walked)

    def joined(batches):
        for (conv,), rows in _grouped(batches, 1):
            made, state, cost, kind, turns, sums = [], NOTHING, None, None, [None, None, 0], [0] * 4
            for _, _, edits, left, total, first_kind, last_kind, first, last, n, *counts in rows:
                made.append(edits[state])
                state, cost = left[state], total if cost is None else cost
                sums = [a + b for a, b in zip(sums, counts)]
                if kind is not None:
                    sums[3] += not _legal(kind, first_kind)
                kind = last_kind
                if n:
                    turns = [first if turns[0] is None else turns[0], last, turns[2] + n - (turns[1] == first)]
            gaps = 0 if turns[0] is None else turns[1] - turns[0] + 1 - turns[2]
            yield conv, gaps, *sums, cost, "".join(made)

    return _mapped(ways.repartition("conv").sortWithinPartitions("conv", "part"),
                   "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string", joined)


def _edited(audit: str, rows: Iterator[tuple]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the rows that stay or are inserted, from rows (role, text) in order."""
    names, state = {USER: "user", ASSISTANT: "assistant"}, NOTHING
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = {"s": SYSTEM, "u": USER}.get(role[:1], ASSISTANT)
        else:
            state = _next(state)
            role = names[state]
        yield edit, role, text


def _streamed(d: DataFrame, found: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows of every conversation after the one with its counts and audit, in order, in one task."""
    counts = [c for c in found.columns if c != "conv"]
    heads = found.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("key"), F.lit("").alias("role"), F.lit("").alias("text"), *counts)
    rows = d.select("conv", F.lit(1).alias("kind"), "turn", "key", "role", "text", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in counts])
    return heads.unionByName(rows).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "key"), counts


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation that has rows: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows go by turn (NULL first), rows of one turn by the MD5 of their role and text. NULL roles and texts are one space; a NULL
    id is a conversation. Repeated rows are duplicates after their first. Roles are known by their initials s, u and a; an empty or other role
    is legal nowhere. Empty tables give no rows; other columns are not read.
    """
    return _finished(rows, conv_id, turn, role, text, True)


def repaired_rows(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations: id, place (from 0), edit (K, R or I), role and text. Cases are as in ``repair``."""
    return _finished(rows, conv_id, turn, role, text, False)


def _finished(rows: DataFrame, conv_id: str, turn: str, role: str, text: str, hashed: bool) -> DataFrame:
    d = _narrow(rows, conv_id, turn, role, text)
    found = audits(segments(d))
    stream, counts = _streamed(d, found)

    def run(batches):
        for (conv,), group in _grouped(batches, 1):
            head = next(group)
            sha, between = hashlib.sha256(), b""
            for place, (edit, name, body) in enumerate(_edited(head[-1], ((r[4], r[5]) for r in group))):
                if not hashed:
                    yield conv, place, edit, name, body
                    continue
                sha.update(between + f"{name}:{body}".encode())
                between = b"\n"
            if hashed:
                yield conv, *head[6:], sha.hexdigest()

    kinds = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in counts)
    out = _mapped(stream, f"{kinds}, repaired_sha256 string" if hashed else "place long, edit string, role string, text string", run)
    return out.withColumnRenamed("conv", conv_id)


def damaged(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with one in five of them spoilt, by the CRC of their place: dropped, emptied, unpunctuated, repeated or given to the user.

    NULLs are one space. Columns with other names stay as they are.
    """
    one = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind, copy = fresh(rows, "_damage"), fresh(rows, "_copy")
    d = rows.withColumn(kind, F.pmod(F.crc32(F.concat_ws(":", one(conv_id), one(turn))), F.lit(20))).where(F.col(kind) != 0)
    d = d.withColumns({text: F.when(F.col(kind) == 1, "").when(F.col(kind) == 2, F.translate(one(text), ".!?", "")).otherwise(one(text)),
                       role: F.when(F.col(kind) == 4, "user").otherwise(one(role))})
    return d.withColumn(copy, F.explode(F.when(F.col(kind) == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop(kind, copy)
