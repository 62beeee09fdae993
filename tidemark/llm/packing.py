"""Token sequences packed by bin completion: branch and bound over undominated fillings."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.words import slices
from tidemark.session import write_through

#: Tokens of a sequence, the id that ends a document, and bytes of a Python worker's word cache (an entry takes about ENTRY_BYTES besides its texts).
CAPACITY, END_ID, CACHE_BYTES, ENTRY_BYTES = 4096, 1, 48 << 20, 170

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Letters that the vocabulary's normal form only lower-cases: ASCII and Latin-1, without the micro sign and ordinals.
_PLAIN = re.compile("([a-zß-öø-ÿ]+)([!-&*-/:-@|]*)")


class WordEncoder(dict):
    """Token ids (little-endian unsigned 32-bit integers) of words, learnt when a word is first seen.

    The vocabulary's rules drop white space and never join across it, so the ids of a text are those of
    its words, one after the other. Words are cut at ASCII white space only, a part of what the rules
    drop. A word of plain letters, with punctuation after them, goes to the vocabulary's merges
    lower-cased and in its byte alphabet; any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.merge = self.whole.model.tokenize
        alphabet = sorted(pre_tokenizers.ByteLevel.alphabet())
        own = {ord(c) for c in alphabet if ord(c) < 256}  # these bytes stand for themselves, the others for the rest in order
        self.alphabet = dict(zip([b for b in range(256) if b not in own], [c for c in alphabet if ord(c) >= 256]))
        self.runs: dict[str, bytes] = {}
        self.held = 0

    def _run(self, run: str) -> bytes:
        found = self.runs.get(run)
        if found is None:
            chars = run if run.isascii() else run.encode().decode("latin-1").translate(self.alphabet)
            found = self.runs[run] = _packed([t.id for t in self.merge(chars)])
            self.held += len(chars) + len(found) + ENTRY_BYTES
        return found

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        m = _PLAIN.fullmatch(text.lower())
        if m is None:
            ids = _packed(self.whole.encode(text, add_special_tokens=False).ids)
        else:
            ids = self._run(m[1]) + self._run(m[2]) if m[2] else self._run(m[1])
        self[word] = ids
        self.held += len(word) + len(ids) + ENTRY_BYTES
        return ids

    def forget(self) -> None:
        self.clear()
        self.runs.clear()
        self.held = 0

    def encode(self, text: bytes | None) -> bytes:
        if self.held > CACHE_BYTES:
            self.forget()
        return b"".join(map(self.__getitem__, (text or b"").split()))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One in each Python worker, as most words of a task were seen by the one before; it never holds more than ``CACHE_BYTES``."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document, which ends with the end id.

    NULL and empty texts are the end id alone. Repeated rows give repeated pieces.
    """
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows, done = [], 0
            for part in slices(batch.column(1)):
                for key, words in zip(ids[done:done + len(part)], part):
                    data = enc.encode(words) + end
                    n = len(data) // 4
                    rows.extend((key, p, s, min(capacity, n - s), zlib.crc32(data[4 * s:4 * (s + capacity)]))
                                for p, s in enumerate(range(0, n, capacity)))
                done += len(part)
            if not rows:
                continue
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return src.mapInArrow(run, PIECES)


def best_fit(lengths: Counter, capacity: int) -> list[list[int]]:
    """Best-fit decreasing; open bins are found by the smallest room that is enough."""
    open_bins: dict[int, list[list[int]]] = {}
    rooms, out = 0, []  # bit r of ``rooms``: some bin has room r
    for length in sorted(lengths, reverse=True):
        for _ in range(lengths[length]):
            fit = rooms >> length
            if fit:
                room = length + (fit & -fit).bit_length() - 1
                chosen = open_bins[room].pop()
                if not open_bins[room]:
                    rooms &= ~(1 << room)
            else:
                room, chosen = capacity, []
                out.append(chosen)
            chosen.append(length)
            room -= length
            if room:
                open_bins.setdefault(room, []).append(chosen)
                rooms |= 1 << room
    return out


def fillings(lengths: Counter, room: int, waste: int, width: int) -> list[tuple[int, ...]]:
    """Undominated ways to fill ``room``, least waste first; at most ``width`` are looked at.

    Only fillings that nothing can be added to and that waste at most ``waste`` are candidates.
    """
    have = sorted((x for x, n in lengths.items() if n and x <= room), reverse=True)
    smallest = have[-1] if have else room + 1
    found: list[tuple[int, ...]] = []
    steps = [0]

    def grow(first: int, left: int, chosen: tuple[int, ...]) -> None:
        steps[0] += 1
        if left < smallest or not any(x <= left and lengths[x] > chosen.count(x) for x in have[-3:] if x <= left):
            if left <= waste and not any(x <= left and lengths[x] > chosen.count(x) for x in have):
                found.append(chosen)
        for i in range(first, len(have)):
            if len(found) >= width or steps[0] > 8 * width:
                return
            x = have[i]
            if x <= left and lengths[x] > chosen.count(x):
                grow(i, left - x, (*chosen, x))

    grow(0, room, ())
    found.sort(key=lambda c: (-sum(c), len(c), tuple(-x for x in c)))
    kept: list[tuple[int, ...]] = []
    for c in found:
        if not any(_dominates(k, c) for k in kept):
            kept.append(c)
    return kept


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the items of ``b`` fit into the items of ``a`` (first fit, so some cases are not seen)."""
    rooms = list(a)
    for x in b:
        i = next((i for i, r in enumerate(rooms) if r >= x), None)
        if i is None:
            return False
        rooms[i] -= x
    return True


def complete_bins(lengths: Counter, capacity: int = CAPACITY, nodes: int = 2_000, width: int = 24) -> list[list[int]]:
    """Bins for the given lengths, as few as the search finds.

    Best fit gives the first incumbent. If it needs more bins than the sum bound, bins are completed one by
    one around the largest item left, least waste first; a branch ends when its waste shows that it cannot
    beat the incumbent, and at every node best fit over the rest is tried as a new incumbent.
    ``nodes`` and ``width`` bound the search, not what is packed.
    """
    total = sum(x * n for x, n in lengths.items())
    bound, best = -(-total // capacity), best_fit(lengths, capacity)
    if len(best) <= bound or not total:
        return best
    left, rest, done, waste = nodes, Counter(lengths), [], 0
    stack: list[Iterator] = []

    def options() -> Iterator[tuple[int, ...]]:
        top = max(x for x, n in rest.items() if n)
        allowed = (len(best) - 1) * capacity - total - waste
        rest[top] -= 1
        ways = fillings(rest, capacity - top, allowed, width) if allowed >= 0 else []
        rest[top] += 1
        return iter([(top, *w) for w in ways])

    stack.append(options())
    while stack and left > 0 and len(best) > bound:
        way = next(stack[-1], None)
        if way is None or waste > (len(best) - 1) * capacity - total:
            stack.pop()
            if done:
                last = done.pop()
                waste -= capacity - sum(last)
                for x in last:
                    rest[x] += 1
            continue
        left -= 1
        for x in way:
            rest[x] -= 1
            if not rest[x]:
                del rest[x]
        done.append(list(way))
        waste += capacity - sum(way)
        tail = best_fit(rest, capacity) if left % 64 == 0 or len(rest) < 256 else None
        if not rest or (tail is not None and len(done) + len(tail) < len(best)):
            best = [list(b) for b in done] + (tail or [])
        if rest:
            stack.append(options())
        else:
            last = done.pop()
            waste -= capacity - sum(last)
            for x in last:
                rest[x] += 1
    return best


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item."""
    order: dict[int, list[int]] = {}
    for i, x in enumerate(lengths.tolist()):
        order.setdefault(x, []).append(i)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, items in enumerate(complete_bins(Counter({x: len(i) for x, i in order.items()}), capacity)):
        at = 0
        for x in items:
            i = order[x].pop()
            bins[i], offsets[i] = b, at
            at += x
    return bins, offsets


def pack(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         group_pieces: int = 100_000) -> DataFrame:
    """Pieces of all documents with a sequence and a place in it.

    Pieces carry no ids, only their checksum. They are dealt to groups of about ``group_pieces`` by a hash of
    their row number, and every group is packed in one task; a group leaves at most about one sequence that
    could have been shared. Full pieces are sequences of their own. An empty table gives none.
    """
    rows = write_through(pieces(docs, vocabulary, doc_id, text, capacity).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-rows.count() // group_pieces))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def packed(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_row", ignore_index=True)
        bins, offsets = place(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=bins + (np.int64(key[0]) << 32), offset=offsets).drop(columns=["_row", "_group"])

    return (rows.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
            .groupBy("_group").applyInPandas(packed, out))
