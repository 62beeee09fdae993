"""Importance resampling toward a target: hashed word n-grams, counted and scored by an Aho-Corasick dictionary.

The dictionary holds frequent words between two delimiters, each with its CRC and its length as payload. A scan of a text
emits the payloads of its words; payloads of adjacent words are composed to the CRCs of their n-grams, whose
bytes are never built. Words outside the dictionary, found as gaps between two emissions, bring a payload that is
computed on the spot, so the dictionary's size decides about speed alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm.words import _FOLD, add_struct, folded_words, fresh, head_counts, slices, word_counts
from tidemark.operators.ordering import number_rows
from tidemark.session import write_through

#: Hash buckets, words that make a document eligible, and percent of the eligible documents that are drawn.
BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, "2024"
#: Words of the dictionary and bytes of the longest one: 4 MB of words at most, whatever the corpus.
DICTIONARY_WORDS, WORD_BYTES = 65_536, 64

FEATURES = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")])


def frequent_words(docs: DataFrame, text: str = "text", words: int | None = None, longest: int = WORD_BYTES) -> list[bytes]:
    """The most frequent words, at most ``words`` (default ``DICTIONARY_WORDS``). A task doesn't report words that it sees once."""
    counts = write_through(word_counts(docs, text, folded_words, 2), "words")
    return sorted(head_counts(counts, DICTIONARY_WORDS if words is None else words, longest))


class Shift:
    """CRCs of texts with more bytes behind them: tables for every number of bytes up to the dictionary's longest word."""

    def __init__(self, longest: int):
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, np.uint32(0xEDB88320) ^ (step >> np.uint32(1)), step >> np.uint32(1))
        self.step = step
        lane = np.arange(256, dtype=np.uint32)
        tables = [np.stack([lane << np.uint32(8 * k) for k in range(4)])]
        for _ in range(longest):
            tables.append(self._zero(tables[-1]))
        self.tables = np.stack(tables)

    def _zero(self, crc: np.ndarray) -> np.ndarray:
        return (crc >> np.uint32(8)) ^ self.step[crc & np.uint32(255)]

    def __call__(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        """``crc`` moved on by ``length`` zero bytes, each by its own."""
        out, longest = crc.astype(np.uint32), len(self.tables) - 1
        while True:
            n = np.minimum(length, longest)
            out = (self.tables[n, 0, out & np.uint32(255)] ^ self.tables[n, 1, (out >> np.uint32(8)) & np.uint32(255)]
                   ^ self.tables[n, 2, (out >> np.uint32(16)) & np.uint32(255)] ^ self.tables[n, 3, out >> np.uint32(24)])
            length = length - n
            if not length.any():
                return out


class Scanner:
    """Payloads of the words of many texts, and the buckets of their n-grams."""

    def __init__(self, words: list[bytes], orders: int = 1, buckets: int = BUCKETS):
        self.orders, self.buckets = orders, buckets
        self.crc = np.array([zlib.crc32(w) for w in words], np.uint32)
        self.length = np.array([len(w) for w in words], np.int64)
        self.shift = Shift(WORD_BYTES) if orders > 1 else None
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, w in enumerate(words):
            self.automaton.add_word(f" {w.decode('latin-1')} ", i)  # bytes as code points, so places are bytes
        if words:
            self.automaton.make_automaton()
        self.used = bool(words)

    def payloads(self, body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, CRC, length) of the words of a folded text that begins and ends with a space, by place."""
        found = self.automaton.iter(body.decode("latin-1")) if self.used else ()
        hits = np.fromiter(chain.from_iterable(found), np.int64).reshape(-1, 2)  # (place of the closing space, number of the word)
        letter = np.frombuffer(body, np.uint8) != 32
        start, end = np.flatnonzero(letter[1:] > letter[:-1]) + 1, np.flatnonzero(letter[1:] < letter[:-1]) + 1
        crc, known = np.zeros(len(start), np.uint32), np.searchsorted(end, hits[:, 0])
        crc[known] = self.crc[hits[:, 1]]
        gap = np.ones(len(start), bool)
        gap[known] = False
        crc[gap] = [zlib.crc32(body[a:b]) for a, b in zip(start[gap].tolist(), end[gap].tolist())]
        length = end - start
        length[known] = self.length[hits[:, 1]]
        return start, crc, length

    def features(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words of each text, number of the text, bucket) with one entry for every n-gram of 1 to ``orders`` words."""
        folded = [(t or b"").translate(_FOLD) for t in texts]
        ends = np.cumsum([len(t) + 1 for t in folded])
        start, crc, length = self.payloads(b" " + b" ".join(folded) + b" ")
        owner = np.searchsorted(ends, start, side="right").astype(np.int64)
        n_words = np.bincount(owner, minlength=len(texts))
        owners, found, gram = [owner], [crc % np.uint32(self.buckets)], crc
        for k in range(1, self.orders):
            gram = self.shift(gram[:-1], np.ones(len(gram) - 1, np.int64)) ^ np.uint32(zlib.crc32(b" ")) if len(gram) else gram
            gram = self.shift(gram, length[k:]) ^ crc[k:]
            same = owner[:-k] == owner[k:] if k < len(owner) else np.zeros(0, bool)
            owners.append(owner[:-k][same])
            found.append((gram % np.uint32(self.buckets))[same])
        return n_words, np.concatenate(owners), np.concatenate(found)


def bucket_counts(docs: DataFrame, words, orders: int = 1, buckets: int = BUCKETS, text: str = "text") -> np.ndarray:
    """Features of all texts by bucket; ``words`` is a broadcast list. Every task reports its sums, at most one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, total = Scanner(words.value, orders, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch.column(0)):
                total += np.bincount(scanner.features(part)[2], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select(F.col(f"`{text}`")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """Per bucket: floor(1000 ln) of the target's smoothed share over the source's."""
    b, s, t = len(source), float(source.sum()), float(target.sum())
    return [math.floor(1000 * math.log((float(y) + 1) * (s + b) / ((float(x) + 1) * (t + b)))) for x, y in zip(source, target)]


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weighted(docs: DataFrame, target: DataFrame, text: str = "text", into: str = "features", orders: int = 1, buckets: int = BUCKETS,
             keep: list[str] | None = None, dictionary: int | None = None) -> DataFrame:
    """``docs`` with a struct column: n_words, n_features and weight, the sum of the gains of a text's features.

    Words are folded (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, A-Z lower-cased). NULL, empty and wordless texts have no features
    and weight 0. Repeated rows count as often as they stand there and all stay; empty tables pass through. ``keep`` lists the
    columns to return; a caller's column named ``into`` is refused.
    """
    if keep is None and fresh(docs, into) != into:
        raise ValueError(f"docs has a column {into}")
    sent = docs.sparkSession.sparkContext.broadcast(frequent_words(docs, text, dictionary))
    gain = np.array(gains(bucket_counts(docs, sent, orders, buckets, text), bucket_counts(target, sent, orders, buckets)), np.int64)

    def each() -> Iterator:
        scanner = Scanner(sent.value, orders, buckets)

        def run(texts: list[bytes | None]) -> list[dict]:
            n_words, owner, bucket = scanner.features(texts)
            n = np.bincount(owner, minlength=len(texts))
            weight = np.zeros(len(texts), np.int64)
            np.add.at(weight, owner, gain[bucket])
            return [{"n_words": int(w), "n_features": int(f), "weight": int(g)} for w, f, g in zip(n_words, n, weight)]

        return run

    return add_struct(docs, text, into, FEATURES, each, keep, per_task=True)


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", orders: int = 1, buckets: int = BUCKETS,
             percent: int = PERCENT, least: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """One row per document: its id, n_features, weight, score and rank; rank is NULL for documents that are not drawn.

    Of the N documents with ``least`` words or more, floor(percent * N / 100) are drawn without replacement: those with the highest sum of
    weight and noise, ties to the smaller id (a NULL id has the noise of an empty text and comes first). Repeated rows are documents of their own.
    """
    scored = weighted(docs, target, text, "f", orders, buckets, keep=[doc_id])
    d = write_through(scored.select(F.col(f"`{doc_id}`").alias("doc_id"), "f.*").withColumn("score", F.col("weight") + noise(F.col("doc_id"))), "scores")
    able = F.col("n_words") >= least
    drawn = d.where(able).count() * percent // 100
    last = float(1 << 60)  # below every score
    ranked = number_rows(d, F.when(able, -F.col("score")).otherwise(F.lit(last)), "doc_id", "row_no")
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(able & (F.col("row_no") <= drawn), F.col("row_no")).alias("rank"))
