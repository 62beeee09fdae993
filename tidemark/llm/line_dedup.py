"""Repeated passages of lines, removed after a comparison of their bytes.

Both operators cut texts into content-defined chunks. A rolling hash over the hashes of a line and the one before it chooses
the boundaries, so an insertion moves only the boundaries beside it. A long line is a chunk of its own.

``dedup_lines`` removes the chunks that stand earlier. ``dedup_runs`` removes every run of lines that stands earlier, whole: the
chunks first, then the runs grow line by line, over the pairs of neighbouring lines that no removed chunk holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.words import fresh, hash_filter, slices
from tidemark.session import write_through

#: Words that make a line a chunk of its own, the rolling window in lines, and lines per boundary on average.
LONG_LINE, WINDOW_LINES, EVERY = 50, 2, 2

def chunk_ranges(hashes: list[int], counts: list[int]) -> Iterator[tuple[int, int]]:
    """(first line, end line) of the chunks of a text, from the hashes and word counts of its lines."""
    start = 0
    for i, n in enumerate(counts):
        rolled = 0
        for j in range(max(0, i - WINDOW_LINES + 1), i + 1):
            rolled = (rolled * 0x9E3779B97F4A7C15 + hashes[j]) & 0xFFFFFFFFFFFFFFFF
        if i + 1 == len(counts) or n >= LONG_LINE or counts[i + 1] >= LONG_LINE or (rolled >> 32) % EVERY == 0:
            yield start, i + 1
            start = i + 1


def chunks(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(first line, end line, hash, words) of the chunks of a text. Hashes are of the chunk's bytes."""
    lines = text.split("\n")
    counts = [len(x.split()) for x in lines]
    for first, end in chunk_ranges([xxhash.xxh3_64_intdigest(x) for x in lines], counts):
        yield first, end, xxhash.xxh3_64_intdigest("\n".join(lines[first:end])), sum(counts[first:end])


def _counts(first: int, end: int, words: int) -> bool:
    """Whether a chunk may be removed: several lines with a word, or one long line."""
    return words > 0 and (end - first > 1 or words >= LONG_LINE)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def chunk_rows(docs: DataFrame, text: str, with_text: bool = False, keep=None) -> DataFrame:
    """Chunks that may be removed: their hash alone, or the columns of ``docs`` but the text, first, last, hash, chunk.

    ``keep(hashes)`` chooses among them.
    """
    own_columns = [c for c in docs.columns if c != text] if with_text else []
    src = docs.select(*own_columns, text)
    schema = T.StructType([*src.schema.fields[:-1], *T._parse_datatype_string(
        "first int, last int, hash long, chunk string" if with_text else "hash long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in slices(batch.column(batch.num_columns - 1)):
                rows, at = [], []
                for i, data in enumerate(part, done):
                    body = (data or b"").decode("utf-8", "replace")
                    own = [(a, b, _signed(h)) for a, b, h, n in chunks(body) if _counts(a, b, n)]
                    if keep is not None and own:
                        own = [r for r, ok in zip(own, keep(np.array([r[2] for r in own], np.int64))) if ok]
                    if with_text and own:
                        lines = body.split("\n")
                        own = [(*r, "\n".join(lines[r[0]:r[1]])) for r in own]
                    rows.extend(own)
                    at.extend([i] * len(own))
                done += len(part)
                if rows and with_text:
                    made = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.string()))]
                    yield pa.RecordBatch.from_arrays([*[c.take(pa.array(at)) for c in batch.columns[:-1]], *made], [*own_columns, "first", "last", "hash", "chunk"])
                elif rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows], pa.int64())], ["hash"])

    return src.mapInArrow(run, schema)


def repeated_chunks(docs: DataFrame, text: str) -> DataFrame:
    """(id, body, first, last): line ranges whose bytes stand earlier in the table too, by (id, body, line); NULL ids last.

    ``docs``: id, body (a hash of the text) and the text. Three steps: hashes of all chunks; the texts of the
    chunks whose hash repeats, grouped by their bytes; the places after the first of each. Equal
    chunks of one partition are combined before the shuffle.
    """
    repeated = chunk_rows(docs, text).groupBy("hash").count().where("count > 1").select("hash")
    keep = hash_filter(repeated)
    rows = write_through(chunk_rows(docs, text, True, keep), "chunks")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "body", "first")
    owner = rows.groupBy("hash", "chunk").agg(F.min(place).alias("owner"), F.max(place).alias("other")).where("owner <> other").drop("other")
    return rows.join(owner, ["hash", "chunk"]).where(place != F.col("owner")).select("id", "body", "first", "last")


def _cores(hashes: list[int], counts: list[int]) -> Iterator[tuple[int, int]]:
    """(first line, end line) of the chunks that may be removed, without blank lines at their ends but the one beside a word:
    what is left is the union of the units inside it, wherever the chunk stands."""
    for first, end in chunk_ranges(hashes, counts):
        words = [i for i in range(first, end) if counts[i]]
        if words:
            first, end = max(first, words[0] - 1), min(end, words[-1] + 2)
            if _counts(first, end, sum(counts[first:end])):
                yield first, end


def units(lines: list[str], hashed: Callable[[str], int]) -> Iterator[tuple[int, int, int, int, int, int | None]]:
    """(first line, end line, hash, hash of the first line, hash of the lines after it or 0, chunk): content-defined chunks (chunk is None), and
    what runs grow over: pairs of neighbouring lines with a word, and stretches of blank lines with the lines with words around them, as
    pairs leave out the middle of those; ``chunk`` is the first line of the chunk that holds them whole, or -1."""
    counts, hashes = [len(x.split()) for x in lines], [hashed(x) for x in lines]
    own = [(-1, -1)] * len(lines)  # the chunk that holds a line

    def unit(first: int, last: int, b: int, chunk: int | None) -> tuple[int, int, int, int, int, int | None]:
        mixed = hashes[first] * 0x9E3779B97F4A7C15 + b + last - first + (chunk is None) * 0xD6E8FEB86659FD93
        return first, last, _signed(mixed & 0xFFFFFFFFFFFFFFFF), _signed(hashes[first]), _signed(b), chunk

    for first, end in _cores(hashes, counts):
        own[first:end] = [(first, end)] * (end - first)
        yield unit(first, end, 0 if end - first == 1 else hashes[first + 1] if end - first == 2 else hashed("\n".join(lines[first + 1:end])), None)

    def grown(first: int, last: int, b: int) -> tuple[int, int, int, int, int, int | None]:
        return unit(first, last, b, own[first][0] if last <= own[first][1] else -1)

    word = -1  # the last line with a word
    for i, n in enumerate(counts):
        if i + 1 < len(counts) and n + counts[i + 1]:
            yield grown(i, i + 2, hashes[i + 1])
        if n or i + 1 == len(counts) and word >= 0:
            if i - max(word, 0) > 1 + (n > 0 and word >= 0):
                yield grown(max(word, 0), i + 1, hashed("\n".join(lines[max(word, 0) + 1:i + 1])))
            word = i


def unit_rows(docs: DataFrame, text: str, keep=None, ranks: dict[str, int] | None = None, hashed: Callable[[str], int] = xxhash.xxh3_64_intdigest) -> DataFrame:
    """Without ``keep``: the hash of every unit. With it, two kinds of rows for the units that it chooses: the columns of ``docs`` but the
    text, first, last, chunk, the hashes of the lines and their ``ranks`` (0 if they have none); and, with ``line``, hash and text of those lines."""
    own_columns = [c for c in docs.columns if c != text] if keep else []
    src, ranks = docs.select(*own_columns, text), ranks or {}
    schema = T.StructType([*src.schema.fields[:-1], *T._parse_datatype_string("first int, last int, chunk int, a long, b long, c long, line string" if keep else "hash long").fields])
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in slices(batch.column(batch.num_columns - 1)):
                rows, at, texts = [], [], {}
                for i, data in enumerate(part, done):
                    lines = (data or b"").decode("utf-8", "replace").split("\n")
                    own = list(units(lines, hashed))
                    if keep is not None and own:
                        own = [r for r, ok in zip(own, keep(np.array([r[2] for r in own], np.int64))) if ok]
                    for first, last, _, a, b, chunk in own if keep is not None else ():
                        rest = "\n".join(lines[first + 1:last])
                        texts[lines[first]] = a
                        if last - first > 1:
                            texts[rest] = b
                        rows.append((first, last, chunk, a, b, ranks.get(lines[first], 0) << 32 | ranks.get(rest, 0) if ranks else 0, None))
                    if keep is None:
                        rows.extend(r[2] for r in own)
                    at.extend([i] * len(own))
                done += len(part)
                if rows and keep is None:
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64())], ["hash"])
                elif rows:
                    made = rows + [(None, None, None, a, None, None, x) for x, a in texts.items()]
                    places = pa.array(at + at[-1:] * len(texts))
                    yield pa.RecordBatch.from_arrays([*[c.take(places) for c in batch.columns[:-1]], *[pa.array(c, k) for c, k in zip(zip(*made), kinds)]],
                                                     [*own_columns, "first", "last", "chunk", "a", "b", "c", "line"])

    return src.mapInArrow(run, schema)


def repeated_runs(docs: DataFrame, text: str, hashed: Callable[[str], int] = xxhash.xxh3_64_intdigest) -> DataFrame:
    """(id, body, first, last): line ranges, overlapping ones as well, whose bytes stand earlier in the table too, by (id, body, line); NULL ids last.

    ``docs``: id, body (a hash of the text) and the text. Hashes of all units tell which may repeat. The texts of their lines are
    compared once for each slice of rows that holds them: lines with equal hashes have equal bytes, or else ranks that tell them apart.
    A chunk that stands earlier is one range, and nothing inside it is looked up: what it holds stands in its owner, as early or earlier.
    """
    repeated = unit_rows(docs, text, hashed=hashed).groupBy("hash").count().where("count > 1").select("hash")
    keep = hash_filter(repeated)
    rows = write_through(unit_rows(docs, text, keep, hashed=hashed), "units")
    lines = rows.where("line is not null").select("a", "line")
    clash = lines.groupBy("a").agg(F.min("line").alias("x"), F.max("line").alias("y")).where("x <> y").select("a")
    texts = [r["line"] for r in lines.join(clash, "a").select("line").distinct().orderBy("line").collect()]  # 64-bit clashes: as good as none
    if texts:
        rows = write_through(unit_rows(docs, text, keep, {x: i for i, x in enumerate(texts, 1)}, hashed), "units")
    rows = rows.where("line is null")
    rows = rows.withColumn("width", F.col("last") - F.col("first"))
    copies = write_through(_later_places(rows.where("chunk is null")), "chunk-copies")
    return copies.unionByName(_later_places(outside_copies(rows.where("chunk is not null"), copies)))


def _later_places(rows: DataFrame) -> DataFrame:
    """(id, body, first, last) of the units that stand earlier too."""
    place, key = F.struct(F.col("id").isNull().alias("none"), "id", "body", "first"), ["a", "b", "c", "width"]
    owner = rows.groupBy(*key).agg(F.min(place).alias("owner"), F.max(place).alias("other")).where("owner <> other").drop("other")
    return rows.join(owner, key).where(place != F.col("owner")).select("id", "body", "first", "last")


def outside_copies(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """The units that no copied chunk holds whole."""
    c = copies.select(F.col("id").alias("_id"), F.col("body").alias("_body"), F.col("first").alias("_chunk"))
    return rows.join(c, F.col("id").eqNullSafe(F.col("_id")) & (F.col("body") == F.col("_body")) & (F.col("chunk") == F.col("_chunk")), "left_anti")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", into: str | None = None) -> DataFrame:
    """``docs`` without the line chunks that repeat: the first occurrence stays, by id (NULL last) and line.

    A chunk counts if it has several lines with a word among them, or one line of ``LONG_LINE`` words or more.
    With ``into``, the number of removed lines is added under that name. Texts of only removed lines become
    empty; NULL and empty texts stay as they are. Rows that agree in id and text count as one
    row and get the same result; rows that share only the id are told apart by their texts.
    """
    return _without(docs, doc_id, text, into, repeated_chunks)


def dedup_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", into: str | None = None,
               hashed: Callable[[str], int] = xxhash.xxh3_64_intdigest) -> DataFrame:
    """``docs`` without the runs of lines that stand earlier, by id (NULL last) and line: every run of several lines
    with a word in each two neighbours, and every line of ``LONG_LINE`` words or more. Of each removed line an equal one stays.

    Columns and rows are as in ``dedup_lines``; a text whose lines all repeat as one run becomes empty.
    """
    return _without(docs, doc_id, text, into, lambda d, t: repeated_runs(d, t, hashed))


def _without(docs: DataFrame, doc_id: str, text: str, into: str | None, repeated: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    body, key, gone = fresh(docs, "_body"), fresh(docs, "_key"), fresh(docs, "_gone")
    d = docs.withColumns({key: F.col(f"`{doc_id}`"), body: F.xxhash64(F.col(f"`{text}`"))})
    cuts = (repeated(d.select(F.col(key).alias("id"), F.col(body).alias("body"), F.col(f"`{text}`").alias("text")), "text").distinct()
            .groupBy("id", "body").agg(F.collect_list(F.struct("first", "last")).alias(gone)))  # no more than the text has lines
    joined = d.join(cuts, F.col(key).eqNullSafe(cuts["id"]) & (F.col(body) == cuts["body"]), "left").drop(cuts["id"], cuts["body"])
    lines = fresh(joined, "_lines")
    joined = joined.withColumn(lines, F.when(F.col(gone).isNotNull(), F.split(F.col(f"`{text}`"), "\n", -1)))
    cut = F.flatten(F.transform(gone, lambda g: F.sequence(g["first"], g["last"] - 1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), cut)
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n")
    out = joined.withColumn(text, F.when(F.col(gone).isNull(), F.col(f"`{text}`")).otherwise(kept)).drop(lines)
    if into:
        out = out.withColumn(into, F.when(F.col(gone).isNull(), F.lit(0).cast("long")).otherwise(F.size(F.array_distinct(cut)).cast("long")))
    return out.drop(body, key, gone)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``documents`` after line deduplication: texts cut, ``n_chars`` renewed, documents of only repeated lines gone."""
    left = fresh(docs, "_removed")
    out = dedup_runs(docs, into=left).where((F.col(left) == 0) | (F.trim("text") != ""))
    return out.withColumn("n_chars", F.when(F.col(left) == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).drop(left)
