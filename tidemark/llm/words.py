"""Word classes and small helpers that the operators share."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

#: A-Z to a-z, other ASCII bytes than digits and letters to a space; bytes of longer code points stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded_words(data: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text after lower-casing A-Z."""
    return (data or b"").translate(_FOLD).split()


def spaced_words(data: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text after lower-casing A-Z."""
    return (data or b"").translate(_LOWER).split()


#: Bits of a hash filter: 8 MB, whatever the input. A larger table only lets more through.
FILTER_BITS = 26


def hash_filter(hashes: DataFrame):
    """A function telling which values of an int64 array may be in the column ``hash``; it never says no to one that is.

    The bitmap has a fixed size and is built by the executors. What passes is checked by the caller's join.
    """
    bit = F.shiftrightunsigned("hash", 64 - FILTER_BITS) + 1  # bitmaps begin with 1
    maps = (hashes.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect())  # 2**FILTER_BITS bits at most
    table = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in maps:
        at = (r["bucket"] - 1) * 4096
        table[at:at + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    sent = hashes.sparkSession.sparkContext.broadcast(table)

    def keep(values: np.ndarray) -> np.ndarray:
        place = values.view(np.uint64) >> np.uint64(64 - FILTER_BITS)
        return (sent.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1

    return keep


def rows_of(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be in the column ``key`` of ``keys``, before a join shuffles them. NULL is a key."""
    keep = hash_filter(keys.select(F.xxhash64(F.col(key)).alias("hash")))
    src = df.withColumn(fresh(df, "_hash"), F.xxhash64(F.col(key)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(keep(batch.column(batch.num_columns - 1).to_numpy())))
            if part.num_rows:
                yield pa.RecordBatch.from_arrays(part.columns[:-1], part.schema.names[:-1])

    return src.mapInArrow(run, df.schema)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def add_struct(df: DataFrame, text: str, into: str, kind: T.StructType, each, keep: list[str] | None = None,
               per_task: bool = False) -> DataFrame:
    """``df`` with a struct column ``into``; ``each(list of UTF-8 texts or None)`` gives a dict for every text.

    ``keep`` lists the columns to return (default: all). Rows pass through in Arrow batches, and these
    are worked off in slices, so what ``each`` holds is small. With ``per_task``, ``each()`` makes that function
    once in every task, and what it holds goes with the task.
    """
    names, at = list(df.columns) if keep is None else keep, len(df.columns) if keep is None else len(keep)
    src = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias(fresh(df, "_text")))
    schema = T.StructType([*src.schema.fields[:at], T.StructField(into, kind)])
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = each() if per_task else each
        for batch in batches:
            found = [x for part in slices(batch.column(at)) for x in one(part)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(found, arrow)], [*names, into])

    return src.mapInArrow(run, schema)


#: UTF-8 bytes of a slice of texts; a longer text is a slice of its own.
SLICE_BYTES = 1 << 21


def slices(column: pa.Array, rows: int = 256) -> Iterator[list[bytes | None]]:
    """The texts of a column as UTF-8 bytes, some at a time: at most ``rows`` texts and ``SLICE_BYTES``, but one text at least."""
    raw = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    ends = np.cumsum(pc.fill_null(pc.binary_length(column.cast(raw)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(column):
        before = ends[i - 1] if i else 0
        j = max(i + 1, min(i + rows, int(np.searchsorted(ends, before + SLICE_BYTES, side="right"))))
        yield column.slice(i, j - i).cast(raw).to_pylist()
        i = j


def word_counts(docs: DataFrame, text: str, words: Callable[[bytes | None], list[bytes]], least: int = 1, held: int = 200_000) -> DataFrame:
    """(word, n) of the texts' words. A task adds up what it holds, ``held`` words or so, and leaves out words below ``least`` then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def report() -> Iterator[pa.RecordBatch]:
            own = seen if least < 2 else {w: n for w, n in seen.items() if n >= least}
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.binary()), pa.array(own.values(), pa.int64())], ["word", "n"])
            seen.clear()

        for batch in batches:
            for part in slices(batch.column(0)):
                for data in part:
                    seen.update(words(data))
                if len(seen) > held:
                    yield from report()
        yield from report()

    return docs.select(F.col(f"`{text}`")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_counts(counts: DataFrame, words: int, longest: int) -> dict[bytes, int]:
    """The most frequent of the words (word, n) with at most ``longest`` bytes: as many steps of counts as ``words`` words have room for.

    ``counts`` is read twice, so it should be a written table. The driver sees some hundred step sizes, then the head alone.
    """
    short = counts.where(F.length("word") <= longest).withColumn("step", F.floor(4 * F.log2("n")))
    least = None
    for r in sorted(short.groupBy("step").agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True):
        words -= r["k"]
        if words < 0:
            break
        least = r["step"]
    if least is None:
        return {}
    head = short.where(F.col("step") >= least).toArrow()
    return dict(zip(head.column("word").to_pylist(), head.column("n").to_pylist()))
