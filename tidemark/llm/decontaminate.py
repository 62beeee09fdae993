"""Benchmark passages in documents, found by Wu-Manber multi-pattern search."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.words import add_struct, folded_words, fresh
from tidemark.session import write_through

#: Words of a window, and the share of a document's words that must be hit: one in ``SHARE``.
WINDOW, SHARE = 13, 20
#: Bytes of windows that are searched in one pass.
BLOCK_BYTES = 8 << 20

HIT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
                    T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("items", T.ArrayType(T.StringType()))])


class Searcher:
    """Wu-Manber tables over byte strings: a shift per block of ``block`` bytes, buckets by the last block.

    Patterns are split into classes of similar length, because the shortest pattern of a class bounds
    its shifts. Each class has its own pass over the text.
    """

    def __init__(self, patterns: Iterable[tuple[bytes, object]], block: int = 8):
        classes = defaultdict(list)
        for p, label in patterns:
            classes[min(len(p), 64).bit_length()].append((p, label))
        self.classes = []
        for members in classes.values():
            m = min(len(p) for p, _ in members)
            b = min(block, m)
            shift: dict[bytes, int] = {}
            bucket: dict[bytes, list] = defaultdict(list)
            for p, label in members:
                for end in range(b, m + 1):
                    key = p[end - b:end]
                    shift[key] = min(shift.get(key, m), m - end)
                bucket[p[m - b:m]].append((p, label))
            self.classes.append((m, b, shift, dict(bucket)))

    def find(self, text: bytes) -> Iterator[tuple[int, bytes, object]]:
        """(start, pattern, label) of every occurrence, by start within a class."""
        for m, b, shift, bucket in self.classes:
            get, far, i, n = shift.get, m - b + 1, m, len(text)
            while i <= n:
                key = text[i - b:i]
                step = get(key, far)
                if step:
                    i += step
                    continue
                for p, label in bucket[key]:
                    if text.startswith(p, i - m):
                        yield i - m, p, label
                i += 1


def windows(words: list[bytes], size: int = WINDOW) -> Iterator[bytes]:
    """Runs of ``size`` words, spaces around; fewer words, but not none, are one window."""
    for i in range(max(len(words) - size + 1, min(len(words), 1))):
        yield b" " + b" ".join(words[i:i + size]) + b" "


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """Distinct (window, item) rows of the benchmark, ordered by window."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = sorted({(w, i) for i, t in zip(ids, texts) for w in windows(folded_words(t), size)})
            yield pa.RecordBatch.from_pydict({"window": pa.array([w for w, _ in rows], pa.binary()), "item": pa.array([i for _, i in rows], pa.string())})

    src = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("i"), F.col(f"`{text}`").cast("binary").alias("t"))
    return src.mapInArrow(run, "window binary, item string").distinct().orderBy("window", "item")


def merged(spans: Iterable[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def search_text(searcher: Searcher, data: bytes | None) -> dict:
    words = folded_words(data)
    spans, items = [], set()
    if words:
        text = b" " + b" ".join(words) + b" "
        at, seen = 0, 0
        for start, pattern, label in searcher.find(text):
            if start < at:
                at, seen = 0, 0
            seen += text.count(b" ", at, start)  # the number of words before this place
            at = start
            spans.append((seen, seen + pattern.count(b" ") - 1))
            items |= label
    spans = merged(spans)
    return {"n_words": len(words), "n_hit": sum(b - a for a, b in spans), "spans": spans, "items": sorted(items)}


def find_passages(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                  into: str = "passages", size: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                  keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a struct: n_words, n_hit (words inside occurrences), merged word spans, and item ids as sorted strings.

    Windows reach the executors in blocks of about ``block_bytes``, the proven bound of what the driver holds and sends
    (one window more, however long its words are). A benchmark of one block, the usual case, is searched in one pass without a
    shuffle. More blocks are searched one after the other; each pass reads and writes the table.

    NULL and empty texts have no words and no hits; a NULL item id counts as the empty string; repeated items
    and rows change nothing; an empty benchmark hits nothing. Other columns stay as they are; ``keep`` lists the
    columns to return (default: all).
    """
    spark = docs.sparkSession
    rows = ((bytes(r[0]), r[1]) for r in item_windows(benchmark, item, item_text, size).toLocalIterator())

    def block() -> dict[bytes, set]:
        out: dict[bytes, set] = {}
        room = block_bytes
        for w, i in rows:
            out.setdefault(w, set()).add(i)
            room -= len(w) + len(i)
            if room <= 0:
                break
        return out

    def search(df: DataFrame, patterns: dict[bytes, set], name: str) -> DataFrame:
        sent = spark.sparkContext.broadcast(sorted(patterns.items()))

        def each():  # the search tables go with the task
            searcher = Searcher((p, frozenset(items)) for p, items in sent.value)
            return lambda texts: [search_text(searcher, t) for t in texts]

        return add_struct(df, text, name, HIT, each, columns, per_task=True)

    patterns, more = block(), block()
    columns = None if more else keep  # a later block needs the text again
    found = search(docs, patterns, into)
    while more:
        found = write_through(found, "passages")
        found, more = _joined(search(found, more, fresh(found, "more")), into, fresh(found, "more")), block()
    return found if keep is None else found.select(*keep, into)


def _joined(df: DataFrame, a: str, b: str) -> DataFrame:
    """Merge the hits of two blocks into ``a``."""
    spans = F.array_sort(F.concat(f"{a}.spans", f"{b}.spans"))
    start, end = lambda s: F.element_at(s, 1), lambda s: F.element_at(s, 2)
    # fold over sorted spans, growing the last one while the next begins inside it
    fold = F.aggregate(spans, F.array().cast("array<array<int>>"), lambda acc, s: F.when(
        (F.size(acc) > 0) & (start(s) <= end(F.element_at(acc, -1))),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.array(start(F.element_at(acc, -1)), F.greatest(end(s), end(F.element_at(acc, -1)))))),
    ).otherwise(F.concat(acc, F.array(s))))
    out = df.withColumn(a, F.struct(F.col(f"{a}.n_words").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), fold.alias("spans"),
                                    F.array_sort(F.array_union(f"{a}.items", f"{b}.items")).alias("items"))).drop(b)
    hit = F.aggregate(f"{a}.spans", F.lit(0).cast("long"), lambda n, s: n + end(s) - start(s))
    return out.withColumn(a, F.col(a).withField("n_hit", hit))


def is_contaminated(passages: str, share: int = SHARE):
    """At least one word in ``share`` is inside an occurrence."""
    n, hit = F.col(f"{passages}.n_words"), F.col(f"{passages}.n_hit")
    return (hit > 0) & (hit * share >= n)


def without_passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    into = fresh(docs, "_passages")
    return find_passages(docs, benchmark, into=into).where(~is_contaminated(into)).drop(into)
