"""Jaccard links between n-gram sets, by a join on prefix trees.

Sets are ordered by one global order, rare n-grams first. Sets that can reach the threshold share an
n-gram among their first few, so n-grams of these prefixes alone tell groups of sets that may be linked. Every group is joined by a prefix tree of its whole sets: walking the tree, a set shares the
overlap counted so far between all sets below, and leaves subtrees that the remaining lengths rule out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.llm.words import _LOWER, fresh, rows_of, slices
from tidemark.operators.entities import connected_components
from tidemark.session import write_through

#: Words of an n-gram, and the threshold as a whole percentage of the union.
SIZE, PERCENT = 3, 90

#: Counters of the global order: 2**20 numbers of 4 bytes, whatever the input.
ORDER_BITS = 20

#: N-grams that one block of a group may hold; larger groups are cut into blocks.
BLOCK_GRAMS = 1_000_000

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


#: Words of more bytes are hashed one by one, the others eight bytes of all words at a time.
LONG_WORD = 256
#: Low bytes of a number: the first 0 to 8.
_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_SPACES = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * _M1
    h ^= h >> np.uint64(29)
    h *= _M2
    h ^= h >> np.uint64(32)
    return h


class Grams:
    """64-bit n-gram hashes of texts; those of a slice of texts are made at once."""

    def __init__(self, size: int = SIZE):
        self.size = size

    def of(self, data: bytes | None) -> np.ndarray:
        """Sorted distinct hashes; a text of fewer words is one n-gram, a text of none has no set."""
        return self.of_all([data])[0]

    def of_all(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """``of`` each text."""
        # words of several texts never touch: a space follows each
        joined = b"".join(x for t in texts for x in (t or b"", b" ")).translate(_LOWER) + bytes(8)
        ends_of = np.cumsum(np.array([len(t or b"") + 1 for t in texts], np.int64))
        h, starts = self._words(joined)
        upto = np.searchsorted(starts, ends_of)  # words of the texts up to each one
        n = np.diff(upto, prepend=0)
        grams = self._windows(h, self.size) if len(h) >= self.size else np.empty(0, np.uint64)
        # a window counts if it lies in one text; texts of fewer words are one window
        each = np.maximum(n - self.size + 1, 0)
        first = np.repeat(upto - n - np.cumsum(each) + each, each) + np.arange(each.sum())
        sets, at = grams[first], (np.cumsum(each) - each).tolist()
        for i, k in zip(at, each.tolist()):
            sets[i:i + k].sort()
        new = np.ones(len(sets), bool)
        new[1:] = sets[1:] != sets[:-1]
        new[[i for i, k in zip(at, each.tolist()) if k]] = True
        ends = np.concatenate([[0], np.cumsum(new)])
        sets = sets[new]
        out = [sets[x:y] for x, y in zip(ends[at].tolist(), ends[np.cumsum(each)].tolist())]
        for i in np.flatnonzero((n > 0) & (n < self.size)).tolist():
            out[i] = self._windows(h[upto[i] - n[i]:upto[i]], int(n[i]))
        return out

    @staticmethod
    def _windows(h: np.ndarray, k: int) -> np.ndarray:
        """Hashes of every ``k`` words in turn."""
        out = np.full(len(h) - k + 1, np.uint64(k), np.uint64)
        for i in range(k):  # a chain of mixes, so the order of the words matters
            out = (out ^ h[i:len(h) - k + 1 + i]) * _M1
            out ^= out >> np.uint64(29)
            out *= _M2
            out ^= out >> np.uint64(32)
        return out

    @staticmethod
    def _words(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and places of the words of lower-case bytes that end in eight bytes of no text."""
        raw = np.frombuffer(joined, np.uint8)
        space = _SPACES[raw[:-8]]
        edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
        starts, ends = edge[::2], edge[1::2]
        size = ends - starts
        eight = np.ndarray((len(joined) - 7,), "<u8", joined, strides=(1,))  # the eight bytes from every place on
        h = _mixed((eight[starts] & _BYTES[np.minimum(size, 8)]) ^ size.astype(np.uint64) * _M3)
        at, of = 8, np.flatnonzero((size > 8) & (size <= LONG_WORD))
        while len(of):
            left = size[of] - at
            h[of] = _mixed((eight[starts[of] + at] & _BYTES[np.minimum(left, 8)]) ^ h[of])
            at, of = at + 8, of[left > 8]
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            h[i] = xxhash.xxh3_64_intdigest(joined[starts[i]:ends[i]])
        return h, starts


def needed(a: int, b: int, percent: int = PERCENT) -> int:
    """Smallest overlap of sets of these sizes with 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """How many first n-grams of a set of ``n`` every set that reaches the threshold must meet."""
    return n - -(-percent * n // 100) + 1


def size_class(n: int, percent: int = PERCENT) -> int:
    """Class of a set size; sizes within the threshold of each other are in one class or in two neighbours."""
    k, top = 0, 1
    while n > top:
        top, k = max(top + 1, top * 100 // percent), k + 1
    return k


def _class_table(percent: int) -> np.ndarray:
    tops, top = [], 1
    while top < 1 << 31:
        tops.append(top)
        top = max(top + 1, top * 100 // percent)
    return np.array(tops)


def profiles(docs: DataFrame, doc_id: str, text: str, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, set): size and 128-bit identity of every document's set; and (bucket, n): how many sets have n-grams there."""
    names = ["kind", "doc_id", "n", "a", "b", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = Grams(size), np.zeros(1 << ORDER_BITS, np.uint32)
        for batch in batches:
            rows = []
            for part in slices(batch.column(1)):
                sets = grams.of_all(part)
                np.add.at(counts, np.concatenate(sets) >> np.uint64(64 - ORDER_BITS), 1)
                rows += [(len(g), *identity(g)) for g in sets]
            n, a, b = zip(*rows) if rows else ((), (), ())
            rows_n = len(n)
            yield pa.RecordBatch.from_arrays([pa.array([0] * rows_n, pa.int32()), batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()),
                                              pa.array(b, pa.int64()), pa.nulls(rows_n, pa.binary())], names)
        for at in range(0, len(counts), 4096):  # in pieces, and only those with counts
            piece = counts[at:at + 4096]
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.nulls(1, pa.int64()), pa.array([at // 4096], pa.int64()), pa.nulls(1, pa.int64()),
                                                  pa.nulls(1, pa.int64()), pa.array([piece.astype("<u4").tobytes()], pa.binary())], names)

    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    both = write_through(src.mapInArrow(run, "kind int, doc_id long, n long, a long, b long, counts binary"), "profiles")
    return (both.where("kind = 0").select("doc_id", "n", "a", "b"), both.where("kind = 1").select(F.col("n").alias("piece"), "counts"))


def global_order(counts: DataFrame) -> np.ndarray:
    """Sets per bucket of n-gram hashes, over the whole table; the order of an n-gram is (count of its bucket, hash)."""

    def total(key, rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(4096, np.uint64)
        for data in rows["counts"]:
            out += np.frombuffer(data, "<u4")
        return pd.DataFrame({"piece": [key[0]], "counts": [np.minimum(out, 0xFFFFFFFF).astype("<u4").tobytes()]})

    # pieces of one partition are few and small: partitions x 16 KB for a piece
    table = np.zeros(1 << ORDER_BITS, np.uint32)
    for r in counts.groupBy("piece").applyInPandas(total, "piece long, counts binary").collect():
        table[r["piece"] * 4096:(r["piece"] + 1) * 4096] = np.frombuffer(bytes(r["counts"]), "<u4")
    return table


def ordered(grams: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A set by (count of its bucket, hash)."""
    return grams[np.argsort(table[grams >> np.uint64(64 - ORDER_BITS)], kind="stable")]


def hot_count(table: np.ndarray) -> int:
    """Bucket count from which an n-gram counts as common without being looked at: far above the mean bucket."""
    return 64 + 2 * int(table.mean(dtype=np.float64))


def identity(grams: np.ndarray) -> tuple[int, int]:
    """128-bit name of a set."""
    a, b = np.frombuffer(hashlib.blake2b(grams.tobytes(), digest_size=16).digest(), "<i8").tolist()
    return a, b


def prefixes(docs: DataFrame, text: str, table, percent: int, size: int = SIZE) -> DataFrame:
    """(gram, size_class, a) for the n-grams of prefixes that other sets hold too; ``a`` is half of a set's name.

    The global order of n-grams: first those of a hash quarter of all n-grams that only one set holds, then the
    rest of that quarter, then all others; inside each by (bucket count, hash). Common n-grams (see ``hot_count``)
    count as others, so no key of the shuffle is hot. Most prefixes hold only n-grams of their own, which need no
    row: how many of them a set has follows from the size of its quarter.
    """
    chosen = np.uint64(1) << np.uint64(62)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, order = Grams(size), table.value
        hot = hot_count(order)
        for batch in batches:
            for part in slices(batch.column(0), 64):
                cols: list[tuple] = []
                for g in grams.of_all(part):
                    if not len(g):
                        continue
                    # the hash quarter is taken from other bits than the buckets
                    quarter = (g << np.uint64(ORDER_BITS) < chosen) & (order[g >> np.uint64(64 - ORDER_BITS)] <= hot)
                    inside, name = g[quarter], identity(g)[0]
                    more = max(0, prefix_length(len(g), percent) - len(inside))
                    rows = np.concatenate([inside, ordered(g[~quarter], order)[:more]]) if more else inside
                    kind = np.zeros(len(rows), np.int8)
                    kind[len(inside):] = 1
                    cols.append((rows.view(np.int64), np.full(len(rows), name), np.full(len(rows), len(g) << 32 | len(inside)), kind))
                if cols:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*cols)], ["gram", "a", "sizes", "kind"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of n-grams that several sets hold, and those beyond the quarter; repeats by copies of a set are dropped."""
        order, held = table.value, None

        def chosen_rows(rows):
            gram, a, sizes, kind = rows
            new = np.ones(len(a), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (a[1:] != a[:-1])
            gram, a, sizes, kind = (c[new] for c in rows)
            run = np.cumsum(np.concatenate([[True], gram[1:] != gram[:-1]])) - 1
            many = np.bincount(run)[run] > 1
            keep = many | (kind == 1)
            g = gram[keep]
            rank = order[g.view(np.uint64) >> np.uint64(64 - ORDER_BITS)].astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(g), pa.array(a[keep]), pa.array(sizes[keep]), pa.array(kind[keep]), pa.array(rank)],
                                              ["gram", "a", "sizes", "kind", "rank"])

        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                rows = [np.concatenate(c) for c in zip(held, rows)]
            if not len(rows[0]):
                continue
            # the last n-gram may go on in the next batch
            cut = int(np.searchsorted(rows[0], rows[0][-1], side="left"))
            held = [c[cut:] for c in rows]
            if cut:
                yield chosen_rows([c[:cut] for c in rows])
        if held is not None and len(held[0]):
            yield chosen_rows(held)

    sampled = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(emit, "gram long, a long, sizes long, kind byte")
    by_gram = sampled.repartition("gram").sortWithinPartitions("gram", "a")
    rows = write_through(by_gram.mapInArrow(shared, "gram long, a long, sizes long, kind byte, rank long"), "shared")
    n, inside = F.shiftright("sizes", 32), F.col("sizes").bitwiseAND(F.lit((1 << 32) - 1))
    prefix = n - F.ceil(F.lit(percent) * n / 100) + 1
    own = W.partitionBy("a")  # a set has no more rows than n-grams
    place = F.row_number().over(own.orderBy("kind", "rank", "gram"))
    held = F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).over(own)
    tops = _class_table(percent).tolist()
    cls = F.size(F.filter(F.array(*[F.lit(t) for t in tops]), lambda t: t < n))
    return (rows.withColumns({"_at": place, "_held": held}).where((F.col("kind") == 1) | (F.col("_at") <= prefix - (inside - F.col("_held"))))
            .select("gram", cls.cast("int").alias("size_class"), "a"))


def candidate_links(found: DataFrame) -> DataFrame:
    """(src, dst): each set that meets another in a prefix n-gram and fits it by size, linked to one such set.

    Rows are dealt by ranges of (n-gram, size class, set), which cuts a hot n-gram as well, and read in order:
    every set is linked to the first of its n-gram and size class in the partition, and firsts of neighbouring
    classes to each other. The first and last class of each partition are linked across partitions
    afterwards. Links are never more than the rows, and the groups they make hold every pair.
    """
    schema = "open boolean, gram long, size_class int, src long, dst long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = first = None  # (gram, class, head)

        def made(opened: bool, gram, cls, src, dst):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(src), opened)), pa.array(gram), pa.array(cls), pa.array(src), pa.array(dst)],
                                              ["open", "gram", "size_class", "src", "dst"])

        for batch in batches:
            gram, cls, a = (batch.column(i).to_numpy() for i in range(3))
            if not len(a):
                continue
            new = np.ones(len(a), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (cls[1:] != cls[:-1])
            new[0] = last is None or (gram[0], cls[0]) != last[:2]
            at = np.flatnonzero(new)
            run_of = np.cumsum(new)  # 0: the class that the batch before ended with
            heads = np.concatenate([[last[2] if last else a[0]], a[at]])
            keys = np.concatenate([[last[0] if last else gram[0]], gram[at]])
            sizes = np.concatenate([[last[1] if last else cls[0]], cls[at]])
            beside = np.flatnonzero((keys[1:] == keys[:-1]) & (sizes[1:] == sizes[:-1] + 1))
            src, dst = np.concatenate([a, heads[beside + 1]]), np.concatenate([heads[run_of], heads[beside]])
            pairs = np.unique(np.stack([src, dst], 1)[src != dst], axis=0)
            if len(pairs):
                none = np.zeros(len(pairs), np.int64)
                yield made(False, none, none.astype(np.int32), pairs[:, 0].copy(), pairs[:, 1].copy())
            last = (keys[-1], sizes[-1], heads[-1])
            first = first or (gram[0], cls[0], a[0])
        ends = [x for x in dict.fromkeys((first, last)) if x]
        if ends:
            g, c, h = (np.array(x) for x in zip(*ends))
            yield made(True, g.astype(np.int64), c.astype(np.int32), h.astype(np.int64), h.astype(np.int64))

    ranged = write_through(found, "prefixes").repartitionByRange("gram", "size_class", "a").sortWithinPartitions("gram", "size_class", "a")
    rows = write_through(ranged.mapInArrow(run, schema), "links")
    across = W.partitionBy("gram").orderBy("size_class", "src")  # two rows a partition
    ends = rows.where("open").select("src", F.lag("src").over(across).alias("dst"), F.lag("size_class").over(across).alias("_c"), "size_class")
    return (rows.where("not open").select("src", "dst")
            .unionByName(ends.where("dst is not null and src <> dst and size_class - _c <= 1").select("src", "dst")).distinct())


class Tree:
    """Prefix tree of ordered sets, edges compressed to the n-grams up to the next fork.

    Walks look for sets linked to the probe but in another component; a subtree whose sets are all in the
    probe's component is passed by.
    """

    __slots__ = ("root", "parent", "percent", "sets")

    def __init__(self, percent: int):
        self.root, self.parent, self.percent, self.sets = _Node(()), [], percent, []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)

    def probe(self, i: int, grams: tuple, members: frozenset) -> None:
        """Link set ``i`` to every component of the tree that has a set close enough to it."""
        n, percent, stack = len(grams), self.percent, [(self.root, 0, 0)]
        low, high = -(-percent * n // 100), n * 100 // percent
        while stack:
            node, depth, overlap = stack.pop()
            if node.longest < low or node.shortest > high or (node.member >= 0 and not node.mixed and self.find(node.member) == self.find(i)):
                continue
            short, long = max(node.shortest, low), min(node.longest, high)
            # n-grams that a set below may lack, and that the probe may lack: both follow from the overlap needed
            lacks = long - needed(n, long, percent)
            at, edge = 0, node.edge
            while at < len(edge):
                part = edge[at:at + 32]
                overlap += len(members.intersection(part))
                at += len(part)
                if depth + at - overlap > lacks:
                    break
            else:
                depth += len(edge)
                if overlap + min(n - overlap, long - depth) < needed(n, short, percent):
                    continue
                for k in node.ends:
                    if overlap >= needed(n, depth, percent) and self.find(k) != self.find(i):
                        self.union(k, i)
                stack.extend((child, depth, overlap) for child in node.children.values())

    def add(self, i: int, grams: tuple) -> None:
        node, rest, n = self.root, grams, len(grams)
        while True:
            node.note(i, n, self)
            if not rest:
                node.ends.append(i)
                return
            child = node.children.get(rest[0])
            if child is None:
                node.children[rest[0]] = leaf = _Node(rest)
                leaf.note(i, n, self)
                leaf.ends.append(i)
                return
            same, edge = 0, child.edge
            most = min(len(edge), len(rest))
            while same < most and edge[same] == rest[same]:
                same += 1
            if same < len(edge):
                child = child.split(same)
                node.children[rest[0]] = child
            node, rest = child, rest[same:]


class _Node:
    __slots__ = ("edge", "children", "ends", "shortest", "longest", "member", "mixed")

    def __init__(self, edge: tuple):
        self.edge, self.children, self.ends = edge, {}, []
        self.shortest, self.longest, self.member, self.mixed = 1 << 62, 0, -1, False

    def note(self, i: int, n: int, tree: Tree) -> None:
        """A set of ``n`` n-grams is below."""
        self.shortest, self.longest = min(self.shortest, n), max(self.longest, n)
        if self.member < 0:
            self.member = i
        elif tree.find(self.member) != tree.find(i):
            self.mixed = True

    def split(self, at: int) -> _Node:
        above = _Node(self.edge[:at])
        above.shortest, above.longest, above.member, above.mixed = self.shortest, self.longest, self.member, self.mixed
        self.edge = self.edge[at:]
        above.children[self.edge[0]] = self
        return above


def linked(sets: list[tuple], percent: int = PERCENT) -> list[int]:
    """For each ordered set (a tuple of n-grams), the smallest place of its component."""
    tree = Tree(percent)
    for i, grams in enumerate(sets):
        tree.parent.append(i)
        tree.probe(i, grams, frozenset(grams))
        tree.add(i, grams)
    return [tree.find(i) for i in range(len(sets))]


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, size: int = SIZE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Two documents are linked when 100 * intersection >= percent * union of their sets of distinct n-grams of ``size`` words;
    a component's id is its smallest doc_id. Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.
    NULL, empty and blank texts have an empty set and are their own component. Equal sets are one class and
    are joined once. Rows may share a doc_id; a NULL doc_id never names a component of others.
    N-grams are known by 64-bit hashes, sets by 128-bit ones.
    """
    spark = docs.sparkSession
    sizes, counts = profiles(docs, doc_id, text, size)
    table = spark.sparkContext.broadcast(global_order(counts))
    links = write_through(candidate_links(prefixes(docs, text, table, percent, size)), "links")
    groups = connected_components(links.select("src").union(links.select("dst")).distinct().toDF("node"), links)

    # one document of each set that may have links carries its text to the group
    one = sizes.where("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    members = write_through(_dealt(groups.select(F.col("node").alias("a"), F.col("label").alias("grp")).join(one, "a"), percent), "members")
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    texts = rows_of(texts, "doc_id", members).withColumnRenamed("doc_id", "_id")
    # members grow with the input: a merge join at every size
    cells = members.hint("merge").join(texts, F.col("doc_id").eqNullSafe(F.col("_id"))).select("cell", "a", "b", "text")

    def join_cell(group: pd.DataFrame) -> pd.DataFrame:
        grams, order = Grams(size), table.value
        sets, names_a, names_b = {}, iter(group["a"]), iter(group["b"])
        for part in slices(pa.array(group["text"], pa.large_string(), from_pandas=True)):
            for a, b, g in zip(names_a, names_b, grams.of_all(part)):
                if identity(g) == (a, b):  # rows that share a doc_id may have another text
                    sets[a, b] = g
        names = sorted(sets)
        head = linked([tuple(ordered(sets[k], order).tolist()) for k in names], percent)
        rows = [(*names[i], *names[h]) for i, h in enumerate(head) if h != i]
        return pd.DataFrame(rows, columns=["a", "b", "c", "d"], dtype="int64")

    edges = cells.groupBy("cell").applyInPandas(join_cell, "a long, b long, c long, d long")
    edges = write_through(edges.select(F.struct("a", "b").alias("src"), F.struct(F.col("c").alias("a"), F.col("d").alias("b")).alias("dst")), "edges")
    joined = connected_components(edges.select("src").union(edges.select("dst")).distinct().toDF("node"), edges)
    named = sizes.join(joined.select("node.a", "node.b", F.col("label.a").alias("x"), F.col("label.b").alias("y")), ["a", "b"], "left")
    named = named.withColumns({"x": F.coalesce("x", "a"), "y": F.coalesce("y", "b")})
    least = named.where("n > 0").groupBy("x", "y").agg(F.min("doc_id").alias("least"))
    return named.join(least, ["x", "y"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def _dealt(members: DataFrame, percent: int) -> DataFrame:
    """Members with the cells they are joined in.

    A group of up to ``BLOCK_GRAMS`` n-grams is one cell. A larger one is cut into blocks by size class and a
    hash, and every two blocks that can hold linked sets make a cell: its work is spread, no pair is lost.
    """
    whole = members.groupBy("grp").agg(F.sum("n").alias("grams"))
    tops = _class_table(percent).tolist()
    size = F.size(F.filter(F.array(*[F.lit(t) for t in tops]), lambda t: t < F.col("n"))) + 1
    d = members.join(whole, "grp").withColumn("k", F.when(F.col("grams") > BLOCK_GRAMS, size).otherwise(F.lit(0)))
    per = d.where("k > 0").groupBy("grp", "k").agg(F.ceil(F.sum("n") / BLOCK_GRAMS).cast("int").alias("blocks"))
    d = d.join(per, ["grp", "k"], "left").join(per.select("grp", (F.col("k") - 1).alias("k"), F.col("blocks").alias("above")), ["grp", "k"], "left") \
        .join(per.select("grp", (F.col("k") + 1).alias("k"), F.col("blocks").alias("below")), ["grp", "k"], "left")
    own = F.pmod(F.xxhash64("a", "b"), F.col("blocks")).cast("int")
    upto = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) > 0, F.sequence(F.lit(0), F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    block = lambda k, i: F.concat_ws(":", k, i)
    pair = lambda x, y: F.concat_ws("|", F.least(x, y), F.greatest(x, y))
    cells = F.concat(F.transform(upto("blocks"), lambda i: pair(block(F.col("k"), own), block(F.col("k"), i))),
                     F.transform(upto("above"), lambda i: pair(block(F.col("k"), own), block(F.col("k") + 1, i))),
                     F.transform(upto("below"), lambda i: pair(block(F.col("k"), own), block(F.col("k") - 1, i))))
    cells = F.when(F.col("k") == 0, F.array(F.lit(""))).otherwise(cells)
    return d.select("doc_id", "a", "b", "grp", F.explode(cells).alias("c")).select("doc_id", "a", "b", F.struct("grp", "c").alias("cell"))


def one_of_each(docs: DataFrame, percent: int = PERCENT, size: int = SIZE) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id. Rows without words all stay."""
    ids = components(docs, percent=percent, size=size)
    cut = ids.where("n_shingles = 0 or doc_id is null or doc_id = component_id").select(F.col("doc_id").alias("keep")).distinct()
    key = fresh(docs, "keep")
    return docs.join(cut.withColumnRenamed("keep", key), F.col("doc_id").eqNullSafe(F.col(key)), "left_semi")
