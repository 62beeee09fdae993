"""A language model by context-tree weighting, trained and applied by Spark jobs.

Texts are lower-cased bytes, with a mark in place of the bytes before the first and after the last one. Every byte is eight binary
decisions; each decision has its own tree of contexts, the bytes before it. A node holds the Krichevsky-Trofimov estimate of the
decisions seen there, and its weighted probability is the mean of that estimate and the product of its children's. A prediction mixes the
estimates of all depths by these weights.

The corpus is gathered as counts of (context, byte), of training texts and, as zeros, of the others. Nodes below a context of three bytes
are worked off together (at most 2**24 different rows, for a depth of five), many contexts at a time. Their roots are summed to the nodes of the three
depths above, which are at most 65,536 * 255 for all pairs of bytes and some thousand for texts. Each (context, byte) of any text
then gets its logarithm, and texts are scored by a table of them, in blocks of a bounded size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain
from math import lgamma, log, log10, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm.words import _LOWER, add_struct, fresh, head_counts, slices, spaced_words, word_counts
from tidemark.operators.ordering import join_on
from tidemark.session import write_through

#: Bytes of context, and of the contexts below which nodes are worked off together.
DEPTH, ROOT = 5, 3
MARK = 255  # no byte of UTF-8
#: (context, byte) rows of a block of the model, which is sent to the executors: 64 MB.
BLOCK_ROWS = 4_000_000
#: Frequent words whose counts are sent, and bytes of the longest of them: 8 MB at most. Other words are joined with their counts.
HEAD_WORDS, HEAD_BYTES = 131_072, 64
#: Keys and words that a task holds before it reports them; rows of the model that a task works off at once; bytes of text made to keys at once.
HELD, WORDS_HELD, CHUNK, PIECE = 1_000_000, 150_000, 200_000, 1 << 19

#: Log gamma of half integers less the main terms of Stirling's formula.
_REST = np.array([0.0] + [lgamma(x) - (x - 0.5) * log(x) + x - 0.5 * log(2 * pi) for x in np.arange(1, 1024) / 2])


def _rest(x: np.ndarray) -> np.ndarray:
    twice = np.minimum(2 * x, len(_REST)).astype(np.int64)
    return np.where(twice < len(_REST), _REST[np.minimum(twice, len(_REST) - 1)], 1 / (12 * x) - 1 / (360 * x**3))


def kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of ``a`` zeros and ``b`` ones, gamma(a + 1/2) gamma(b + 1/2) / (pi gamma(a + b + 1)).

    Stirling's main terms are joined before they are added up, so large counts cost no digits.
    """
    x, y, z = a + 0.5, b + 0.5, a + b + 1.0
    return a * np.log(x / z) + b * np.log(y / z) - 0.5 * np.log(z) + 0.5 * log(2 / pi) + _rest(x) + _rest(y) - _rest(z)


def weighted(estimate: np.ndarray, children: np.ndarray) -> np.ndarray:
    return np.logaddexp(estimate, children) - log(2)


def keys(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, number of its text) for all bytes and ends, at most ``PIECE`` at a time. A key is a byte after its context, whose nearest byte comes first."""
    marks = bytes([MARK]) * DEPTH
    held, room = [], PIECE
    for i, t in enumerate(texts):
        whole = marks + (t or b"").translate(_LOWER) + marks[:1]
        at = DEPTH
        while at < len(whole):
            end = min(len(whole), at + room)
            held.append((i, whole[at - DEPTH:end]))
            room -= end - at
            at = end
            if not room:
                yield _keyed(held)
                held, room = [], PIECE
    if held:
        yield _keyed(held)


def _keyed(pieces: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    s = np.frombuffer(b"".join(p for _, p in pieces), np.uint8).astype(np.uint64)
    key, moved = s.copy(), np.empty_like(s)
    for d in range(1, DEPTH + 1):
        np.left_shift(s[:-d], np.uint64(8 * (DEPTH + 1 - d)), out=moved[d:])
        key[d:] |= moved[d:]
    sizes = np.array([len(p) for _, p in pieces])
    inside = np.ones(len(s), bool)
    inside[((np.cumsum(sizes) - sizes)[:, None] + np.arange(DEPTH)).ravel()] = False  # context only
    return key[inside], np.repeat(np.array([i for i, _ in pieces], np.uint64), sizes - DEPTH)


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, length) of the runs of equal values."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return first, np.diff(np.concatenate([first, [len(key)]]))


def key_counts(docs: DataFrame, text: str, training: str) -> DataFrame:
    """(key, n): every byte in its context with how often training texts have it; 0 if only other texts do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merge() -> None:
            key, n = (np.concatenate([x[i] for x in held]) for i in range(2))
            order = np.argsort(key)
            key = key[order]
            first, _ = runs(key)
            held[:] = [(key[first], np.add.reduceat(n[order], first))]

        def report() -> pa.RecordBatch:
            key, n = held.pop()
            return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n)], ["key", "n"])

        for batch in batches:
            done = 0
            for part in slices(batch.column(0)):
                learnt = batch.column(1).slice(done, len(part)).to_pylist()
                done += len(part)
                for chosen in (True, False):
                    texts = [t for t, own in zip(part, learnt) if own == chosen]
                    for key, _ in keys(texts):
                        key.sort()
                        first, n = runs(key)
                        held.append((key[first], n * int(chosen)))
                if sum(len(k) for k, _ in held) > HELD:
                    merge()
                    if len(held[0][0]) > HELD // 2:
                        yield report()
        if held:
            merge()
            yield report()

    found = docs.select(F.col(f"`{text}`"), F.col(f"`{training}`")).mapInArrow(run, "key long, n long")
    return found.groupBy("key").agg(F.sum("n").alias("n"))


class Level:
    """Contexts of one depth in one group: rows (context, byte, n) by their place in the order of keys."""

    def __init__(self, key: np.ndarray, n: np.ndarray, depth: int):
        self.key, self.n, self.depth = key, n, depth  # key: context of ``depth`` bytes, then the byte
        self.byte = (key & np.uint64(255)).astype(np.int64)

    def above(self) -> tuple["Level", np.ndarray]:
        """The level with a byte less of context, and the row there of each row here."""
        shorter = (self.key >> np.uint64(16) << np.uint64(8)) | (self.key & np.uint64(255))
        key, row = np.unique(shorter, return_inverse=True)
        return Level(key, np.bincount(row, self.n, len(key)), self.depth - 1), row

    def nodes(self, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(node of each row, first row of each node, zeros, ones) of the decision for one bit of the byte."""
        top = self.key >> np.uint64(8 - bit)
        first = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]]))
        node = np.cumsum(np.concatenate([[0], (top[1:] != top[:-1]).astype(np.int64)]))
        one = (self.byte >> (7 - bit)) & 1
        ones, total = np.add.reduceat(self.n * one, first), np.add.reduceat(self.n, first)
        return node, first, total - ones, ones


def levels(key: np.ndarray, n: np.ndarray) -> tuple[list[Level], list[np.ndarray]]:
    """The levels from ``DEPTH`` to ``ROOT`` of a group's sorted rows, and for each the rows of the one before."""
    found, up = [Level(key, n.astype(np.float64), DEPTH)], [np.arange(len(key))]
    while found[-1].depth > ROOT:
        level, row = found[-1].above()
        found.append(level)
        up.append(row)
    return found, up


def group_nodes(key: np.ndarray, n: np.ndarray):
    """For each bit, the nodes of every level with their counts, estimates, children's product and weighted probability (logs)."""
    found, up = levels(key, n)
    for bit in range(8):
        out, below = [], None
        for i, level in enumerate(found):
            node, first, a, b = level.nodes(bit)
            estimate = kt(a, b)
            if below is None:
                children, weight = None, estimate
            else:
                parent = node[up[i][below[1]]]  # the node here of the first row of each node below
                children = np.bincount(parent, below[0], len(first))
                weight = weighted(estimate, children)
            out.append((level, node, first, a, b, estimate, children, weight))
            below = (weight, first)
        yield bit, found, up, out


def roots(key: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """(context, node, zeros, ones, weighted probability) of the nodes of depth ``ROOT``. A node is a one and the bits before it."""
    rows = []
    for bit, _, _, out in group_nodes(key, n):
        level, _, first, a, b, _, _, weight = out[-1]
        rows.append(((level.key[first] >> np.uint64(8)).astype(np.int64), (1 << bit) + (level.byte[first] >> (8 - bit)), a, b, weight))
    return [np.concatenate(c) for c in zip(*rows)]


class Top:
    """The nodes above depth ``ROOT``: per depth the sorted places (context, node), the chance of a one, and the share of the node's own estimate."""

    def __init__(self, context: np.ndarray, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, inner: np.ndarray):
        self.depths = []
        place, inside = context << 8 | node, [zeros, ones, inner]
        while True:
            place, row = np.unique(place, return_inverse=True)
            a, b, children = (np.bincount(row, x, len(place)) for x in inside)
            estimate = kt(a, b)
            self.depths.append((place, (b + 0.5) / (a + b + 1), self.own(estimate, children)))
            if len(self.depths) == ROOT:
                return
            place, inside = (place >> 16 << 8) | (place & 255), [a, b, weighted(estimate, children)]

    @staticmethod
    def own(estimate: np.ndarray, children: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(children - estimate, -700, 700)))

    def mix(self, chance: np.ndarray, context: np.ndarray, node: np.ndarray) -> np.ndarray:
        """``chance`` of a one at depth ``ROOT`` with the estimates above; ``context`` has ``ROOT`` - 1 bytes."""
        for i, (place, ones, share) in enumerate(self.depths):
            at = np.searchsorted(place, (context >> (8 * i)) << 8 | node)
            chance = share[at] * ones[at] + (1 - share[at]) * chance
        return chance


def logarithms(key: np.ndarray, n: np.ndarray, top: Top) -> np.ndarray:
    """Log10 probability of the byte of each row in its context."""
    total = np.zeros(len(key))
    context = (key >> np.uint64(8 * (DEPTH + 2 - ROOT))).astype(np.int64)
    byte = (key & np.uint64(255)).astype(np.int64)
    for bit, _, up, out in group_nodes(key, n):
        one, row, chance = ((byte >> (7 - bit)) & 1).astype(bool), np.arange(len(key)), None
        for i, (_, node, _, a, b, estimate, children, _) in enumerate(out):
            row = up[i][row]
            at = node[row]
            ones = ((b + 0.5) / (a + b + 1))[at]
            if chance is None:
                chance = ones
            else:
                share = Top.own(estimate, children)[at]
                chance = share * ones + (1 - share) * chance
        chance = top.mix(chance, context, (1 << bit) + (byte >> (8 - bit)))
        total += np.log10(np.where(one, chance, 1 - chance))
    return total


def _by_root(counts: DataFrame, rows, names: list[str], schema: str) -> DataFrame:
    """``rows(keys, counts)`` over whole contexts of ``ROOT`` bytes, about ``CHUNK`` rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in chain(batches, [None]):
            if batch is not None:
                key = np.concatenate([key, batch.column(0).to_numpy().astype(np.uint64)])
                n = np.concatenate([n, batch.column(1).to_numpy()])
                if len(key) < CHUNK:
                    continue
                own = key >> np.uint64(8 * (DEPTH + 1 - ROOT))
                end = int(np.searchsorted(own, own[-1]))  # the last context may go on
            else:
                end = len(key)
            if end:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows(key[:end], n[:end])], names)
                key, n = key[end:], n[end:]

    placed = counts.select("key", "n").repartition(F.shiftright("key", 8 * (DEPTH + 1 - ROOT))).sortWithinPartitions("key")
    return placed.mapInArrow(run, schema)


def train(counts: DataFrame) -> DataFrame:
    """(key, lp): log10 probabilities of all keys of ``counts`` (key, n)."""
    found = _by_root(counts, roots, ["context", "node", "zeros", "ones", "weight"], "context long, node long, zeros double, ones double, weight double")
    sums = found.groupBy(F.shiftright("context", 8).alias("context"), "node").agg(
        F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weight").alias("weight")).toArrow()
    if not sums.num_rows:
        return counts.select("key", F.lit(0.0).alias("lp"))
    top = counts.sparkSession.sparkContext.broadcast(Top(*[sums.column(c).to_numpy() for c in ("context", "node", "zeros", "ones", "weight")]))
    return _by_root(counts, lambda key, n: [key.astype(np.int64), logarithms(key, n, top.value)], ["key", "lp"], "key long, lp double")


def is_held_out(doc_id: Column) -> Column:
    """One in ten, by the CRC of the id as text (NULL: empty)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 == 0


LOGS = T.StructField("lp", T.DoubleType())
WORD_SCORES = T.StructType([LOGS, T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()),
                            T.StructField("rest", T.MapType(T.BinaryType(), T.LongType()))])


def _log_sums(texts: list[bytes | None], known: np.ndarray, lp: np.ndarray) -> list[float]:
    """Sums of the logarithms that a block of the model has for the bytes of each text; a slice has 256 texts at most."""
    total = np.zeros(len(texts))
    for key, owner in keys(texts) if len(known) else ():
        placed = np.sort(key << np.uint64(8) | owner)
        first, n = runs(placed)
        placed = placed[first]
        key = (placed >> np.uint64(8)).astype(np.int64)
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        total += np.bincount((placed & np.uint64(255)).astype(np.int64), np.where(known[at] == key, lp[at], 0.0) * n, len(texts))
    return total.tolist()


def _scored(docs: DataFrame, text: str, model: DataFrame, words, into: str, keep: list[str]) -> DataFrame:
    """``docs`` with a struct: the sum of the logarithms of its bytes, and what ``words(text)`` gives for the text's words.

    One pass over the texts for every block of the model; the last one, usually the only one, looks at the words too.
    """
    model = write_through(model, "model")
    blocks, spark = max(1, -(-model.count() // BLOCK_ROWS)), docs.sparkSession
    number = F.pmod(F.xxhash64("key"), F.lit(blocks))
    names = []
    for i in range(blocks):
        rows = model.where(number == i).toArrow()
        order = np.argsort(key := rows.column("key").to_numpy())
        sent, last = spark.sparkContext.broadcast((key[order], rows.column("lp").to_numpy()[order])), i + 1 == blocks

        def each(texts: list[bytes | None], sent=sent, last=last) -> list[dict]:
            sums = _log_sums(texts, *sent.value)
            return [{"lp": x, **(words(t) if last else {})} for x, t in zip(sums, texts)]

        name = into if last else fresh(docs, f"_lp{i}")
        docs = add_struct(docs, text, name, WORD_SCORES if last else T.StructType([LOGS]), each, [*keep, *names] if last else None)
        if not last:
            names.append(name)
            docs = write_through(docs, "partly")
    return docs.withColumn(into, F.col(into).withField("lp", sum((F.col(f"`{c}`.lp") for c in names), F.col(f"{into}.lp")))).drop(*names)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, held_out, n_tokens, n_known, train_tokens, base_score, score and n_bytes.

    ``score`` is the tree model's log10 probability of the lower-cased (A-Z) text and its end; -``score`` * log2(10) / ``n_bytes`` is the
    code length per byte. ``base_score`` is that of the words and the end under smoothed word counts, in which the end is a token like the words. Both learn from
    texts that are not held out. NULL and empty texts are their end alone; NULL ids are held out. Repeated rows all stay and all count;
    without training texts every byte costs eight bits. Empty tables give no rows; other columns are not read.
    """
    d = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    d = d.withColumns({"training": ~is_held_out(F.col("doc_id")), "body": F.xxhash64("text")})
    counts = write_through(word_counts(d.where("training"), "text", spaced_words, held=WORDS_HELD), "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = d.where("training").count()
    n_all, room = total["n"] + ends, total["n"] + ends + 0.1 * (total["v"] + (ends > 0) + 1)
    head = head_counts(counts, HEAD_WORDS, HEAD_BYTES)
    end = log10((ends + 0.1) / room)
    sent = d.sparkSession.sparkContext.broadcast({w: log10((c + 0.1) / room) for w, c in head.items()})

    def words(data: bytes | None) -> dict:
        found = spaced_words(data)
        values = list(map(sent.value.get, found))
        rest = Counter(w for w, v in zip(found, values) if v is None) if None in values else None
        known = [v for v in values if v is not None] if rest else values
        return {"n_tokens": len(found) + 1, "n_known": len(known) + (ends > 0), "base": sum(known) + end, "rest": list(rest.items()) if rest else None}

    d = d.withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    model = train(write_through(key_counts(d, "text", "training"), "contexts"))
    scored = write_through(_scored(d, "text", model, words, "w", ["doc_id", "training", "body", "n_bytes"]), "scored")
    # words outside the head, once for each of equal rows, meet their counts; unknown ones have none
    rest = scored.where("w.rest is not null").select("doc_id", "body", F.explode("w.rest").alias("word", "k")).repartition("word").dropDuplicates(["word", "doc_id", "body"])
    seen = F.coalesce("n", F.lit(0))
    terms = rest.join(counts, "word", "left").groupBy("doc_id", "body").agg(
        F.sum(F.col("k") * F.log10((seen + 0.1) / F.lit(float(room)))).alias("more"), F.sum(F.when(seen > 0, F.col("k")).otherwise(0)).alias("also"))
    out = join_on(scored, terms, ["doc_id"], ["body"], "left")
    return out.select(F.col("doc_id").alias(doc_id), (~F.col("training")).alias("held_out"), "w.n_tokens", (F.col("w.n_known") + F.coalesce("also", F.lit(0))).alias("n_known"),
                      F.lit(n_all).cast("long").alias("train_tokens"), (F.col("w.base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), F.col("w.lp").alias("score"), "n_bytes")
