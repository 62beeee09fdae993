"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Every source block sends an exactly drawn number of rows to every shard: its row of the matrix is
multivariate hypergeometric given the rows before, so all placements are equally likely. Rows are put in a random
order inside their block, exchanged by the drawn counts, and put in a random order again inside the shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.llm.words import fresh
from tidemark.session import shuffle_width, write_through

SHARDS = 16


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """An exact draw for any population; numpy's own generator stops at 10**9."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    total = good + bad
    spread = int(40 * (draws * (good / total) * (bad / total) * max(total - draws, 1) / (total - 1)) ** 0.5) + 50
    a, b = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(a, b, dtype=np.float64)  # log of P(k + 1) / P(k), summed up from the lower end
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def communication_matrix(block_sizes: list[int], shard_sizes: list[int], seed: int) -> list[list[int]]:
    """Rows to send from each block to each shard; row sums are the block sizes, column sums the shard sizes."""
    rng, left, matrix = np.random.default_rng(seed), list(shard_sizes), []
    for size in block_sizes:
        row, rest, behind = [], size, sum(left)
        for room in left:
            behind -= room
            row.append(hypergeometric(rng, room, behind, rest) if behind else rest)
            rest -= row[-1]
        left = [a - b for a, b in zip(left, row)]
        matrix.append(row)
    return matrix


def _random(row: Column, seed: int, use: str) -> Column:
    return F.xxhash64(row, F.lit(seed), F.lit(use))


def shard_columns(rows: DataFrame) -> tuple[str, str]:
    """Names of the two columns that ``assign`` adds: ``shard`` and ``slot``, with underscores before them where ``rows`` has such columns."""
    return fresh(rows, "shard"), fresh(rows, "slot")


def assign(rows: DataFrame, shards: int = SHARDS, seed: int = 17, blocks: int | None = None) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` (gapless from 0 in every shard; see ``shard_columns``); shard sizes differ by one row at most.

    Rows are numbered and written once, so every retry sees the same rows in the same blocks. A block is a hash range
    of row numbers, not of their content: hot keys and repeated rows make no block larger. The matrix has
    blocks x shards numbers, where ``blocks`` (default: four for each shuffle partition) sets the rows of one
    sort; the rows never pass through the driver. Pass narrow rows: texts need not be shuffled to be placed.
    An empty table stays empty.
    """
    spark = rows.sparkSession
    blocks = blocks or 4 * shuffle_width(spark)
    number, block, at, part, ends_at, ahead = (fresh(rows, x) for x in ("_number", "_block", "_at", "_part", "_ends", "_before"))
    shard, slot = shard_columns(rows)
    d = write_through(rows.withColumn(number, F.monotonically_increasing_id()), "rows")
    d = d.withColumn(block, F.pmod(_random(F.col(number), seed, "block"), F.lit(blocks)).cast("int"))
    counts = {r[0]: r[1] for r in d.groupBy(block).count().collect()}  # one number for each block
    sizes = [counts.get(b, 0) for b in range(blocks)]
    n = sum(sizes)
    matrix = communication_matrix(sizes, [n // shards + (s < n % shards) for s in range(shards)], seed)
    ends = spark.createDataFrame([(b, np.cumsum(row).tolist()) for b, row in enumerate(matrix)], f"{block} int, {ends_at} array<long>")

    # first permutation: the rows of a block in random order go to the shards by the drawn counts
    inside = W.partitionBy(block).orderBy(_random(F.col(number), seed, "local"), number)
    d = d.withColumn(at, F.row_number().over(inside)).join(ends, block)
    d = d.withColumn(shard, F.size(F.filter(ends_at, lambda e: e < F.col(at)))).drop(ends_at, at, block)

    # second permutation: a random order of each shard, sorted in ranges of its random keys
    ranges = max(1, blocks // shards)
    key = _random(F.col(number), seed, "shard")
    d = d.withColumn(part, F.floor((key / F.lit(2.0**64) + 0.5) * ranges).cast("int"))
    sizes = d.groupBy(shard, part).count()
    before = sizes.select(shard, part, F.coalesce(F.sum("count").over(
        W.partitionBy(shard).orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(ahead))
    order = F.row_number().over(W.partitionBy(shard, part).orderBy(key, number))
    return (d.withColumn(at, order).join(before, [shard, part])
            .withColumn(slot, (F.col(ahead) + F.col(at) - 1).cast("long")).select(*[f"`{c}`" for c in rows.columns], shard, slot))


def shard_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every document. A NULL text has no bytes, size 1 and checksum 0."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), (F.length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    return assign(rows, shards, seed)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = 17) -> None:
    """Whole rows, in slot order, in one folder for each shard, named by ``shard_columns``.

    Ranges of slots are dealt to the writers, so a shard is written by many tasks.
    """
    d, (shard, slot) = assign(docs, shards, seed), shard_columns(docs)
    d.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.mode("errorifexists").partitionBy(shard).parquet(path)
