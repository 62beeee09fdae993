"""Words of texts without spaces: the best path over the lattice of dictionary words, and term weights that are fitted once.

A dictionary is a table (word, n). A word costs floor(1000 ln(total / n)), a character that is no word as much as a word seen once, so costs
are whole numbers and the best path is the same everywhere. Of paths that cost the same, the one whose next word is longer wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.functions import text as T
from tidemark.operators.ordering import compute_once, order_statistics, top_per_group, upper_middle
from tidemark.session import write_through

#: Bytes of dictionary words that are sent to the executors; a larger dictionary is joined with the substrings of the texts.
SENT_BYTES = 16 << 20


def word_costs(dictionary: DataFrame) -> DataFrame:
    """(word, cost) and, under the empty word, the cost of a character that is no word. Repeated words add up; NULL and empty words and counts below one are left out."""
    d = dictionary.where("word is not null and word <> '' and n > 0").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    total = d.agg(F.coalesce(F.sum("n"), F.lit(1)).alias("t")).scalar()
    unknown = dictionary.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(1).cast("long").alias("n"))
    return d.unionByName(unknown).select("word", F.floor(1000 * F.log(total.cast("double") / F.col("n"))).cast("long").alias("cost"))


def best_path(text: str, costs: dict[str, int], longest: int) -> list[str]:
    """Words of the cheapest path, by dynamic programming from the end."""
    n, unknown = len(text), costs[""]
    best, step = [0] * (n + 1), [1] * n
    for i in range(n - 1, -1, -1):
        low = costs.get(text[i], unknown) + best[i + 1]
        for k in range(2, min(longest, n - i) + 1):
            cost = costs.get(text[i:i + k])
            if cost is not None and cost + best[i + k] <= low:
                low, step[i] = cost + best[i + k], k
        best[i] = low
    out, i = [], 0
    while i < n:
        out.append(text[i:i + step[i]])
        i += step[i]
    return out


def segmented(runs: DataFrame, dictionary: DataFrame, run: str = "run", into: str = "words", sent_bytes: int = SENT_BYTES) -> DataFrame:
    """``runs`` with an array of the words of each run (a text without separators; NULL and empty runs have none).

    Repeated runs are worked off each; pass distinct ones. A dictionary of at most ``sent_bytes`` (measured) is sent and the paths are found in Arrow batches;
    a larger one meets the substrings of the runs in a join, and the paths are folded from its edges, with the same result.
    """
    costs = write_through(word_costs(dictionary), "costs")
    size = costs.agg(F.sum(F.octet_length("word") + 8).alias("b"), F.max(F.length("word")).alias("l")).first()
    longest = max(1, size["l"])
    if size["b"] > sent_bytes:
        return _joined(runs, costs, run, into, longest)
    sent = runs.sparkSession.sparkContext.broadcast({r["word"]: r["cost"] for r in costs.collect()})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [best_path(t or "", sent.value, longest) for t in b.column(run).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(words, pa.list_(pa.string()))], [*b.schema.names, into])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema.fields)
    return runs.mapInArrow(work, f"{fields}, `{into}` array<string>")


def _joined(runs: DataFrame, costs: DataFrame, run: str, into: str, longest: int) -> DataFrame:
    unknown = costs.where("word = ''").select("cost").scalar()
    text = runs.select(F.col(run).alias("_run")).distinct().where("_run <> ''")
    starts = text.select("_run", F.explode(F.sequence(F.lit(1), F.length("_run"))).alias("i"))
    spans = starts.select("_run", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("_run") - F.col("i") + 1))).alias("k"))
    spans = spans.withColumn("word", F.substr("_run", F.col("i"), F.col("k")))
    edges = spans.join(costs, "word", "left").withColumn("cost", F.coalesce("cost", F.when(F.col("k") == 1, unknown))).where("cost is not null")
    at = edges.groupBy("_run", "i").agg(F.collect_list(F.struct("k", "cost")).alias("e"))  # one entry a length at most
    nodes = at.groupBy("_run").agg(F.reverse(F.array_sort(F.collect_list(F.struct("i", "e")))).alias("nodes"))
    # from the end: the first element is the best of the place just passed, {cost, -length}
    low = lambda node, acc: F.array_min(F.transform(node["e"], lambda e: F.struct(
        (e["cost"] + F.element_at(acc, e["k"])["c"]).alias("c"), (-e["k"]).cast("long").alias("k"))))
    first = F.array(F.struct(F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("k")))
    path = nodes.withColumn("best", F.aggregate("nodes", first, lambda acc, node: F.concat(F.array(low(node, acc)), acc)))
    step = lambda acc, i: F.when(acc["next"] == i, F.struct(F.concat(acc["w"], F.array(F.substr("_run", i, -F.element_at("best", i)["k"].cast("int")))).alias("w"),
                                                            (i - F.element_at("best", i)["k"]).cast("int").alias("next"))).otherwise(acc)
    start = F.struct(F.array().cast("array<string>").alias("w"), F.lit(1).alias("next"))
    found = path.select("_run", F.aggregate(F.sequence(F.lit(1), F.length("_run")), start, step, lambda acc: acc["w"]).alias("_words"))
    return runs.join(found, F.col(run) == F.col("_run"), "left").withColumn(into, F.coalesce("_words", F.array().cast("array<string>"))).drop("_run", "_words")


def segmented_frequency(df: DataFrame, dictionary: DataFrame, text: str = "text", pattern: str = "[a-z]+", stop_words=(), shortest: int = 2, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(word, n): how often each word of ``shortest`` characters or more stands in the texts' runs of ``pattern``. Distinct runs are segmented once."""
    runs = df.select(F.explode(T.words(F.lower(F.col(text)), pattern)).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    words = segmented(write_through(runs, "runs"), dictionary, sent_bytes=sent_bytes).select(F.explode("words").alias("word"), "n").where(F.length("word") >= shortest)
    if stop_words:
        words = words.where(~F.col("word").isin(*stop_words))
    return words.groupBy("word").agg(F.sum("n").alias("n"))


def fit_term_weights(df: DataFrame, text: str, pattern: str, version: str) -> DataFrame:
    """(version, word, weight) with ln(documents / document frequency), and the weight of unknown words, the upper median, under the empty word.

    A fitted table is stored and applied to later texts, so their weights don't move with the texts at hand. NULL texts count as documents.
    """
    words = compute_once(df.select(text), _w=F.array_distinct(T.words(F.lower(F.coalesce(text, F.lit(""))), pattern))).select(F.explode("_w").alias("word"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    fitted = write_through(words.groupBy("word").agg(F.count(F.lit(1)).alias("df")).select("word", F.log(total / F.col("df")).alias("weight")), "term-weights")
    median = order_statistics(fitted, [], ["weight"], {"median": upper_middle}).select(F.lit("").alias("word"), F.col("median_weight").alias("weight"))
    return fitted.unionByName(median).select(F.lit(version).alias("version"), "word", "weight")


def weighted_keywords(df: DataFrame, group: str, text: str, pattern: str, weights: DataFrame, version: str, k: int = 30) -> DataFrame:
    """Top ``k`` words per group by term share x fitted weight, in millionths; words that the table doesn't have weigh its median.

    Words are rows at once, and a task adds them up before the shuffle. ``weights`` may hold other versions too.
    """
    own = weights.where(F.col("version") == version)
    unknown = own.where("word = ''").agg(F.max("weight").alias("w")).scalar()
    listed = df.select(group, F.explode(T.words(F.lower(F.col(text)), pattern)).alias("word"))
    tf = write_through(listed.groupBy(group, "word").agg(F.count(F.lit(1)).alias("n")), "terms")
    size = tf.groupBy(group).agg(F.sum("n").alias("total"))
    known = own.where("word <> ''").select("word", "weight")
    scored = tf.join(size, group).join(known, "word", "left").withColumn("known", F.col("weight").isNotNull()).withColumn(
        "weight", F.floor(F.col("n") / F.col("total") * F.coalesce("weight", unknown) * 1000000))
    return top_per_group(scored.select(group, "word", "n", "weight", "known"), [group], [F.desc("weight"), F.asc("word")], k, "rank")
