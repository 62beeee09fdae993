"""Quality rules as a bitmask ledger: every rule is evaluated once, policies are masks over its bits.

Built from DataFrame functions only. The ledger holds the measurements and one failure bit per rule;
a policy of some version is a set of rules, and its verdicts and ablations are bitwise operations on
the stored bits, without another look at the texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.words import fresh
from tidemark.operators.ordering import compute_once

SPACE, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"

#: Measurements of a text, in ledger order.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts")

#: The rules by bit; each is a failure condition on the measurements. A rule never moves to another bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "shouting": "2 * n_shouts > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines AND n_dup_lines > 3",
}
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules; a document is kept when none of them failed."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


POLICIES = {p.version: p for p in (Policy("base", BASE), Policy("v1", tuple(RULES)))}


def _covered(starts: Column) -> Column:
    """Words inside 3-word windows that begin at the sorted places ``starts``."""
    return F.aggregate(starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
                       lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])


def ledger(docs: DataFrame, text: str = "text", into: str = "ledger") -> DataFrame:
    """``docs`` with a struct column: the measurements and ``failed``, the failure bits of all rules.

    Words are ``[^\\x20\\x09-\\x0D]+``. A 3-word window is known by its 64-bit hash within its own text.
    Whether a text has a repeated window at all is told by a hash set; only texts that do go on:
    with few repeated windows their places are looked up one by one, with many by a sort of
    (hash, place), so a long text costs no square of its length. NULL and empty texts have zero for every
    measurement and fail ``few_words``. Other columns and repeated rows stay as they are; ``into`` gets underscores
    before it if ``docs`` has such a column.
    """
    into = fresh(docs, into)
    src, at = fresh(docs, "_q"), lambda name: F.col(f"{src}.{name}")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    trimmed = F.btrim(body, F.lit(SPACE))
    d = docs.withColumn(src, F.struct(
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+")).alias("words"),
        F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("lines"),
        F.length(F.translate(body, SPACE, "")).alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).alias("n_symbols")))
    n, grams, repeated = F.size(at("words")), fresh(docs, "_g"), fresh(docs, "_r")
    d = d.withColumn(grams, F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(
        F.get(at("words"), i), F.get(at("words"), i + 1), F.get(at("words"), i + 2)))))
    # NULL where no window repeats: later steps are skipped for those texts
    d = d.withColumn(repeated, F.when(F.size(F.array_distinct(grams)) < F.size(grams), F.sort_array(grams)))
    d = d.withColumn(repeated, F.when(F.col(repeated).isNotNull(), F.array_distinct(F.filter(
        F.transform(F.col(repeated), lambda x, i: F.when((i > 0) & (x == F.get(F.col(repeated), i - 1)), x)), lambda x: x.isNotNull()))))
    few = _covered(F.filter(F.sequence(F.lit(0), F.size(grams) - 1), lambda i: F.array_contains(F.col(repeated), F.get(F.col(grams), i))))
    placed, order = fresh(docs, "_p"), F.arrays_zip(F.col(grams).alias("g"), F.sequence(F.lit(0), F.size(grams) - 1).alias("p"))
    d = d.withColumn(placed, F.when(F.size(repeated) > 32, F.sort_array(order)))
    same = lambda i, j: F.get(F.col(placed), i)["g"] == F.get(F.col(placed), j)["g"]
    many = _covered(F.sort_array(F.filter(F.transform(F.col(placed), lambda x, i: F.when(
        F.coalesce(same(i, i + 1), F.lit(False)) | ((i > 0) & F.coalesce(same(i, i - 1), F.lit(False))), x["p"])), lambda p: p.isNotNull())))
    shouts = F.size(F.filter(at("words"), lambda w: (F.length(w) > 1) & (w != F.lower(w)) & (w == F.upper(w))))
    measured = {
        "n_words": n, "word_chars": at("word_chars"), "n_symbols": at("n_symbols"),
        "n_dup_lines": F.size(at("lines")) - F.size(F.array_distinct(at("lines"))),
        "n_repeat_words": F.when(F.col(repeated).isNull(), F.lit(0)).when(F.size(repeated) > 32, many).otherwise(few),
        "n_lines": F.size(at("lines")), "n_shouts": shouts,
    }
    d = d.withColumn(into, F.struct(*[measured[m].cast("long").alias(m) for m in MEASURES]))
    bits = sum((F.when(_on(into, rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(RULES.values())), F.lit(0).cast("long"))
    return d.withColumn(into, F.col(into).withField("failed", bits)).drop(src, grams, repeated, placed)


def _on(ledger_column: str, rule: str) -> Column:
    """The rule with its measurements taken from the ledger."""
    for m in MEASURES:
        rule = rule.replace(m, f"`{ledger_column}`.{m}")
    return F.expr(rule)


def fails(bits: Column, policy: Policy) -> Column:
    return bits.bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def ablations(ledgers: DataFrame, policies: Sequence[Policy], bits: str = "failed") -> DataFrame:
    """Per policy and rule: documents that fail it, and documents only it removes (what its ablation would bring back)."""
    combos = ledgers.groupBy(F.col(bits).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rows = F.explode(F.array(*[F.struct(F.lit(p.version).alias("version"), F.lit(p.mask).cast("long").alias("mask"), F.lit(r).alias("rule"),
                                        F.lit(1 << list(RULES).index(r)).cast("long").alias("bit")) for p in policies for r in p.rules]))
    d = combos.select("bits", "n", rows.alias("p")).select("n", "p.*", F.col("bits").bitwiseAND(F.col("p.mask")).alias("_hit"))
    return d.groupBy("version", "rule").agg(
        F.sum("n").alias("n_documents"), F.sum(F.when(F.col("_hit") != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
        F.sum(F.when(F.col("_hit").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("_hit") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only_this"))


def kept_documents(docs: DataFrame, policy: Policy = POLICIES["v1"]) -> DataFrame:
    """The documents that fail no rule of the policy, with their own columns."""
    into, out = fresh(docs, "_ledger"), fresh(docs, "_rejected")
    # a filter on the ledger itself would be pushed below its steps, with all their expressions in it
    judged = compute_once(ledger(docs, into=into), **{out: fails(F.col(f"{into}.failed"), policy)})
    return judged.where(~F.col(out)).drop(into, out)
