"""Rule tables (label, pattern) turned into column expressions that stay inside codegen."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

Rules = Sequence[tuple[str, str]]


def words_pattern(words: Iterable[str]) -> str:
    """One alternation for a word list; longest first so that overlaps match whole words."""
    quoted = sorted({re.escape(w) for w in words if w}, key=lambda w: (-len(w), w))
    return "(?:" + "|".join(quoted) + ")" if quoted else "[^\\s\\S]"


def has_any(col: Column, words: Iterable[str]) -> Column:
    return F.coalesce(col, F.lit("")).rlike(words_pattern(words))


def matches(col: Column, pattern: str) -> Column:
    return F.coalesce(col, F.lit("")).rlike(pattern)


def first_label(col: Column | Sequence[Column], rules: Rules, default: str | None) -> Column:
    """Label of the first rule that matches; with several columns, all rules on the first come first."""
    cols = [col] if isinstance(col, Column) else list(col)
    out = None
    for c in cols:
        for label, pattern in rules:
            hit = matches(c, pattern)
            out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def all_labels(col: Column, rules: Rules, default: str | None = None) -> Column:
    """Array of the labels of all rules that match, in rule order."""
    found = F.array_compact(F.array(*[F.when(matches(col, p), label) for label, p in rules]))
    if default is None:
        return found
    return F.when(F.size(found) == 0, F.array(F.lit(default))).otherwise(found)


def dictionary_labels(col: Column, table: Mapping[str, Iterable[str]]) -> Column:
    """Array of the dictionary labels with at least one keyword in the text."""
    return all_labels(col, [(label, words_pattern(ws)) for label, ws in table.items()])


def count_words(col: Column, words: Iterable[str]) -> Column:
    """How many different words of the list occur in the text."""
    text = F.coalesce(col, F.lit(""))
    return reduce(lambda a, b: a + b,
                  [F.contains(text, F.lit(w)).cast("long") for w in words], F.lit(0).cast("long"))


def weigh(col: Column, weighted: Iterable[tuple[Iterable[str], int]]) -> Column:
    """Sum of weight x different words found, over several word lists."""
    return reduce(lambda a, b: a + b, [count_words(col, ws) * F.lit(w).cast("long") for ws, w in weighted])


def best_label(scores: Mapping[str, Column], default: str | None) -> Column:
    """Label with the highest score above zero; the earlier label wins a tie."""
    top = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    out = F.when(top <= 0, F.lit(default))
    for label, s in scores.items():
        out = out.when(s == top, label)
    return out


def bucket_label(col: Column, bounds: Sequence[tuple[float, str]], last: str, closed: str = "left") -> Column:
    """Ordered buckets: value < bound (``left``) or value <= bound (``right``) gives the label."""
    out = None
    for bound, label in bounds:
        hit = col < bound if closed == "left" else col <= bound
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.when(col.isNull(), F.lit(None)).otherwise(out.otherwise(F.lit(last)))
