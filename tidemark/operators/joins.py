"""Joins and merges: substring joins, latest rows, upserts, as-of fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.ordering import top_per_group


#: Names that ``contains_pairs`` sends to every executor (some 20 MB) before it shuffles both sides instead.
SENT_NAMES = 100_000


def char_pieces(col: Column, n: int) -> Column:
    """All n-character pieces of a text, in one linear scan."""
    return F.regexp_extract_all(col, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def char_grams(col: Column, n: int) -> Column:
    return F.array_distinct(char_pieces(col, n))


def contains_pairs(texts: DataFrame, key: str, text: str, names: DataFrame, name: str, n: int = 3) -> DataFrame:
    """Exact pairs (key, name) where the text contains the name (names of at least n characters).

    A text that contains a name contains every n-character piece of it. Each name is looked up by
    the one of its pieces that fewest names share, so names with a common prefix do not meet in one
    join key; candidates are then verified on the whole text. Up to ``SENT_NAMES`` names are sent to
    the executors, so the pieces of the corpus meet them where they are read and only matches are
    shuffled; more names are joined by a shuffle of both sides.
    """
    ns = names.where(F.length(name) >= n).select(F.col(name).alias("_name")).distinct()
    pieces = ns.select("_name", F.explode(char_grams(F.col("_name"), n)).alias("_piece"))
    shared = pieces.groupBy("_piece").agg(F.count(F.lit(1)).alias("_df"))
    rare = (pieces.join(shared, "_piece").groupBy("_name")
            .agg(F.min_by("_piece", F.struct("_df", "_piece")).alias("_piece")))
    grams = texts.select(key, F.explode(char_pieces(F.col(text), n)).alias("_piece"))
    if ns.limit(SENT_NAMES + 1).count() <= SENT_NAMES:
        rare = F.broadcast(rare)
    cand = grams.join(rare, "_piece").select(key, "_name").distinct()
    return (cand.join(texts.select(key, F.col(text).alias("_text")), key)
            .where(F.contains(F.col("_text"), F.col("_name")))
            .select(key, F.col("_name").alias(name)).distinct())


def longest_contained(texts: DataFrame, key: str, text: str, names: DataFrame, name: str, n: int = 3) -> DataFrame:
    """The longest name contained in each text; the smaller name wins among equal lengths."""
    pairs = contains_pairs(texts, key, text, names, name, n)
    return pairs.groupBy(key).agg(F.min_by(name, F.struct(-F.length(name), F.col(name))).alias(name))


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One latest row per key by an aggregate, so ties cannot duplicate a key."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
            .select(*keys, "_r.*"))


def join_latest(accounts: DataFrame, rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    return accounts.join(latest_rows(rows, [key], order), key, "left")


def latest_and_previous(rows: DataFrame, key: str, order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Latest and previous value of every column, and the number of rows per key."""
    top2 = top_per_group(rows.select(key, *dict.fromkeys([*order, *cols])), [key],
                         [F.desc(c) for c in order], 2, "_rn")
    pair = top2.groupBy(key).agg(
        *[F.max(F.when(F.col("_rn") == 1, F.col(c))).alias(f"last_{c}") for c in cols],
        *[F.max(F.when(F.col("_rn") == 2, F.col(c))).alias(f"prev_{c}") for c in cols])
    return pair.join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")), key)


def unseen(df: DataFrame, keys: Sequence[str], *seen: DataFrame) -> DataFrame:
    """Rows whose key is in none of the seen, rejected or processed tables."""
    for s in seen:
        df = df.join(s.select(*keys).distinct(), list(keys), "left_anti")
    return df


def watched(df: DataFrame, keys: Sequence[str], names: DataFrame) -> DataFrame:
    return df.join(names.select(*keys).distinct(), list(keys), "left_semi")


def merge_known(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = (),
                keep_first: Sequence[str] = (), empty_is_unknown: bool = True) -> DataFrame:
    """Upsert that never overwrites a known value with NULL or an empty text.

    ``new`` may hold several rows per key; the newest known value of each column wins. Columns in
    ``keep_first`` keep the stored value once it is known.
    """
    cols = [c for c in old.columns if c not in keys]
    text_cols = {f.name for f in new.schema.fields if f.dataType.simpleString() == "string"}

    def known(c: str) -> Column:
        return F.nullif(F.col(c), F.lit("")) if empty_is_unknown and c in text_cols else F.col(c)

    by = F.struct(*order) if order else F.lit(0)
    fresh = new.groupBy(*keys).agg(*[
        F.max_by(known(c), F.when(known(c).isNotNull(), by)).alias(f"_new_{c}")
        for c in cols if c in new.columns])
    merged = old.join(fresh, list(keys), "full")
    out = []
    for c in cols:
        if c not in new.columns:
            out.append(F.col(c))
        elif c in keep_first:
            out.append(F.coalesce(F.col(c), F.col(f"_new_{c}")).alias(c))
        else:
            out.append(F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c))
    return merged.select(*keys, *out)


def replace_rows(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert-or-replace on the key."""
    return unseen(old, keys, new).unionByName(new, allowMissingColumns=True)


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert-or-ignore on the key."""
    return old.unionByName(unseen(new, keys, old), allowMissingColumns=True)


def inherit_labels(today: DataFrame, yesterday: DataFrame, key: str, cols: Sequence[str],
                   fresh: str = "?NEW") -> DataFrame:
    """Labels of the previous day by name; rows without one are marked as new."""
    prev = yesterday.select(key, *[F.col(c).alias(f"_{c}") for c in cols]).dropDuplicates([key])
    out = today.join(prev, key, "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(f"_{c}"), F.lit(fresh))).drop(f"_{c}")
    return out


def recent_before(left: DataFrame, right: DataFrame, keys: Sequence[str], day: str, value: str,
                  days: int = 5) -> DataFrame:
    """Value of the most recent earlier day within ``days`` days, NULL when there is none.

    A bounded look-back is an equi-join on (key, day): every right row is offered to the days it
    may serve, so no range join is needed.
    """
    offered = right.select(*keys, F.col(day).alias("_from"), F.col(value).alias("_value"),
                           F.explode(F.sequence(F.lit(1), F.lit(days))).alias("_d"))
    offered = offered.withColumn(day, F.date_add("_from", F.col("_d")))
    best = offered.groupBy(*keys, day).agg(F.max_by(F.struct(F.col("_from").alias("base_day"),
                                                             F.col("_value").alias(f"base_{value}")),
                                                    F.col("_from")).alias("_b"))
    return left.join(best, [*keys, day], "left").select(*left.columns, "_b.*")


def resolve_edges(edges: DataFrame, units: DataFrame, src: str = "src", dst: str = "dst",
                  unit: str = "unit_id") -> DataFrame:
    """Edge targets looked up among the units: ``valid`` or ``target_missing``."""
    known = units.select(F.col(unit).alias(dst), F.lit(True).alias("_known")).distinct()
    return (edges.join(known, dst, "left")
            .withColumn("status", F.when(F.col("_known"), "valid").otherwise("target_missing")).drop("_known"))
