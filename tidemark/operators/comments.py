"""Comment intelligence: words, topics, demand, questions, leads.

A comment frame has ``dataset``, ``text`` and the order columns named by the caller.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import rules as R, text as T
from tidemark.functions.text import CommentRules
from tidemark.operators.joins import contains_pairs
from tidemark.operators.ordering import compute_once, join_on, top_per_group
from tidemark.session import write_through

CJK_WORD = r"[一-鿿]{2,}|[a-zA-Z]{2,}"


def total_rows(df: DataFrame) -> Column:
    """Row count as a scalar subquery."""
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def word_counts(df: DataFrame, text: str = "text", pattern: str = CJK_WORD,
                stop_words: Iterable[str] = (), lower: bool = True, weight: Column | None = None) -> DataFrame:
    """Occurrences per word; ``weight`` is how often the text row stands for."""
    col = F.lower(F.col(text)) if lower else F.col(text)
    w = F.lit(1) if weight is None else weight
    tokens = df.select(F.explode(T.words(col, pattern)).alias("word"), w.alias("_w"))
    stop = list(stop_words)
    if stop:
        tokens = tokens.where(~F.col("word").isin(*stop))
    return tokens.groupBy("word").agg(F.sum("_w").cast("long").alias("n"))


def word_frequency(df: DataFrame, k: int = 100, **kw) -> DataFrame:
    return word_counts(df, **kw).orderBy(F.desc("n"), "word").limit(k)


def topic_assign(df: DataFrame, top_words: DataFrame, order: Sequence[str], k_words: int = 50,
                 k_samples: int = 5, other: str = "other") -> DataFrame:
    """Each text goes to the most frequent of the top words it contains; counts and first samples.

    The top words are at most ``k_words`` rows, so they are read once and become constants. Texts with none
    of the words all count as ``other``. Each text is looked at once; topic and order are written, and only the
    texts of the samples are read again.
    """
    words = [r["word"] for r in top_words.orderBy(F.desc("n"), "word").limit(k_words).collect()]
    hit = F.coalesce(*[F.when(F.contains(F.col("_low"), F.lit(w)), F.lit(w)) for w in words], F.lit(other))

    def assigned(d: DataFrame) -> DataFrame:
        return compute_once(compute_once(d, _low=F.lower("text")), topic=hit)

    by = [F.col(c) for c in order]
    found = write_through(assigned(df).select("topic", *order), "topics")
    sizes = found.groupBy("topic").agg(F.count(F.lit(1)).alias("n_texts"))
    first = top_per_group(found, ["topic"], by, k_samples).select(*order).distinct()
    samples = top_per_group(assigned(join_on(df, first, order, how="left_semi")).select("topic", *order, "text"), ["topic"], by, k_samples, "sample_no")
    return samples.join(sizes, "topic").select("topic", "n_texts", "sample_no", "text")


def demand_flags(df: DataFrame, categories: R.Rules, text: str = "text") -> DataFrame:
    """Boolean column per category (``is_<name>``) and ``is_demand`` for any of them."""
    for name, pattern in categories:
        df = df.withColumn(f"is_{name}", R.matches(F.col(text), pattern))
    any_hit = R.matches(F.col(text), "|".join(f"(?:{p})" for _, p in categories))
    return df.withColumn("is_demand", any_hit)


def demand_density(df: DataFrame, categories: R.Rules, key: str = "dataset") -> DataFrame:
    """Rows, demand rows, rows per category and demand share in percent, per account."""
    flagged = demand_flags(df, categories)
    out = flagged.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_demand").alias("demand"),
        *[F.count_if(f"is_{n}").alias(f"n_{n}") for n, _ in categories])
    return out.withColumn("density", F.col("demand") * 100.0 / F.col("total"))


def demand_mix(df: DataFrame, categories: R.Rules) -> DataFrame:
    """Share of each category in the demand rows and in all rows."""
    flagged = demand_flags(df, categories)
    one = flagged.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_demand").alias("demand"),
                      *[F.count_if(f"is_{n}").alias(f"n_{n}") for n, _ in categories])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("category"),
                                                   F.col(f"n_{n}").alias("n")) for n, _ in categories]))
                      .alias("c"), "total", "demand").select(
        "c.category", "c.n", F.try_divide(F.col("c.n") * F.lit(1.0), F.col("demand")).alias("share_of_demand"),
        F.try_divide(F.col("c.n") * F.lit(1.0), F.col("total")).alias("share_of_total"))


def first_match_mix(df: DataFrame, types: R.Rules, other: str = "other") -> DataFrame:
    """Distribution of the first matching type over distinct texts."""
    return (df.select("text").distinct()
            .withColumn("type", R.first_label(F.col("text"), types, other))
            .groupBy("type").agg(F.count(F.lit(1)).alias("n")))


def question_types(df: DataFrame, questions: R.Rules, order: Sequence[str], ending: str = r"[?？]\s*$",
                   k: int = 3, min_len: int = 6, max_len: int = 60, first_only: bool = False) -> DataFrame:
    """Per question word: rows, and the first k distinct texts.

    Only texts with a question ending, no tag mark and a plausible length count.
    """
    t = F.col("text")
    asked = df.where(F.length(t).between(min_len, max_len) & ~F.contains(t, F.lit("#")) & R.matches(t, ending))
    if first_only:
        labelled = asked.withColumn("question", R.first_label(t, questions, None)).where("question is not null")
    else:
        labelled = asked.withColumn("question", F.explode(R.all_labels(t, questions)))
    per_text = labelled.groupBy("question", "text").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(*order)).alias("_first"))
    sizes = per_text.groupBy("question").agg(F.sum("_n").alias("n_questions"))
    samples = top_per_group(per_text, ["question"], [F.col("_first"), F.col("text")], k, "sample_no")
    return samples.join(sizes, "question").select("question", "n_questions", "sample_no", "text")


def demand_signals(df: DataFrame, words: Iterable[str], order: Sequence[str], k: int = 5,
                   width: int = 120) -> DataFrame:
    """First k distinct texts with a demand word, shortened for the report."""
    first = (df.where(R.has_any(F.col("text"), words)).groupBy("text")
             .agg(F.min(F.struct(*order)).alias("_first")))
    shown = F.when(F.length("text") > width,
                   F.concat(F.substring("text", 1, width), F.lit("..."))).otherwise(F.col("text"))
    return first.orderBy("_first", "text").limit(k).select(shown.alias("signal"), "_first.*")


def text_spread(df: DataFrame) -> DataFrame:
    """Per distinct trimmed text: rows and number of datasets it appears in."""
    per = (df.select("dataset", T.strip(F.col("text")).alias("text"))
           .groupBy("text", "dataset").agg(F.count(F.lit(1)).alias("n")))
    return per.groupBy("text").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_datasets"))


def injected_texts(df: DataFrame, min_datasets: int = 4) -> DataFrame:
    """Texts repeated word for word in many datasets: platform content, not comments."""
    return text_spread(df).where(F.col("n_datasets") >= min_datasets)


def topic_board(df: DataFrame, rules: CommentRules, pattern: str = r"[一-鿿]{2,6}",
                stop_words: Iterable[str] = (), k: int = 10, min_datasets: int = 4) -> DataFrame:
    """Top words after topic noise, injected texts and tagged texts are removed.

    Works on distinct texts with their row counts, so a text that fills a third of the table is
    one row after the map side.
    """
    t = F.col("text")
    clean = text_spread(df).where((F.col("n_datasets") < min_datasets) & ~T.is_topic_noise(t, rules)
                                  & ~F.contains(t, F.lit(rules.tag_mark)))
    words = word_counts(clean, pattern=pattern, stop_words=stop_words, lower=False, weight=F.col("n"))
    top = words.orderBy(F.desc("n"), "word").limit(k)
    return top.withColumn("share", F.col("n") * 1.0 / total_rows(df))


def account_grades(density: DataFrame, watchlist: Iterable[str] = (), key: str = "dataset",
                   density_a: float = 11, demand_a: int = 60, line_density: float = 13,
                   line_demand: int = 50) -> DataFrame:
    """S (watch list), A (dense or many demand rows), else B; and the two-line pass flag."""
    named = F.col(key).isin(*watchlist) if watchlist else F.lit(False)
    return (density
            .withColumn("grade", F.when(named, "S").when(
                (F.col("density") >= density_a) | (F.col("demand") >= demand_a), "A").otherwise("B"))
            .withColumn("passes", (F.col("density") >= line_density) & (F.col("demand") >= line_demand)))


def digest_totals(df: DataFrame) -> DataFrame:
    """Raw and distinct texts per dataset."""
    return df.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_raw"),
                                     F.countDistinct("text").alias("n_distinct"))


def ordered_dedup(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First occurrence of every key."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*keys, "_row.*")


def drop_blocked(df: DataFrame, blocked: DataFrame, text: str = "text", key: str = "row_id",
                 phrase: str = "phrase", min_len: int = 8) -> DataFrame:
    """Drop texts that contain a blocked phrase of at least ``min_len`` characters.

    The list can be a large table: pairs come from an equi-join on pieces of the phrases.
    """
    hit = contains_pairs(df.select(key, text), key, text, blocked.where(F.length(phrase) >= min_len),
                         phrase, min_len).select(key).distinct()
    return df.join(hit, key, "left_anti")


def drop_own_text(df: DataFrame, captions: DataFrame, key: str = "row_id", owner: str = "dataset",
                  width: int = 30, min_len: int = 12) -> DataFrame:
    """Drop comments whose bare prefix is a prefix of an owner caption, or the other way round.

    Both prefixes have at least ``min_len`` characters, so related ones share the first ``min_len``.
    """
    caps = (captions.select(F.col(owner), T.bare_prefix(F.col("text"), width).alias("_cap"))
            .where(F.length("_cap") >= min_len).distinct()
            .withColumn("_head", F.substring("_cap", 1, min_len)))
    own = (df.select(key, owner, T.bare_prefix(F.col("text"), width).alias("_pre"))
           .where(F.length("_pre") >= min_len).withColumn("_head", F.substring("_pre", 1, min_len)))
    hit = (own.join(caps, [owner, "_head"])
           .where(F.startswith(F.col("_cap"), F.col("_pre")) | F.startswith(F.col("_pre"), F.col("_cap")))
           .select(key).distinct())
    return df.join(hit, key, "left_anti")


def peer_leads(df: DataFrame, known: DataFrame, service: str, sentence_marks: str,
               markers: Iterable[str] = (), min_len: int = 4, max_len: int = 30, **norm) -> DataFrame:
    """Short phrases that look like service accounts, by normalized name, with their spread."""
    t = F.col("text")
    cand = df.where(F.length(t).between(min_len, max_len) & R.matches(t, service)
                    & ~R.matches(t, sentence_marks))
    if markers:
        cand = cand.where(~R.has_any(t, markers))
    cand = cand.withColumn("name", T.normalize_name(t, **norm)).where(F.length("name") >= 3)
    agg = cand.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dataset").alias("spread"),
                                   F.min("text").alias("sample"))
    seen = known.select(T.normalize_name(F.col("name"), **norm).alias("name")).distinct()
    return agg.join(seen, "name", "left_anti")


def poll_policy(per_round: DataFrame, key: str = "dataset", round_no: str = "round", dense: float = 15,
                thin: float = 2, dense_days: int = 3, thin_days: int = 14, default_days: int = 7) -> DataFrame:
    """Poll interval from the density of the last two rounds; empty sets and thin accounts drop out.

    Rounds are one row per account and round, so the lag runs over a small table.
    """
    from pyspark.sql import Window as W

    prev = F.lag("density").over(W.partitionBy(key).orderBy(round_no))
    d = F.col("density")
    return (per_round.withColumn("prev_density", prev)
            .withColumn("action", F.when(F.col("total") == 0, "drop").when(d >= dense, "fast")
                        .when((d < thin) & (F.col("prev_density") < thin), "slow").otherwise("normal"))
            .withColumn("days", F.when(F.col("action") == "fast", dense_days)
                        .when(F.col("action") == "slow", thin_days)
                        .when(F.col("action") == "normal", default_days).cast("long")))
