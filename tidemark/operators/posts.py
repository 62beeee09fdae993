"""Factor analysis of posts: viral flag, buckets, tags, titles, authors, structure."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import rules as R, text as T
from tidemark.operators.ordering import (join_on, long_metrics, number_rows, order_statistics, rank_values,
                                         top_per_group)


def viral_flag(df: DataFrame, score: str, row_id: str, share: int = 10, name: str = "viral") -> DataFrame:
    """Flag the first max(1, n div share) rows by score, ties broken by the smaller id.

    The cut value comes from ranks of distinct scores; only when rows tie at the cut are their ids
    ranked, so there is no global sort. The cut itself is one row, read once, so that every later
    use of the flag is a plain comparison that reaches the scan.
    """
    neg = df.select((-F.col(score).cast("double")).alias("s"))
    k = F.greatest(F.lit(1), F.floor(F.col("n_total") / share))
    cut = (rank_values(neg, [], "s").where((F.col("n_before") < k) & (k <= F.col("n_before") + F.col("n")))
           .select((-F.col("s")).alias("score"), (k - F.col("n_before")).alias("need"), "n").first())
    if cut is None:
        return df.withColumn(name, F.lit(False))
    above, level = F.col(score) > cut["score"], F.col(score) == cut["score"]
    if cut["need"] < cut["n"]:
        ids = rank_values(df.where(level).select(F.col(row_id).alias("i")), [], "i")
        last = ids.where(F.col("n_before") == cut["need"] - 1).select("i").first()["i"]
        level = level & (F.col(row_id) <= F.lit(last))
    return df.withColumn(name, F.coalesce(above | level, F.lit(False)))


def overview(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Sum, truncated mean, median and maximum per metric, one row per metric."""
    long = long_metrics(df, [], metrics).withColumnRenamed("metric", "name")
    s = order_statistics(long, ["name"], ["value"], {"median": 0.5, "high": 1.0}, means=True)
    return s.select(F.col("name").alias("metric"), F.col("n_value").alias("n"),
                    (F.col("mean_value") * F.col("n_value")).alias("total"), F.floor("mean_value").alias("mean"),
                    F.col("median_value").alias("median"), F.col("high_value").alias("high"))


def bucket_stats(df: DataFrame, bucket: Column, metrics: Sequence[str]) -> DataFrame:
    """Rows and truncated means per ordered bucket; rows with no bucket value stay out."""
    return (df.withColumn("bucket", bucket).where("bucket is not null").groupBy("bucket")
            .agg(F.count(F.lit(1)).alias("n"), *[F.floor(F.avg(m)).alias(f"avg_{m}") for m in metrics]))


def tag_performance(df: DataFrame, tags: Column, metrics: Sequence[str], least: int = 3, k: int = 20) -> DataFrame:
    """Tags used often enough, by average of the first metric."""
    per = (df.select(F.explode(tags).alias("tag"), *metrics).groupBy("tag")
           .agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(f"avg_{m}") for m in metrics])
           .where(F.col("n") >= least))
    return per.orderBy(F.desc(f"avg_{metrics[0]}"), "tag").limit(k)


def title_feature_stats(df: DataFrame, features: Mapping[str, Column], metrics: Sequence[str]) -> DataFrame:
    """Rows and averages for every ``feature=value``, all features in one pass."""
    pairs = F.explode(F.array(*[F.concat(F.lit(f"{n}="), c.cast("string")) for n, c in features.items()]))
    return (df.select(pairs.alias("feature"), *metrics).groupBy("feature")
            .agg(F.count(F.lit(1)).alias("n"), *[F.floor(F.avg(m)).alias(f"avg_{m}") for m in metrics]))


def viral_rate_by(df: DataFrame, dims: Mapping[str, Column], flag: str = "viral") -> DataFrame:
    """Rows, viral rows and viral share per value of every dimension, in one pass.

    Array dimensions count each element.
    """
    def tagged(name: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("dim"), v.cast("string").alias("value")))

    arrays = F.concat(*[tagged(n, c) for n, c in dims.items()])
    return (df.select(F.explode(arrays).alias("_d"), flag).groupBy("_d.dim", "_d.value")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("n_viral"))
            .withColumn("viral_rate", F.col("n_viral") * 100.0 / F.col("n")))


def one(c: Column) -> Column:
    return F.array(c.cast("string"))


def tag_combos(df: DataFrame, tags: Column, flag: str = "viral", least: int = 3, k: int = 50) -> DataFrame:
    """Sorted tag sets of two or more tags, by frequency, with their viral rate."""
    combos = (df.select(F.array_sort(tags).alias("_t"), flag).where(F.size("_t") >= 2)
              .groupBy(F.array_join("_t", "+").alias("combo"))
              .agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("n_viral")).where(F.col("n") >= least))
    return (combos.withColumn("viral_rate", F.col("n_viral") * 100.0 / F.col("n"))
            .orderBy(F.desc("n"), "combo").limit(k))


def author_consistency(df: DataFrame, author: str, metric: str, flag: str = "viral") -> DataFrame:
    v = F.col("n_viral")
    return (df.groupBy(author).agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("n_viral"),
                                   F.avg(metric).alias("avg_metric"), F.max(metric).alias("max_metric"))
            .withColumn("viral_rate", v * 100.0 / F.col("n"))
            .withColumn("label", F.when(v >= 3, "steady").when(v >= 1, "occasional").otherwise("none")))


def viral_against_normal(df: DataFrame, metrics: Sequence[str], flag: str = "viral") -> DataFrame:
    """Mean and median of every metric in both classes and the relative difference of the means."""
    d = df.withColumn("side", F.when(F.col(flag), "viral").otherwise("normal"))
    stat = order_statistics(d, ["side"], metrics, {"median": 0.5}, means=True)
    wide = stat.select("side", F.explode(F.array(*[F.struct(
        F.lit(m).alias("metric"), F.col(f"mean_{m}").alias("mean"), F.col(f"median_{m}").alias("median"))
        for m in metrics])).alias("r")).select("side", "r.*")
    both = wide.groupBy("metric").agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s}")
                                        for c in ("mean", "median") for s in ("viral", "normal")])
    return both.withColumn("diff_pct", F.try_divide((F.col("mean_viral") - F.col("mean_normal")) * 100, F.col("mean_normal")))


def word_lift(df: DataFrame, text: str, flag: str, pattern: str, k: int = 100) -> DataFrame:
    """Word rate per 100 texts in the flagged class minus the rate in the rest, top words of the class."""
    words = df.select(F.col(flag).alias("on"), F.explode(T.words(F.col(text), pattern)).alias("word"))
    counts = words.groupBy("word").agg(F.count_if("on").alias("n_on"), F.count_if(~F.col("on")).alias("n_off"))
    size = df.agg(F.struct(F.count_if(flag).alias("a"), F.count_if(~F.col(flag)).alias("b")).alias("s")).scalar()
    top = counts.where("n_on > 0").orderBy(F.desc("n_on"), "word").limit(k).withColumn("_s", size)
    return (top.withColumn("rate_on", F.col("n_on") * 100.0 / F.col("_s.a"))
            .withColumn("rate_off", F.try_divide(F.col("n_off") * 100.0, F.col("_s.b")))
            .withColumn("lift", F.col("rate_on") - F.coalesce(F.col("rate_off"), F.lit(0.0))).drop("_s"))


def group_rollup(df: DataFrame, key: str, author: str, metrics: Sequence[str], type_col: str | None = None,
                 ratios: Mapping[str, Column] | None = None, k_types: int = 2) -> DataFrame:
    """Posts, authors, averages, median ratios and the dominant types per country or topic."""
    ratios = dict(ratios or {})
    d = df.withColumns(ratios) if ratios else df
    out = d.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(author).alias("n_authors"),
                             *[F.avg(m).alias(f"avg_{m}") for m in metrics])
    if ratios:
        out = join_on(out, order_statistics(d, [key], list(ratios), {"median": 0.5})
                      .select(key, *[f"median_{r}" for r in ratios]), [key], how="left")
    if type_col:
        per = d.groupBy(key, type_col).agg(F.count(F.lit(1)).alias("_n"))
        top = top_per_group(per, [key], [F.desc("_n"), F.col(type_col)], k_types, "_r")
        out = join_on(out, top.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
            F.struct("_r", F.col(type_col).cast("string").alias("t")))), lambda s: s["t"]), ",").alias("top_types")), [key])
    return out


def comment_report(comments: DataFrame, post: str, likes: str, text: str, row: str, k: int | None = None) -> DataFrame:
    """Per post: comments fetched, the comment with most likes and its share of all likes."""
    out = comments.groupBy(post).agg(
        F.count(F.lit(1)).alias("n_comments"), F.sum(likes).alias("sum_likes"),
        F.min_by(F.struct(F.col(text).alias("top_text"), F.col(likes).alias("top_likes")),
                 F.struct(-F.col(likes), F.col(row))).alias("_t"))
    out = out.select(post, "n_comments", "sum_likes", "_t.*") \
        .withColumn("top_share", F.try_divide(F.col("top_likes") * 1.0, F.col("sum_likes")))
    return out.orderBy(F.desc("n_comments"), post).limit(k) if k else out


def hook_pairs(df: DataFrame, hooks: Column) -> DataFrame:
    """How often two hooks share a title, and the share of the first hook's titles."""
    d = df.select(hooks.alias("h"))
    pairs = (d.select(F.explode("h").alias("hook"), "h").select("hook", F.explode("h").alias("partner"))
             .groupBy("hook", "partner").agg(F.count(F.lit(1)).alias("n")))
    alone = pairs.where("hook = partner").select("hook", F.col("n").alias("n_hook"))
    both = pairs.where("hook <> partner").join(alone, "hook")
    best = both.groupBy("hook").agg(F.min_by("partner", F.struct(-F.col("n"), F.col("partner"))).alias("b"))
    return (both.join(best, "hook").withColumn("share", F.col("n") * 1.0 / F.col("n_hook"))
            .withColumn("is_best", F.col("partner") == F.col("b")).drop("b"))


def structure_columns(df: DataFrame, title: str, body: str, rules: R.Rules, default: str, cta: str, ask: str,
                      roles: Sequence[str], tags: Column | None = None) -> DataFrame:
    """Reusable structure of a post: hook, length, paragraphs, call to action, role terms."""
    b = F.coalesce(F.col(body), F.lit(""))
    paras = F.filter(F.split(b, r"\n+"), lambda p: T.strip(p) != "")
    role = F.array_compact(F.array(*[F.when(F.contains(b, F.lit(r)), r) for r in roles]))
    n = F.size(paras)
    return (df.withColumn("hook", R.first_label([F.coalesce(F.col(title), F.lit("")), F.substring(b, 1, 60)], rules, default))
            .withColumn("chars", F.length(b).cast("long")).withColumn("paras", n.cast("long"))
            .withColumn("avg_para_len", F.when(n > 0, F.round(F.length(b) / n)).otherwise(0).cast("long"))
            .withColumn("cta", F.when(R.matches(b, cta), "direct").when(R.matches(b, ask), "question").otherwise("none"))
            .withColumn("tags_n", (F.size(tags) if tags is not None else F.lit(0)).cast("long"))
            .withColumn("role_terms", F.when(F.size(role) > 0, F.array_join(F.slice(role, 1, 4), ",")).otherwise("-")))


def structure_matrix(df: DataFrame, account: str, unit: str, likes: str, saves: str,
                     default: str, alarm: float = 0.3) -> DataFrame:
    """Per account and unit: posts, median likes, median save ratio, fallback share and alarm."""
    d = df.withColumn("save_ratio", F.try_divide(F.col(saves) * 1.0, F.col(likes)))
    med = order_statistics(d, [account, unit], [likes, "save_ratio"], {"median": 0.5})
    fallback = d.groupBy(account).agg(
        (F.count_if(F.col(unit) == default) * 1.0 / F.count(F.lit(1))).alias("fallback_share"))
    return (join_on(med, fallback, [account]).select(
        account, unit, F.col(f"n_{likes}").alias("n"), F.col(f"median_{likes}").alias("median_likes"),
        F.col("median_save_ratio").alias("median_save_ratio"), "fallback_share")
        .withColumn("alarm", F.col("fallback_share") > alarm))


def top_third_structure(df: DataFrame, account: str, likes: str, row_id: str, metrics: Sequence[str]) -> DataFrame:
    """Average structure of the best third (at least one post) of every account.

    The cut is the order statistic of likes at the third; ties at the cut go to the smaller id.
    """
    sizes = df.groupBy(account).agg(F.count(F.lit(1)).alias("_n"))
    numbered = number_rows(df.select(account, likes, row_id, *[m for m in metrics if m != likes]),
                           -F.col(likes), row_id, "_pos", [account])
    best = join_on(numbered, sizes, [account]).where(
        F.col("_pos") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 3)))
    return best.groupBy(account).agg(F.count(F.lit(1)).alias("n_top"),
                                     *[F.avg(m).alias(f"avg_{m}") for m in metrics])


def opportunity_board(df: DataFrame, dims: Mapping[str, Sequence[str]], multiple: str, save_ratio: str,
                      least: int = 1) -> DataFrame:
    """Median multiple of the account baseline and median save ratio for several groupings at once."""
    views = F.array(*[F.struct(F.lit(n).alias("view"), F.concat_ws(" | ", *[F.col(c) for c in cs]).alias("label"))
                      for n, cs in dims.items()])
    d = df.select(F.explode(views).alias("v"), multiple, save_ratio).select("v.*", multiple, save_ratio)
    med = order_statistics(d, ["view", "label"], [multiple, save_ratio], {"median": 0.5})
    return med.select("view", "label", F.col(f"n_{multiple}").alias("n"),
                      F.col(f"median_{multiple}").alias("median_multiple"),
                      F.col(f"median_{save_ratio}").alias("median_save_ratio")).where(F.col("n") >= least)


def order_opportunities(board: DataFrame, k: int) -> DataFrame:
    """Unknown medians sort as 0."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return board.orderBy(z("median_save_ratio").desc(), z("median_multiple").desc(), F.desc("n"), "view", "label").limit(k)


def track_vote(df: DataFrame, account: str, text: Column, signal: str, least: float = 0.35,
               yes: str = "geo_map", no: str = "overseas_service") -> DataFrame:
    """Track per account by the share of posts with a signal, and the majority track of all accounts."""
    per = df.groupBy(account).agg(F.count(F.lit(1)).alias("n"), F.count_if(R.matches(text, signal)).alias("hits"))
    per = per.withColumn("rate", F.col("hits") * 1.0 / F.col("n")) \
        .withColumn("track", F.when(F.col("rate") > least, yes).otherwise(no))
    votes = per.agg(F.when(F.count_if(F.col("track") == yes) > F.count_if(F.col("track") == no), yes)
                    .otherwise(no).alias("m")).scalar()
    return per.withColumn("majority", votes)


def save_ratio_bands(df: DataFrame, saves: str, likes: str) -> DataFrame:
    """Rows per band of saves over likes; values between the bands stay unbanded."""
    r = F.try_divide(F.col(saves) * 1.0, F.col(likes))
    band = (F.when(r < 0.06, "weak").when(r.between(0.20, 0.45), "list demand").when(r > 1.0, "directory demand")
            .otherwise("unbanded"))
    return df.withColumn("band", F.when(r.isNull(), "unknown").otherwise(band)).groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.avg(r).alias("avg_ratio"))


def hot_comment_words(comments: DataFrame, text: str, pattern: str, k: int = 30) -> DataFrame:
    return (comments.select(F.explode(T.words(F.col(text), pattern)).alias("word")).groupBy("word")
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(k))


def commented_effect(posts: DataFrame, comments: DataFrame, key: str, metric: str) -> DataFrame:
    """Mean metric of posts with and without collected comments."""
    has = comments.select(key).distinct().withColumn("_c", F.lit(True))
    return (posts.join(has, key, "left").groupBy(F.coalesce(F.col("_c"), F.lit(False)).alias("commented"))
            .agg(F.count(F.lit(1)).alias("n"), F.floor(F.avg(metric)).alias("avg_metric")))


def factor_ranking(*parts: DataFrame) -> DataFrame:
    """Union of (factor, n, avg_metric) tables, best first."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.desc("avg_metric"), "factor")

