"""Account labels, scores, tiers and gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import lexicons, rules as R
from tidemark.operators.ordering import order_statistics, top_per_group


def geo_unit(text: Column, global_words: Sequence[str], regions: Mapping[str, str], countries: Sequence[str],
             cities: Mapping[str, str], labels: Mapping[str, str]) -> Column:
    """Geographic scale of a text: global, region, region with several countries, city, country, many."""
    found = F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(text, F.lit(k)), v) for k, v in regions.items()])))
    named = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(c)), c) for c in countries]))
    towns = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(c)), c) for c in cities]))
    owners = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(c)), v) for c, v in cities.items()]))
    places = F.array_distinct(F.concat(named, owners))

    def named_as(label: str, what: Column) -> Column:
        return F.concat(F.lit(labels[label] + " ("), what, F.lit(")"))

    return (F.when(R.has_any(text, global_words), labels["global"])
            .when((F.size(found) > 0) & (F.size(places) >= 2), labels["region_many"])
            .when(F.size(found) > 0, named_as("region", F.array_min(found)))
            .when((F.size(places) == 1) & (F.size(towns) > 0), named_as("city", F.array_min(towns)))
            .when(F.size(places) == 1, named_as("country", F.get(places, F.lit(0))))
            .when(F.size(places) >= 2, labels["many"]).otherwise(labels["none"]))


@dataclass(frozen=True)
class Signals:
    """Word lists and patterns behind the account scores; every list is (words, weight)."""

    identity: Mapping[str, R.Rules] = field(default_factory=dict)
    identity_weights: Mapping[str, Mapping[str, int]] = field(default_factory=dict)
    whitelist: Sequence[str] = ()
    domains: Mapping[str, Sequence[tuple[Sequence[str], int]]] = field(default_factory=dict)
    by_field: Mapping[str, tuple[Sequence[str], int, int]] = field(default_factory=dict)
    region_direct: Sequence[str] = ()
    region_context: Sequence[str] = ()
    creator: Sequence[str] = ()


def whitelist_score(nick: Column, names: Sequence[str]) -> Column:
    """80 for a listed name, 75 for one with at most four more characters after it, 70 for one after at most three."""
    # fixed values: the weights, the lengths and the characters that do not count after a name
    score = F.lit(0)
    for w in names:
        at = F.instr(nick, w)
        after = F.btrim(F.substr(nick, F.lit(len(w) + 1)), F.lit("-_·. "))
        score = F.greatest(score, F.when((at == 1) & (F.length(after) <= 4), 75).when(
            at.between(1, 4) & (at + len(w) - 1 == F.length(nick)), 70).otherwise(0))
    return F.when(nick.isin(*names), 80).otherwise(score).cast("long")


def account_features(df: DataFrame, nick: str, sig: str, verify: str | None, s: Signals,
                     official: Column | None = None) -> DataFrame:
    """Identity, domain, region and creator scores of an account, all as sums of weighted hits.

    ``identity`` maps media / enterprise / personal to (field, pattern) rules: the first rule on
    ``nick`` and on ``verify`` counts, every rule on ``text`` counts.
    """
    n, g = F.lower(F.coalesce(F.col(nick), F.lit(""))), F.lower(F.coalesce(F.col(sig), F.lit("")))
    ev = F.lower(F.coalesce(F.col(verify), F.lit(""))) if verify else F.lit("")
    d = df.withColumns({"_n": n, "_g": g, "_e": ev, "_t": F.concat_ws(" ", n, g, ev), "_s": F.concat_ws(" ", n, g)})
    columns = {"nick": F.col("_n"), "verify": F.col("_e")}
    creators = R.count_words(F.col("_s"), s.creator)
    out: dict[str, Column] = {}
    for kind in ("media", "enterprise", "personal"):
        score = F.lit(0).cast("long")
        for name, col in columns.items():
            first = None
            for where, pattern in s.identity.get(kind, ()):
                if where == name:
                    hit, w = R.matches(col, pattern), F.lit(s.identity_weights[kind][pattern]).cast("long")
                    first = F.when(hit, w) if first is None else first.when(hit, w)
            if first is not None:
                score = score + first.otherwise(F.lit(0).cast("long"))
        for where, pattern in s.identity.get(kind, ()):
            if where == "text":
                w = F.when(R.matches(F.col("_t"), pattern), F.lit(s.identity_weights[kind][pattern]).cast("long")).otherwise(F.lit(0).cast("long"))
                score = F.greatest(score, w) if kind == "media" else score + w
        out[f"{kind}_score"] = score
    if official is not None:
        out["media_score"] = out["media_score"] + F.when(official, F.lit(100).cast("long")).otherwise(F.lit(0).cast("long"))
    if s.whitelist:
        out["media_score"] = F.greatest(out["media_score"], whitelist_score(F.col("_n"), [w.lower() for w in s.whitelist]))
    out["personal_score"] = out["personal_score"] + F.when(creators >= 2, 30).when(creators >= 1, 15).otherwise(0).cast("long")
    for name, lists in s.domains.items():
        out[f"{name}_score"] = R.weigh(F.col("_t"), lists)
    for name, (words, in_nick, in_sig) in s.by_field.items():
        out[f"{name}_score"] = sum((F.when(F.contains(F.col("_n"), F.lit(w)), in_nick).when(F.contains(F.col("_g"), F.lit(w)), in_sig)
                                    .otherwise(0).cast("long") for w in words), F.lit(0).cast("long"))
    direct = R.count_words(F.col("_t"), s.region_direct)
    out["region_score"] = direct * 20 + R.count_words(F.col("_t"), s.region_context) * 10
    out["is_creator"] = creators >= 1
    return d.withColumns(out).drop("_n", "_g", "_e", "_t", "_s")


#: fixed values: class names of the account classifier
CLASSES = {
    "media": "新闻媒体", "region_business": "非洲商业", "business": "商业/企业", "travel": "旅行/探险",
    "region": "非洲相关", "entertainment": "影视娱乐", "sports": "体育/游戏", "military": "军事/时政",
    "knowledge": "泛知识/科普", "lifestyle": "生活方式", "finance": "财经内容", "creator": "个人创作者", "none": "信息不足",
}


def classify_account(df: DataFrame, names: Mapping[str, str] = CLASSES) -> DataFrame:
    """Class of an account from its scores: identity first, then region, strongest domain, weak signals."""
    def c(name: str) -> Column:
        return F.col(f"{name}_score")

    business = c("finance") + c("trade")
    best = R.best_label({"business": business, **{k: c(k) for k in (
        "entertainment", "sports", "travel", "military", "knowledge", "lifestyle")}}, "business")
    strongest = F.greatest(business, *[c(k) for k in ("entertainment", "sports", "travel", "military", "knowledge", "lifestyle")])
    region = c("region")

    def label(key: str) -> Column:
        return F.lit(names[key])

    regional = F.when(region >= 10, label("region_business"))
    in_business = (F.when(c("enterprise") >= 30, label("business"))
                   .when(c("finance") >= 20, F.coalesce(regional, label("finance")))
                   .when(c("trade") >= 20, F.coalesce(regional, label("business")))
                   .when(F.col("is_creator") & (business < 40), label("creator")).otherwise(label("business")))
    strong = F.when(F.col("_best") == "business", in_business)
    for k in ("entertainment", "sports", "travel", "military", "knowledge", "lifestyle"):
        strong = strong.when(F.col("_best") == k, label(k))
    weak = F.when(region >= 10, label("region")).when(
        business >= 20, F.when(F.col("is_creator"), label("creator")).otherwise(label("business")))
    for k in ("travel", "military", "knowledge", "entertainment", "sports", "lifestyle"):
        weak = weak.when(c(k) >= 15, label(k))
    return df.withColumns({"_best": best, "_top": strongest}).withColumn("class", F.coalesce(
        F.when(c("media") >= 60, label("media"))
        .when((c("enterprise") >= 50) & (business >= 20), F.when(region >= 20, label("region_business")).otherwise(label("business")))
        .when(region >= 40, F.when((c("travel") >= 20) & (c("travel") > business), label("travel"))
              .when(business >= 15, label("region_business")).otherwise(label("region")))
        .when(F.col("_top") >= 30, strong).otherwise(weak), label("none"))).drop("_best", "_top")


def author_rollup(posts: DataFrame, author: str, tag: str, followers: str, metrics: Sequence[str], k_tags: int = 10) -> DataFrame:
    """Per author: posts, sums, floor averages, up to ``k_tags`` tags, highest follower count."""
    sums = posts.groupBy(author).agg(
        F.count(F.lit(1)).alias("n"), F.max(followers).alias("followers"),
        *[F.sum(m).alias(f"sum_{m}") for m in metrics], *[F.floor(F.avg(m)).alias(f"avg_{m}") for m in metrics])
    tags = top_per_group(posts.select(author, tag).where(F.col(tag).isNotNull()).distinct(), [author], [F.col(tag)], k_tags, "_r")
    listed = tags.groupBy(author).agg(F.array_join(F.array_sort(F.collect_list(tag)), ",").alias("tags"))
    return sums.join(listed, author, "left")


def author_relevance(posts: DataFrame, author: str, country: str, mention: Column, metrics: Mapping[str, str]) -> DataFrame:
    """Countries, primary country, mention rate and engagement rates per author.

    Works on (author, country) partial sums, so an author's posts meet only as one row per country.
    """
    parts = posts.groupBy(author, country).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(mention).alias("_m"), F.max(metrics["followers"]).alias("_f"),
        *[F.sum(metrics[m]).alias(f"_{m}") for m in ("likes", "comments", "shares")])
    out = parts.groupBy(author).agg(
        F.sum("_n").alias("n_posts"), F.count(F.lit(1)).alias("n_countries"),
        F.array_join(F.array_sort(F.collect_list(country)), ",").alias("countries"),
        F.min_by(F.struct(F.col(country).alias("c"), F.col("_n").alias("n")), F.struct(-F.col("_n"), F.col(country))).alias("_p"),
        F.sum("_m").alias("mentions"), F.max("_f").alias("followers"),
        *[F.sum(f"_{m}").alias(f"total_{m}") for m in ("likes", "comments", "shares")])
    total = F.col("total_likes") + F.col("total_comments") + F.col("total_shares")
    return out.select(
        author, "n_posts", "n_countries", "countries", F.col("_p.c").alias("primary_country"), F.col("_p.n").alias("primary_posts"),
        (F.col("mentions") / F.col("n_posts")).alias("relevance"), "followers", "total_likes", "total_comments",
        (total / F.col("n_posts")).alias("avg_engagement"),
        F.try_divide(F.col("total_comments"), F.col("total_likes")).alias("comment_like_rate"),
        F.try_divide(total / F.col("n_posts"), F.col("followers")).alias("engagement_per_follower"))


def account_tier(df: DataFrame, region_in_name: Column, country_in_name: Column, country_relevance: Column | None = None) -> DataFrame:
    """Core regional, core single-country, and the general accounts in four steps."""
    n, rel = F.col("n_countries"), F.col("relevance")
    related = rel >= 0.5 if country_relevance is None else (rel >= 0.5) | (country_relevance >= 0.5)
    return df.withColumn("tier", F.when(region_in_name & ((n >= 3) | (rel >= 0.5)), "core region")
                         .when(country_in_name & (F.col("primary_posts") >= 3), "core country")
                         .when(region_in_name, "region related").when(n >= 5, "many countries")
                         .when(related, "related").otherwise("touching"))


def role_of(nick: Column, sig: Column, operator: Column | None = None, official: str = lexicons.OFFICIAL_ROLE,
            contact: str = lexicons.CONTACT_ROLE, tenant: str = lexicons.TENANT_ROLE,
            personal: str = lexicons.PERSONAL_ROLE) -> Column:
    """Official, tenant, personal or unknown."""
    text = F.concat_ws(" ", F.coalesce(nick, F.lit("")), F.coalesce(sig, F.lit("")))
    named = F.lit(False)
    if operator is not None:
        key = F.regexp_extract(F.coalesce(operator, F.lit("")), r"^([^（(]*)", 1)
        named = (F.length(key) >= 3) & F.contains(text, key)
    return (F.when(named | R.matches(text, official), "official")
            .when(R.matches(sig, contact) | R.matches(text, tenant), "tenant")
            .when(R.matches(text, personal), "personal").otherwise("unknown"))


def original_sound(music_title: Column, music_author: Column, nickname: Column) -> Column:
    """The title names the author with an @, the sound's author contains the nickname, or the title says so.

    Unknown texts count as empty; an empty nickname is contained in any author.
    """
    title, author, nick = (F.coalesce(c, F.lit("")) for c in (music_title, music_author, nickname))
    return F.contains(title, F.concat(F.lit("@"), nick)) | F.contains(author, nick) | F.contains(title, F.lit(lexicons.ORIGINAL_SOUND))


def tier_medians(df: DataFrame, tier: str, metrics: Sequence[str]) -> DataFrame:
    return order_statistics(df, [tier], metrics, {"median": 0.5})


def default_signals(region_direct: Sequence[str] = ("非洲",), whitelist: Sequence[str] = ()) -> Signals:
    """Signals from the default word lists; place names and the media list are the caller's."""
    authority = rf"(?s)^(?!.*(?:{lexicons.ENTERPRISE_VERIFIED})).*(?:{lexicons.AUTHORITY_VERIFIED})"
    company = rf"(?s)^(?!.*(?:{lexicons.MEDIA_VERIFIED})).*(?:{lexicons.ENTERPRISE_VERIFIED})"
    lists = {"media": [("verify", lexicons.MEDIA_VERIFIED, 90), ("verify", authority, 85), *[("nick", *r) for r in lexicons.MEDIA_NAMES],
                       *[("text", *r) for r in lexicons.MEDIA_SIGNATURES]],
             "enterprise": [("verify", company, 80), *[("nick", *r) for r in lexicons.ENTERPRISE_NAMES]],
             "personal": [("text", *r) for r in lexicons.PERSONAL_WORDS]}
    return Signals(
        identity={k: [(where, p) for where, p, _ in v] for k, v in lists.items()},
        identity_weights={k: {p: w for _, p, w in v} for k, v in lists.items()}, whitelist=whitelist,
        domains=lexicons.DOMAIN_WORDS, by_field=lexicons.NICKNAME_WORDS, region_direct=region_direct,
        region_context=lexicons.REGION_CONTEXT, creator=lexicons.CREATOR_WORDS)
