"""Entity work: canonical names, reconciliation with a reference list, merging of leads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.operators.joins import contains_pairs, unseen
from tidemark.operators.ordering import lag_in_chunks, top_per_group
from tidemark.session import write_through


def canonical_names(names: DataFrame, name: str = "name", n: int = 3) -> DataFrame:
    """Every name with the longest other name that contains it; itself when there is none."""
    ns = names.select(name).distinct()
    longer = ns.select(F.col(name).alias("_long"), F.col(name).alias("_text"))
    pairs = contains_pairs(longer, "_long", "_text", ns, name, n).where(F.col("_long") != F.col(name))
    best = pairs.groupBy(name).agg(F.min_by("_long", F.struct(-F.length("_long"), F.col("_long"))).alias("_c"))
    return ns.join(best, name, "left").select(name, F.coalesce("_c", name).alias("canonical"))


def _same_country(a: Column, b: Column) -> Column:
    unknown = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return unknown | F.contains(a, b) | F.contains(b, a)


def reconcile(projects: DataFrame, accounts: DataFrame, refs: DataFrame, manual: Mapping[str, str] | None = None,
              special: Sequence[tuple[str, str, str]] = (), noise: Column | None = None, n: int = 3) -> DataFrame:
    """Match projects to reference entities by the first rule that applies.

    Order: manual map, special rules with a country, account nickname, longest key in the project
    name, noise, lead. ``projects``: project, country; ``accounts``: project, account, nickname;
    ``refs``: canonical, country, key (one row per key). Both substring matches are indexed joins.
    """
    p = projects.select("project", "country")
    ref_country = refs.groupBy("canonical").agg(F.first("country").alias("_rc"))
    by_nick = (contains_pairs(accounts.select("account", "nickname"), "account", "nickname", refs, "key", n)
               .join(refs.select("key", "canonical").distinct(), "key").join(accounts.select("account", "project"), "account")
               .groupBy("project").agg(F.min_by("canonical", F.struct("account", "canonical")).alias("_nick")))
    by_key = (contains_pairs(p.select("project", F.col("project").alias("_t")), "project", "_t", refs, "key", n)
              .join(refs.select("key", "canonical").distinct(), "key").groupBy("project")
              .agg(F.min_by("canonical", F.struct(-F.length("key"), F.col("canonical"))).alias("_key")))
    out = p
    for col, found in (("_nick", by_nick), ("_key", by_key)):
        country = ref_country.select(F.col("canonical").alias(col), F.col("_rc").alias(f"{col}_c"))
        out = out.join(found.join(country, col, "left"), "project", "left")
        ok = F.col(col).isNotNull() & _same_country(F.col("country"), F.col(f"{col}_c"))
        out = out.withColumn(col, F.when(ok, F.col(col))).drop(f"{col}_c")
    by_hand = F.lit(None).cast("string")
    for name, canonical in (manual or {}).items():
        by_hand = F.when(F.col("project") == name, canonical).otherwise(by_hand)
    by_rule = None
    for word, country, canonical in special:
        hit = F.contains(F.col("project"), F.lit(word)) & (F.lit(country == "") | F.contains(F.col("country"), F.lit(country)))
        by_rule = F.when(hit, canonical) if by_rule is None else by_rule.when(hit, canonical)
    by_rule = F.lit(None).cast("string") if by_rule is None else by_rule
    steps = [("manual", by_hand), ("special", by_rule), ("nickname", F.col("_nick")), ("key", F.col("_key"))]
    via = None
    for name, c in steps:
        via = F.when(c.isNotNull(), name) if via is None else via.when(c.isNotNull(), name)
    if noise is not None:
        via = via.when(noise, "noise")
    return out.select("project", "country", F.coalesce(*[c for _, c in steps]).alias("canonical"),
                      via.otherwise("lead").alias("via"))


def split_conflicts(accounts: DataFrame, text: Column, refs: DataFrame, countries: Sequence[str]) -> DataFrame:
    """Flag accounts whose text names another country and neither the entity nor its country.

    ``accounts`` has account and canonical; ``refs`` has canonical, country and key.
    """
    d = accounts.withColumn("_t", text)
    country = refs.groupBy("canonical").agg(F.first("country").alias("_rc"))
    own = (contains_pairs(d.select("account", "_t"), "account", "_t", refs, "key", 3)
           .join(refs.select("key", "canonical").distinct(), "key").select("account", "canonical").distinct().withColumn("_own", F.lit(True)))
    d = d.join(country, "canonical", "left").join(own, ["account", "canonical"], "left")
    named = [(F.contains(F.col("_t"), F.lit(c)), F.contains(F.col("_rc"), F.lit(c)) | F.contains(F.lit(c), F.col("_rc"))) for c in countries]
    same, other = F.contains(F.col("_t"), F.col("_rc")), F.lit(False)
    for hit, fits in named:
        same, other = same | (hit & fits), other | (hit & ~fits)
    return d.withColumn("conflict", F.coalesce(F.col("_own").isNull() & ~same & other, F.lit(False))).drop("_rc", "_own", "_t")


def reassign(accounts: DataFrame, text: str, refs: DataFrame, n: int = 3) -> DataFrame:
    """Move accounts whose text names another entity in a fitting country and not their own one.

    ``accounts``: account, canonical, country and the text column.
    """
    hits = (contains_pairs(accounts.select("account", text), "account", text, refs, "key", n)
            .join(refs.select("key", F.col("canonical").alias("_other"), F.col("country").alias("_oc")), "key")
            .join(accounts.select("account", "canonical", "country"), "account"))
    per = hits.groupBy("account").agg(
        F.max(F.col("_other") == F.col("canonical")).alias("_own"),
        F.min(F.when((F.col("_other") != F.col("canonical")) & _same_country(F.col("country"), F.col("_oc")), F.col("_other"))).alias("_to"))
    moved = accounts.join(per, "account", "left")
    to = F.when(~F.coalesce("_own", F.lit(False)) & F.col("_to").isNotNull(), F.col("_to"))
    return moved.withColumns({"moved_to": to, "final": F.coalesce(to, F.col("canonical"))}).drop("_own", "_to")


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """Smallest node of each connected component, by neighbour minimum and pointer jumping.

    Every round is written to the shared folder, which keeps the plan short and survives a lost
    executor. The only value the driver reads is the number of labels that changed.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = write_through(both.where("src <> dst").distinct(), "edges")
    labels = write_through(nodes.select(node, F.col(node).alias("label")).distinct(), "labels")
    while True:
        near = (both.join(labels.select(F.col(node).alias("dst"), "label"), "dst").groupBy(F.col("src").alias(node))
                .agg(F.min("label").alias("_near")))
        step = labels.join(near, node, "left").select(
            node, F.col("label").alias("_old"), F.least("label", F.coalesce("_near", "label")).alias("_cand"))
        jump = labels.select(F.col(node).alias("_cand"), F.col("label").alias("_jump"))
        new = write_through(step.join(jump, "_cand", "left").select(
            node, F.least("_cand", F.coalesce("_jump", "_cand")).alias("label"), "_old"), "labels")
        labels = new.select(node, "label")
        if new.where("label <> _old").limit(1).count() == 0:
            return labels


def merge_leads(leads: DataFrame, name: str = "name", account: str = "account", n: int = 4) -> DataFrame:
    """Cluster leads that contain each other's name or share an account; the longest name stands for them.

    Accounts link each of their leads to the smallest one, so a shared account adds one edge per
    lead and not all pairs.
    """
    names = leads.select(name).distinct()
    contained = contains_pairs(names.select(F.col(name).alias("_k"), F.col(name).alias("_t")), "_k", "_t", names, name, n)
    by_name = contained.where(F.col("_k") != F.col(name)).select(F.col("_k").alias("src"), F.col(name).alias("dst"))
    hub = leads.groupBy(account).agg(F.min(name).alias("src"))
    shared = leads.join(hub, account).where(F.col("src") != F.col(name)).select("src", F.col(name).alias("dst")).distinct()
    parts = connected_components(names, by_name.unionByName(shared).distinct(), name)
    best = parts.groupBy("label").agg(F.min_by(name, F.struct(-F.length(name), F.col(name))).alias("merged"))
    return parts.join(best, "label").select(name, "merged")


def _age(name: Column) -> Column:
    """Place of a lead in the order of merging: longest name first, then the name."""
    return F.struct((-F.length(name)).alias("s"), name.alias("n"))


def _earlier_leads(leads: DataFrame, name: str, account: str, n: int) -> DataFrame:
    """(src, dst, contained): the earlier leads that decide about a lead.

    Of the leads of an account the first and the one just before are enough: the one before has met all others, and only
    leads as long as the first are left out by it. So a shared account adds two rows for each of its leads.
    """
    names = leads.select(name).distinct()
    inside = contains_pairs(names.select(F.col(name).alias("src"), F.col(name).alias("_t")), "src", "_t", names, name, n)
    inside = inside.where(F.col("src") != F.col(name)).select("src", F.col(name).alias("dst"), F.lit(True).alias("contained"))
    held = leads.where(F.col(account).isNotNull()).select(F.col(account).alias("_a"), F.col(name).alias("dst")).distinct().withColumn("age", _age(F.col("dst")))
    before = lag_in_chunks(held, ["_a"], ["age"], F.struct("age.s", F.substring("dst", 1, 2).alias("p")), ["dst"]).select(F.col("prev_dst").alias("src"), "dst")
    first = held.groupBy("_a").agg(F.min("age")["n"].alias("src"))
    shared = before.unionByName(held.join(first, "_a").select("src", "dst")).where("src is not null and src <> dst").distinct()
    return inside.unionByName(shared.withColumn("contained", F.lit(False)))


#: Oldest open leads that one task replays when the rounds settle few; they have less than half the square of that many links of each kind.
REPLAYED_LEADS = 2000


def _replayed(edges: DataFrame, state: DataFrame, most: int) -> DataFrame:
    """(dst, _new): owners of the ``most`` oldest open leads. All leads before them are settled, or among them."""
    first = state.where("owner is null").select("dst", _age(F.col("dst")).alias("_a")).orderBy("_a").limit(most)
    first = write_through(first.select("dst", F.row_number().over(W.orderBy("_a")).alias("j")), "oldest-leads")
    met = edges.join(F.broadcast(first), "dst")
    src, owner = F.col("src"), F.col("owner")
    offer = F.when(F.col("contained"), F.when(owner == src, src)).when(owner != src, owner).when(F.length(src) > F.length("dst"), src)
    known = met.join(state.where("owner is not null").select(F.col("dst").alias("src"), "owner"), "src").select("j", offer.alias("taker"))
    known = known.where("taker is not null").groupBy("j").agg(F.min_by("taker", _age(F.col("taker"))).alias("taker"))
    inner = met.join(F.broadcast(first.select(F.col("dst").alias("src"), F.col("j").alias("i"))), "src").select("j", "i", "contained")
    rows = first.join(known, "j", "left").select("j", "dst", "taker", F.lit(None).cast("int").alias("i"), F.lit(None).cast("boolean").alias("contained"))
    rows = rows.unionByName(inner, allowMissingColumns=True)

    def replay(pdf):
        leads = pdf[pdf["i"].isna()].sort_values("j")
        name, links, owners = dict(zip(leads["j"], leads["dst"])), {}, {}
        inside = pdf[pdf["i"].notna()]
        for i, j, contained in zip(inside["i"].astype(int), inside["j"], inside["contained"]):
            links.setdefault(j, []).append((i, bool(contained)))
        for j, own, taker in zip(leads["j"], leads["dst"], leads["taker"]):
            offers = [own] + ([taker] if isinstance(taker, str) else [])
            for i, contained in links.get(j, ()):
                stands = owners[i] == name[i]
                if contained and stands or not contained and (not stands or len(name[i]) > len(own)):
                    offers.append(owners[i])
            owners[j] = min(offers, key=lambda x: (-len(x), x))
        return leads[["dst"]].assign(_new=[owners[j] for j in leads["j"]])

    return rows.groupBy(F.lit("oldest")).applyInPandas(replay, "dst string, _new string")


def merge_leads_in_order(leads: DataFrame, name: str = "name", account: str = "account", n: int = 4, replayed: int = REPLAYED_LEADS) -> DataFrame:
    """(name, merged): leads merged one after the other, longest name first, as a replay of the list would do it.

    A lead that still stands takes every shorter lead that its name contains (of ``n`` characters or more) or that shares an account with it or with
    a lead that it has taken before; a lead that was taken takes none. Equally long names go by name and do not take each other.
    Rounds replace the replay: a lead is settled when all earlier leads that touch it are, or when none of the open ones can offer an older taker than it has.
    Long chains settle few leads a round; after a round that settles less than half of the open ones, the ``replayed`` oldest are replayed in one task.
    NULL accounts link nothing, repeated rows count once, an empty table gives none. Every round is written to the shared folder.
    """
    edges = write_through(_earlier_leads(leads.where(F.col(name).isNotNull()), name, account, n), "lead-edges")
    nobody = F.lit(None)
    state = leads.where(F.col(name).isNotNull()).select(F.col(name).alias("dst")).distinct()
    kind = state.select(_age(F.col("dst")).alias("a")).schema["a"].dataType
    state = write_through(state.select("dst", nobody.cast("string").alias("owner"), nobody.cast(kind).alias("oldest")), "leads")
    src, dst, owner = F.col("src"), F.col("dst"), F.col("owner")
    offer = F.when(F.col("contained"), F.when(owner == src, _age(src))).when(owner != src, _age(owner)).when(F.length(src) > F.length(dst), _age(src))
    left = state.count()
    while left:
        known = state.withColumnsRenamed({"dst": "src"})
        met = edges.join(state.where("owner is null").select("dst"), "dst", "left_semi").join(known, "src")
        met = met.select("dst", F.when(owner.isNotNull(), offer).alias("taker"), owner.isNull().alias("waits"),
                         F.when(owner.isNull(), F.when(F.col("contained"), _age(src)).otherwise(F.col("oldest"))).alias("bound"))
        met = met.groupBy("dst").agg(F.min("taker").alias("taker"), F.min("bound").alias("bound"),
                                     F.max("waits").alias("waits"), F.max(F.col("waits") & F.col("bound").isNull()).alias("unknown"))
        best = F.least(F.coalesce("taker", _age(dst)), _age(dst))
        waits, unknown = F.coalesce("waits", F.lit(False)), F.coalesce("unknown", F.lit(False))
        done = ~waits | (~unknown & (best <= F.col("bound")))
        state = write_through(state.join(met, "dst", "left").select(
            "dst", F.when(owner.isNotNull(), owner).when(done, best["n"]).alias("owner"),
            F.when(~unknown, F.least(best, F.coalesce("bound", best))).alias("oldest")), "leads")
        before, left = left, state.where("owner is null").count()
        if left * 2 > before:
            state = write_through(state.join(_replayed(edges, state, replayed), "dst", "left").select(
                "dst", F.coalesce("owner", "_new").alias("owner"), "oldest"), "leads")
            left = state.where("owner is null").count()
    return state.select(dst.alias(name), owner.alias("merged"))


def reference_status(refs: DataFrame, matched: DataFrame, searched: DataFrame) -> DataFrame:
    """Reference entities with accounts, searched without a hit, or never searched."""
    has = matched.where("n_accounts > 0").select("canonical").distinct().withColumn("_has", F.lit(True))
    tried = searched.select("canonical").distinct().withColumn("_tried", F.lit(True))
    return (refs.select("canonical").distinct().join(has, "canonical", "left").join(tried, "canonical", "left")
            .select("canonical", F.when(F.col("_has"), "with accounts").when(F.col("_tried"), "searched").otherwise("none").alias("status")))


def backfill(entity_accounts: DataFrame, found: DataFrame, role: Column) -> DataFrame:
    """Accounts not yet listed for their entity, with their role, appended to the list."""
    fresh = unseen(found, ["canonical", "account"], entity_accounts).withColumn("role", role)
    return (entity_accounts.withColumn("is_new", F.lit(False))
            .unionByName(fresh.withColumn("is_new", F.lit(True)), allowMissingColumns=True))


def project_registry(accounts: DataFrame, projects: Column, country: str, kind: str, followers: str, account: str,
                     per_account: int = 2, k: int = 8) -> DataFrame:
    """Project -> accounts, countries, types, head followers and its first ``k`` accounts."""
    rows = (accounts.select(account, country, kind, followers, F.posexplode(projects).alias("_pos", "project"))
            .where(F.col("_pos") < per_account).drop("_pos"))
    sizes = rows.groupBy("project").agg(
        F.countDistinct(account).alias("account_count"), F.max(followers).alias("top_followers"),
        F.array_join(F.array_sort(F.collect_set(country)), ",").alias("countries"),
        F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("types"))
    head = top_per_group(rows.select("project", account, followers).distinct(), ["project"],
                         [F.desc(followers), F.col(account)], k, "_r")
    listed = head.groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(account).cast("string").alias("a")))),
                                                                  lambda x: x["a"]), ",").alias("head_accounts"))
    return sizes.join(listed, "project")

