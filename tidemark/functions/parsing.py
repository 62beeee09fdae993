"""Columns parsed out of packed text, cards, markdown and nested JSON."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType

from tidemark.functions import lexicons, metrics as M, rules as R, text as T
from tidemark.operators.ordering import compute_once


def parse_desc(df: DataFrame, col: str) -> DataFrame:
    """Packed description -> duration, play_count, tags, author, publish_time, title."""
    head = r"^(?:合集\s*)?(?:(\d+:\d+(?::\d+)?)\s*)?(?:([\d.]+[万亿]?)\s+)?"
    body = T.strip(F.regexp_replace(T.strip(F.col(col)), head, ""))
    when = r"(\d+(?:\.\d+)?(?:秒|分钟|小时|天|周|月|年)前|昨天|前天|刚刚)$"
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, when, ""), r"@\S+", ""), r"#\S+", "")
    packed = T.strip(F.col(col))
    return df.withColumns({
        "duration": F.regexp_extract(packed, head, 1),
        "play_count": M.parse_count(F.regexp_extract(packed, head, 2), "zero"),
        "tags": F.regexp_extract_all(body, F.lit(r"#([^\s#@]+)"), F.lit(1)),
        "author": F.regexp_extract(body, r"@([^\s@]+)", 1),
        "publish_time": F.regexp_extract(body, when, 1),
        "title": F.regexp_replace(plain, r"^[ \t\n·\-—]+|[ \t\n·\-—]+$", ""),
    })


#: fixed values: rows of an account card that carry no data, and the id line
CARD_NOISE = ["关注", "私信", "已关注", "私密账号", "直播中", "求更新"]
CARD_ID = r"^抖音号[:：]\s*"
CARD_COUNTS = r"([\d.]+(?:亿|万|w|W)?)\s*获赞\s*([\d.]+(?:亿|万|w|W)?)\s*粉丝"


def parse_account_card(df: DataFrame, col: str) -> DataFrame:
    """Card text -> nickname, account_id, likes, followers, signature (longest text line)."""
    rows = F.filter(F.transform(F.split(F.coalesce(F.col(col), F.lit("")), "\n"), T.strip),
                    lambda x: (x != "") & ~x.isin(*CARD_NOISE))
    df = df.withColumn("_rows", rows)
    id_row = F.coalesce(F.get(F.filter("_rows", lambda x: x.rlike(CARD_ID)), F.lit(0)), F.lit(""))
    likes, fans = F.regexp_extract(id_row, CARD_COUNTS, 1), M.parse_count(F.regexp_extract(id_row, CARD_COUNTS, 2), "zero")
    id_at = F.array_position(F.transform("_rows", lambda x: x.rlike(CARD_ID)), True)
    nick = F.coalesce(F.get("_rows", F.lit(0)), F.lit(""))
    lines = F.filter("_rows", lambda x, i: (i > 0) & ~x.rlike(CARD_ID) & (x != nick) & (
        F.length(x) > F.when((id_at > 0) & (i + 1 > id_at), 3).otherwise(6)))
    longest = F.array_sort(F.transform(lines, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("x"))))
    return df.withColumns({
        "nickname": nick,
        "account_id": T.strip(F.regexp_replace(F.regexp_replace(id_row, CARD_ID, ""), CARD_COUNTS + ".*$", "")),
        "likes": F.when(likes.rlike("[亿万wW]$"), M.parse_count(likes)).otherwise(F.lit(0).cast("long")),
        "followers": F.when(fans > 50000000, F.lit(0)).otherwise(fans).cast("long"),
        "signature": F.coalesce(F.get(longest, F.lit(0))["x"], F.lit("")),
    }).drop("_rows")


def clean_project_name(col: Column, prefixes: Sequence[str] = tuple(lexicons.PROJECT_NOISE_PREFIXES), rounds: int = 3) -> Column:
    """Leading verbs and fillers removed while four characters remain."""
    for _ in range(rounds):
        for p in prefixes:
            col = F.when(F.startswith(col, F.lit(p)) & (F.length(col) - len(p) >= 4),
                         F.substr(col, F.lit(len(p) + 1))).otherwise(col)
    return col


def extract_projects(col: Column, suffixes: Sequence[str] = tuple(lexicons.PROJECT_SUFFIXES),
                     prefixes: Sequence[str] = tuple(lexicons.PROJECT_NOISE_PREFIXES), lead: str = "[一-龥A-Za-z0-9]{0,8}?",
                     min_len: int = 3) -> Column:
    """Distinct project names: a short prefix and a project suffix, bare suffixes left out."""
    found = F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(f"({lead}(?:{'|'.join(suffixes)}))"), F.lit(1))
    named = F.filter(F.transform(found, T.strip), lambda n: ~n.isin(*suffixes) & (F.length(n) >= min_len))
    # Prefixes are peeled by one pattern per name; the longest prefix wins and four characters stay.
    peel = f"^(?:{'|'.join(sorted(prefixes, key=len, reverse=True))})(?=.{{4,}}$)" if prefixes else "^$"
    for _ in range(2):
        named = F.transform(named, lambda n: F.regexp_replace(n, peel, ""))
    return F.array_distinct(F.filter(named, lambda n: F.length(n) >= min_len))


def clean_seed(col: Column, countries: Iterable[str], stop: Sequence[str] = (), barred: Sequence[str] = (),
               min_len: int = 3) -> Column:
    """Name cut at its first country word; NULL for stop names, barred words and short rests."""
    n = T.strip(F.coalesce(col, F.lit("")))
    at = F.regexp_instr(n, F.lit("(" + R.words_pattern(countries) + ")"))
    cut = F.when(at > 1, F.substr(n, at)).otherwise(n)
    bad = (F.length(n) < min_len) | (R.has_any(n, barred) if barred else F.lit(False))
    if stop:
        bad = bad | n.isin(*stop)
    return F.when(~bad & (F.length(cut) >= min_len), cut)


def deep_get(doc: Column, keys: Sequence[str], parents: Sequence[str], kind: str = "string") -> Column:
    """First known value of the keys below the given parents, outer parents first.

    ``doc`` is a parsed document (variant), so the text is parsed once for all lookups.
    """
    places = [F.try_variant_get(doc, f"$.{p}.{k}" if p else f"$.{k}", kind) for p in parents for k in keys]
    return F.coalesce(*[F.nullif(c, F.lit("")) if kind == "string" else c for c in places])


#: fixed values: names a note payload uses for its parts
NOTE_COUNTS = {
    "likes": ["likedCount", "likeCount", "likes"], "collects": ["collectedCount", "collectCount", "collects"],
    "comments_cnt": ["commentCount", "commentsCount"], "shares": ["shareCount", "sharedCount", "shares"],
}
NOTE_TIMES = ["time", "publishTime", "createTime", "lastUpdateTime"]
NOTE_TEXTS = ["noteId", "id", "title", "desc", "content", "type", *NOTE_TIMES]


def _note_schema() -> str:
    counts = ",".join(f"{k}:string" for ks in NOTE_COUNTS.values() for k in ks)
    texts = ",".join(f"{k}:string" for k in NOTE_TEXTS)
    flat = (f"{texts},{counts},interactInfo:struct<{counts}>,user:struct<nickname:string>,"
            "tagList:array<struct<name:string,title:string>>")
    return f"struct<note:struct<{flat}>,{flat}>"


def parse_note_detail(df: DataFrame, col: str, zone: str = "Asia/Shanghai") -> DataFrame:
    """Nested note payload -> flat note; counts may carry units, times may be epoch (milli)seconds.

    The payload is parsed once with a declared schema; every field falls back from the inner note
    to the outer document.
    """
    d = compute_once(df, _d=F.from_json(col, DataType.fromDDL(_note_schema())))

    def field(*names: str, under: tuple[str, ...] = ("_d.note", "_d")) -> Column:
        return F.coalesce(*[F.nullif(F.col(f"{u}.{n}"), F.lit("")) for u in under for n in names])

    places = ("_d.note.interactInfo", "_d.interactInfo", "_d.note", "_d")
    d = d.select("*", field(*NOTE_TIMES).alias("_t"), *[field(*ks, under=places).alias(f"_{n}") for n, ks in NOTE_COUNTS.items()])
    raw = F.col("_t")
    num = F.when(raw.rlike(r"^\d+(\.\d+)?$"), raw.cast("double"))
    secs = F.when(num > 1e11, num / 1000).otherwise(num)
    local = F.date_format(F.from_utc_timestamp(F.timestamp_seconds(secs), zone), "yyyy-MM-dd HH:mm")
    tags = F.coalesce("_d.note.tagList", "_d.tagList")
    names = F.array_compact(F.transform(tags, lambda x: T.strip(F.coalesce(x["name"], x["title"]))))
    return d.withColumns({
        "note_id": field("noteId", "id"), "title": T.strip(field("title")), "content": T.strip(field("desc", "content")),
        **{n: M.parse_count(F.col(f"_{n}")) for n in NOTE_COUNTS},
        "publish_time": F.coalesce(local, raw), "author": field("nickname", under=("_d.note.user", "_d.user")),
        "tags": F.nullif(F.array_join(names, ","), F.lit("")), "note_type": field("type"),
    }).drop("_d", "_t", *[f"_{n}" for n in NOTE_COUNTS])


def section(col: Column, heading: str) -> Column:
    """Text under a ``## heading`` up to the next one; empty when there is none."""
    return T.strip(F.regexp_extract(F.concat(F.lit("\n"), col, F.lit("\n## ")),
                                    rf"(?s)\n## {heading}\s*?\n(.*?)\n## ", 1))


def bullets(col: Column) -> Column:
    """Bullet and numbered items as plain text."""
    items = F.regexp_extract_all(col, F.lit(r"(?m)^\s*(?:[-*+]|\d+\.)\s+(.+)$"), F.lit(1))
    return F.filter(F.transform(items, T.strip_markdown), lambda x: x != "")


def inline_field(col: Column, label: str) -> Column:
    return T.strip(F.regexp_extract(col, rf"\*\*{label}[：:]\*\*\s*([^\n]+)", 1))


def first_sentence(col: Column, ends: str = "[。！？!?]") -> Column:
    t = T.strip_markdown(col)
    parts = F.filter(F.transform(F.split(t, ends), T.strip), lambda x: x != "")
    return F.coalesce(F.get(parts, F.lit(0)), t)


def cut_text(col: Column, n: int = 120, tail: str = "……") -> Column:
    return F.when(F.length(col) <= n, col).otherwise(F.concat(T.strip(F.substring(col, 1, n)), F.lit(tail)))


def front_matter(df: DataFrame, col: str, scalars: Sequence[str] = ("id", "type", "title"),
                 lists: Sequence[str] = ("themes", "keywords", "source_documents")) -> DataFrame:
    """Markdown with front matter -> scalar fields, lists, relationships and body."""
    text = F.replace(F.coalesce(F.col(col), F.lit("")), F.lit("\r\n"), F.lit("\n"))
    d = df.withColumn("_fm", F.concat(F.lit("\n"), F.regexp_extract(text, r"^---\n(?s)(.*?)\n---\n?", 1), F.lit("\n")))
    out = {f: F.nullif(T.strip(F.regexp_extract("_fm", rf"\n{f}:[ \t]*([^\n]+)", 1)), F.lit("")) for f in scalars}
    for f in lists:
        block = F.regexp_extract("_fm", rf"\n{f}:[ \t]*\n((?:  - [^\n]*\n)*)", 1)
        out[f] = F.filter(F.transform(F.split(block, "\n"), lambda x: T.strip(F.regexp_replace(x, "^  - ", ""))), lambda x: x != "")
    rel = F.concat(F.regexp_extract("_fm", r"\nrelationships:[ \t]*\n((?:  [^\n]*\n)*)", 1), F.lit("  - type:"))
    one = F.regexp_extract_all(rel, F.lit(r"(?s)- type:(.*?)(?=  - type:)"), F.lit(1))
    out["relationships"] = F.transform(one, lambda r: F.struct(
        T.strip(F.regexp_extract(r, r"^([^\n]*)", 1)).alias("type"),
        T.strip(F.regexp_extract(r, r"\n\s*target:([^\n]*)", 1)).alias("target"),
        T.strip(F.regexp_extract(r, r"\n\s*note:([^\n]*)", 1)).alias("note")))
    out["body"] = F.regexp_replace(text, r"^---\n(?s:.*?)\n---\n?", "")
    return d.withColumns(out).drop("_fm")

