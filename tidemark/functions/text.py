"""Text predicates and text shaping, all as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from tidemark.functions import lexicons
from tidemark.functions.rules import has_any, matches, words_pattern


#: characters that count as space at the ends of a text
SPACES = " \t\n\x0b\f\r\u3000\u00a0"


def strip(col: Column | str) -> Column:
    return F.btrim(col, F.lit(SPACES))


@dataclass(frozen=True)
class CommentRules:
    """Word lists and patterns of one platform and language."""

    script: str = r"[一-鿿]"
    noise: tuple = tuple(lexicons.COMMENT_NOISE)
    control_words: tuple = tuple(lexicons.CONTROL_WORDS)
    exact_words: tuple = tuple(lexicons.PLAYER_WORDS)
    prefixes: tuple = ("发布时间", "下载", "大家都在搜")
    relative_time_row: str = lexicons.RELATIVE_TIME_ROW
    relative_time: str = lexicons.RELATIVE_TIME_PLACE
    reply_fold: str = lexicons.REPLY_FOLD
    placeholder_user: str = lexicons.PLACEHOLDER_USER
    countdown: str = lexicons.COUNTDOWN
    account_mention: str = lexicons.ACCOUNT_MENTION
    comment_marker: str = lexicons.COMMENT_MARKER
    spec_value: str = r"\d+(?:\.\d+)?\s*" + lexicons.SPEC_UNIT
    spec_mark: str = "："
    spec_min_len: int = 28
    episode_prefix: str = lexicons.EPISODE_PREFIX
    column_words: tuple = tuple(lexicons.COLUMN_WORDS)
    title_marks: str = lexicons.TITLE_MARKS
    title_marks_within: int = 40
    caption_min_len: int = 45
    echo_min_len: int = 8
    max_tags: int = 2
    tag_mark: str = "#"
    min_len: int = 2
    max_len: int = 500
    extra: dict = field(default_factory=dict)


def clean_comment(col: Column, rules: CommentRules) -> Column:
    """Trimmed comment, or NULL for short rows, interface noise and relative-time rows."""
    t = strip(col)
    kept = F.when((F.length(t) >= rules.min_len) & ~has_any(t, rules.noise), t)
    left = strip(F.regexp_replace(kept, rules.relative_time_row, ""))
    return F.when(left != "", left)


def is_ui_residue(col: Column, rules: CommentRules) -> Column:
    t = strip(F.coalesce(col, F.lit("")))
    words = [*rules.control_words, *rules.exact_words]
    exact = t.isin(*words) if words else F.lit(False)
    return ((t == "") | matches(t, rules.countdown) | matches(t, rules.placeholder_user) | exact
            | matches(t, rules.relative_time))


def is_account_mention(col: Column, rules: CommentRules) -> Column:
    t = strip(F.coalesce(col, F.lit("")))
    return matches(t, rules.account_mention) & ~matches(t, rules.comment_marker)


def is_spec_residue(col: Column, rules: CommentRules) -> Column:
    t = strip(F.coalesce(col, F.lit("")))
    return ((F.length(t) >= rules.spec_min_len) & F.contains(t, F.lit(rules.spec_mark))
            & (F.regexp_count(t, F.lit(rules.spec_value)) >= 3))


def is_feed_caption(col: Column, rules: CommentRules) -> Column:
    """Title echo, decorated head, column words or an episode prefix."""
    t = F.coalesce(col, F.lit(""))
    head = F.regexp_extract(t, r"^([^ 　]*)", 1)
    rest = F.substr(t, F.length(head) + 1)
    echo = (F.length(head) >= rules.echo_min_len) & F.contains(rest, head)
    long_rules = (has_any(t, rules.column_words) | echo
                  | matches(F.substring(t, 1, rules.title_marks_within), rules.title_marks))
    return matches(t, rules.episode_prefix) | ((F.length(t) >= rules.caption_min_len) & long_rules)


def is_topic_noise(col: Column, rules: CommentRules) -> Column:
    return is_ui_residue(col, rules) | is_account_mention(col, rules) | is_spec_residue(col, rules)


def occurrences(col: Column, mark: str) -> Column:
    """How often a one-character mark occurs."""
    return F.length(col) - F.length(F.replace(col, F.lit(mark), F.lit("")))


def is_comment_text(col: Column, rules: CommentRules) -> Column:
    """Whether a row is a real comment rather than interface text or a caption."""
    t = F.coalesce(col, F.lit(""))
    bad = (has_any(t, rules.control_words) | (t.isin(*rules.exact_words) if rules.exact_words else F.lit(False))
           | matches(t, rules.relative_time) | matches(t, rules.reply_fold)
           | (occurrences(t, rules.tag_mark) > rules.max_tags) | is_feed_caption(t, rules)
           | matches(t, rules.placeholder_user) | matches(t, rules.countdown))
    if rules.prefixes:
        bad = bad | matches(t, "^" + words_pattern(rules.prefixes))
    return F.length(t).between(rules.min_len, rules.max_len) & matches(t, rules.script) & ~bad


def bare_prefix(col: Column, n: int = 30) -> Column:
    return F.substring(F.regexp_replace(F.coalesce(col, F.lit("")), r"\s+", ""), 1, n)


def words(col: Column, pattern: str) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(0))


def strip_front_matter(col: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(col, F.lit("")), F.lit("\r\n"), F.lit("\n")),
                            r"^---\n(?s:.*?)\n---\n*", "")


def strip_markdown(col: Column) -> Column:
    """Plain text: code, links, images, headings, bullets and emphasis removed, spaces collapsed."""
    def unmarked(x: Column) -> Column:
        t = strip_front_matter(x)
        for pattern, by in (
                (r"```(?s:.*?)```", " "), (r"`([^`]+)`", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"),
                (r"!\[[^\]]*\]\([^)]+\)", " "), (r"(?m)^#{1,6}\s*", ""), (r"(?m)^\s*[-*+]\s+", ""),
                (r"(?m)^\s*\d+\.\s+", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"),
                (r"__([^_]+)__", "$1"), (r"_([^_]+)_", "$1")):
            t = F.regexp_replace(t, pattern, by)
        return t

    # each pattern needs one of these marks, so most texts only have their spaces collapsed
    marked = bind(F.coalesce(col, F.lit("")), lambda x: F.when(x.rlike(r"[`\[#*+_-]|\d\."), unmarked(x)).otherwise(x))
    return strip(F.regexp_replace(marked, r"\s+", " "))


def paragraphs(col: Column, min_len: int = 16) -> Column:
    parts = F.split(strip_front_matter(col), r"\n{2,}")
    return F.filter(F.transform(parts, lambda p: strip(F.replace(p, F.lit("\n"), F.lit(" ")))),
                    lambda p: F.length(p) >= min_len)


def sentences(col: Column, terminators: str = r"[。！？!?\n]+") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(col, F.lit("")), terminators), strip),
                    lambda s: s != "")


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once, for use inside array expressions."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def index_tokens(col: Column, script: str = r"\p{IsHan}", sizes: tuple = (2, 3), min_len: int = 2) -> Column:
    """Distinct lower-case parts of two characters or more, plus n-grams of parts in the script."""
    parts = F.split(F.lower(F.coalesce(col, F.lit(""))), rf"[^{script}a-z0-9]+")

    def whole(ps: Column) -> Column:
        return F.filter(ps, lambda p: F.length(p) >= min_len)

    if not sizes:
        return F.array_distinct(whole(parts))

    def grams(dense: Column, n: int) -> Column:
        return F.flatten(F.transform(F.filter(dense, lambda p: F.length(p) >= n), lambda p: F.transform(
            F.sequence(F.lit(1), F.length(p) - (n - 1)), lambda i: F.substr(p, i, F.lit(n)))))

    def all_tokens(ps: Column) -> Column:
        dense = F.filter(ps, lambda p: p.rlike(rf"^[{script}]+$"))
        return F.concat(whole(ps), bind(dense, lambda d: F.concat(*[grams(d, n) for n in sizes])))

    return F.array_distinct(bind(parts, all_tokens))


def title_chars(col: Column, keep: str = r"\p{IsHan}A-Za-z0-9") -> Column:
    """Distinct characters of a title without punctuation."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(
        F.coalesce(col, F.lit("")), rf"[^{keep}]+", ""), ""), lambda c: c != ""))


def char_similarity(a: Column, b: Column) -> Column:
    """Shared distinct characters over the larger distinct set; arguments from ``title_chars``."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / most)


def normalize_name(col: Column, keep: str = r"一-鿿A-Za-z0-9", lower: bool = False,
                   count_prefix: str | None = r"^\d+(\.\d+)?万?", notes: str | None = r"[（(][^）)]*[）)]") -> Column:
    """Account name without follower prefix, bracketed notes and symbols; None keeps prefixes or notes, as in lines that are no account names."""
    t = F.coalesce(col, F.lit(""))
    for part in (count_prefix, notes):
        t = F.regexp_replace(t, part, "") if part else t
    t = F.regexp_replace(t, rf"[^{keep}]+", "")
    return F.lower(t) if lower else t


def extract_links(col: Column, patterns: list[str]) -> Column:
    """First link found by the patterns in order."""
    out = [F.nullif(F.regexp_extract(F.coalesce(col, F.lit("")), f"({p})", 1), F.lit("")) for p in patterns]
    return F.coalesce(*out)
