"""Articles out of rendered HTML."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import strip


@dataclass(frozen=True)
class ArticleRules:
    """Patterns of one site. The defaults name the fields of the article platform."""

    title: str = r'(?s)<h1[^>]*class="rich_media_title"[^>]*>(.*?)</h1>'
    title_fallback: str = r'<meta property="og:title" content="([^"]*)"'
    author: str = r'(?s)id="js_name"[^>]*>(.*?)</a>'
    published: str = r'id="publish_time"[^>]*>([^<]*)<'
    body: str = r'(?s)<div[^>]*id="js_content"[^>]*>(.*?)<script'
    image: str = r"""https://mmbiz\.qpic\.cn/sz_mmbiz_(?:jpg|png|gif|jpeg)/[^"' ),]+"""
    image_group: int = 0
    image_barred: tuple = ("qlogo", "mmbizappmsg")


def untag(html: Column) -> Column:
    return strip(F.regexp_replace(html, r"<[^>]+>", ""))


def body_text(html: Column) -> Column:
    """Text with line breaks at ``br`` and the end of paragraphs."""
    return untag(F.regexp_replace(F.regexp_replace(html, r"<br\s*/?>", "\n"), "</p>", "\n"))


def html_article(df: DataFrame, html: str, rules: ArticleRules = ArticleRules()) -> DataFrame:
    """Title, author, publish time, body text and distinct image addresses of a page."""
    h = F.col(html)
    first = untag(F.regexp_extract(h, rules.title, 1))
    other = F.regexp_extract(h, rules.title_fallback, 1)
    inner = F.regexp_extract(h, rules.body, 1)
    images = F.array_distinct(F.regexp_extract_all(h, F.lit(rules.image), F.lit(rules.image_group)))
    for word in rules.image_barred:
        images = F.filter(images, _without(word))
    return df.withColumns({
        "title": F.when(first != "", first).when(other != "", other).otherwise("untitled"),
        "author": untag(F.regexp_extract(h, rules.author, 1)),
        "published": strip(F.regexp_extract(h, rules.published, 1)),
        "body": body_text(F.when(inner != "", inner).otherwise(h)), "images": images})


def _without(word: str):
    return lambda u: ~F.contains(u, F.lit(word))
