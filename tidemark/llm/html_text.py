"""Main text of web pages, by markup and by differencing pages of neighbouring URLs.

Pages of a host are paired by URL path, their text lines are aligned by longest common subsequence, and
lines that a page shares with its neighbour are deleted, as sites repeat what is not the article. Lines
that the markup itself names as article are kept, and those it names as menu, notice and the like are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.llm.words import slices
from tidemark.session import shuffle_width

#: Elements without content, elements whose content is not markup, and elements that are never article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template xmp noembed noframes".split())
DROPPED = frozenset("nav header footer aside form menu dialog button select option svg math object audio video canvas head".split())

#: Words of a class, id or role that name something else than the article.
OTHER = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices
alert sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead contentinfo complementary comment comments reply replies
disqus share sharing social related recommended newsletter subscribe subscription popup modal overlay login signup search pagination pager""".split())

#: Of these, names of elements whose own articles are other people's texts or teasers; words that begin a state or a layout, not
#: a name ("has-sidebar"); and words after a name that say which part or place it is ("sidebar-left").
FIRM = frozenset("comment comments reply replies disqus related recommended".split())
STATES = frozenset("has no not non with without is show hide hides content layout body text".split())
PARTS = frozenset("""area bar block bottom box button buttons card container content element footer group header icon icons inner item items left link links
list main outer panel primary right secondary section text title top unit widget wrap wrapper""".split())

#: Elements around blocks of text; others are part of a line.
BLOCK = frozenset("""address article blockquote body br caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html li main
ol p pre section summary table tbody td tfoot th thead tr ul""".split()) | DROPPED

TAG = re.compile(r"""<(?:!--|(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:\s|/|[^\s"'>]|"[^"]*"|'[^']*')*+)>|(/?)([a-zA-Z][a-zA-Z0-9:-]*+)[^>]*+>|[!?/][^>]*+>)""")
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)""", re.I)
ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}

#: Regions of lines; ``HELD`` is an article or main in an element that is named as something else.
PLAIN, HELD, MAIN, ARTICLE = 0, 1, 2, 3


def _names_other(attributes: str) -> int:
    """0: no name of something else; 1: one that an article inside refutes; 2: goes with all it holds.

    Names are whole: "site-footer" and "sidebar-left" name a footer and a sidebar, "has-sidebar" and "share-enabled" name neither.
    """
    if not attributes.strip(" /"):
        return 0
    found = 2 if HIDDEN.search(attributes) else 0
    for m in NAMED.finditer(attributes):
        for name in m[1].lower().strip("\"'").split():
            words = [w for w in re.split(r"[^a-z0-9]+", name) if w and not w.isdigit()]
            while len(words) > 1 and words[-1] in PARTS and words[-1] not in OTHER:
                words.pop()
            if words and words[-1] in PARTS and len(words) > 1 and words[-2] in OTHER:
                words.pop()
            if words and words[-1] in OTHER and (len(words) == 1 or words[0] not in STATES):
                found = max(found, 2 if words[-1] in FIRM else 1)
    return found


def lines(html: str) -> list[tuple[int, str]]:
    """(region, text) of the blocks outside dropped elements: white space is one space, references are decoded.

    Unclosed elements end with the element around them; a paragraph ends where the next block begins.
    An element named as something else stays if it holds an article or main that is not named so.
    """
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[str] = []
    marks: list[tuple[int, int]] = []  # (depth, region) of open article and main elements
    doubted: list[list] = []  # [depth, lines before, parts before, whether it holds an article] of open elements named as something else
    dropped, at = 0, 0  # depth of the dropped element, 0 for none

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((marks[-1][1] if marks else PLAIN, text))
            parts.clear()

    def close(depth: int) -> None:
        nonlocal dropped
        del stack[depth - 1:]
        if dropped >= depth:
            dropped = 0
        while doubted and doubted[-1][0] >= depth:
            _, before, open_parts, holds = doubted.pop()
            if holds:
                flush()
            else:
                del out[before:]
                parts[:] = open_parts
        while marks and marks[-1][0] >= depth:
            marks.pop()

    def hold() -> None:
        """What is open and named as something else holds an article."""
        moved = 0
        for d in doubted:
            d[1] += moved
            if not d[3]:
                d[3], text = True, " ".join(unescape("".join(d[2])).split())
                if text:
                    region = max((m for m in marks if m[0] < d[0]), default=(0, PLAIN))[1]
                    out.insert(d[1], (region, text))
                    moved += 1

    end_of_tags = html.rfind(">") + 1  # no tag is looked for where none can end
    while m := TAG.search(html, at, max(at, end_of_tags)):
        if not dropped and m.start() > at:
            parts.append(html[at:m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if html.startswith("<!--", m.start()):
                end = html.find("-->", at)
                at = len(html) if end < 0 else end + 3
            continue
        if name in BLOCK and not dropped:
            flush()
        if m[1] or m[4]:
            for depth in range(len(stack), 0, -1):
                if stack[depth - 1] == name:
                    close(depth)
                    break
                if stack[depth - 1] in ("article", "main") and name not in ("body", "html", "article", "main"):
                    break  # a stray end tag does not leave the article
            continue
        if name in RAW:
            end = ENDS[name].search(html, at)
            at = len(html) if end is None else end.end()
            continue
        if name in VOID:
            continue
        if name in BLOCK and "p" in stack[-4:]:
            depth = len(stack) - stack[::-1].index("p")
            if not any(x in BLOCK for x in stack[depth:]):
                close(depth)
        stack.append(name)
        if dropped:
            continue
        other = 0 if name in ("html", "body", "main") else _names_other(m[3] or "")
        if name in DROPPED or other == 2:
            dropped = len(stack)
        elif other:
            doubted.append([len(stack), len(out), parts.copy(), False])
            parts.clear()
        elif name in ("article", "main"):
            hold()
            region = HELD if doubted else ARTICLE if name == "article" else MAIN
            marks.append((len(stack), max(region, marks[-1][1]) if marks and marks[-1][1] != MAIN else region))
    if not dropped:
        rest = html[at:]
        parts.append(rest[:rest.find("<!--")] if "<!--" in rest else rest)
        flush()
    if doubted:
        close(doubted[0][0])
        flush()
    return out


def common(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``; a bit-parallel table, one number for each line."""
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    found = set(range(first)) | set(range(len(a) - last, len(a)))
    x, y = a[first:len(a) - last], b[first:len(b) - last]
    where: dict[str, int] = {}
    for j, line in enumerate(y):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(y)) - 1
    rows, v = [full], full
    for line in x:
        u = v & where.get(line, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    i, j = len(x), len(y)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            found.add(first + i)
    return found


def _alike(a: str, b: str) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def main_text(page: list[tuple[int, str]], neighbour: list[tuple[int, str]] | None) -> tuple[str, int]:
    """The text of a page, and how many of its lines the neighbour has too.

    The lines of one region are the text: of articles, of the main element outside its articles, of what is outside both, whichever
    has more text of its own (ties: in this order); shared lines are deleted but for those of an article.
    """
    shared = common([t for _, t in page], [t for _, t in neighbour]) if neighbour else set()
    own: dict[int, list[str]] = {}
    for i, (r, t) in enumerate(page):
        if r in (ARTICLE, HELD) or i not in shared:
            own.setdefault(r, []).append(t)
    best = max(own, key=lambda r: (sum(map(len, own[r])), r), default=PLAIN)
    return " ".join(own.get(best, ())), len(shared)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def _cuts(pages: DataFrame, key: Column) -> Column:
    """Ends of ranges of keys, drawn by a hash of the keys. They only balance the ranges."""
    width = 4 * shuffle_width(pages.sparkSession)  # several ranges a partition even out their sizes
    drawn = F.xxhash64(key)
    sample = pages.groupBy(F.pmod(drawn, F.lit(8 * width)).alias("s")).agg(F.min(F.struct(drawn.alias("h"), key.alias("k"))).alias("m"))
    return sample.agg(F.filter(F.array_sort(F.collect_list("m.k")), lambda k, i: i % 8 == 7).alias("c")).scalar()


def _in_ranges(pages: DataFrame, key: Column, cuts: Column) -> DataFrame:
    """``pages`` with ``part``, the range of the key."""
    width = 4 * shuffle_width(pages.sparkSession)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(width.bit_length()))])
    d = pages.withColumn("_key", key).withColumn("_cuts", cuts)
    return d.withColumn("part", F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(F.col("_cuts"), at + step - 1) < F.col("_key"), step).otherwise(0))).drop("_cuts", "_key")


#: Order of pages: pages that share an id are told apart by their html.
ORDER = ["host", "path", "page_id", "c"]


def _edge_runs(src: DataFrame, key: Column, cuts: Column) -> list:
    """First two and last two runs of every range, in order. A run is pages of a host with equal lines and none with other lines between;
    pages without lines or host are in no run."""
    kind = src.schema["page_id"].dataType.simpleString()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [xxhash.xxh3_64_intdigest(repr(x).encode("utf-8", "replace")) >> 1 if (x := lines((data or b"").decode("utf-8", "replace"))) else None
                     for part in slices(batch.column(4)) for data in part]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.int64())], [*ORDER, "h"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, runs, n, types = None, [], 0, None

        def made():
            rows = [(part, i, *r) for i, r in enumerate(runs)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                              ["part", "i", "host", "h", "path", "page_id", "c", "last_path", "last_id", "last_c"])

        for batch in batches:
            types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), batch.column(2).type, pa.int64(), pa.string(), batch.column(2).type, pa.int64())
            for host, path, page, c, h, p in zip(*(x.to_pylist() for x in batch.columns)):
                if p != part:
                    if runs:
                        yield made()
                    part, runs = p, []
                if runs and (runs[-1][0], runs[-1][1]) == (host, h):
                    runs[-1] = (*runs[-1][:5], path, page, c)
                else:
                    if len(runs) == 4:
                        del runs[2]
                    runs.append((host, h, path, page, c, path, page, c))
        if runs:
            yield made()

    named = src.select(*ORDER, "html").mapInArrow(hashes, f"host string, path string, page_id {kind}, c long, h long").where("h is not null and host <> ''")
    dealt = _in_ranges(named, key, cuts).repartition("part").sortWithinPartitions("part", *ORDER)
    runs = dealt.mapInArrow(ends, f"part int, i int, host string, h long, path string, page_id {kind}, c long, last_path string, last_id {kind}, last_c long")
    return sorted(runs.collect(), key=lambda r: (r["part"], r["i"]))  # four rows for each range at most


def _beside(runs: list) -> tuple[dict, dict]:
    """For pages by their place in the order, the ranges they are to stand beside: the last page before and the first page after
    a range that differ from its first and its last run. And for each range, the first path of its first run and the last one of its last
    run, which may begin and end in other ranges."""
    whole, own = [], {}
    for r in runs:
        if not (r["i"] == 0 and whole and (whole[-1][0]["host"], whole[-1][0]["h"]) == (r["host"], r["h"])):
            whole.append([r, r])
        whole[-1][1] = r
        first, _ = own.get(r["part"], (len(whole) - 1, 0))
        own[r["part"]] = (first, len(whole) - 1)
    places, paths = {}, {}
    for part, (a, b) in own.items():
        paths[part] = (whole[a][0]["path"], whole[b][1]["last_path"])
        if a and whole[a - 1][1]["host"] == whole[a][0]["host"]:
            r = whole[a - 1][1]
            places.setdefault((r["host"], r["last_path"], r["last_id"], r["last_c"]), []).append(part)
        if b + 1 < len(whole) and whole[b + 1][0]["host"] == whole[b][0]["host"]:
            r = whole[b + 1][0]
            places.setdefault((r["host"], r["path"], r["page_id"], r["c"]), []).append(part)
    return places, paths


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_shared) of every page.

    Pages are dealt by ranges of (host, path), so a host with many pages is many partitions; in each they are read
    in order. Neighbouring pages of a host with equal lines are one run, whatever pages without lines stand between them, and all pages
    of a run have one result: it is aligned with the page before or after it on its host, whichever path is nearer (ties: the one
    before). A first pass tells which runs stand at the ends of ranges; the pages that these are to be aligned with are copied to the
    range, however far away they are. Three pages and the ids of a run are held at a time. NULL and empty html has an
    empty text; a page without a host has no neighbour; repeated rows are pages.
    """
    spark = pages.sparkSession
    src = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), host_of(F.col(f"`{url}`")).alias("host"),
                       path_of(F.col(f"`{url}`")).alias("path"), F.xxhash64(F.col(f"`{html}`")).alias("c"), F.col(f"`{html}`").alias("html"))
    key = F.struct("host", "path", "page_id")
    cuts = _cuts(src, key)
    places, paths = _beside(_edge_runs(src, key, cuts))
    fields = src.select(*ORDER).schema.fields
    beside = spark.createDataFrame([(*k, v) for k, v in places.items()], T.StructType([*[T.StructField("_" + f.name, f.dataType) for f in fields], T.StructField("_to", T.ArrayType(T.IntegerType()))]))
    there = lambda part, copied: F.struct(part.alias("part"), F.lit(copied).alias("beside"))
    to = F.concat(F.array(there(F.col("part"), False)), F.transform(F.coalesce("_to", F.array().cast("array<int>")), lambda p: there(p, True)))
    same = [F.col(c).eqNullSafe(F.col("_" + c)) for c in ORDER]
    dealt = _in_ranges(src, key, cuts).join(F.broadcast(beside), same, "left").select("page_id", "url", "host", "path", "c", "html", F.inline(to))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = part = before = now = None  # now: [host, lines, first path, last path, pages of the run]
        first = True

        def made(after, last: bool) -> Iterator[tuple]:
            """The results of the run."""
            nonlocal first
            if not now[4]:
                return
            ends = paths.get(part, (now[2], now[3]))
            start, stop, first = ends[0] if first else now[2], ends[1] if last else now[3], False
            near = [(_alike(x[k], own), x[1]) for x, k, own in ((before, 3, start), (after, 2, stop)) if x and x[0] == now[0]]
            text, shared = main_text(now[1], max(near, key=lambda x: x[0], default=(0, None))[1])
            for page, url in now[4]:
                yield page, url, text, len(text), shared

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["page_id", "url", "text", "n_chars", "n_shared"])

        def results(batches) -> Iterator[tuple]:
            nonlocal kinds, part, before, now, first
            for batch in batches:
                kinds = (batch.column(0).type, pa.string(), pa.string(), pa.int64(), pa.int64())
                ids, urls, hosts, paths_, parts, copied = (batch.column(i).to_pylist() for i in (0, 1, 2, 3, 6, 7))
                k = -1
                for datas in slices(batch.column(5)):
                    for data in datas:
                        k += 1
                        if parts[k] != part:
                            if now:
                                yield from made(None, True)
                            part, before, now, first = parts[k], None, None, True
                        page = lines((data or b"").decode("utf-8", "replace"))
                        own = [] if copied[k] else [(ids[k], urls[k])]
                        if not page or not hosts[k]:
                            text, shared = main_text(page, None)
                            for page_id, url in own:
                                yield page_id, url, text, len(text), shared
                        elif now and now[0] == hosts[k] and now[1] == page and bool(now[4]) == bool(own):
                            now[3] = paths_[k]
                            now[4] += own
                        else:
                            after = [hosts[k], page, paths_[k], paths_[k], own]
                            if now:
                                yield from made(after, not own)
                            before, now = now, after
            if now:
                yield from made(None, True)

        rows = []
        for row in results(batches):
            rows.append(row)
            if len(rows) == 256:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    kind = src.schema["page_id"].dataType.simpleString()
    return (dealt.repartition("part").sortWithinPartitions("part", *ORDER, "beside")
            .mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, n_shared long"))
