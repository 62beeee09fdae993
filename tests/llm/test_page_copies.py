from __future__ import annotations

import random

import pytest

from tidemark.llm import html_text as H

PAGES = "page_id long, url string, html string"


def results(rows):
    """{id: (text, shared lines)} by walking the pages of each host in order."""
    out = {}
    place = lambda u: u.split("/", 3)
    order = sorted((place(u)[2], "/" + place(u)[3], i, H.lines(h or "")) for i, u, h in rows)
    full = [x for x in order if x[3]]
    for k, (host, path, i, page) in enumerate(full):
        a = b = k
        while a and full[a - 1][0] == host and full[a - 1][3] == page:
            a -= 1
        while b + 1 < len(full) and full[b + 1][0] == host and full[b + 1][3] == page:
            b += 1
        near = []
        if a and full[a - 1][0] == host:
            near.append((H._alike(full[a - 1][1], full[a][1]), full[a - 1][3]))
        if b + 1 < len(full) and full[b + 1][0] == host:
            near.append((H._alike(full[b + 1][1], full[b][1]), full[b + 1][3]))
        out[i] = H.main_text(page, max(near, key=lambda x: x[0], default=(0, None))[1])
    return {i: ("", 0) for i, _, _ in rows} | out


def test_copies_and_pages_beside_empty_ones_lose_shared_lines(spark):
    frame = "<div>Site</div><div>All news</div><div>{}</div>"
    rows = [(0, "http://a.org/0", frame.format("first"))] + [(i, f"http://a.org/1{i}", frame.format("copied text")) for i in range(1, 6)]
    rows += [(6, "http://a.org/2", None), (7, "http://a.org/3", frame.format("last")), (8, "http://a.org/4", "")]
    got = {r.page_id: (r.text, r.n_shared) for r in H.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {0: ("first", 2), 6: ("", 0), 7: ("last", 2), 8: ("", 0)} | {i: ("copied text", 2) for i in range(1, 6)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_runs_over_many_ranges_equal_a_walk(spark, seed):
    rnd, rows = random.Random(seed), []
    for host in ("a.org", "b.org", "c.org"):
        n = rnd.choice([1, 40, 160])
        while n > 0:
            text, many = f"text {rnd.randint(0, 5)}", rnd.choice([1, 1, 2, 3, 60])
            for _ in range(many):
                html = rnd.choice([None, "", "<br>"]) if rnd.random() < 0.3 else f"<div>Site {host}</div><div a={len(rows)}>{text}</div><div>Imprint</div>"
                rows.append((len(rows), f"http://{host}/{rnd.choice('pq')}{len(rows):05d}", html))
            n -= many
    got = {r.page_id: (r.text, r.n_shared) for r in H.extract(spark.createDataFrame(rows, PAGES).repartition(4)).collect()}
    assert got == results(rows)
