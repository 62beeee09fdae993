"""Plain-Python versions of the operators, for small tables."""

from __future__ import annotations

import re

import xxhash


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def folded(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def groups(n, linked):
    """Smallest member of each component of 0..n-1."""
    head = list(range(n))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                head[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(text, size=3):
    w = spaced(lower(text))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def similar(a, b, percent=90):
    both = len(a & b)
    return bool(a) and bool(b) and 100 * both >= percent * (len(a) + len(b) - both)


def quality(text):
    w, text = spaced(text), text or ""
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    covered = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if spaced(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def contamination(text, items):
    """(words, hit words, item ids) by comparing windows of 13 words."""
    w, hit, found = folded(text), set(), set()
    for item, body in items:
        v = folded(body)
        k = min(13, len(v))
        for win in {tuple(v[i:i + k]) for i in range(len(v) - k + 1)} if k else ():
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) == win:
                    hit.update(range(i, i + k))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def without_runs(rows):
    """{id: (text, removed lines)} by comparing every place with every earlier one, line by line.

    A run of several equal lines goes, and so does one line of 50 words or more; the first occurrence stays.
    """
    docs = [(i, (t or "").split("\n")) for i, t in sorted(rows)]
    places = [(k, j) for k, (_, lines) in enumerate(docs) for j in range(len(lines))]
    at_line = {}
    gone = set()
    for k, j in places:
        a = docs[k][1]
        for m, n in at_line.setdefault(a[j], []):
            b, run = docs[m][1], 0
            while j + run < len(a) and n + run < len(b) and a[j + run] == b[n + run]:
                run += 1
            if run > 1 or run and len(a[j].split()) >= 50:
                gone |= {(k, j + r) for r in range(run)}
        at_line[a[j]].append((k, j))
    out = {}
    for k, (i, lines) in enumerate(docs):
        kept = [x for j, x in enumerate(lines) if (k, j) not in gone]
        out[i] = ("\n".join(kept), len(lines) - len(kept))
    return out


def without_chunks(rows):
    """{id: (text, removed lines)} by the rule of content-defined chunks: a boundary where the rolled hash of a line and the one before it is
    even in its upper half, or beside a line of 50 words; the first of equal chunks of several lines, or of one such line, stays."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines, kept, chunk, removed = text.split("\n"), [], [], 0
        hashes = [0, *map(xxhash.xxh3_64_intdigest, lines)]
        for j, line in enumerate(lines):
            chunk.append(line)
            rolled = (hashes[j] * 0x9E3779B97F4A7C15 + hashes[j + 1]) % 2**64
            if j + 1 < len(lines) and len(line.split()) < 50 and len(lines[j + 1].split()) < 50 and (rolled >> 32) % 2:
                continue
            body = "\n".join(chunk)
            if body.split() and (len(chunk) > 1 or len(body.split()) >= 50) and body in seen:
                removed += len(chunk)
            else:
                kept += chunk
            if len(chunk) > 1 or len(body.split()) >= 50:
                seen.add(body)
            chunk = []
        out[i] = ("\n".join(kept) if removed else text, removed)
    return out
