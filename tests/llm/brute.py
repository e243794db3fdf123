"""Plain Python versions of what the operators compute."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACE = r"[^\x20\x09-\x0D]+"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def components(rows, size=5):
    """{row number: (set size, least id reachable)} of (id, text) rows."""
    sets, parent = [], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = defaultdict(list)
    for k, (_, text) in enumerate(rows):
        w = re.findall(SPACE, lower(text))
        s = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        counts = Counter(j for x in s for j in lists[x])
        for j, c in counts.items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                parent[root(k)] = root(j)
        for x in s:
            lists[x].append(k)
        sets.append(s)
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        r = root(k)
        least[r] = i if least.get(r) is None else min(least[r], i if i is not None else least[r])
    return [(i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows)]


def suffix_dedup(rows, length):
    data = [(t or "").encode() for _, t in rows]
    counts = Counter(b[i:i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, data):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if counts[b[k:k + length]] > 1:
                gone[k:k + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def kept_lines(rows, least):
    """Kept text of each (id, text) row after later copies of runs with `least` words are gone; ids ascend."""
    docs = [(t or "").split("\n") for _, t in rows]
    windows = set()
    for d, lines in enumerate(docs):
        n = [len(re.findall(SPACE, x)) for x in lines]
        for a in range(len(lines)):
            b = next((b for b in range(a, len(lines)) if sum(n[a:b + 1]) >= least), None)
            if b is not None:
                windows.add((d, a, b))
        for b in range(len(lines)):
            a = next((a for a in range(b, -1, -1) if sum(n[a:b + 1]) >= least), None)
            if a is not None:
                windows.add((d, a, b))
    first: dict = {}
    gone = defaultdict(set)
    for d, a, b in sorted(windows):
        body = tuple(docs[d][a:b + 1])
        if body in first:
            gone[d] |= set(range(a, b + 1))
        else:
            first[body] = d
    return ["\n".join(x for i, x in enumerate(lines) if i not in gone[d]) for d, lines in enumerate(docs)]


def contaminated(text, benchmark, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    w, hit, items = cut(text), set(), set()
    for item, t in benchmark:
        p = cut(t)
        m = min(window, len(p))
        if not m:
            continue
        for i in range(len(p) - m + 1):
            for k in range(len(w) - m + 1):
                if w[k:k + m] == p[i:i + m]:
                    hit |= set(range(k, k + m))
                    items.add("null" if item is None else str(item))
    return len(w), len(hit), sorted(items)


def base_metrics(text):
    text = text or ""
    w = re.findall(SPACE, text)
    runs = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    counts, covered = Counter(runs), set()
    for i, r in enumerate(runs):
        if counts[r] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
