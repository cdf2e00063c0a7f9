"""Plain Python versions of the corpus operators, for small inputs.
Documents are (doc_id, text) pairs, in any order."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(t):
    return WORD.findall(t or "")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def substring_dedup(docs, k=50):
    first = {}
    split = [(d, words(t)) for d, t in docs]
    for d, w in split:
        for i in range(len(w) - k + 1):
            x = tuple(w[i:i + k])
            if d is not None and (x not in first or d < first[x]):
                first[x] = d
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - k + 1):
            f = first.get(tuple(w[i:i + k]))
            if d is not None and f is not None and f < d:
                gone.update(range(i, i + k))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def decontaminate(docs, items, n=10):
    grams = collections.defaultdict(set)
    for i, t in items:
        w = NORMAL.findall((t or "").translate(UP))
        m = min(n, len(w))
        for p in range(len(w) - m + 1 if m else 0):
            grams[tuple(w[p:p + m])].add(i)
    sizes = {len(g) for g in grams}
    out = []
    for d, t in docs:
        w = NORMAL.findall((t or "").translate(UP))
        hit, found = set(), set()
        for m in sizes:
            for p in range(len(w) - m + 1):
                g = tuple(w[p:p + m])
                if g in grams:
                    hit.update(range(p, p + m))
                    found |= grams[g]
        ids = ",".join(sorted(str(x) for x in found))
        out.append((d, len(w), len(hit), len(found), sha(ids), bool(hit)))
    return out


def shingles(t, k=4):
    w = words((t or "").translate(UP))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_duplicates(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    where = collections.defaultdict(set)
    for i, (_, s) in enumerate(sets):
        for x in s:
            where[x].add(i)
    for i, (d, s) in enumerate(sets):
        for j in {j for x in s for j in where[x] if j > i}:
            both = len(s & sets[j][1])
            if d is not None and sets[j][0] is not None and 100 * both >= 80 * (len(s) + len(sets[j][1]) - both):
                a, b = find(d), find(sets[j][0])
                parent[max(a, b)] = min(a, b)
    return [(d, len(s), find(d) if d is not None else None, d is None or find(d) == d) for d, s in sets]


def quality_base(docs):
    out = []
    for d, t in docs:
        t = t or ""
        w = words(t)
        seen = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        rep = {j for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if words(x)]
        out.append((d, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep),
                    len(w) < 10 or 100 * len(rep) > 20 * len(w)))
    return out


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets_base(docs):
    out = []
    for d, t in docs:
        t = t or ""
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        n = collections.Counter(k for _, k, _ in found)
        out.append((d, n[0], n[1], n[2], sha(",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found)))))
    return out


def line_dedup(rows, ratio=0.1, min_pages=3):
    """rows: (host, text)."""
    pages = collections.defaultdict(set)
    for h, t in rows:
        pages[h].add(t)
    count = collections.Counter()
    for h, texts in pages.items():
        for t in texts:
            count.update((h, x) for x in {x.strip(" \t\n\x0b\x0c\r") for x in (t or "").split("\n")} if x)
    drop = {k for k, n in count.items() if n >= min_pages and n / len(pages[k[0]]) > ratio}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(" \t\n\x0b\x0c\r")) not in drop)
            for h, t in rows]


def targets(sizes, weights=(5, 2, 1), budget=1.5, most=2.0):
    """sizes: {source: tokens}; water filling in plain steps."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    open_, left, out = set(order), budget * sum(sizes.values()), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] >= most * sizes[s]}
        if not over:
            out |= {s: level * w[s] for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out
