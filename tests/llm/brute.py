"""Plain versions of the operators for small inputs."""

import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return SPACED.findall(text or "")


def components(rows, size, num, den):
    """{id: (set size, smallest linked id)} by comparing all pairs that share a shingle."""
    sets, held = {}, defaultdict(list)
    for i, text in rows:
        w = words((text or "").translate(SMALL))
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
        for x in sets[i]:
            held[x].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        common = Counter(j for x in s for j in held[x] if j < i)
        for j, n in common.items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:k] + b[k + 1 :] for k in range(len(b)))


def line_dedup(rows, least):
    """{id: removed line numbers}: a line goes if an earlier one is equal or within one edit."""
    seen, out = [], {}
    for i, text in sorted(rows):
        out[i] = []
        for k, line in enumerate((text or "").split("\n")):
            w = words(line)
            if not w:
                continue
            if any(v == w or (min(len(v), len(w)) >= least and one_edit(v, w)) for v in seen):
                out[i].append(k)
            seen.append(w)
    return out


def substring_dedup(rows, size):
    """{id: (words, kept words)} for windows that start anywhere else too."""
    split = {i: words(t) for i, t in rows}
    counts = Counter(tuple(w[k : k + size]) for w in split.values() for k in range(len(w) - size + 1))
    out = {}
    for i, w in split.items():
        gone = {j for k in range(len(w) - size + 1) if counts[tuple(w[k : k + size])] > 1 for j in range(k, k + size)}
        out[i] = (w, [x for j, x in enumerate(w) if j not in gone])
    return out


def quality_base(text):
    w = words(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if SPACED.search(line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def license_base(text):
    w = LETTERS.findall((text or "").translate(SMALL))
    phrases = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
    hits = [(k, label) for p, label in phrases for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    at = [k for k, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def best_fit(items, capacity):
    """Bins for (size, source, cluster) by trying every bin: the tightest compatible one, the first of equals."""
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(room, b) for b, (room, s, c) in enumerate(bins) if room >= size and source not in s and cluster not in c]
        if fits:
            b = min(fits)[1]
        else:
            b = len(bins)
            bins.append([capacity, set(), set()])
        bins[b][0] -= size
        bins[b][1] |= {source} - {None}
        bins[b][2] |= {cluster} - {None}
        out.append(b)
    return out
