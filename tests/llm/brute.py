"""Plain versions of the contracts, row by row, against which the queries are tested."""

import hashlib
import math
import re
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def secrets(text):
    """n_assign, n_access, n_hex, base_sha256."""
    text = text or ""
    found = [[(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]]
    found += [[(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]]
    found += [[(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]]
    names = ("assign", "access", "hex")
    listed = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(sum(found, [])))
    return (*map(len, found), hashlib.sha256(listed.encode()).hexdigest())


def linked_spans(text, operator):
    """(start, kind, end) of linked spans by comparing every pair of spans; patterns of weak parts are the operator's."""
    spans = lambda pattern: [m.span() for m in re.finditer(pattern, text, re.ASCII)]
    assigned = [(m.start(), m.end(), len(m[2])) for m in ASSIGN.finditer(text)]
    assign = [(a, b) for a, b, n in assigned if n >= 12]
    hexes, access = spans("[0-9a-f]{16,}"), spans("AKIA[A-Z0-9]{14,}")
    base = assign + hexes + access
    apart = lambda found: [x for x in found if not any(o[0] < x[1] and x[0] < o[1] for o in base)]
    mixed = [x for x in spans(operator.WEAK_SECRET) if re.search("[0-9]", v := text[slice(*x)]) and re.search("[A-Za-z]", v) and not re.fullmatch("[0-9a-f]+", v)]
    weak = [(a, b) for a, b, n in assigned if 6 <= n < 12] + apart(mixed)
    ids, ends = apart(spans(operator.WEAK_ID)), spans(operator.ENDPOINT)
    secret, identifier = assign + hexes + weak, access + ids
    near = lambda others, x: any(o[0] - x[1] <= operator.SCOPE and x[0] - o[1] <= operator.SCOPE for o in others)
    out = [(a, 3, b) for a, b in ids if near(secret, (a, b))]
    out += [(a, 4, b) for a, b in weak if near(identifier, (a, b)) or near(ends, (a, b))]
    return sorted(out + [(a, 5, b) for a, b in ends if near(identifier, (a, b)) and near(secret, (a, b))])


def statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            hit |= {i, i + 1, i + 2}
    n, again = len(words), len(hit)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), again, n < 50 or 100 * again > 50 * n


def contamination(text, items, width=10):
    """n_words, n_hit, sorted item ids."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: pattern.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = split(text), set(), set()
    for item, t in items:
        own = split(t)
        k = min(width, len(own))
        windows = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else set()
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def shingles(text):
    words = WORD.findall(text or "")
    n = max(1, len(words) - 4) if words else 0
    return Counter(tuple(words[i : i + 5]) for i in range(n))


def similarity(a, b):
    """Weighted Jaccard similarity of two multisets."""
    keys = a.keys() | b.keys()
    top = sum(max(a[k], b[k]) for k in keys)
    return sum(min(a[k], b[k]) for k in keys) / top if top else 0.0


def targets(sizes, cap=3):
    """Targets of sources in order, by repeated sharing."""
    total, fixed = sum(sizes), {}
    while True:
        free = [k for k in range(len(sizes)) if k not in fixed]
        rest, weights = total - sum(fixed.values()), sum(k % 3 + 1 for k in free)
        share = {k: rest * (k % 3 + 1) / weights for k in free}
        over = {k: cap * sizes[k] for k in free if share[k] > cap * sizes[k]}
        if not over:
            return [{**fixed, **share}[k] for k in range(len(sizes))]
        fixed |= over


def kept_by_determinant(vectors, floor, share=0.75, tail=1e-6):
    """Which rows of one group the minimum covariance determinant keeps: exact nearest subsets, numpy's own algebra."""
    x = np.asarray(vectors, float)
    n, d = x.shape
    h = math.ceil(share * n)
    quantile = lambda p: next(q for q in np.arange(0, 200, 1e-3) if 1 - math.exp(-q / 2) * (1 + q / 2) >= p)  # noqa: E731  four dimensions
    below = lambda q: 1 - math.exp(-q / 2) * (1 + q / 2 + q * q / 8)  # noqa: E731  six of them
    factor = share / below(quantile(share))

    def lower(c):
        out = np.zeros((d, d))
        for i in range(d):
            for j in range(i):
                out[i, j] = (c[i, j] - out[i, :j] @ out[j, :j]) / out[j, j]
            out[i, i] = math.sqrt(max(c[i, i] - out[i, :i] @ out[i, :i], floor[i] ** 2))
        return out

    distance = lambda m, low: (np.linalg.solve(low, (x - m).T) ** 2).sum(0)
    middle = np.median(x, axis=0)
    wide = np.maximum((np.quantile(x, 0.75, axis=0) - np.quantile(x, 0.25, axis=0)) / 1.349, floor)
    ends = []
    for m, c in ((middle, np.diag(wide**2)), (x.mean(0), np.cov(x.T, bias=True))):
        low, last = lower(c), None
        for _ in range(100):
            near = x[np.argsort(distance(m, low), kind="stable")[:h]]
            m, low = near.mean(0), lower(factor * np.cov(near.T, bias=True))
            if last is not None and abs(last - np.log(np.diag(low)).sum()) < 1e-9:
                break
            last = np.log(np.diag(low)).sum()
        ends.append((np.log(np.diag(low)).sum(), m, low))
    _, m, low = min(ends, key=lambda e: e[0])
    return distance(m, low) <= quantile(1 - tail)
