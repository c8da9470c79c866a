"""Plain versions of the operators, for small fixtures."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def words(text):
    return WORD.findall(text or "")


def secrets(text):
    """Counts and digest of the base kinds."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    spelled = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
    n = Counter(k for _, k, _ in found)
    return n[0], n[1], n[2], hashlib.sha256(spelled.encode()).hexdigest()


def base_counts(text):
    ws = words(text)
    text = text or ""
    grams = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def shingles(text):
    ws = tuple((text or "").lower().split())
    c, out = Counter(), []
    for i in range(max(1, len(ws) - 4)):
        g = ws[i : i + 5]
        out.append((g, c[g]))
        c[g] += 1
    return ws, frozenset(out)


def near_classes(texts: dict, threshold=0.8):
    """Class (its smallest id) of each id: components of all pairs of threshold or more; all shingles weigh alike."""
    ids = sorted(texts)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = {i: shingles(texts[i]) for i in ids}
    for a in ids:
        for b in ids:
            if a < b and root(a) != root(b):
                (wa, sa), (wb, sb) = sets[a], sets[b]
                k = len(sa & sb)
                if wa == wb or wa and wb and k >= threshold * (len(sa) + len(sb) - k) - 1e-9:
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def lm_tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def lm_base(rows):
    """doc_id: (held_out, n_tokens, n_known, N, base_score)."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in lm_tokens(t))
    n, v = sum(c.values()), len(c)
    return [(held(i), len(x := lm_tokens(t)), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x)) for i, t in rows]


def mix_targets(docs, max_repeat=3.0):
    """source: (size, target)."""
    size = defaultdict(int)
    for source, text in docs:
        size[source] += len(words(text))
    order = sorted((s for s in size if s is not None), key=lambda s: s) + ([None] if None in size else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    capped: set = set()
    while True:
        rest = sum(size.values()) - sum(max_repeat * size[s] for s in capped)
        left = [s for s in order if s not in capped and size[s]]
        unit = rest / sum(weight[s] for s in left) if left else 0
        over = {s for s in left if weight[s] * unit > max_repeat * size[s]}
        if not over:
            return {s: (size[s], 0.0 if not size[s] else max_repeat * size[s] if s in capped else weight[s] * unit) for s in order}
        capped |= over
