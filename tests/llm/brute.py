"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import xxhash

SPACE = re.compile("[^\x20\x09-\x0d]+")
PLAIN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def space_words(text):
    return SPACE.findall((text or "").translate(LOWER))


def plain_words(text):
    return PLAIN.findall((text or "").translate(LOWER))


def shingles(words, width):
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def fold(doc_id, folds):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % folds == 0


def base_scores(rows, folds=10):
    """(n_tokens, n_known, N, base score) for each (id, text)."""
    docs = [(i, [*space_words(t), " "]) for i, t in rows]
    c = Counter(w for i, ws in docs if not fold(i, folds) for w in ws)
    n = sum(c.values())
    d = n + 0.1 * (len(c) + 1)
    return [(len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / d) for w in ws)) for _, ws in docs]


def fingerprint(text):
    words = space_words(text)
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n, linked):
    """Root of each of ``n`` nodes under all pairs for which ``linked`` holds."""
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                parent[root(i)] = root(j)
    return [root(i) for i in range(n)]


def leaks(docs, items, threshold=0.8):
    out = []
    for d, text in docs:
        have = shingles(plain_words(text), 5)
        for i, item in items:
            own = shingles(plain_words(item), 5)
            if own and len(own & have) >= threshold * len(own) - 1e-9:
                out.append((d, i, len(own), len(own & have)))
    return out


def digest(spans):
    """SHA-256 of kind:start:end of (start, order, kind, end) rows."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)).encode()).hexdigest()


def secret_base(text):
    text = text or ""
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii_base(text):
    def fine(kind, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return {
            "email": True,
            "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")),
            "card": 14 <= len(d) <= 19 and luhn,
            "phone": 10 <= len(d) <= 15,
        }[kind]

    text = text or ""
    return sorted((m.start(), i, k, m.end()) for i, (k, p) in enumerate(PII.items()) for m in re.finditer(p, text) if fine(k, m[0]))


def best_fit(pieces, capacity):
    """As the packing operator promises: every bin tried for each (length, source, cluster)."""
    bins, out = [], []
    for n, s, c in pieces:
        fits = [(b["rest"], i) for i, b in enumerate(bins) if b["rest"] >= n and b["rest"] > 0 and not (b["s"] & s or b["c"] & c)]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append({"rest": capacity, "s": 0, "c": 0})
        b = bins[i]
        out.append((i, capacity - b["rest"]))
        b["rest"] -= n
        b["s"] |= s
        b["c"] |= c
    return out


def runs(words, least=12, repeats=2):
    """(start, length, period) of maximal stretches under every lag, the smallest lag for each stretch."""
    n, found = len(words), {}
    for q in range(1, n // repeats + 1):
        i = q
        while i < n:
            a = i
            while i < n and words[i] == words[i - q]:
                i += 1
            length = i - a + q
            if i > a and length >= max(least, repeats * q):
                found.setdefault((a - q, length), q)
            i += i == a
    return sorted((s, length, q) for (s, length), q in found.items())


def nearest_row(rows, point):
    """(number, squared distance) of the nearest row, ties to the smaller number."""
    distances = [sum((a - b) ** 2 for a, b in zip(point, row)) for row in rows]
    return distances.index(min(distances)), min(distances)


def clusters(data, dim=64, k=8, rounds=10, scale=1024):
    """(vec_id, cluster, distance, cluster inertia, inertia, digest) of (vec_id, vector) rows."""
    kept = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in data if v and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: "~" if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest()
    rows = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    for _ in range(rounds):
        homes = [nearest_row(rows, v)[0] for _, v in kept]
        for c in set(homes):
            own = [v for (_, v), h in zip(kept, homes) if h == c]
            rows[c] = [sum(x) // len(own) for x in zip(*own)]
    last = [nearest_row(rows, v) for _, v in kept]
    sums = [sum(d for h, d in last if h == c) for c in range(len(rows))]
    long = lambda x, parts: x if x < 1 << 63 and all(d < 1 << 63 for d in parts) else None
    digests = [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in rows]
    every = [d for _, d in last]
    return [
        (i, h, long(d, []), long(sums[h], [x for c, x in last if c == h]), long(sum(every), every), digests[h]) for (i, _), (h, d) in zip(kept, last)
    ]
