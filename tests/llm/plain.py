"""Plain one-machine versions of the operators, straight from their definitions."""

from __future__ import annotations

import hashlib
import re

import xxhash

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def sha(b) -> str:
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def words(t):
    return [w for w in SPACE.split(t or "") if w]


def substrings(docs, k):
    first = {}
    for i, t in docs:
        w = words(t)
        for s in range(len(w) - k + 1):
            g = tuple(w[s : s + k])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in docs:
        w = words(t)
        gone = set()
        for s in range(len(w) - k + 1):
            if first[tuple(w[s : s + k])] < i:
                gone.update(range(s, s + k))
        out.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return sorted(out)


def suffixes(docs, size, keep):
    docs = [(i, (t or "").encode()) for i, t in docs]
    first, count = {}, {}
    for i, t in sorted(docs):
        for s in range(len(t) - size + 1):
            w = t[s : s + size]
            count[w] = count.get(w, 0) + 1
            first.setdefault(w, (i, s))
    out = []
    for i, t in docs:
        gone = bytearray(len(t))
        for s in range(len(t) - size + 1):
            w = t[s : s + size]
            if count[w] > 1 and (keep == "none" or first[w] != (i, s)):
                gone[s : s + size] = b"\1" * size
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, sha(bytes(b for b, g in zip(t, gone, strict=True) if not g))))
    return sorted(out)


def lines(docs, w):
    """(id, text) with later repeated runs of w lines deleted."""
    first = {}
    split = {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        rows = (t or "").split("\n")
        full = [n for n, x in enumerate(rows) if words(x)]
        split[i] = rows, full
        for s in range(len(full) - w + 1):
            first.setdefault(tuple(rows[n] for n in full[s : s + w]), (i, s))
    out = []
    for i, (rows, full) in split.items():
        gone = set()
        for s in range(len(full) - w + 1):
            if first[tuple(rows[n] for n in full[s : s + w])] != (i, s):
                gone.update(full[s : s + w])
        out.append((i, "\n".join(x for n, x in enumerate(rows) if n not in gone), len(full), len(gone)))
    return sorted(out)


def fingerprint(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near(docs):
    fp = {i: fingerprint(t) for i, t in docs}
    root = {i: i for i in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fp)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (fp[i], find(i)) for i in ids}


def bench_words(t):
    return [(m[0], m.span()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]


def contamination(docs, items, k=10):
    """(id, n_words, n_hit, item ids, text without hit spans)."""
    windows = {}
    for i, t in items:
        w = [x for x, _ in bench_words(t)]
        n = min(k, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w = bench_words(t)
        names = [x for x, _ in w]
        hit, found = set(), set()
        for n in {len(g) for g in windows}:
            for s in range(len(w) - n + 1):
                if (g := tuple(names[s : s + n])) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[g]
        text, at = "", 0
        for j in sorted(hit):
            if j - 1 not in hit:
                text += (t or "")[at : w[j][1][0]]
            at = w[j][1][1]
        out.append((i, len(w), len(hit), sorted(found), text + (t or "")[at:]))
    return out


PRIVATE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _private_ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "phone":
        return 9 <= len(d) <= 15
    if kind == "card":
        luhn = sum(v - 9 if (v := int(c) * (1 + i % 2)) > 9 else v for i, c in enumerate(reversed(d)))
        return 12 <= len(d) <= 19 and luhn % 10 == 0
    return True


def private(t):
    spans = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(PRIVATE.items()) for m in re.finditer(p, t or "") if _private_ok(k, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
