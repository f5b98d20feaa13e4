"""Brute-force versions of the operators: one document or pair at a time, no hashing, no sketches."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = " \t\r\x0b\x0c"


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def order(key):
    """Documents by id, nulls first; ties by the row hash that the key carries."""
    return (key[0] is not None, key[0] or 0, key[1])


def line_dedup(docs, size=3):
    """docs: {(doc_id, hash): text}. The numbers of the lines that go, by key."""
    seen, gone = set(), defaultdict(set)
    for key in sorted(docs, key=order):
        full = [(i, x.strip(BLANK)) for i, x in enumerate((docs[key] or "").split("\n")) if x.strip(BLANK)]
        for j in range(len(full) - size + 1):
            part = full[j : j + size]
            window = tuple(x for _, x in part)
            if window in seen:
                gone[key] |= {i for i, _ in part}
            seen.add(window)
    return gone


def without_lines(text, gone):
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def classes(docs, k, num, den):
    """The first key of each document's component."""
    sets = {key: shingles(t, k) for key, t in docs.items()}
    parent = {key: key for key in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(docs, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                if x != y:
                    first = min(x, y, key=keys.index)
                    parent[y if first == x else x] = first
    return {key: find(key) for key in docs}, {key: len(s) for key, s in sets.items()}


def overlaps(text, items, n=13):
    """Words, hit words and items found, for items {item: text}."""
    words, hit, found = WORD.findall(lowered(text)), set(), set()
    for item, t in items:
        w = WORD.findall(lowered(t))
        size = min(n, len(w))
        for j in range(len(w) - size + 1) if w else []:
            for i in range(len(words) - size + 1):
                if words[i : i + size] == w[j : j + size]:
                    hit |= set(range(i, i + size))
                    found.add(str(item))
    return words, hit, sorted(found)


def repeats(docs, length=100):
    """(n_bytes, n_removed, n_spans, sha256 of the rest) by key."""
    seen, out = set(), {}
    for key in sorted(docs, key=order):
        b = (docs[key] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(b[p : p + length])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[key] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def copies(rows, flatten=0.7, seed=7, weights=None):
    """rows: (doc_id, text, source). Counter of (doc_id, source, copy)."""
    size = Counter()
    for _, t, s in rows:
        size[s] += max(len(t or ""), 1)
    target = {s: size[s] ** flatten if weights is None else weights.get(s, 0.0) for s in size}
    total, out = sum(size.values()), Counter()
    for i, t, s in rows:
        rate = target[s] / sum(target.values()) * total / size[s]
        pieces, n = max(math.ceil(rate / 64), 1), 0
        who = str(i) if i is not None else hashlib.md5((t or "").encode()).hexdigest()
        for j in range(1, pieces + 1):
            u = (int(hashlib.md5(f"{seed}|{who}|{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            p = c = math.exp(-rate / pieces)
            k = 0
            while c < u and k < 1000:
                k += 1
                p *= rate / pieces / k
                c += p
            n += k
        for copy in range(1, n + 1):
            out[i, s, copy] += 1
    return out
