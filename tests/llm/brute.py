"""Plain single-machine versions of the operators' contracts, to hold the results against."""

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lower(text))


def simhash(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps, radius=4):
    """Component (smallest id) of each (id, fp)."""
    at = {i: i for i, _ in fps}

    def find(x):
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for k, (i, a) in enumerate(fps):
        for j, b in fps[:k]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(i), find(j)))
                at[y] = x
    return {i: find(i) for i, _ in fps}


def decontaminated(docs, items, size=13):
    held = {}
    for k, t in items:
        w = words(t)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            held.setdefault(tuple(w[i : i + size]), set()).add(k)
    sizes = {len(x) for x in held}
    out = {}
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i in range(len(w)):
            for n in sizes:
                if i + n <= len(w) and (got := held.get(tuple(w[i : i + n]))):
                    hit |= set(range(i, i + n))
                    ids |= got
        names = ",".join(sorted(map(str, ids)))
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out
