"""Brute-force versions that the operators are tested against."""

import hashlib
import re
from collections import defaultdict

import xxhash

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, pattern=WORD):
    return pattern.findall((text or "").translate(UP))


def license_base(text, phrases):
    w, hits, labels = words(text), [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        hits += at
        if at:
            labels.add(label)
    return len(w), len(hits), min(hits, default=None), max(hits, default=None), labels


def license_blocks(text, half, pairs):
    """Overlapping stretches of the whole text's words; the tokens of neighbouring
    words stand between the two."""
    w = []
    for word in words(text):
        if w and (both := f"{w[-1]}_{word}") in pairs:
            w.append(both)
        w.append(word)
    for k in range(0, max(1, -(-len(w) // half) - 1), 1):
        yield set(w[k * half : (k + 2) * half])


def simhash(text, n=3):
    w = words(text, TOKEN)
    if not w:
        return 0
    n = min(n, len(w))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(len(w) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def linked(fps, distance):
    """id -> smallest id reachable, from id -> fingerprint, by all pairs."""
    ids, root = sorted(fps), {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def contamination(text, items, window=10):
    w, hit, found = words(text), set(), set()
    at = defaultdict(list)
    sizes = set()
    for item, t in items:
        p = words(t)
        n = min(window, len(p))
        if item is None or not n:
            continue
        sizes.add(n)
        for k in range(len(p) - n + 1):
            at[tuple(p[k : k + n])].append(str(item))
    for n in sizes:
        for k in range(len(w) - n + 1):
            if key := at.get(tuple(w[k : k + n])):
                found.update(key)
                hit.update(range(k, k + n))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), digest, bool(hit)
