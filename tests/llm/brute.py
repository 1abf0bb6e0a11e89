"""Plain versions of the operators, for small fixtures."""

import hashlib
import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, size=5):
    w = words(text)
    return frozenset(tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1))) if w else frozenset()


def contamination(docs, bench, window=13):
    """doc -> (n_words, n_hit, n_items, items_sha256, contaminated)"""
    windows = {}
    for i, text in bench:
        w = words(text)
        size = min(window, len(w))
        for k in range(len(w) - size + 1) if w else ():
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for i, text in docs:
        w, hit, items = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    items |= own
                    hit.update(range(k, k + size))
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def dedup(docs, length=50):
    """(doc, n_bytes, n_removed, n_spans, kept_sha256) by looking at every window."""
    first = {}
    for i, text in docs:
        b = (text or "").encode()
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, text in docs:
        b = (text or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def groups(docs):
    """doc -> (class_id, copy_of, n_links, n_copies) at a similarity of 0.8 or more of five-word shingles."""
    own = {}
    for i, text in docs:
        own.setdefault(shingles(text), []).append(i)
    sets = [s for s in own if s]
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = [0] * len(sets)
    for a in range(len(sets)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    members = {}
    for k, s in enumerate(sets):
        members.setdefault(find(k), []).extend(own[s])
    out = {}
    for k, s in enumerate(sets):
        for i in own[s]:
            out[i] = (min(members[find(k)]), min(own[s]), links[k], len(own[s]))
    for i in own.get(frozenset(), []):
        out[i] = (i, i, 0, 1)
    return out
