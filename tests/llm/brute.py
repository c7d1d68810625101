"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import collections
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=5):
    words = WORD.findall(text or "")
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def links(texts, threshold=0.8):
    """The pairs of keys at the threshold or above."""
    sets = {k: shingles(t) for k, t in texts.items()}
    holders = collections.defaultdict(list)
    for k, s in sets.items():
        for g in s:
            holders[g].append(k)
    common = collections.Counter((a, b) for ks in holders.values() for a in ks for b in ks if a < b)
    return {
        (a, b) for (a, b), n in common.items() if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9
    }


def classes(keys, pairs):
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}


def bench_words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def overlaps(texts, items, least=5):
    """(document, item) -> agreeing words of the best alignment that the law calls an overlap.

    The law: ten agreeing words in some run of 13, or four fifths of an item of 5 to 12 words.
    """
    places = collections.defaultdict(list)
    words = {i: bench_words(t) for i, t in items.items()}
    for item, w in words.items():
        for q, x in enumerate(w if len(w) >= least else []):
            places[x].append((item, q))
    out = {}
    for key, text in texts.items():
        agree = collections.defaultdict(set)
        for p, x in enumerate(bench_words(text)):
            for item, q in places.get(x, ()):
                agree[item, p - q].add(q)
        for (item, _), at in agree.items():
            n = len(words[item])
            if any(sum(q in at for q in range(s, s + 13)) >= 10 for s in range(n - 12)) if n >= 13 else len(at) * 5 >= n * 4:
                out[key, item] = max(out.get((key, item), 0), len(at))
    return out


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal(text):
    """(start, kind, end) of the base spans."""
    valid = {
        "email": lambda v, d: True,
        "ip": lambda v, d: all(int(x) <= 255 for x in v.split(".")),
        "card": lambda v, d: 14 <= len(d) <= 19 and luhn(d),
        "phone": lambda v, d: 10 <= len(d) <= 15,
    }
    return sorted(
        (m.start(), no, m.end())
        for no, (kind, pattern) in enumerate(PII.items())
        for m in re.finditer(pattern, text or "")
        if valid[kind](m.group(), re.sub("[^0-9]", "", m.group()))
    )
