"""Plain versions of the operators, for small tables."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def components(rows):
    """{row number: least key reachable}; a null key is below all others."""
    order = lambda k: (k is not None, k or 0)
    sets = [shingles(t) for _, t in rows]
    name = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] == rows[j][0] or (sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both)):
                old, new = name[i], name[j]
                name = [new if x == old else x for x in name]
    least = {c: min((rows[i][0] for i in range(len(rows)) if name[i] == c), key=order) for c in set(name)}
    return [(len(sets[i]), least[name[i]]) for i in range(len(rows))]


def kept_bytes(texts, length=400):
    """(kept bytes, removed, spans) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[p:p + length] for r in raw for p in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for p in range(len(r) - length + 1):
            if seen[r[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        out.append((bytes(b for b, g in zip(r, gone) if not g), sum(gone), len(re.findall(b"\1+", bytes(gone)))))
    return out


def base_counts(text):
    w = WORD.findall(text or "")
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i:i + 5])].append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed)
