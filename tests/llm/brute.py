"""Plain versions of the operators, for small tables."""

import re
from collections import defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = SPACED.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def components(docs):
    """{doc_id: (set size, component)} of (doc_id, text) pairs with distinct ids."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = defaultdict(list)
    for i, s in sets.items():
        common = defaultdict(int)
        for g in s:
            for j in having[g]:
                common[j] += 1
            having[g].append(i)
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def repeats(docs, size=50):
    """{position in docs: (words, repeated word numbers, text left)} of (doc_id, text) pairs in order, distinct by pair."""
    seen, out = set(), []
    for _, text in docs:
        places = [(m.start(), m.end()) for m in SPACED.finditer(text or "")]
        w = [text[a:b].translate(LOWER) for a, b in places]
        gone = set()
        for j in range(len(w) - size + 1):
            k = tuple(w[j : j + size])
            if k in seen:
                gone.update(range(j, j + size))
            seen.add(k)
        left, at, q = "", 0, 0
        while q < len(w):
            if q in gone:
                left += text[at : places[q][0]]
                while q < len(w) and q in gone:
                    q += 1
                at = places[q][0] if q < len(w) else len(text)
            else:
                q += 1
        out.append((len(w), gone, None if text is None else left + text[at:]))
    return out


def leaks(docs, items, window=10):
    """[(words, hit word numbers, items)] of texts; items: (id, text)."""
    grams = defaultdict(set)
    for i, t in items:
        if i is None or t is None:
            continue
        w = ALNUM.findall(t.translate(LOWER))
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            grams[n, tuple(w[j : j + n])].add(str(i))
    sizes, out = {n for n, _ in grams}, []
    for t in docs:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, which = set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if found := grams.get((n, tuple(w[j : j + n]))):
                    hit.update(range(j, j + n))
                    which |= found
        out.append((len(w), hit, which))
    return out
