"""Plain Python answers to set the operators against."""

import re


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def join(parent, a, b):
    a, b = find(parent, a), find(parent, b)
    parent[max(a, b)] = min(a, b)


def shingle_set(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1)))


def near_copies(docs, words, percent):
    """[(id, text)] with distinct ids to {id: (n_shingles, component)}, every pair that shares a shingle compared."""
    sets = {i: shingle_set(t, words) for i, t in docs}
    parent = {i: i for i in sets}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    seen = set()
    for ids in holders.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1:]:
                if find(parent, a) != find(parent, b) and (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        join(parent, a, b)
    return {i: (len(s), find(parent, i)) for i, s in sets.items()}
