"""Brute-force versions of operators in plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def uniform(key):
    return (int(hashlib.md5(("null" if key is None else str(key)).encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)


def targets(size, weights=(5, 2, 1), share=1.5, most=2.0):
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    free, left, out = set(size), share * sum(size.values()), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * size[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        out |= {s: most * size[s] for s in over}
        left, free = left - sum(most * size[s] for s in over), free - over
    return out


def mix(rows, by_size=0.25, most=2.0):
    """Copies of each (id, source, size) row."""
    total, by = Counter(), defaultdict(list)
    for i, source, size in rows:
        total[source] += size
        by[source].append((i, size))
    goal, copies = targets(total), {}
    for source, docs in by.items():
        step = {n: math.floor(4 * by_size * math.log2(max(n, 1)) + 0.5) for _, n in docs}
        held = Counter()
        for _, n in docs:
            held[step[n]] += n
        weight, left, full = {s: 2 ** (s / 4) for s in held if held[s]}, goal[source], set()
        while len(full) < len(weight):
            level = left / sum(held[s] * weight[s] for s in weight if s not in full)
            top = max(s for s in weight if s not in full)
            if level * weight[top] <= most * (1 + 1e-12):
                break
            full.add(top)
            left -= most * held[top]
        expected = {s: most if s in full else min(most, level * weight[s]) for s in weight}
        whole = {s: math.floor(e + 1e-9) for s, e in expected.items()}
        chance = {s: c if (c := expected[s] - whole[s]) >= 1e-9 else 0.0 for s in expected}
        budget = max(0.0, goal[source] - sum(whole[s] * held[s] for s in whole))
        alike = Counter((i, n) for i, n in docs if n and chance[step[n]] > 0)
        u = {k: uniform(k[0]) for k in alike}
        rank = {k: math.log(u[k] / (1 - u[k])) - math.log(chance[step[k[1]]] / (1 - chance[step[k[1]]])) for k in alike}
        order = sorted(alike, key=lambda k: (rank[k], k[0] is None, k[0] or 0, k[1]))
        taken, upto = set(), 0
        for k in order:
            upto += k[1] * alike[k]
            if upto > budget:
                gap = budget - (upto - k[1] * alike[k])
                rest = [(abs(x[1] * alike[x] - gap), rank[x], x[0] is None, x[0] or 0, x[1], x) for x in order if x not in taken]
                best = min((r for r in rest if r[0] < gap), default=None)
                taken |= {best[-1]} if best else set()
                break
            taken.add(k)
        for i, n in docs:
            copies[(source, i, n)] = whole[step[n]] + ((i, n) in taken) if n else 0
    return [copies[(source, i, n)] for i, source, n in rows]


def nearest(item, text):
    """The least edit distance between an item and any run of words."""
    line = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(line[j] + (a != b), line[j + 1] + 1, new[-1] + 1))
        line = new
    return min(line)


def plain_words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, k):
    w = words((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(sets, t):
    """Per key, the least key reachable by links."""
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and 100 * len(a & b) >= t * len(a | b):
                p, q = find(ids[x]), find(ids[y])
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


def measures(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside), "n_lines": len(lines)}


def kept(docs):
    """The (id, text, source) rows that the quality rules keep."""
    failed = {}
    for row in docs:
        m = measures(row[1])
        base = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
        failed[row] = base or 100 * m["n_symbols"] > 25 * m["n_words"] or 100 * m["n_dup_lines"] > 60 * m["n_lines"] or m["word_chars"] > 15 * m["n_words"]
    n, k = Counter(r[2] for r in docs), Counter(r[2] for r in docs if failed[r])
    total = sum(n.values())
    mean = sum(k.values()) / total
    var = sum(k[s] ** 2 / n[s] for s in n) / total - mean**2 - mean * (1 - mean) * len(n) / total
    strength = min(1e4, max(1.0, mean * (1 - mean) / var - 1)) if var > 0 else 1e4
    return [r for r in docs if not failed[r] and (k[r[2]] + mean * strength) / (n[r[2]] + strength) <= 0.5]
