"""Plain Python versions of the operators' contracts, for small inputs."""

import collections
import fractions
import re

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def shingles(text, size=5):
    w = words((text or "").translate(LOWER))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(docs):
    """{index: (set size, indexes of its component)} for a list of texts."""
    sets = [shingles(t) for t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(docs)):
        groups[find(i)].append(i)
    return {i: (len(sets[i]), groups[find(i)]) for i in range(len(docs))}


def quality_counts(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    where = collections.defaultdict(list)
    for k in range(len(w) - 7):
        where[tuple(w[k : k + 8])].append(k)
    inside = {k + j for ks in where.values() if len(ks) > 1 for k in ks for j in range(8)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(w), sum(map(len, w)), symbols, dup, len(inside)


def target_lines(halves, weights):
    """Slot by slot: how many halves each source should have had, as fractions. halves, weights: by source."""
    left = {s: fractions.Fraction(n) for s, n in halves.items()}
    lines = [{s: fractions.Fraction(0) for s in halves}]
    for _ in range(sum(halves.values())):
        room = fractions.Fraction(1)
        while room:
            live = [s for s in left if left[s]]
            total = sum(weights[s] for s in live)
            step = min([room, *(left[s] * total / weights[s] for s in live)])
            for s in live:
                left[s] -= step * weights[s] / total
            room -= step
        lines.append({s: halves[s] - left[s] for s in halves})
    return lines


def earliest_deadline_first(counts):
    """One window by a plain scheduler: counts by source -> sources in order."""
    slots, done, order = sum(counts.values()), dict.fromkeys(counts, 0), []
    for t in range(slots):
        ready = [(-(-(done[s] + 1) * slots // c), s) for s, c in counts.items() if done[s] < c and done[s] * slots // c <= t]
        order.append(min(ready, key=lambda x: (x[0], list(counts).index(x[1])))[1])
        done[order[-1]] += 1
    return order
