"""Every statistic and command once more, in plain Python over plain rows, for the tests to compare with."""

import math
from collections import Counter
from fractions import Fraction
from statistics import NormalDist


def clamp(p):
    return min(1.0, max(1e-16, p))


def tail(x):
    return clamp(2 * (1 - NormalDist().cdf(math.sqrt(x)))) if x > 0 else 1.0


def chi(a, b, t1, t2):
    """The textbook's sum over the four fields, with Yates' half taken off each difference; None where a margin is empty."""
    fields = [[a, t1 - a], [b, t2 - b]]
    rows, columns, n = [t1, t2], [a + b, t1 + t2 - a - b], t1 + t2
    if 0 in rows + columns:
        return None
    expected = [[Fraction(r * c, n) for c in columns] for r in rows]
    return float(sum(max(abs(fields[i][j] - expected[i][j]) - Fraction(1, 2), 0) ** 2 / expected[i][j] for i in (0, 1) for j in (0, 1)))


def p_chi(a, b, t1, t2):
    x = chi(a, b, t1, t2)
    return 1.0 if x is None else tail(x)


def p_g(a, b, t1, t2):
    n, present = t1 + t2, a + b
    parts = [(a, t1 * present), (t1 - a, t1 * (n - present)), (b, t2 * present), (t2 - b, t2 * (n - present))]
    return tail(2 * sum(o * math.log(o * n / e) for o, e in parts if o and e))


def p_exact(a, b, t1, t2):
    ways = {i: math.comb(t1, i) * math.comb(t2, a + b - i) for i in range(max(0, a + b - t2), min(t1, a + b) + 1)}
    return clamp(float(Fraction(sum(w for w in ways.values() if w <= ways[a] * (1 + 1e-9)), math.comb(t1 + t2, a + b))))


def factor(a, b, t1, t2):
    beta = lambda k, n: Fraction(1, (n + 1) * math.comb(n, k))
    return float(beta(a, t1) * beta(b, t2) / beta(a + b, t1 + t2))


def posterior(a, b, t1, t2, prior=0.01, linked=0.9):
    ways = lambda p, q: p**a * (1 - p) ** (t1 - a) * q**b * (1 - q) ** (t2 - b)
    odds = prior / (1 - prior) * (ways(linked, 1 - linked) + ways(1 - linked, linked)) / 2 / ways(0.5, 0.5)
    return 1.0 if math.log(odds) > 20 else 0.0 if math.log(odds) < -20 else odds / (1 + odds)


def adjusted(p):
    """Benjamini and Hochberg, by the definition: the least of ``p[j] n / rank[j]`` over all that are no smaller."""
    return [min(1.0, min(y * len(p) / sum(z <= y for z in p) for y in p if y >= x)) for x in p]


def cell(depths, people, groups, least=1):
    return tuple(sum(d >= least and g == name for d, (_, g) in zip(depths, people)) for name in groups)


def tested(rows, people, groups, least=1, p_of=p_chi):
    """``{id: (g1, g2, n_ind, p, bonferroni, fdr)}`` of markers that someone has."""
    totals = [sum(g == name for _, g in people) for name in groups]
    seen = {i: (*cell(d, people, groups, least), sum(x >= least for x in d)) for i, _, d in rows if any(x >= least for x in d)}
    p = {i: p_of(*c[:2], *totals) for i, c in seen.items()}
    q = dict(zip(p, adjusted(list(p.values()))))
    return {i: (*c, p[i], min(1.0, p[i] * len(p)), q[i]) for i, c in seen.items()}


def depth(rows, people, frequency):
    least = int(frequency * len(people) + 1e-6)
    kept = [d for _, _, d in rows if sum(x > 0 for x in d) >= least]
    out = []
    for k, (name, group) in enumerate(people):
        own, all_own = sorted(d[k] for d in kept), [d[k] for _, _, d in rows]
        out.append((name, group, sum(all_own), sum(x > 0 for x in all_own), len(own), own[0], own[-1], own[len(own) // 2], sum(own) // len(own)))
    return out


def freq(rows, n, least=1):
    seen = Counter(sum(x >= least for x in d) for _, _, d in rows)
    return [(k, seen[k]) for k in range(1, n + 1)]


def reverse_complement(s):
    return "".join({"A": "T", "C": "G", "G": "C", "T": "A"}[c] for c in reversed(s))


def signature(s, k):
    return min(min(s[i : i + k], reverse_complement(s[i : i + k])) for i in range(len(s) - k + 1)) if len(s) >= k else s


def merged(tables):
    """``{sequence: depths}`` over all columns of ``(rows, number of columns)``."""
    width, out, at = sum(n for _, n in tables), {}, 0
    for rows, n in tables:
        for _, s, d in rows:
            s = "".join(c if c in "CGT" else "A" for c in s.upper())
            line = out.setdefault(s, [0] * width)
            for k, x in enumerate(d):
                line[at + k] = min(65535, line[at + k] + x)
        at += n
    return out
