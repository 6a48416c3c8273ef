"""An independent scalar version of the quartet engine, straight from the definitions."""

from __future__ import annotations

import itertools
import math

from tetraclade.sources.newick import parse


class Scalar:
    """Tree by parents; every answer walks to the root."""

    def __init__(self, text, strategy="multifurcation", names=None):
        t = parse(text, strategy)
        self.names = names or t.names
        self.parent = {v: int(p) for v, p in enumerate(t.parent)}
        length = [1.0 if math.isnan(x) and not p else (0.0 if p and math.isnan(x) else x) for x, p in zip(t.length, t.poly)]
        self.poly = {v for v, p in enumerate(t.poly) if p}
        self.rd = {}
        for v in range(len(self.parent) - 1, -1, -1):
            self.rd[v] = 0.0 if self.parent[v] < 0 else self.rd[self.parent[v]] + float(length[v])

    def up(self, v):
        while v >= 0:
            yield v
            v = self.parent[v]

    def lca(self, u, v):
        over = set(self.up(u))
        return next(x for x in self.up(v) if x in over)

    def quartet(self, leaves):
        """(topology, subtree length) of four leaf numbers in the order of global ids."""
        a, b, c, d = leaves
        pairs = [((a, b), (c, d)), ((a, c), (b, d)), ((a, d), (b, c))]
        anc = [[self.lca(*p) for p in pair] for pair in pairs]
        r = [self.rd[x] + self.rd[y] for x, y in anc]
        k = r.index(max(r))
        if any(x in self.poly for p in anc for x in p) and r[0] == r[1] == r[2]:
            k = 3
        return k, sum(self.rd[x] for x in leaves) - (r[0 if k == 3 else k] + sum(r)) / 2


def count(groups, taxa, quartets, strategy="multifurcation"):
    """{(quartet, group, k): [lengths]} over trees that hold the quartet."""
    out = {}
    for g, texts in groups.items():
        for text in texts:
            t = Scalar(text, strategy)
            at = {n: i for i, n in enumerate(t.names)}
            for q in quartets:
                leaves = [at.get(taxa[i]) for i in q]
                if None not in leaves:
                    k, s = t.quartet(leaves)
                    out.setdefault((tuple(q), g, k), []).append(s)
    return out


def qed(x, y):
    """Score of two count triples."""
    if not sum(x) or not sum(y):
        return 0.0
    s = 1.0
    for a, b in zip(x, y):
        p = a / sum(x) * b / sum(y)
        s += p * math.log(p, 3) if p else 0
    return s if x.index(max(x)) == y.index(max(y)) else -s


def combos(n):
    return list(itertools.combinations(range(n), 4))
