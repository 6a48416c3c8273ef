"""The array kernel: quartet topologies and subtree lengths of many trees at once.

A stored tree is held as the common ancestors of neighbouring leaves; the common
ancestor of two leaves is the shallowest of those between them. Up to ``DENSE`` taxa
the ancestors of all pairs are tabulated, beyond that a sparse table answers each
look-up in constant time with memory of order n log n.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

DENSE = 512
#: Quartets that go through all trees together.
BATCH = 8192


class Packed:
    """One stored tree, addressed by global taxon ids."""

    def __init__(self, slots: np.ndarray, gap: np.ndarray, depth: np.ndarray, poly: np.ndarray, rd: np.ndarray, variants: list[tuple[int, np.ndarray]]):
        self.leaf = slots  # leaf of each gid, -1 if absent
        self.rd, self.variants = rd, variants
        self.multiplicity = sum(m for m, _ in variants)
        self.poly = poly if poly.any() else None
        n = len(slots)
        self.dense = n <= DENSE
        self.useful = int((slots >= 0).sum()) >= 4
        if self.dense:
            here = np.flatnonzero(slots >= 0)
            order = here[np.argsort(slots[here])]
            table = np.full((n, n), -1, np.int32)
            low = np.full(len(gap) + 1, -1, np.int32)  # ancestors of one leaf and those to its right
            for i in range(len(gap) - 1, -1, -1):
                # walking right, the shallowest ancestor so far
                low[i] = gap[i]
                right = low[i + 1 : -1]
                low[i + 1 : -1] = np.where(depth[right] < depth[gap[i]], right, gap[i]) if len(right) else right
                if len(order) == len(gap) + 1:
                    table[order[i], order[i + 1 :]] = low[i:-1]
                    table[order[i + 1 :], order[i]] = low[i:-1]
                else:  # some leaves have no gid
                    j = slots[order]
                    if i in (k := {int(x): int(g) for x, g in zip(j, order)}):
                        to = order[j > i]
                        table[k[i], to] = low[slots[to] - 1]
                        table[to, k[i]] = low[slots[to] - 1]
            self.table = table.ravel()
            self.n = n
            # depth of each pair's common ancestor; not a number where a taxon is absent
            self.pair_rd = self.spread(rd)
        else:
            levels = [gap]
            step = 1
            while 2 * step <= len(gap):
                a, b = levels[-1][:-step], levels[-1][step:]
                levels.append(np.where(depth[b] < depth[a], b, a))
                step *= 2
            self.levels = np.full((len(levels), len(gap)), -1, np.int32)
            for k, row in enumerate(levels):
                self.levels[k, : len(row)] = row
            self.depth = depth

    def spread(self, rd: np.ndarray) -> np.ndarray:
        """Root distances of the common ancestors of all pairs (dense trees)."""
        return np.where(self.table >= 0, rd[self.table], np.nan)

    def lca(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common ancestors of present taxa (gids)."""
        if self.dense:
            return self.table[x * self.n + y]
        i, j = self.leaf[x], self.leaf[y]
        lo, hi = np.minimum(i, j), np.maximum(i, j)
        k = np.frexp((hi - lo).astype(float))[1] - 1
        a, b = self.levels[k, lo], self.levels[k, hi - (1 << k)]
        return np.where(self.depth[b] < self.depth[a], b, a)


PAIRS = ((0, 1), (2, 3), (0, 2), (1, 3), (0, 3), (1, 2))


def count(trees: list[tuple[int, Packed]], q: np.ndarray, n_groups: int, steiner: bool) -> list[np.ndarray]:
    """Counts (quartets, groups, 4) and, with ``steiner``, sum, least, greatest and sum of squares.

    Topology: of the pair sums of common-ancestor depths the largest wins, ties go to
    the lowest number; 3 only if an inserted node is involved and all three are equal.
    Comparisons with an absent taxon's not-a-number are false, so such a quartet wins
    nothing and is left out of the number present.
    """
    n = len(q)
    q = np.ascontiguousarray(q.T)
    counts = np.zeros((n_groups, 4, n), np.int64)
    stats = [np.zeros((n_groups, 4, n)), np.full((n_groups, 4, n), np.inf), np.full((n_groups, 4, n), -np.inf), np.zeros((n_groups, 4, n))] if steiner else []
    size, flat = None, []
    column = np.arange(n)
    for group, t in trees:
        if not t.useful:
            continue
        if t.dense:
            if size != t.n:
                size, flat = t.n, [q[x] * t.n + q[y] for x, y in PAIRS]
            r = [t.pair_rd[f] for f in flat]
        else:
            leaf = t.leaf[q]
            absent = (leaf < 0).any(0)
            safe = np.where(absent, q[:, :1] * 0 + np.flatnonzero(t.leaf >= 0)[:4, None], q) if absent.any() else q
            anc = [t.lca(safe[x], safe[y]) for x, y in PAIRS]
            r = [np.where(absent, np.nan, t.rd[v]) for v in anc]
        r0, r1, r2 = r[0] + r[1], r[2] + r[3], r[4] + r[5]
        two = r2 > np.maximum(r0, r1)
        one = (r1 > r0) & ~two
        here = r0 == r0
        none = None
        if t.poly is not None:
            tie = np.flatnonzero((r0 == r1) & (r1 == r2))
            if len(tie):
                inserted = np.zeros(len(tie), bool)
                for k in range(6):
                    inserted |= t.poly[t.table[flat[k][tie]] if t.dense else anc[k][tie]]
                none = tie[inserted]
        m = t.multiplicity
        cell = counts[group]
        cell[1] += one * m
        cell[2] += two * m
        cell[0] += (here & ~one & ~two) * m
        if none is not None:
            cell[0][none] -= m
            cell[3][none] += m
        if steiner:
            at = np.flatnonzero(here)
            topo = one.astype(np.int64) + 2 * two
            if none is not None:
                topo[none] = 3
            where = (topo * n + column)[at]
            total, least, most, square = (x[group].reshape(-1) for x in stats)
            leaves = t.leaf[q[:, at]]
            for m, rd in t.variants:
                if t.dense:
                    pair = t.pair_rd if rd is t.rd else t.spread(rd)
                    v = [pair[f[at]] for f in flat]
                else:
                    v = [rd[x[at]] for x in anc]
                s0, s1, s2 = v[0] + v[1], v[2] + v[3], v[4] + v[5]
                won = np.where(one[at], s1, np.where(two[at], s2, s0))
                s = rd[leaves].sum(0) - (won + s0 + s1 + s2) * 0.5
                total[where] += s * m
                square[where] += s * s * m
                least[where] = np.minimum(least[where], s)
                most[where] = np.maximum(most[where], s)
    return [np.moveaxis(x, 2, 0) for x in (counts, *stats)]


_loaded: dict[bytes, list[tuple[int, Packed]]] = {}


def load_once(payload: bytes) -> list[tuple[int, Packed]]:
    """:func:`load`, kept by the process for its next task on the same trees."""
    key = hashlib.blake2b(payload, digest_size=16).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = load(payload)
    return _loaded[key]


def load(payload: bytes) -> list[tuple[int, Packed]]:
    """The trees of a block."""
    out = []
    with pa.ipc.open_stream(payload) as r:
        for row in r.read_all().to_pylist():
            rd = np.array(row["rd"])
            if "variants" in row:
                variants = [(v["multiplicity"], rd if v["rd"] == row["rd"] else np.array(v["rd"])) for v in row["variants"]]
            else:
                variants = [(row["multiplicity"], rd)]
            out.append((row["group_idx"], Packed(np.array(row["slots"], np.int32), np.array(row["gap"], np.int32), np.array(row["depth"], np.int32), np.array(row["poly"], bool), rd, variants)))
    return out
