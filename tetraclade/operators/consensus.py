"""A prunable consensus tree: branches as bipartitions of an ordered list of leaves.

The tree is one small object on the driver. Every node covers an interval of leaf
positions that pruning never changes, so both sides of a branch are lists of
intervals.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions.quartets import topology_index
from ..sources.newick import _TOKEN, strip_comments

if TYPE_CHECKING:
    from .ensemble import Ensemble

Interval = tuple[int, int]


class _Branch:
    __slots__ = ("active", "child", "inner", "length", "parent")

    def __init__(self, parent: int, child: int, length: float, inner: bool):
        self.parent, self.child, self.length, self.inner, self.active = parent, child, length, inner, True


class ConsensusGraph:
    """The tree of ``newick`` over exactly the given taxa (at least four).

    Inner branches no longer than ``zero_eps`` are collapsed at once; an absent length
    is zero. A root of two children isn't a branch point of the unrooted tree and is
    moved to its first inner child.
    """

    def __init__(self, newick: str, taxa: Sequence[str], zero_eps: float = 1e-12):
        self.taxa = list(taxa)
        number = {t: i for i, t in enumerate(self.taxa)}
        self.kids: list[list[int]] = []
        self.parent: list[int] = []
        self.leaf: list[int] = []  # gid of a leaf, -1 for an inner node
        self.span: list[Interval] = []
        self.branches: list[_Branch] = []
        self.above: dict[int, int] = {}  # branch over each node
        self.order: list[int] = []
        root = _read(newick)
        todo = [(root, -1)]
        visited = []
        while todo:
            (kids, name, length), up = todo.pop()
            v = len(self.kids)
            self.kids.append([])
            self.parent.append(up)
            visited.append(v)
            if kids:
                self.leaf.append(-1)
                self.span.append((0, 0))
                todo += [(k, v) for k in reversed(kids)]
            else:
                if name not in number:
                    raise ValueError(f"leaf {name!r} is not in the namespace" if name else "a leaf has no name")
                self.leaf.append(number[name])
                self.span.append((len(self.order), len(self.order)))
                self.order.append(number[name])
            if up >= 0:
                self.above[v] = len(self.branches)
                self.branches.append(_Branch(up, v, length, bool(kids)))
                self.kids[up].append(v)
        for v in reversed(visited):
            if self.kids[v]:
                self.span[v] = (self.span[self.kids[v][0]][0], self.span[self.kids[v][-1]][1])
        if len(self.order) < 4:
            raise ValueError(f"a consensus tree needs four taxa or more, not {len(self.order)}")
        missing = set(range(len(self.taxa))) - set(self.order)
        if missing or len(set(self.order)) < len(self.order):
            raise ValueError(f"the tree's leaves must be the namespace; missing: {sorted(self.taxa[i] for i in missing)}")
        self.root = 0
        if zero_eps > 0:
            for b, x in enumerate(self.branches):
                if x.active and x.inner and x.length <= zero_eps:
                    self.prune(b)
        self._unroot()

    def _unroot(self) -> None:
        kids = self.kids[self.root]
        if len(kids) != 2:
            return
        inner = [v for v in kids if self.leaf[v] < 0]
        if not inner:
            return
        new = inner[0]
        other = kids[0] if kids[1] == new else kids[1]
        self.branches[self.above[other]].parent = new
        self.parent[other] = new
        self.kids[new].append(other)
        self.branches[self.above.pop(new)].active = False
        self.kids[self.root] = []
        self.root, self.parent[new], self.span[new] = new, -1, (0, len(self.order) - 1)

    @property
    def active_branch_ids(self) -> set[int]:
        """Inner branches that haven't been pruned."""
        return {i for i, b in enumerate(self.branches) if b.active and b.inner}

    def sides(self, branch: int) -> tuple[list[list[Interval]], list[list[Interval]]]:
        """Components on both sides of a branch, each a list of leaf intervals."""
        b = self.branches[branch]
        upper = []
        if self.parent[b.parent] != -1:
            lo, hi = self.span[b.parent]
            rest = [x for x in ((0, lo - 1), (hi + 1, len(self.order) - 1)) if x[0] <= x[1]]
            if rest:
                upper.append(rest)
        upper += [[self.span[v]] for v in self.kids[b.parent] if v != b.child]
        return upper, [[self.span[v]] for v in self.kids[b.child]]

    def n_qsupp(self, branch: int) -> int:
        """Quartets that test the branch: two components on each side."""
        u, v = self.sides(branch)
        return _pairs(u) * _pairs(v)

    def neighbours(self, branch: int) -> set[int]:
        """Active inner branches that touch this one."""
        b = self.branches[branch]
        near = [b.parent, *(v for v in self.kids[b.parent] if v != b.child), *self.kids[b.child]]
        ids = (self.above.get(v) for v in near)
        return {i for i in ids if i is not None and self.branches[i].active and self.branches[i].inner}

    def prune(self, branch: int) -> set[int]:
        """Collapse a branch; the branches whose sides change. AssertionError if it is not an active inner one."""
        b = self.branches[branch]
        assert b.active and b.inner, f"branch {branch} can't be pruned"
        dirty = self.neighbours(branch)
        kids = self.kids[b.parent]
        kids.remove(b.child)
        for v in self.kids[b.child]:
            self.branches[self.above[v]].parent = b.parent
            self.parent[v] = b.parent
            kids.append(v)
        b.active = False
        self.above.pop(b.child, None)
        self.kids[b.child] = []
        return dirty

    def sample_quartets(self, branch: int, n: int, rng: random.Random) -> list[tuple[tuple[int, int, int, int], int]]:
        """n quartets that test the branch, drawn uniformly, each with the topology it predicts."""
        if n <= 0:
            return []
        u, v = self.sides(branch)
        if not _pairs(u) or not _pairs(v):
            raise ValueError(f"no quartet tests branch {branch}")
        g = np.random.default_rng(rng.getrandbits(64))
        picks = []
        for side in (u, v):
            size = np.array([_size(c) for c in side])
            x, y = np.triu_indices(len(side), 1)
            cum = np.cumsum(size[x] * size[y], dtype=np.int64)
            k = np.searchsorted(cum, g.integers(0, int(cum[-1]), size=n), side="right")
            picks.append((side, x[k], y[k]))
        order = np.array(self.order)
        drawn = [order[self._leaf(side, c, g)] for side, x, y in picks for c in (x, y)]
        return [(tuple(sorted(q)), topology_index(*q)) for q in np.stack(drawn, 1).tolist()]

    @staticmethod
    def _leaf(side: list[list[Interval]], which: np.ndarray, g: np.random.Generator) -> np.ndarray:
        first = np.array([c[0] for c in side])
        width = first[:, 1] - first[:, 0] + 1
        size = np.array([_size(c) for c in side])
        second = np.array([c[1][0] if len(c) > 1 else 0 for c in side])
        r = g.integers(0, size[which])
        return np.where(r < width[which], first[which, 0] + r, second[which] + r - width[which])

    def to_newick(self) -> str:
        """The tree as it is now, without lengths."""
        text: dict[int, str] = {}
        todo = [(self.root, False)]
        while todo:
            v, done = todo.pop()
            if not self.kids[v]:
                text[v] = self.taxa[self.leaf[v]]
            elif done:
                text[v] = "(" + ",".join(text.pop(k) for k in self.kids[v]) + ")"
            else:
                todo.append((v, True))
                todo += [(k, False) for k in self.kids[v]]
        return text[self.root] + ";"

    def branch_table(self, spark: SparkSession) -> DataFrame:
        """``(branch, leaf_lo, leaf_hi, length, n_qsupp)`` of active inner branches."""
        rows = [(b, *self.span[self.branches[b].child], float(self.branches[b].length), self.n_qsupp(b)) for b in sorted(self.active_branch_ids)]
        return spark.createDataFrame(rows, "branch int, leaf_lo int, leaf_hi int, length double, n_qsupp bigint")

    def support(self, ens: Ensemble, n: int, rng: random.Random) -> DataFrame:
        """``(branch, group, n_trees, n_agree, support)``: how often trees show what sampled quartets predict."""
        from pyspark.sql import functions as F

        rows = [(b, q, k) for b in sorted(self.active_branch_ids) if self.n_qsupp(b) for q, k in self.sample_quartets(b, n, rng)]
        window = ens.quartets([q for _, q, _ in rows], count=len(rows))
        want = ens.spark.createDataFrame([(i, b, k) for i, (b, _, k) in enumerate(rows)], "qi bigint, branch int, expected int")
        t = ens.quartet_topology(window).join(want, "qi")
        agree = F.sum(F.when(F.col("topology") == F.col("expected"), F.col("count")).otherwise(0))
        return t.groupBy("branch", "group").agg(F.sum("count").alias("n_trees"), agree.alias("n_agree")).withColumn("support", F.when(F.col("n_trees") > 0, F.col("n_agree") / F.col("n_trees")))


def _size(component: list[Interval]) -> int:
    return sum(b - a + 1 for a, b in component)


def _pairs(side: list[list[Interval]]) -> int:
    s = [_size(c) for c in side]
    return (sum(s) ** 2 - sum(x * x for x in s)) // 2


def _read(text: str) -> tuple:
    """Nested (children, name, length) of a NEWICK string; missing or bad lengths are 0."""
    text = strip_comments(text)
    stack: list[list] = [[]]
    at, after_colon = 0, False
    closed = False
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            break
        at = m.end()
        sign = m.group(1)
        if sign == "(":
            stack.append([])
            closed = False
        elif sign == ")":
            kids = stack.pop()
            if not stack:
                raise ValueError("')' without '('")
            stack[-1].append([kids, "", 0.0])
            closed = True
        elif sign == ",":
            closed = False
        elif sign == ":":
            after_colon = True
            continue
        elif sign == ";":
            break
        else:
            word = m.group(2).replace("''", "'") if m.group(2) is not None else m.group(3)
            if after_colon:
                try:
                    stack[-1][-1][2] = float(word)
                except ValueError:
                    stack[-1][-1][2] = 0.0
            elif closed:
                stack[-1][-1][1] = word
            else:
                stack[-1].append([[], word, 0.0])
        after_colon = False
    if len(stack) != 1 or len(stack[0]) != 1:
        raise ValueError("a NEWICK string must hold one tree")
    return stack[0][0]
