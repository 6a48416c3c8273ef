"""NEWICK text to binary rooted trees, in plain Python for use inside executors.

Quoted labels and bracketed comments are accepted. Node numbers: leaves from left to
right, then inner nodes in post-order, the root last. A node of more than two
children becomes a left cascade of binary nodes; the inserted ones are *poly* and
have length zero.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from array import array
from collections.abc import Callable

import numpy as np

STRATEGIES = ("multifurcation", "zero-length-branch", "both")
_TOKEN = re.compile(r"\s*(?:([(),:;])|'((?:[^']|'')*)'|([^\s(),:;']+))")
#: Names joined, or nodes renumbered, at a time.
_CHUNK = 1 << 16


def format_newick(text: str) -> str:
    """Stripped text with a final semicolon."""
    text = text.strip()
    return text if text.endswith(";") else text + ";"


def strip_comments(text: str) -> str:
    """Text without bracketed comments, which may nest; quoted labels are left alone."""
    if "[" not in text:
        return text
    out, depth, quoted = [], 0, False
    for c in text:
        if c == "'" and not depth:
            quoted = not quoted
        if c == "[" and not quoted:
            depth += 1
        elif c == "]" and depth:
            depth -= 1
        elif not depth:
            out.append(c)
    return "".join(out)


def validate_newick(text: str) -> str:
    """The stripped tree, or ValueError: one semicolon, at the end, and balanced parentheses."""
    if not isinstance(text, str) or not text.strip():
        raise ValueError("empty NEWICK string")
    text = text.strip()
    if not text.endswith(";"):
        raise ValueError("a NEWICK string must end with ';'")
    if text.count(";") > 1:
        raise ValueError("a NEWICK string must have one ';' only")
    depth = 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            raise ValueError("')' without '('")
    if depth:
        raise ValueError("'(' without ')'")
    return text


class Tree:
    """Arrays of one binary tree; see :func:`parse`."""

    __slots__ = ("children", "depth", "gap", "had_multifurcations", "hi", "length", "lo", "n_leaves", "n_zero_length", "names", "parent", "poly", "rd", "support")

    def __init__(self, names: list[str], scan: _Scan, strategy: str, missing: float):
        n = len(names)
        total = 2 * n - 1
        children, inserted, known, length, known_leaf, leaf_length = scan.arrays()
        self.names, self.n_leaves, self.had_multifurcations = names, n, scan.multi
        self.children = np.full((total, 2), -1, np.int32)
        self.children[n:] = children
        self.parent = np.full(total, -1, np.int32)
        self.parent[children] = np.arange(n, total, dtype=np.int32)[:, None]
        self.poly = np.concatenate([np.zeros(n, bool), inserted])
        self.length = np.concatenate([leaf_length, length])
        value = np.where(np.concatenate([known_leaf, known]) | self.poly, self.length, missing)
        self.support = np.concatenate([np.full(n, np.nan), np.frombuffer(scan.support, float)])
        zero = (value == 0.0) & ~self.poly
        zero[-1] = False
        if strategy == "multifurcation":
            self.n_zero_length = int(zero.sum())
        else:
            zero[:n] = False
            self.poly = self.poly | zero
            self.n_zero_length = 0
        self.rd = np.zeros(total)
        self.depth = np.zeros(total, np.int32)
        self.lo, self.hi = np.arange(total), np.arange(total)
        self.gap = np.zeros(max(n - 1, 0), np.int32)  # common ancestor of leaves i and i + 1
        for v in range(n, total):
            a, b = self.children[v]
            self.lo[v], self.hi[v] = self.lo[a], self.hi[b]
            self.gap[self.hi[a]] = v
        for v in range(total - 2, -1, -1):
            p = self.parent[v]
            self.rd[v] = self.rd[p] + value[v]
            self.depth[v] = self.depth[p] + 1

    def topology_key(self) -> str:
        """Digest of shape, names and inserted nodes, not of lengths or supports."""
        return _topology_key(self.n_leaves, self.children[self.n_leaves :], "\0".join(self.names).encode(), np.flatnonzero(self.poly))

    def length_key(self) -> str:
        """Digest of topology and lengths."""
        return _length_key(self.topology_key(), self.length)

    def lca(self, u: int, v: int) -> int:
        """Lowest common ancestor of two nodes."""
        while u != v:
            if self.depth[u] >= self.depth[v]:
                u = int(self.parent[u])
            else:
                v = int(self.parent[v])
        return u

    def node(self, x: int | str) -> int:
        """Node number of a name or number; KeyError for an unknown name."""
        if isinstance(x, str):
            if x not in self.names:
                raise KeyError(x)
            return self.names.index(x)
        return x

    def distance(self, u: int | str, v: int | str, return_lca: bool = False) -> float | tuple[float, int]:
        """Summed lengths on the path between two nodes, and the node where it turns if asked for."""
        u, v = self.node(u), self.node(v)
        top = self.lca(u, v)
        d = 0.0 if u == v else float(self.rd[u] + self.rd[v] - 2 * self.rd[top])
        return (d, top) if return_lca else d

    def multi_lca(self, nodes: list[int | str]) -> tuple[int, float]:
        """Common ancestor of all nodes, and the length of the smallest subtree that joins them."""
        if not nodes:
            raise ValueError("no nodes")
        ids = sorted((self.node(x) for x in nodes), key=lambda v: (self.lo[v], -self.hi[v]))
        top = ids[0]
        for v in ids[1:]:
            top = self.lca(top, v)
        if len(ids) == 1:
            return top, 0.0
        return top, sum(self.distance(a, b) for a, b in zip(ids, ids[1:] + ids[:1])) / 2

    def split(self, a: int | str, b: int | str, c: int | str, d: int | str, return_steiner: bool = False) -> tuple:
        """(p0, p1, q0, q1) of the pairing p0 p1 | q0 q1; equal scores give the first with the last.

        With ``return_steiner`` that and the length of the four nodes' subtree.
        """
        w, x, y, z = sorted(self.node(v) for v in (a, b, c, d))
        if len({w, x, y, z}) < 4:
            raise ValueError("the four nodes must differ")
        r = self.rd
        first = r[self.lca(w, x)] + r[self.lca(y, z)]
        second = r[self.lca(w, y)] + r[self.lca(x, z)]
        third = r[self.lca(w, z)] + r[self.lca(x, y)]
        out = (w, z, x, y)
        if first > max(second, third):
            out = (w, x, y, z)
        elif second > max(first, third):
            out = (w, y, x, z)
        return (out, self.multi_lca([w, x, y, z])[1]) if return_steiner else out

    def split_index(self, a: int | str, b: int | str, c: int | str, d: int | str) -> int:
        """0, 1 or 2: which of the other nodes, in ascending order, pairs with the least."""
        p0, p1, *rest = self.split(a, b, c, d)
        return sorted([p1, *rest]).index(p1)

    def split_sets(self, a: int | str, b: int | str, c: int | str, d: int | str) -> frozenset[frozenset]:
        """The pairing as a set of two sets, of names if all four are names."""
        q = (a, b, c, d)
        label = {self.node(x): x for x in q} if all(isinstance(x, str) for x in q) else {}
        p = [label.get(v, v) for v in self.split(*q)]
        return frozenset((frozenset(p[:2]), frozenset(p[2:])))


class _Scan:
    """What a NEWICK string holds, in flat arrays; the names of its leaves go to ``leaf``, one after the other.

    ``children`` has a pair for each inner node in post-order, ``~number`` for a leaf and
    a number from 0 for an inner node. Absent lengths are not numbers and not ``known``.
    """

    __slots__ = ("children", "inserted", "known", "known_leaf", "leaf_length", "length", "multi", "n", "support")

    def __init__(self, text: str, leaf: Callable[[str], object], supports: bool):
        self.children, self.inserted, self.multi = array("i"), bytearray(), False
        self.length, self.known, self.leaf_length, self.known_leaf = array("d"), bytearray(), array("d"), bytearray()
        self.support = array("d") if supports else None
        self.n = 0
        kids, marks = array("i"), array("i", [0])  # open nodes: their children so far, and where these begin
        nan, match = math.nan, _TOKEN.match
        at, last, end = 0, "", len(text)  # last: what a label or length belongs to
        while at < end:
            m = match(text, at)
            if not m:
                if text[at:].strip():
                    raise ValueError(f"unexpected text at {at}: {text[at : at + 20]!r}")
                break
            at = m.end()
            kind = m.lastindex
            word = m[kind]
            sign = word if kind == 1 else None
            if sign == "(":
                if last in ("leaf", "inner"):
                    raise ValueError("'(' after a node")
                marks.append(len(kids))
                last = "("
            elif sign == ",":
                last = ","
            elif sign == ")":
                if len(marks) < 2:
                    raise ValueError("')' without '('")
                first = marks.pop()
                if len(kids) - first < 2:
                    raise ValueError("a node of fewer than two children")
                v = kids[first]
                for k in range(first + 1, len(kids) - 1):
                    self.multi = True
                    v = self._inner(v, kids[k], True)
                v = self._inner(v, kids[-1], False)
                del kids[first:]
                kids.append(v)
                last = "inner"
            elif sign == ":":
                last = last + ":" if last in ("leaf", "inner") else "leaf:"
            elif sign == ";":
                break
            elif last in ("leaf:", "inner:"):
                if len(kids) == marks[-1]:
                    raise ValueError("a length without a node")
                v = kids[-1]
                if v < 0:
                    self.leaf_length[~v] = float(word if kind == 3 else word.replace("''", "'"))
                    self.known_leaf[~v] = 1
                else:
                    self.length[v] = float(word if kind == 3 else word.replace("''", "'"))
                    self.known[v] = 1
                last = "done"
            elif last == "inner":
                value = float(word if kind == 3 else word.replace("''", "'"))
                if supports:
                    self.support[kids[-1]] = value
            else:
                kids.append(~self.n)
                self.n += 1
                leaf(word if kind == 3 else word.replace("''", "'"))
                self.leaf_length.append(nan)
                self.known_leaf.append(0)
                last = "leaf"
        if len(marks) > 1:
            raise ValueError("'(' without ')'")
        if len(kids) != 1:
            raise ValueError("a NEWICK string must hold one tree")

    def _inner(self, a: int, b: int, inserted: bool) -> int:
        self.children.append(a)
        self.children.append(b)
        self.inserted.append(inserted)
        self.length.append(math.nan)
        self.known.append(0)
        if self.support is not None:
            self.support.append(math.nan)
        return len(self.inserted) - 1

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Children by number of the tree, inserted, known and length of inner nodes, known and length of leaves.

        No copies: inserted nodes have length 0 from here on.
        """
        children = np.frombuffer(self.children, np.int32).reshape(-1, 2)
        for s in range(0, len(children), _CHUNK):
            part = children[s : s + _CHUNK]
            part[:] = np.where(part < 0, ~part, self.n + part)
        inserted, known = (np.frombuffer(x, bool) for x in (self.inserted, self.known))
        length = np.frombuffer(self.length, float)
        length[inserted] = 0.0
        return children, inserted, known, length, np.frombuffer(self.known_leaf, bool), np.frombuffer(self.leaf_length, float)


def _topology_key(n: int, children: np.ndarray, names: bytes | bytearray, poly: np.ndarray) -> str:
    """Digest of the pairs of children of inner nodes, of joined names and of inserted nodes."""
    h = hashlib.sha256()
    for s in range(0, n, _CHUNK):
        h.update(b"\xff" * (8 * min(_CHUNK, n - s)))  # leaves have none, (-1, -1)
    h.update(children.reshape(-1))
    h.update(names)
    h.update(poly.astype(np.int32))
    return h.hexdigest()


def _length_key(topology: str, *length: np.ndarray) -> str:
    h = hashlib.sha256(topology.encode())
    for x in length:
        h.update(x)
    return h.hexdigest()


def parse(text: str, strategy: str = "multifurcation", missing: float = 1.0) -> Tree:
    """The tree of a NEWICK string; ``missing`` stands for lengths that aren't given.

    ValueError for malformed text, nodes of one child, and inner labels that aren't
    numbers.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"polytomy strategy must be one of {', '.join(STRATEGIES)}")
    names: list[str] = []
    return Tree(names, _Scan(strip_comments(text), names.append, True), strategy, missing)


class Part:
    """A tree without most of its leaves; see :func:`parse_part`."""

    __slots__ = ("depth", "gap", "length_key", "n_leaves", "names", "poly", "rd", "topology_key")


def parse_part(text: str, keep: int, strategy: str = "multifurcation", missing: float = 1.0) -> Part:
    """The first ``keep`` names of a tree, in leaf order, and the common ancestors of neighbours among them.

    The text is read and checked as a whole. Depths and root distances are those of
    the whole tree, as are the keys and ``n_leaves``; ``gap`` counts in the nodes kept, leaves
    first. Of leaves of one name the first is kept. Nothing but flat arrays grows with the
    tree, some 45 bytes a leaf of a ladder beside the text.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"polytomy strategy must be one of {', '.join(STRATEGIES)}")
    names, chunk, first = bytearray(), [], {}  # first: candidates and their leaves
    done = 0

    def flush() -> None:
        nonlocal done, first
        if not chunk:
            return
        for i, x in enumerate(chunk, done):
            first.setdefault(x, i)
        if len(first) > keep:
            first = {x: first[x] for x in heapq.nsmallest(keep, first)}
        names.extend(("\0" * (done > 0) + "\0".join(chunk)).encode())
        done += len(chunk)
        chunk.clear()

    def leaf(name: str) -> None:
        chunk.append(name)
        if len(chunk) == _CHUNK:
            flush()

    scan = _Scan(strip_comments(text), leaf, False)
    del text
    flush()
    n = scan.n
    children, inserted, known, length, known_leaf, leaf_length = scan.arrays()
    zero = length == 0.0
    if missing == 0.0:
        zero |= ~known
    poly = inserted
    if strategy != "multifurcation":
        zero[-1:] = False
        poly = inserted | zero
    out = Part()
    out.n_leaves = n
    out.topology_key = _topology_key(n, children, names, n + np.flatnonzero(poly))
    out.length_key = _length_key(out.topology_key, leaf_length, length)
    del names, zero
    length[~(known | inserted)] = missing

    place = {leaf: i for i, leaf in enumerate(sorted(first.values()))}
    by_leaf = {i: x for x, i in first.items()}
    out.names = [by_leaf[i] for i in place]
    k, m, pairs = len(place), n - 1, scan.children
    met = [0] * (k - 1)  # the ancestor at which neighbours meet
    top = array("i", [-1]) * m  # last leaf kept below each inner node
    for v in range(m):
        a, b = pairs[2 * v], pairs[2 * v + 1]
        left = top[a - n] if a >= n else place.get(a, -1)
        right = top[b - n] if b >= n else place.get(b, -1)
        if left >= 0 and right >= 0:
            met[left] = v
        top[v] = right if right >= 0 else left
    del top
    rd, depth = array("d", [0.0]) * m, array("i", [0]) * m
    own_rd, own_depth = [0.0] * k, [0] * k
    value = scan.length
    for v in range(m - 1, -1, -1):
        r, d = rd[v], depth[v] + 1
        for x in (pairs[2 * v], pairs[2 * v + 1]):
            if x >= n:
                rd[x - n] = r + value[x - n]
                depth[x - n] = d
            elif x in place:
                i = place[x]
                own_rd[i] = r + (float(leaf_length[x]) if known_leaf[x] else missing)
                own_depth[i] = d
    out.rd, out.depth = own_rd + [rd[v] for v in met], own_depth + [depth[v] for v in met]
    out.poly = [False] * k + [bool(poly[v]) for v in met]
    out.gap = list(range(k, 2 * k - 1))
    return out


def split_block(text: str) -> list[str]:
    """Trees of a block: one a line, without blank lines and lines that start with '#'."""
    out = []
    lines = map(str.strip, text.splitlines())
    for number, tree in enumerate(lines, 1):
        if tree[:1] in ("", "#"):
            continue
        try:
            out.append(validate_newick(tree))
        except ValueError as e:
            raise ValueError(f"line {number}: {e}") from None
    if not out:
        raise ValueError("no trees found")
    return out
