"""Repeated passages by blockwise suffix sorting with a difference cover.

:func:`suffix_array` sorts the suffixes of an integer text without ever holding a
key for all of them: suffixes fall into buckets by their first symbols, one bucket
is sorted at a time, and suffixes that agree in ``PERIOD`` symbols are told apart by
the ranks of the difference-cover sample, which are computed first. For two
positions some shift below ``PERIOD`` brings both into the sample, so a tie costs
one look-up however long the repeat is.

:func:`repeated_spans` applies it to a corpus. A passage of ``LENGTH`` words is
repeated if the same words stand earlier: in a document with a smaller (identifier,
text hash), or earlier in the same document. Every word inside a repeated passage is
reported, the first occurrence never is. The steps, all sharded:

1. Passages that stand earlier in the same document are found by their hashes where
   the document is; the first of them stands for all in what follows.
2. Anchors: of the ``WINDOW`` hashes of ``GRAM`` words inside a passage of ``LENGTH``
   words the least is its anchor. Copies of a passage have their anchors at the same
   place, so nothing is lost. Only (hash, document, position) moves.
3. Anchors whose hash occurs once are dropped in a sorted stream that holds one row.
   Documents that keep some are read again, and cut into pieces: the passages of each
   such anchor, which follow each other. Every passage is in exactly one piece.
4. Pieces meet by anchor hash. Equal pieces follow each other in the sorted stream
   and only the first is held; each shard's pieces go through the suffix array, and
   neighbours with a common prefix of ``LENGTH`` words are occurrences of one passage.
   An anchor with more than ``HOT`` different pieces hands its passages on, by hashes of
   128 bits, to a sorted stream that holds the first occurrence of each.

Defined cases: null, empty and shorter texts have no passages; equal rows (same
identifier and text) are one document and none of them is reported for the other;
a null identifier counts as the least. A very long text is held with some 260 bytes a
word. An empty table gives an empty table.
Columns besides identifier and text are not read by :func:`repeated_spans`, and are
carried by :func:`drop_repeats`.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import checkpoint, runs
from .quality import later
from .textops import Words, chunks, flat, fresh, map_text, mix64, ngrams, plain

LENGTH = 50
GRAM = 10
WINDOW = LENGTH - GRAM + 1
PERIOD = 32
#: Differences of these residues cover all residues modulo PERIOD.
COVER = np.array([0, 1, 3, 11, 17, 24, 29])
#: Suffixes sorted together.
BUCKET = 1 << 18
#: Words of pieces that one suffix array holds.
SHARD_WORDS = 1 << 20
#: Different pieces of one anchor that one suffix array holds.
HOT = 1 << 15
#: Rows of pieces that leave a document at once.
ROWS = 1 << 15

_SHIFT = np.full((PERIOD, PERIOD), -1)
for _a in range(PERIOD):
    for _b in range(PERIOD):
        for _d in range(PERIOD):
            if (_a + _d) % PERIOD in COVER and (_b + _d) % PERIOD in COVER:
                _SHIFT[_a, _b] = _d
                break
assert (_SHIFT >= 0).all()


def _two(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One key for the two symbols at each position."""
    return (text[at].astype(np.uint64) << np.uint64(32)) | text[at + 1]


def _refine(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ``at`` sorted by PERIOD symbols, and the group number of each."""
    order = at
    group = np.zeros(len(at), np.int64)
    open_ = np.ones(len(at), bool)
    for i in range(0, PERIOD, 2):
        where = np.flatnonzero(open_)
        if not len(where):
            break
        key = _two(text, order[where] + i)
        by = np.lexsort((key, group[where]))
        order[where] = order[where][by]
        key = key[by]
        g = group[where]
        split = np.zeros(len(order), bool)
        split[where[1:]] = (g[1:] == g[:-1]) & (key[1:] != key[:-1])
        group = group + np.cumsum(split)
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = group[1:] == group[:-1]
        open_ = same[1:] | same[:-1]
    return order, group


def _sample_ranks(text: np.ndarray, n: int) -> np.ndarray:
    """Rank of each cover position among all of them (-1 elsewhere), by prefix doubling."""
    at = np.arange(n)
    at = at[np.isin(at % PERIOD, COVER)]
    rank = np.full(n + PERIOD * 2, -1, np.int64)
    if not len(at):
        return rank
    at, group = _refine(text, at)
    rank[at] = group
    step = PERIOD
    while group[-1] + 1 < len(at):
        same = np.zeros(len(at) + 1, bool)
        same[1:-1] = group[1:] == group[:-1]
        tied = np.flatnonzero(same[1:] | same[:-1])
        nxt = at[tied] + step
        key = np.where(nxt < n, rank[np.minimum(nxt, n - 1)], -1)
        by = np.lexsort((key, group[tied]))
        at[tied] = at[tied][by]
        key, g = key[by], group[tied]
        split = np.zeros(len(at), bool)
        split[tied[1:]] = (g[1:] == g[:-1]) & (key[1:] != key[:-1])
        group = group + np.cumsum(split)
        rank[at] = group
        step *= 2
    return rank


def suffix_array(text: np.ndarray, wanted: np.ndarray | None = None, bucket: int = BUCKET) -> np.ndarray:
    """The suffixes of ``text`` (uint32, zero is not used) in order, or of ``wanted`` positions only."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint32), np.zeros(2 * PERIOD, np.uint32)])
    rank = _sample_ranks(padded, n)
    at = np.arange(n) if wanted is None else np.asarray(wanted)
    if not len(at):
        return at
    lead = padded[at]
    some = np.sort(lead[:: max(1, len(lead) // 4096)])
    cuts = np.unique(some[:: max(1, int(len(some) * bucket / len(lead)))])
    which = np.searchsorted(cuts, lead, "right")
    out = []
    for b in np.unique(which):
        order, group = _refine(padded, at[which == b])
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = group[1:] == group[:-1]
        tied = np.flatnonzero(same[1:] | same[:-1])
        if len(tied):
            members, g = order[tied], group[tied]
            first = np.concatenate([[True], g[1:] != g[:-1]])
            lead_of = members[np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))]
            one = (members - lead_of) % PERIOD == 0
            mixed = np.zeros(int(g[-1]) + 1, bool)
            mixed[g[~one]] = True
            plain = ~mixed[g]
            p = members[plain]
            key = rank[p + _SHIFT[p % PERIOD, p % PERIOD]]
            by = np.lexsort((key, g[plain]))
            members[plain] = p[by]
            rest = np.flatnonzero(~plain)
            if len(rest):
                edge = np.flatnonzero(np.concatenate([[True], g[rest][1:] != g[rest][:-1]]))
                for a, z in zip(edge, np.append(edge[1:], len(rest))):
                    members[rest[a:z]] = _merge(members[rest[a:z]], rank)
            order[tied] = members
        out.append(order)
    return np.concatenate(out)


def _merge(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Suffixes of one tie, sorted: each residue class by its own sample ranks, then merged pairwise."""

    def before(i: int, j: int) -> int:
        d = _SHIFT[i % PERIOD, j % PERIOD]
        return int(rank[i + d]) - int(rank[j + d])

    return np.array(sorted(at.tolist(), key=functools.cmp_to_key(before)))


def common_prefix(text: np.ndarray, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Whether the suffixes x and y agree in their first ``most`` symbols."""
    out = np.ones(len(x), bool)
    for i in range(most):
        live = np.flatnonzero(out)
        if not len(live):
            break
        out[live] = text[x[live] + i] == text[y[live] + i]
    return out


def _least(v: np.ndarray) -> np.ndarray:
    """Position of the (leftmost) least value among each position and the WINDOW - 1 after it."""
    m, at, span = v.copy(), np.arange(len(v)), 1
    while span < WINDOW:
        k = min(span, WINDOW - span)
        if k < len(m):
            better = m[k:] < m[:-k]
            m[:-k] = np.where(better, m[k:], m[:-k])
            at[:-k] = np.where(better, at[k:], at[:-k])
        span += k
    return at


def _passages(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of the passages that stand for themselves, and of those that stand earlier in their row."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.flatnonzero(row[: max(0, len(row) - LENGTH + 1)] == row[LENGTH - 1 :]) if len(row) >= LENGTH else np.zeros(0, np.int64)
    if not len(start):
        return start, start
    again = later(ngrams(h, LENGTH)[start] ^ mix64(row[start].astype(np.uint64)))
    new = np.ones(len(start), bool)
    new[again] = False
    return start[new], start[~new]


def _anchor_positions(h: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word positions of anchors, their hashes, and the first and last passage each stands for.

    ``start``: first words of passages. Every one of them belongs to exactly one
    anchor, the least hash inside it.
    """
    g = ngrams(h, GRAM)
    if not len(start):
        return start, g[:0], start, start
    owner = _least(g)[start]
    head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    at = owner[head]
    return at, g[at], start[head], start[np.append(head[1:], len(start)) - 1]


_ANCHORS = [T.StructField("gram", T.ArrayType(T.LongType())), T.StructField("pos", T.ArrayType(T.IntegerType()))]


def _anchors(column: pa.Array) -> list:
    data, offsets = flat(column)
    grams, at, cuts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
    total = 0
    for a, b in chunks(offsets):
        w = Words(data, offsets[a : b + 1])
        h = w.hashes()
        start, again = _passages(h, w.first)
        p, g, _, _ = _anchor_positions(h, start)
        row = np.searchsorted(w.first, p, "right") - 1
        place = p - w.first[row]
        if len(again):  # a row that repeats itself says so at place -1
            own = np.searchsorted(w.first, again, "right") - 1
            one = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            row, g, place = np.concatenate([row, own[one]]), np.concatenate([g, h[again[one]]]), np.concatenate([place, np.full(len(one), -1)])
            by = np.argsort(row, kind="stable")
            row, g, place = row[by], g[by], place[by]
        grams.append(g)
        at.append(place)
        cuts.append(total + np.searchsorted(row, np.arange(b - a), "right"))
        total += len(g)
    cut = pa.array(np.concatenate(cuts).astype(np.int32))
    return [
        pa.ListArray.from_arrays(cut, pa.array(np.concatenate(grams).view(np.int64))),
        pa.ListArray.from_arrays(cut, pa.array(np.concatenate(at).astype(np.int32))),
    ]


def _twice(batches):
    """Rows of the sorted stream whose key stands in the stream again, and those at place -1."""
    held = None  # the last row, and whether it goes on already
    for batch in batches:
        if not batch.num_rows:
            continue
        lead = 0
        if held is not None:
            batch = pa.Table.from_batches([held[0], batch]).combine_chunks().to_batches()[0]
            lead = 1
        k, place = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        same = (k[1:] == k[:-1]) & (place[1:] >= 0) & (place[:-1] >= 0)
        keep = place < 0
        keep[1:] |= same
        keep[:-1] |= same
        if lead:
            keep[0] &= not held[1]  # what was sent is not sent again
        sent = bool(keep[-1]) if len(k) > lead else held[1]
        held = batch.slice(len(k) - 1), sent
        if keep.any():
            yield batch.filter(pa.array(keep))


def _spans_of(start: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of the words under passages that begin at ``start``."""
    head = np.flatnonzero(np.concatenate([[True], (start[1:] - start[:-1] > LENGTH) | (row[1:] != row[:-1])]))
    return row[head], start[head], start[np.append(head[1:], len(start)) - 1] + LENGTH


_PIECE = ["gram", "piece", "node", "lo", "anchor"]


def _cut(batches):
    """Pieces around the anchors of each document: the word hashes of the passages each stands for.

    Words under passages that stand earlier in their document come as rows without a
    piece, from ``lo`` up to ``anchor``.
    """
    for batch in batches:
        t = pa.Table.from_batches([batch])
        data, offsets = flat(t["text"])
        for a, b in chunks(offsets):
            w = Words(data, offsets[a : b + 1])
            full = w.hashes()
            start, again = _passages(full, w.first)
            anchors, _, low, high = _anchor_positions(full, start)
            h = np.maximum((full >> np.uint64(32)).astype(np.uint32), 1)
            part = t.slice(a, b - a).combine_chunks()
            nodes = part["node"].combine_chunks()
            if len(again):
                own, begin, end = _spans_of(again, np.searchsorted(w.first, again, "right") - 1)
                key = pa.array(mix64(own.astype(np.uint64)).view(np.int64))
                base = w.first[own]
                yield pa.RecordBatch.from_arrays([key, pa.nulls(len(own), pa.binary()), nodes.take(pa.array(own)), pa.array((begin - base).astype(np.int32)), pa.array((end - base).astype(np.int32))], names=_PIECE)
            lists = part["marks"].combine_chunks()
            row = np.repeat(np.arange(b - a), np.diff(lists.offsets.to_numpy()))
            inner = lists.flatten()
            grams, pos = inner.field(0).to_numpy(), inner.field(1).to_numpy().astype(np.int64)
            real = pos >= 0
            row, grams, pos = row[real], grams[real], pos[real]
            for i in range(0, len(row), ROWS):
                r = row[i : i + ROWS]
                centre = w.first[r] + pos[i : i + ROWS]
                which = np.searchsorted(anchors, centre)
                lo, hi = low[which], high[which] + LENGTH
                size = hi - lo
                cut = np.concatenate([[0], np.cumsum(size)])
                words = h[np.repeat(lo - cut[:-1], size) + np.arange(cut[-1])]
                piece = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((cut * 4).astype(np.int32)), pa.py_buffer(words.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(grams[i : i + ROWS]), piece, nodes.take(pa.array(r)), pa.array((lo - w.first[r]).astype(np.int32)), pa.array((centre - lo).astype(np.int32))], names=_PIECE)


_SPAN = ["node", "a", "b", "p", "q"]


def _span_batch(node: pa.Array, a: np.ndarray, b: np.ndarray, p: np.ndarray | None = None, q: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(a)
    hashes = [pa.nulls(n, pa.int64()) if x is None else pa.array(x.view(np.int64)) for x in (p, q)]
    return pa.RecordBatch.from_arrays([node, pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), *hashes], names=_SPAN)


def _equal(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Where two columns agree; nulls agree."""
    same = pa.compute.fill_null(pa.compute.equal(x, y), False).to_numpy(zero_copy_only=False)
    return same | (x.is_null().to_numpy(zero_copy_only=False) & y.is_null().to_numpy(zero_copy_only=False))


def _first_pieces(batches, out: list):
    """The first of each run of equal pieces; spans of the others, and rows without a piece, go to ``out``."""
    held = None  # the first row of the last run
    for batch in batches:
        own = batch.column(1).is_null()
        if own.true_count:
            plain = batch.filter(own)
            out.append(_span_batch(plain.column(2), plain.column(3).to_numpy(), plain.column(4).to_numpy()))
            batch = batch.filter(pa.compute.invert(own))
        if not batch.num_rows:
            continue
        lead = held is not None
        if lead:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        gram, piece, node, lo = batch.column(0).to_numpy(), batch.column(1), batch.column(2), batch.column(3).to_numpy()
        n = len(gram)
        again = np.zeros(n, bool)
        again[1:] = (gram[1:] == gram[:-1]) & _equal(piece.slice(1), piece.slice(0, n - 1))
        origin = np.maximum.accumulate(np.where(~again, np.arange(n), 0))
        held = batch.slice(int(origin[-1]), 1)
        more = np.flatnonzero(again)
        if len(more):
            x, y = node.take(pa.array(more)), node.take(pa.array(origin[more]))
            # a row that repeats identifier and text is the same occurrence, and stays like the first
            other = ~(_equal(x.field(0), y.field(0)) & _equal(x.field(1), y.field(1)) & (lo[more] == lo[origin[more]]))
            more = more[other]
            size = pa.compute.binary_length(piece).to_numpy().astype(np.int64) // 4
            out.append(_span_batch(node.take(pa.array(more)), lo[more], lo[more] + size[more]))
        new = ~again
        new[0] &= not lead
        if new.any():
            yield batch.filter(pa.array(new))


def _words_of(piece: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all pieces, and where each begins (one more entry)."""
    o = np.frombuffer(piece.buffers()[1], np.int32)[piece.offset : piece.offset + len(piece) + 1].astype(np.int64) // 4
    return np.frombuffer(piece.buffers()[2], np.uint32), o


def _shard(batches):
    """Repeated spans of a shard's pieces, which come sorted by gram, piece, node, lo; passages of hot anchors by their hashes."""
    out: list = []
    for t, part in runs(_first_pieces(batches, out), lambda t: t["gram"].to_numpy(), max(1, SHARD_WORDS // (2 * LENGTH)), HOT):
        yield from out
        out.clear()
        yield from _hashed(t) if part is not None else _sorted(t)
    yield from out


def _hashed(t: pa.Table):
    """The passages of pieces, by two hashes of their words."""
    for part in t.to_batches(4096):
        text, o = _words_of(part.column(1))
        starts = np.diff(o) - LENGTH + 1
        inside = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
        row = np.repeat(np.arange(len(starts)), starts)
        h = mix64(text[o[0] : o[-1]].astype(np.uint64))
        at = o[row] - o[0] + inside
        p, q = ngrams(h, LENGTH)[at], ngrams(h, LENGTH, 0xC2B2AE3D27D4EB4F)[at]
        a = part.column(3).to_numpy()[row] + inside
        yield _span_batch(part.column(2).take(pa.array(row)), a, a + LENGTH, p, q)


def _later_passages(batches):
    """Spans of the passages of the stream sorted by hashes, node and place that aren't the first of theirs."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        node, a, b, p, q = batch.columns
        a, p, q = a.to_numpy(), p.to_numpy(), q.to_numpy()
        again = np.concatenate([[False], (p[1:] == p[:-1]) & (q[1:] == q[:-1])])
        origin = np.maximum.accumulate(np.where(~again, np.arange(len(again)), 0))
        held = batch.slice(int(origin[-1]), 1)
        more = np.flatnonzero(again)
        x, y = node.take(pa.array(more)), node.take(pa.array(origin[more]))
        more = more[~(_equal(x.field(0), y.field(0)) & _equal(x.field(1), y.field(1)) & (a[more] == a[origin[more]]))]
        if len(more):
            yield _span_batch(node.take(pa.array(more)), a[more], b.to_numpy()[more])


def _sorted(t: pa.Table):
    """Repeated spans of different pieces, by their suffix array."""
    piece = t["piece"].combine_chunks()
    text, o = _words_of(piece)
    size = np.diff(o)
    lo, anchor = t["lo"].to_numpy().astype(np.int64), t["anchor"].to_numpy().astype(np.int64)
    node = t["node"].combine_chunks()
    ids = _order(node)
    base = np.concatenate([[0], np.cumsum((size + 1 + PERIOD - 1) // PERIOD * PERIOD + PERIOD)])
    # aligned so that equal passages around one anchor lie in one residue class
    head = base[:-1] + (PERIOD - anchor % PERIOD) % PERIOD
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    dense, codes = np.unique(text[np.repeat(o[:-1], size) + inside], return_inverse=True)
    joined = np.zeros(int(base[-1]) + LENGTH, np.uint32)
    joined[np.repeat(head, size) + inside] = codes + 1
    gaps = np.flatnonzero(joined[: int(base[-1])] == 0)
    joined[gaps] = len(dense) + 1 + np.arange(len(gaps))  # every gap symbol is unique
    joined[int(base[-1]) :] = len(dense) + 1 + len(gaps) + np.arange(LENGTH)
    starts = np.maximum(size - LENGTH + 1, 0)
    within = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
    owner = np.repeat(np.arange(len(size)), starts)
    place = head[owner] + within
    back = np.full(len(joined), -1)
    back[place] = np.arange(len(place))
    sa = suffix_array(joined, place)
    if not len(sa):
        return
    equal = common_prefix(joined, sa[:-1], sa[1:], LENGTH)
    run = np.concatenate([[0], np.cumsum(~equal)])
    who = owner[back[sa]]
    pos = lo[who] + within[back[sa]]
    by = np.lexsort((pos, ids[who], run))
    run, who, pos = run[by], who[by], pos[by]
    first = np.concatenate([[True], run[1:] != run[:-1]])
    origin = np.maximum.accumulate(np.where(first, np.arange(len(run)), 0))
    dup = (ids[who] != ids[who[origin]]) | (pos != pos[origin])
    rows, a, b = _union(who[dup], ids, pos[dup], pos[dup] + LENGTH)
    if len(rows):
        yield _span_batch(node.take(pa.array(rows)), a, b)


def _order(node: pa.StructArray) -> np.ndarray:
    """Rank of each (id, h), null first."""
    table = pa.table({"id": node.field(0), "h": node.field(1)})
    by = pa.compute.sort_indices(table, sort_keys=[("id", "ascending"), ("h", "ascending")], null_placement="at_start").to_numpy()
    s = table.take(pa.array(by))
    i, h = s["id"].combine_chunks(), s["h"].to_numpy()
    same = pa.compute.fill_null(pa.compute.equal(i[1:], i[:-1]), False).to_numpy(zero_copy_only=False)
    null = i.is_null().to_numpy(zero_copy_only=False)
    new = ~((same | (null[1:] & null[:-1])) & (h[1:] == h[:-1]))
    out = np.empty(len(by), np.int64)
    out[by] = np.concatenate([[0], np.cumsum(new)]) if len(by) else 0
    return out


def _union(rows: np.ndarray, ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching spans of one document as one."""
    if not len(rows):
        return rows, a, b
    by = np.lexsort((a, ids[rows]))
    rows, a, b = rows[by], a[by], b[by]
    wide = int(b.max()) + 2
    doc = np.unique(ids[rows], return_inverse=True)[1] * wide
    reach = np.maximum.accumulate(doc + b)
    new = np.concatenate([[True], doc[1:] + a[1:] > reach[:-1]])
    head = np.flatnonzero(new)
    return rows[head], a[head], (reach - doc)[np.append(head[1:], len(a)) - 1]


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h")).alias("node"), text.alias("text"))


def _spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(node, spans)``: arrays of (a, b) word ranges to leave out, ascending and apart."""
    rows = _marked(docs, id_col, text_col)
    kind = rows.schema["node"].dataType
    anchors = map_text(rows, ["node"], "text", _anchors, _ANCHORS).where(F.size("gram") > 0)
    anchors = anchors.select("node", F.explode(F.arrays_zip("gram", "pos")).alias("x")).select("x.gram", "node", "x.pos")
    twice = anchors.repartition("gram").sortWithinPartitions("gram").mapInArrow(_twice, anchors.schema)
    marks = twice.groupBy("node").agg(F.sort_array(F.collect_set(F.struct("gram", "pos"))).alias("marks"))
    cut_schema = T.StructType([
        T.StructField("gram", T.LongType()), T.StructField("piece", T.BinaryType()), T.StructField("node", kind),
        T.StructField("lo", T.IntegerType()), T.StructField("anchor", T.IntegerType()),
    ])
    pieces = rows.join(marks, "node").select("node", "text", "marks").mapInArrow(_cut, cut_schema)
    met = pieces.repartition("gram").sortWithinPartitions("gram", "piece", "node", "lo")
    span = T.StructType([T.StructField("node", kind), *[T.StructField(x, T.IntegerType()) for x in "ab"], *[T.StructField(x, T.LongType()) for x in "pq"]])
    found = checkpoint(met.mapInArrow(_shard, span))  # spans only, and passages of hot anchors
    hot = found.where("p is not null").repartition("p", "q").sortWithinPartitions("p", "q", "node", "a").mapInArrow(_later_passages, span)
    found = found.where("p is null").union(hot).select("node", "a", "b")
    joined = F.aggregate(
        F.array_sort(F.collect_list(F.struct("a", "b"))),
        F.expr("cast(array() as array<struct<a:int,b:int>>)"),
        lambda out, x: F.when((F.size(out) > 0) & (F.element_at(out, -1)["b"] >= x["a"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["a"].alias("a"), F.greatest(F.element_at(out, -1)["b"], x["b"]).alias("b"))))).otherwise(F.concat(out, F.array(x))),
    )
    return found.groupBy("node").agg(joined.alias("spans"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, first_word, end_word)`` of every maximal range of words inside repeated passages."""
    s = _spans(docs, id_col, text_col).select("node", F.explode("spans").alias("s"))
    return s.select(F.col("node.id").alias("doc_id"), F.col("s.a").alias("first_word"), F.col("s.b").alias("end_word"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """The rows with repeated passages cut out of their texts.

    The white space after a cut passage goes with it. Rows of which nothing is left
    are dropped; ``count_col``, if there, is set to the new length of changed texts.
    """
    spans = _spans(docs, id_col, text_col)
    names = docs.columns
    count_at = names.index(count_col) if count_col in names else None
    i, k, own, cuts = fresh(names, "__id", "__k", "__h", "__spans")
    wide = docs.withColumn(own, F.xxhash64(F.col(f"`{text_col}`")))
    s = spans.select(F.col("node.id").alias(i), F.col("node.h").alias(k), F.transform("spans", lambda x: F.array(x["a"], x["b"])).alias(cuts))
    wide = wide.join(s, F.col(f"`{id_col}`").eqNullSafe(F.col(i)) & (F.col(own) == F.col(k)), "left").drop(i, k, own)
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            cut = batch.column(batch.num_columns - 1)
            some = cut.is_valid().to_numpy(zero_copy_only=False)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            if some.any():
                text = columns[at].to_pylist()
                gone = np.zeros(len(text), bool)
                for i in np.flatnonzero(some):
                    text[i] = remove_words(text[i], cut[int(i)].as_py())
                    gone[i] = not text[i].strip()
                columns[at] = pa.array(text, columns[at].type)
                if count_at is not None:
                    n = pa.array([len(x) if x is not None else None for x in text], pa.int64()).cast(columns[count_at].type)
                    columns[count_at] = pa.compute.if_else(pa.array(some), n, columns[count_at])
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(~gone))
            else:
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return plain(wide).mapInArrow(run, docs.schema)


def remove_words(text: str, spans: list[list[int]]) -> str:
    """``text`` without the given ranges of its words and the white space behind each."""
    raw = text.encode()
    w = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : int(w.start[a])])
        at = int(w.start[b]) if b < len(w) else len(raw)
    return b"".join([*out, raw[at:]]).decode()
