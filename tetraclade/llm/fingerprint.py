"""Document fingerprints by prefix polynomial hashes.

For a text of characters c_0 .. c_(n-1) (code points plus one) the fingerprint
modulo a prime M is ``sum(c_i * B**(n-1-i)) mod M``; two primes just below 2**31
give 62 bits. Prefix arrays hold ``sum(c_j * B**-j) mod M`` over all texts of a batch
laid end to end, so the hash of any span is one difference and one product,
whatever text it is in. Two spans are equal if their hashes are, and the longest
common extension of two positions is found by binary search over span lengths.

:func:`fingerprints` gives every row its fingerprint and compares it with the
*leader* of its head: the row with the least (identifier, length, text) among those
whose first ``HEAD`` characters are the same (the whole text if shorter). Only rows
that share a head with another move, sorted by head; the leader comes first in the
stream and is the only one held, so a head that millions of rows share needs no
more memory than one that two share.

:func:`extensions` looks for every row's longest common extension among all rows. In
the order of the texts a row's longest common prefix with any other row is the longer
of those with its two neighbours, and rows of equal texts follow each other; so all
texts are sorted once and each is compared with both neighbours. Partitions are cut
between heads, so rows on both sides of a cut share less than ``HEAD`` characters and
are compared by their heads, two rows a partition, in the driver.

Defined cases: null and empty texts have fingerprint 0 and no characters, and share
the empty head. Null identifiers come first. Equal rows get equal results. A very long
text is hashed whole, with some 90 bytes a character held. An empty table gives an
empty table. Columns besides identifier and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship
from .cluster import checkpoint
from .textops import chunks, flat, map_text

HEAD = 64
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525013)

_tables: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**i modulo prime for i < n."""
    t = _tables.get((base, prime))
    if t is None or len(t) < n:
        t = np.ones(1, np.uint64)
        step = base % prime
        while len(t) < n:
            t = np.concatenate([t, t * np.uint64(step) % np.uint64(prime)])
            step = step * step % prime
        _tables[base, prime] = t
    return t[:n]


class Prefixes:
    """Prefix arrays over code points, for spans of them."""

    def __init__(self, codes: np.ndarray):
        c = codes.astype(np.uint64) + np.uint64(1)
        self.sums, self.up = [], []
        for base, prime in zip(BASES, PRIMES):
            s = np.zeros(len(c) + 1, np.uint64)
            np.cumsum(c * _powers(pow(base, -1, prime), prime, len(c)) % np.uint64(prime), out=s[1:])
            self.sums.append(s % np.uint64(prime))
            self.up.append(_powers(base, prime, len(c) + 1))

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """62-bit hash of the spans from a up to b."""
        out = []
        for s, up, prime in zip(self.sums, self.up, PRIMES):
            out.append((s[b] + np.uint64(prime) - s[a]) % np.uint64(prime) * up[np.maximum(b, 1) - 1] % np.uint64(prime))
        return ((out[0] << np.uint64(31)) | out[1]).view(np.int64)

    def extension(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Longest common extension of positions x and y, up to ``most`` characters."""
        lo, hi = np.zeros(len(x), np.int64), np.asarray(most, np.int64).copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_] + 1) // 2
            same = self.span(x[open_], x[open_] + mid) == self.span(y[open_], y[open_] + mid)
            lo[open_[same]] = mid[same]
            hi[open_[~same]] = mid[~same] - 1
        return lo


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the rows and their offsets in them."""
    d = data[int(offsets[0]) : int(offsets[-1])]
    codes = np.frombuffer(d.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum((d & 0xC0) != 0x80)])[offsets - offsets[0]]


def _whole(column: pa.Array) -> list:
    data, offsets = flat(column)
    size, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in chunks(offsets):
        codes, o = code_points(data, offsets[a : b + 1])
        size.append(np.diff(o))
        value.append(Prefixes(codes).span(o[:-1], o[1:]))
    return [np.concatenate(size), np.concatenate(value)]


def _compare(batches):
    """Rows of the stream sorted by head, each against the first row of its head."""
    lead_head = lead_text = lead_id = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        _, offsets = flat(t["text"])
        for a, b in chunks(offsets):
            part = t.slice(a, b - a).combine_chunks()
            head, text, ids = (part[c].to_pylist() for c in ("head", "text", "doc_id"))
            if head[0] != lead_head or lead_text is None:
                lead_head, lead_text, lead_id = head[0], text[0], ids[0]
            texts = [lead_text, *text]
            codes, o = code_points(*flat(pa.array(texts, pa.large_string())))
            p = Prefixes(codes)
            leader, who = np.zeros(len(text), np.int64), []
            now, now_id = 0, lead_id
            for i, h in enumerate(head):
                if h != lead_head:
                    lead_head, now, now_id = h, i + 1, ids[i]
                leader[i] = now
                who.append(now_id)
            lead_text, lead_id = texts[now], now_id
            row = np.arange(1, len(texts))
            n = np.diff(o)
            common = p.extension(o[row], o[leader], np.minimum(n[row], n[leader]))
            fp = p.span(o[row], o[row + 1])
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"].combine_chunks(), pa.array(fp), pa.array(n[row]), pa.array(who, part["doc_id"].type), pa.array(common)],
                names=["doc_id", "fingerprint", "n_chars", "head_id", "common_chars"],
            )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_chars, fingerprint, head_id, common_chars)`` of every row."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.substring(text, 1, HEAD).alias("head"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType
    fields = [T.StructField("n_chars", T.LongType()), T.StructField("fingerprint", T.LongType())]
    # identifiers, heads and hashes: small beside the texts, and used twice
    every = checkpoint(map_text(rows, ["doc_id", "head"], "text", _whole, fields))
    shared = every.groupBy("head").agg(F.count("*").alias("n")).where("n > 1").select("head")
    schema = T.StructType([T.StructField("doc_id", kind), *fields[::-1], T.StructField("head_id", kind), T.StructField("common_chars", T.LongType())])
    met = rows.join(shared, "head", "left_semi").repartition("head").sortWithinPartitions("head", "doc_id", F.length("text"), "text")
    found = met.mapInArrow(_compare, schema).distinct()
    keys = ["fingerprint", "n_chars"]
    e, f = every.alias("e"), found.alias("f")
    same = F.col("e.doc_id").eqNullSafe(F.col("f.doc_id"))
    for k in keys:
        same = same & (F.col(f"e.{k}") == F.col(f"f.{k}"))
    joined = e.join(f, same, "left")
    alone = F.col("f.fingerprint").isNull()
    return joined.select(
        F.col("e.doc_id").alias("doc_id"),
        F.col("e.n_chars").alias("n_chars"),
        F.col("e.fingerprint").alias("fingerprint"),
        F.when(alone, F.col("e.doc_id")).otherwise(F.col("f.head_id")).alias("head_id"),
        F.when(alone, F.col("e.n_chars")).otherwise(F.col("f.common_chars")).alias("common_chars"),
    )


_FIRST, _LAST = 1, 2  # edges of a partition
_FOUND = ["doc_id", "n_chars", "fingerprint", "first_id", "partner_id", "common_chars"]


def _neighbours(batches):
    """Rows of the stream sorted by text, each against the rows before and after it."""
    task = TaskContext.get().partitionId()
    held = None  # the last row, its lead and its predecessor's identifier, common characters with that (-1: there is none)

    def rows(ids, firsts, befores, text, o, fp, before, after):
        m = len(after)
        j = np.arange(m)
        common = np.maximum(np.maximum(before, after), 0)
        partner = pa.concat_arrays([befores, ids]).take(pa.array(np.where(before >= after, j, len(befores) + j + 1), mask=common == 0))
        edge = np.where(before < 0, _FIRST, 0) | np.where(after < 0, _LAST, 0)
        heads = pa.array([text[int(i)].as_py()[:HEAD] if edge[i] else None for i in j], pa.string())
        return pa.RecordBatch.from_arrays(
            [ids.slice(0, m), pa.array(np.diff(o)[:m]), pa.array(fp[:m]), firsts.slice(0, m), partner, pa.array(common), pa.array(np.full(m, task, np.int32)), pa.array(edge.astype(np.int32)), heads],
            names=[*_FOUND, "task", "edge", "head"],
        )

    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        _, offsets = flat(t["text"])
        for a, b in chunks(offsets):
            part = t.slice(a, b - a).combine_chunks()
            ids, text = part["doc_id"].combine_chunks(), part["text"].combine_chunks().cast(pa.large_string())
            none = pa.nulls(1, ids.type)
            if held is None:
                lead, previous, least = ids.slice(0, 1), none, -1
            else:
                lead, previous, least = held[2:]
                ids, text = pa.concat_arrays([held[0], ids]), pa.concat_arrays([held[1], text])
            codes, o = code_points(*flat(text))
            p, n = Prefixes(codes), np.diff(o)
            between = p.extension(o[:-2], o[1:-1], np.minimum(n[:-1], n[1:]))
            same = (between == n[:-1]) & (between == n[1:])
            runs = np.maximum.accumulate(np.where(np.append(False, same), 0, np.arange(len(ids))))
            firsts = pa.concat_arrays([lead, ids.slice(1)]).take(pa.array(runs))
            before = np.append(least, between)
            befores = pa.concat_arrays([previous, ids.slice(0, len(ids) - 1)])
            if len(between):
                yield rows(ids, firsts, befores, text, o, p.span(o[:-1], o[1:]), before[:-1], between)
            held = ids.slice(len(ids) - 1), text.slice(len(ids) - 1), firsts.slice(len(ids) - 1), befores.slice(len(ids) - 1), int(before[-1])
    if held is not None:
        codes, o = code_points(*flat(held[1]))
        yield rows(held[0], held[2], held[3], held[1], o, Prefixes(codes).span(o[:-1], o[1:]), np.array([held[4]]), np.array([-1]))


def _across(edges: list) -> list[tuple]:
    """The first and last rows of all partitions, compared with those of the partitions beside."""
    edges = sorted(edges, key=lambda r: (r["task"], r["edge"]))
    best = [[r["partner_id"], r["common_chars"]] for r in edges]
    for i in range(1, len(edges)):
        x, y = edges[i - 1], edges[i]
        if x["task"] == y["task"]:
            continue
        common = next((k for k, (a, b) in enumerate(zip(x["head"], y["head"])) if a != b), min(len(x["head"]), len(y["head"])))
        if common > best[i - 1][1]:
            best[i - 1] = [y["doc_id"], common]
        if common and common >= best[i][1]:
            best[i] = [x["doc_id"], common]
    return [(r["doc_id"], r["n_chars"], r["fingerprint"], r["first_id"], *b) for r, b in zip(edges, best)]


def extensions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_chars, fingerprint, first_id, partner_id, common_chars)`` of every row.

    ``first_id`` is the least identifier of the rows with the same text. ``partner_id``
    is another row with the longest common prefix of all, ``common_chars`` long (the
    row before it in the order of texts and identifiers, if both neighbours share as
    much), null if no row begins alike.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.substring(text, 1, HEAD).alias("head"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType
    kinds = [kind, T.LongType(), T.LongType(), kind, kind, T.LongType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(_FOUND, kinds)])
    marked = T.StructType([*schema, T.StructField("task", T.IntegerType()), T.StructField("edge", T.IntegerType()), T.StructField("head", T.StringType())])
    ordered = rows.repartitionByRange("head").drop("head").sortWithinPartitions("text", "doc_id")
    # identifiers and hashes: small beside the texts, and used twice
    found = checkpoint(ordered.mapInArrow(_neighbours, marked))
    edges = _across(found.where("edge > 0").collect())
    return found.where("edge = 0").select(*_FOUND).union(docs.sparkSession.createDataFrame(edges, schema))
