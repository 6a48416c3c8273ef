"""Near duplicates by b-bit MinHash.

Shingles are pairs of consecutive words (the one word of a one-word text). Of each
of ``HASHES`` minima the low ``BITS`` bits are kept, packed as bit planes: 32 bytes
a document. Two signatures agree in a share p of their lanes; because unrelated
lanes agree with probability C = 2**-BITS, similarity is estimated as
``(p - C) / (1 - C)``, with p from one XOR, OR and bit count over the planes.

Candidates come from ``BANDS`` bands of ``HASHES / BANDS`` full minima. Rows with
equal signatures are one node first, so exact copies cost nothing further. A band's
rows meet sorted in one stream; inside a bucket a breadth-first search joins every
pair whose estimate reaches ``THRESHOLD`` and never compares a row again that was
reached, so a bucket of n copies of one text costs n comparisons and no candidate
is left out. A bucket of ``PART`` rows or more comes in parts of that size; each is
searched by itself and then compared with every other part in a task of its own, so
no worker holds a whole bucket. Groups are the connected components over all bands.

At a true similarity of 0.6 a pair meets in a band with probability 0.988, of 0.7 with
0.9998. The estimate's standard deviation is about 0.05, so single pairs close to the
threshold may go either way; short texts that share one line stay apart.

Defined cases: null, empty and blank texts have no shingles; each is a group of its
own with a null similarity. Rows that repeat an identifier with another text are
separate documents; rows that repeat both are one group. A null identifier counts
as the least one. An empty table gives an empty table. Columns besides identifier
and text are not read by :func:`near_duplicates`, and are carried by
:func:`drop_near_duplicates`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import checkpoint, components, runs
from .textops import Words, chunks, flat, fresh, map_text, mix64, ngrams

HASHES = 128
BANDS = 32
BITS = 2
SHINGLE = 2
THRESHOLD = 0.6
#: Rows of a bucket that are compared in one task.
PART = 4096

_C = 2.0**-BITS
_WORDS = HASHES // 64


def _parameters() -> tuple[np.ndarray, np.ndarray]:
    x = mix64(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x >> np.uint64(32)).astype(np.uint32)
    return x[:HASHES] | np.uint32(1), x[HASHES:]


def _mix32(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def minima(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have shingles, and their minima (HASHES by those rows)."""
    w = Words(data, offsets)
    h = w.hashes()
    count = np.diff(w.first)
    rows = np.flatnonzero(count)
    n = np.maximum(count[rows] - SHINGLE + 1, 1)
    pairs = ngrams(h, SHINGLE)
    last = w.first[rows + 1] - 1  # where no pair starts, but in one-word texts
    x = mix64(h ^ np.uint64(0xB5297A4D))
    x[: len(pairs)] = np.where(np.isin(np.arange(len(pairs)), last), x[: len(pairs)], pairs)
    take = np.ones(len(h), bool)
    take[last[count[rows] >= SHINGLE]] = False
    x = (x[take] >> np.uint64(32)).astype(np.uint32)
    start = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
    a, b = _parameters()
    out = np.empty((HASHES, len(rows)), np.uint32)
    if len(rows):
        for i in range(HASHES):
            out[i] = np.minimum.reduceat(x * a[i] + b[i], start)
    return rows, out


def pack(least: np.ndarray) -> np.ndarray:
    """Packed low bits of minima: rows by BITS * HASHES / 8 bytes."""
    low = _mix32(least)
    planes = [np.packbits(((low >> np.uint32(j)) & np.uint32(1)).astype(bool), axis=0) for j in range(BITS)]
    return np.ascontiguousarray(np.concatenate(planes).T)


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band: rows by BANDS."""
    r = HASHES // BANDS
    key = np.repeat(np.arange(BANDS, dtype=np.uint64)[:, None], least.shape[1], 1)
    for i in range(r):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + least[i::r].astype(np.uint64) + np.uint64(1))
    return np.ascontiguousarray(key.T).view(np.int64)


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated similarity of packed signatures (as 64-bit words, last axis)."""
    differ = x ^ y
    off = differ[..., :_WORDS]
    for j in range(1, BITS):
        off = off | differ[..., j * _WORDS : (j + 1) * _WORDS]
    p = 1.0 - np.bitwise_count(off).sum(-1, dtype=np.int64) / HASHES
    return (p - _C) / (1.0 - _C)


def _sketch(column: pa.Array) -> list:
    data, offsets = flat(column)
    rows, sigs, bands = [np.zeros(0, np.int64)], [np.zeros((0, BITS * HASHES // 8), np.uint8)], [np.zeros((0, BANDS), np.int64)]
    for a, b in chunks(offsets):
        r, least = minima(data, offsets[a : b + 1])
        rows.append(r + a)
        sigs.append(pack(least))
        bands.append(band_keys(least))
    has = np.zeros(len(offsets) - 1, bool)
    has[np.concatenate(rows)] = True
    sig, band = np.concatenate(sigs), np.concatenate(bands)
    at = np.concatenate([[0], np.cumsum(has)])
    null = pa.array(~has)
    valid = pc.invert(null)
    wide = pa.Array.from_buffers(pa.binary(), len(has), [valid.buffers()[1], pa.py_buffer((at * sig.shape[1]).astype(np.int32)), pa.py_buffer(sig.tobytes())])
    lists = pa.ListArray.from_buffers(pa.list_(pa.int64()), len(has), [valid.buffers()[1], pa.py_buffer((at * BANDS).astype(np.int32))], children=[pa.array(band.ravel())])
    return [wide, lists]


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, h, sig, bands)`` of every row; h tells apart the texts of one identifier."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"), F.col(f"`{text_col}`").alias("text"))
    fields = [T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    return map_text(rows, ["id", "h"], "text", _sketch, fields)


def _packed(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Signatures of a column without nulls as rows of 64-bit words."""
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    width = BITS * HASHES // 8
    data = np.frombuffer(x.buffers()[2], np.uint8)
    first = int(np.frombuffer(x.buffers()[1], np.int32)[x.offset])
    return data[first : first + len(x) * width].view(np.uint64).reshape(len(x), -1)


def _bucket_edges(batches, threshold: float):
    """Edges of each bucket, and the parts of those that come in parts."""
    kind = None
    for t, part in runs(batches, lambda t: t["band"].to_numpy(), most=PART):
        key = t["band"].to_numpy()
        new = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(key)))
        sig = _packed(t["sig"])
        two = start[size == 2]
        two = two[agreement(sig[two], sig[two + 1]) >= threshold]
        left, right = [two], [two + 1]
        for s, n in zip(start[size > 2], size[size > 2]):
            rest = np.arange(s, s + n)
            while len(rest) > 1:
                seed, rest = rest[0], rest[1:]
                queue = [seed]
                while queue and len(rest):
                    hit = agreement(sig[rest], sig[queue.pop()]) >= threshold
                    found, rest = rest[hit], rest[~hit]
                    left.append(np.full(len(found), seed))
                    right.append(found)
                    queue.extend(found)
        left, right = np.concatenate(left), np.concatenate(right)
        node = t["node"].combine_chunks()
        kind = node.type
        if len(left):
            n = len(left)
            yield pa.RecordBatch.from_arrays([node.take(pa.array(left)), node.take(pa.array(right)), *(pa.nulls(n, k) for k in (pa.int64(), pa.int32(), pa.binary()))], names=_EDGE)
        if part is not None:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("node", kind), ("sig", pa.binary())])) as w:
                w.write_table(pa.table({"node": node, "sig": t["sig"].combine_chunks().cast(pa.binary())}))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, kind), pa.array([key[0]]), pa.array([part], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=_EDGE)


_EDGE = ["a", "b", "band", "part", "rows"]


def _part_edges(batches, threshold: float):
    """Edges between two parts of a bucket that join all rows which any pairs of theirs join."""
    for batch in batches:
        for x, y in zip(batch.column(0), batch.column(1)):
            x, y = (pa.ipc.open_stream(v.as_py()).read_all() for v in (x, y))
            a, b = _packed(x["sig"]), _packed(y["sig"])
            group = np.full(len(b), -1)  # of the rows of y that something has reached
            left, right = [], []
            for i in range(len(a)):
                hit = np.flatnonzero(agreement(b, a[i]) >= threshold)
                if not len(hit):
                    continue
                known, one = np.unique(group[hit], return_index=True)
                new = hit[group[hit] < 0]
                link = np.concatenate([new, hit[one[known >= 0]]])
                left.append(np.full(len(link), i))
                right.append(link)
                group[np.isin(group, known[known >= 0])] = i
                group[new] = i
            if left:
                n, m = x["node"].combine_chunks(), y["node"].combine_chunks()
                yield pa.RecordBatch.from_arrays([n.take(pa.array(np.concatenate(left))), m.take(pa.array(np.concatenate(right)))], names=["a", "b"])


def bucket_edges(met: DataFrame, threshold: float) -> DataFrame:
    """``(a, b)`` of all buckets of ``(band, node, sig)``, whose rows are sorted by band in each partition."""
    kind = met.schema["node"].dataType
    pair = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    schema = T.StructType([*pair, T.StructField("band", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("rows", T.BinaryType())])
    found = checkpoint(met.mapInArrow(lambda batches: _bucket_edges(batches, threshold), schema))
    parts = found.where("rows is not null").select("band", "part", "rows")
    x, y = parts.alias("x"), parts.alias("y")
    both = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.part") < F.col("y.part"))).select(F.col("x.rows").alias("x"), F.col("y.rows").alias("y"))
    return found.where("rows is null").select("a", "b").union(both.mapInArrow(lambda batches: _part_edges(batches, threshold), pair))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """``(id, h, sig, root, root_sig)`` of every row; the root is the group's least (id, h)."""
    node = F.struct("id", "h")
    # the sketches of the table are read twice: once written, the text is hashed once
    all_rows = checkpoint(sketches(docs, id_col, text_col))
    same = all_rows.where(F.col("sig").isNotNull()).groupBy("sig").agg(F.min(node).alias("node"), F.min_by("bands", node).alias("bands"), (F.count("*") > 1).alias("many"))
    same = checkpoint(same)
    met = same.select(F.explode("bands").alias("band"), "node", "sig").repartition("band").sortWithinPartitions("band")
    roots = components(bucket_edges(met, THRESHOLD if threshold is None else threshold))
    # only signatures of several rows or with edges go on; all others are groups of their own
    named = same.select("sig", "node", "many").join(roots, "node", "left").where("many or root is not null").select("sig", "node", F.coalesce("root", "node").alias("root"))
    named = checkpoint(named)
    named = named.select("sig", "root").join(named.select(F.col("node").alias("root"), F.col("sig").alias("root_sig")), "root").select("sig", "root", "root_sig")
    joined = all_rows.select("id", "h", "sig").where("sig is not null").join(named, "sig", "left")
    joined = joined.unionByName(all_rows.where("sig is null").select("id", "h", "sig"), allowMissingColumns=True)
    return joined.select("id", "h", "sig", F.coalesce("root", node).alias("root"), F.coalesce("root_sig", "sig").alias("root_sig"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Identifier of every row, that of its group, and the estimated similarity to the group's first row."""
    kind = T.DoubleType()

    @F.pandas_udf(kind)
    def similar(x, y):
        import pandas as pd

        out = pd.Series(np.nan, index=x.index, dtype="float64")
        ok = x.notna() & y.notna()
        if ok.any():
            a, b = (np.frombuffer(b"".join(v[ok]), np.uint64).reshape(int(ok.sum()), -1) for v in (x, y))
            out[ok] = agreement(a, b)
        return out

    g = groups(docs, id_col, text_col)
    s = similar("sig", "root_sig")
    return g.select(F.col("id").alias("doc_id"), F.col("root.id").alias("group_id"), F.when(F.col("sig").isNotNull(), s).alias("similarity"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, columns unchanged: the one with the least identifier."""
    i, k = fresh(docs.columns, "__id", "__h")
    g = checkpoint(groups(docs, id_col, text_col).select("id", "h", F.col("sig").isNotNull().alias("shingled"), (F.struct("id", "h") != F.col("root")).alias("drop")))
    gone = g.where("drop").select(F.col("id").alias(i), F.col("h").alias(k)).distinct()
    repeated = g.where("shingled and not drop").groupBy(F.col("id").alias(i), F.col("h").alias(k)).count().where("count > 1").drop("count")
    key = F.col(f"`{id_col}`").eqNullSafe(F.col(i)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(k))
    kept = docs.join(gone, key, "left_anti")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, key, "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(repeated, key, "left_anti").unionByName(once)
