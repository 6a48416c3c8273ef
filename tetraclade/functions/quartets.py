"""Quartets: windows into a fixed infinite sequence, and their ranks.

The sequence is the given seed quartets followed by pseudo-random ones; the i-th
random quartet depends only on (seed, i), so executors draw their own ranges from
``spark.range`` and nothing is sent to them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship

_M32 = np.uint64(0xFFFFFFFF)
#: From this many taxa on, ranks may pass 64 bits and are kept as decimals.
WIDE_FROM = 86_000

Quartet = tuple[int, int, int, int]


def draw(seed: int, index: np.ndarray, n: int) -> np.ndarray:
    """The random quartets of the given stream offsets: rows of four ascending ids below n."""
    start = (np.uint64(seed) + index.astype(np.uint64)).astype(np.uint64)
    state = [start & _M32, start >> np.uint64(32), np.full(len(index), 0x9E3779B9, np.uint64), np.full(len(index), 0x7F4A7C13, np.uint64)]
    out = np.full((len(index), 4), -1, np.int64)
    have = np.zeros(len(index), np.int64)
    live = np.arange(len(index))
    while len(live):
        s0, t = state[0], state[3]
        t = t ^ ((t << np.uint64(11)) & _M32)
        t ^= t >> np.uint64(8)
        new = t ^ s0 ^ (s0 >> np.uint64(19))
        state = [new, state[0], state[1], state[2]]
        pick = (new % np.uint64(n)).astype(np.int64)
        fresh = (out[live] != pick[:, None]).all(1)
        rows = live[fresh]
        out[rows, have[rows]] = pick[fresh]
        have[rows] += 1
        more = have[live] < 4
        live = live[more]
        state = [s[more] for s in state]
    return np.sort(out, 1)


def rank(q: Sequence[int]) -> int:
    """Combinatorial rank of four ids."""
    return sum(math.comb(int(x), k) for k, x in enumerate(sorted(q), 1))


def ranks(q: np.ndarray) -> np.ndarray:
    """Ranks of rows of ascending ids; Python integers if they may be wide."""
    if len(q) and int(q.max()) >= WIDE_FROM:
        return np.array([rank(r) for r in q.tolist()], object)
    out = np.zeros(len(q), np.int64)
    for k in range(4):
        term = x = q[:, k].astype(np.int64)
        for i in range(1, k + 1):
            term = term * (x - i) // (i + 1)
        out += term
    return out


def unrank(index: int) -> Quartet:
    """The quartet of a rank."""
    if index < 0:
        raise ValueError("a rank is not negative")
    out = []
    for k in (4, 3, 2, 1):
        lo, hi = k - 1, k
        while math.comb(hi, k) <= index:
            hi *= 2
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if math.comb(mid, k) <= index else (lo, mid)
        out.append(lo)
        index -= math.comb(lo, k)
    return tuple(out[::-1])


def unrank_array(index: np.ndarray) -> np.ndarray:
    """The quartets of ranks below 2**63, by binary search in the tables of binomials."""
    rest = np.asarray(index, np.int64).copy()
    if len(rest) and int(rest.min()) < 0:
        raise ValueError("a rank is not negative")
    out = np.empty((len(rest), 4), np.int64)
    for k in (4, 3, 2):
        top = unrank(int(rest.max()))[3] + 2 if k == 4 and len(rest) else int(out[:, 3].max(initial=0)) + 1
        table = _binomials(k, top)
        out[:, k - 1] = np.searchsorted(table, rest, "right") - 1
        rest -= table[out[:, k - 1]]
    out[:, 0] = rest
    return out


_tables: dict[int, np.ndarray] = {}


def _binomials(k: int, n: int) -> np.ndarray:
    """x over k for x < n, as far as they fit 63 bits."""
    have = _tables.get(k)
    if have is None or len(have) < n:
        out, x = [], 0
        while x < max(n, 1024) and (v := math.comb(x, k)) < 1 << 63:
            out.append(v)
            x += 1
        have = _tables[k] = np.array(out, np.int64)
    return have


def rank_column(a: Column, b: Column, c: Column, d: Column, wide: bool = False) -> Column:
    """Rank of ascending id columns as one expression; wide: DECIMAL(38,0)."""
    kind = "decimal(38,0)" if wide else "bigint"

    total = F.lit(0).cast(kind)
    for k, x in enumerate((a, b, c, d)):
        term = x = x.cast("decimal(19,0)" if wide else kind)
        for i in range(1, k + 1):  # factors by turns, so that no intermediate passes 38 digits
            product = (term * (x - i)).cast(kind)
            term = F.floor(product / (i + 1)).cast(kind) if wide else F.call_function("div", product, F.lit(i + 1))
        total = (total + term).cast(kind)
    return total


def unrank_table(df: DataFrame, index: str = "quartet_idx") -> DataFrame:
    """``df`` with ids a, b, c, d of its ranks."""
    ship(df.sparkSession)
    schema = T.StructType([*df.schema.fields, *[T.StructField(x, T.IntegerType()) for x in "abcd"]])

    def run(batches):
        for b in batches:
            ids = b.column(index)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            wide = pa.types.is_decimal(ids.type) and (top := pa.compute.max(ids).as_py()) is not None and top >= 1 << 63
            if wide:
                q = np.array([unrank(int(x)) if x is not None else (0,) * 4 for x in ids.to_pylist()], np.int64).reshape(-1, 4)
            else:
                q = unrank_array(pa.compute.fill_null(ids.cast(pa.int64()), 0).to_numpy(zero_copy_only=False))
            columns = [pa.array(q[:, k].astype(np.int32), mask=null) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=schema.names)

    return df.mapInArrow(run, schema)


def unrank_names(index: int | Sequence[int], taxa: Sequence[str]) -> tuple | list[tuple]:
    """Names of the quartet of a rank, or of each of several."""
    if isinstance(index, (int, np.integer)):
        return tuple(taxa[i] for i in unrank(int(index)))
    return [unrank_names(int(x), taxa) for x in index]


class Quartets:
    """The window [offset, offset + count) of the sequence over an ordered list of taxa."""

    def __init__(self, taxa: Sequence[str], seed: object = None, offset: int = 0, count: int | None = None, rng_seed: int | None = None):
        self.taxa = list(taxa)
        if count is None or count <= 0:
            raise ValueError("count must be given and positive")
        if offset < 0:
            raise ValueError("offset must not be negative")
        if seed is None:
            if len(self.taxa) < 4:
                raise ValueError("a quartet needs at least four taxa")
            seed = [(0, 1, 2, 3)]
        self._number = {t: i for i, t in enumerate(self.taxa)}
        self.seed = self._seeds(seed)
        self.offset, self.count = int(offset), int(count)
        self.rng_seed = self._hash() if rng_seed is None else rng_seed

    @classmethod
    def from_list(cls, taxa: Sequence[str], quartets: object) -> Quartets:
        """Just the given quartets."""
        x = cls(taxa, quartets, 0, 1)
        x.count = len(x.seed)
        return x

    @classmethod
    def random(cls, taxa: Sequence[str], count: int, seed: object = None) -> Quartets:
        """``count`` random quartets; an integer seed is the stream's seed itself."""
        if isinstance(seed, (int, np.integer)) and not isinstance(seed, bool):
            return cls(taxa, None, 1, count, int(seed) & 0xFFFFFFFF)
        x = cls(taxa, seed, 0, count)
        x.offset = len(x.seed)
        return x

    def _seeds(self, seed: object) -> list[Quartet]:
        if not isinstance(seed, (list, tuple)) or not seed:
            raise ValueError("seed must be a quartet or a list of quartets")
        many = seed if isinstance(seed[0], (list, tuple)) else [seed]
        return [self._one(q) for q in many]

    def _one(self, q: object) -> Quartet:
        if not isinstance(q, (list, tuple)) or len(q) != 4:
            raise ValueError(f"a quartet has four taxa: {q!r}")
        named = [isinstance(x, str) for x in q]
        if all(named):
            unknown = [x for x in q if x not in self._number]
            if unknown:
                raise ValueError(f"unknown taxa: {unknown}")
            ids = [self._number[x] for x in q]
        elif not any(named) and all(isinstance(x, (int, np.integer)) for x in q):
            ids = [int(x) for x in q]
            if min(ids) < 0 or max(ids) >= len(self.taxa):
                raise ValueError(f"ids must lie in [0, {len(self.taxa)}): {q!r}")
        else:
            raise TypeError("a quartet holds names or ids, not both")
        if len(set(ids)) < 4:
            raise ValueError(f"the taxa of a quartet must differ: {q!r}")
        return tuple(sorted(ids))

    def _hash(self) -> int:
        h = 0x12345678
        for x in (x for q in self.seed for x in q):
            h = (h * 31 + x) & 0xFFFFFFFF
        return h

    @property
    def wide(self) -> bool:
        """Whether ranks need more than 64 bits."""
        return len(self.taxa) > WIDE_FROM

    def __len__(self) -> int:
        return self.count

    def __iter__(self) -> Iterator[Quartet]:
        return (tuple(r) for r in self.to_numpy().tolist())

    def __repr__(self) -> str:
        end, n = self.offset + self.count, len(self.seed)
        mode = "explicit" if end <= n else "random" if self.offset >= n else "mixed"
        return f"Quartets({mode}, offset={self.offset}, count={self.count}, taxa={len(self.taxa)})"

    def at(self, position: np.ndarray) -> np.ndarray:
        """Ids of the quartets at positions of the whole sequence."""
        position = np.asarray(position, np.int64)
        out = np.empty((len(position), 4), np.int64)
        n = len(self.seed)
        given = position < n
        if given.any():
            out[given] = np.array(self.seed, np.int64)[position[given]]
        if not given.all():
            out[~given] = draw(self.rng_seed, position[~given] - n, len(self.taxa))
        return out

    def to_numpy(self) -> np.ndarray:
        """All quartets of the window, int32 (count, 4)."""
        return self.at(np.arange(self.offset, self.offset + self.count)).astype(np.int32)

    __array__ = lambda self, dtype=None, copy=None: self.to_numpy() if dtype is None else self.to_numpy().astype(dtype)

    def index_array(self) -> np.ndarray:
        """Ranks of the window."""
        return ranks(self.to_numpy())

    def positions(self, spark: SparkSession, partitions: int | None = None) -> DataFrame:
        """``qi`` 0 .. count - 1 as a distributed range."""
        ship(spark)
        return spark.range(0, self.count, 1, partitions or max(1, min(spark.sparkContext.defaultParallelism * 2, -(-self.count // 4096)))).withColumnRenamed("id", "qi")

    def table(self, spark: SparkSession, partitions: int | None = None) -> DataFrame:
        """``(qi, quartet_idx, a, b, c, d)`` with ids."""
        me = self
        kind = T.DecimalType(38, 0) if self.wide else T.LongType()
        schema = T.StructType([T.StructField("qi", T.LongType()), T.StructField("quartet_idx", kind), *[T.StructField(x, T.IntegerType()) for x in "abcd"]])

        def run(batches):
            for b in batches:
                qi = b.column(0).to_numpy()
                q = me.at(qi + me.offset)
                r = ranks(q)
                idx = pa.array([__import__("decimal").Decimal(int(x)) for x in r], pa.decimal128(38, 0)) if me.wide else pa.array(r.astype(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0), idx, *[pa.array(q[:, k].astype(np.int32)) for k in range(4)]], names=schema.names)

        return self.positions(spark, partitions).mapInArrow(run, schema)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """``(quartet_idx, a, b, c, d)`` with names, in no particular order."""
        return named(self.table(spark), self.taxa).drop("qi")


def named(df: DataFrame, taxa: Sequence[str], columns: Sequence[str] = tuple("abcd")) -> DataFrame:
    """Id columns replaced by names: an array constant for few taxa, joins for many."""
    if len(taxa) <= 2048:
        names = F.array(*[F.lit(t) for t in taxa])
        return df.withColumns({c: F.element_at(names, F.col(c) + 1) for c in columns})
    spark = df.sparkSession
    table = spark.createDataFrame([(i, t) for i, t in enumerate(taxa)], "__gid int, __name string")
    order = df.columns
    for c in columns:
        df = df.join(table, F.col(c) == F.col("__gid")).drop("__gid", c).withColumnRenamed("__name", c)
    return df.select(*order)


def all_quartets(taxa: DataFrame, gid: str = "gid") -> DataFrame:
    """Every quartet of a table of ids, as three range self-joins."""
    a, b, c, d = (taxa.select(F.col(gid).alias(x)) for x in "abcd")
    return a.join(b, F.col("a") < F.col("b")).join(c, F.col("b") < F.col("c")).join(d, F.col("c") < F.col("d"))


def topology_index(a: int, b: int, c: int, d: int) -> int:
    """Topology 0, 1 or 2 of ab | cd."""
    t = sorted((a, b, c, d))
    partner = {a: b, b: a, c: d, d: c}[t[0]]
    return t.index(partner) - 1


def topology_index_column(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The same as an expression: the partner of the least id decides."""
    t = F.array_sort(F.array(a, b, c, d))
    low = t[0]
    partner = F.when(a == low, b).when(b == low, a).when(c == low, d).otherwise(c)
    return (F.array_position(t, partner) - 2).cast("int")


def valid_quartet(q: Column) -> Column:
    """Whether an array holds four different values."""
    return (F.size(q) == 4) & (F.size(F.array_distinct(q)) == 4)


def validate_quartet(q: object) -> bool:
    """The same for a Python value; never raises."""
    return isinstance(q, (tuple, list)) and len(q) == 4 and len(set(q)) == 4


def jaccard(x: Column, y: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def jaccard_similarity(x: set, y: set) -> float:
    """The same for Python sets."""
    union = len(set(x) | set(y))
    return len(set(x) & set(y)) / union if union else 0.0
