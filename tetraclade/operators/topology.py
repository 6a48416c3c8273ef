"""Quartet topology counts and subtree lengths: three plans, one result.

``broadcast``: the packed trees, if their size allows, go to every executor and each
task owns its quartets, so rows come out final and nothing is shuffled. ``blocks``:
trees stay distributed in blocks; see :func:`_blocks`. ``relational``: joins over the table of
common ancestors, for small data and for comparison.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quartets import Quartets, named, ranks
from . import kernel
from .trees import lca_pairs

if TYPE_CHECKING:
    from .ensemble import Ensemble

logger = logging.getLogger("tetraclade")

#: Bytes of packed trees up to which they are broadcast, whatever plan was asked for.
BROADCAST_BYTES = 64 << 20
#: Bytes of packed trees in a block.
BLOCK_BYTES = 4 << 20
#: Bytes of running counts that a task holds.
CUBE_BYTES = 128 << 20

_INT_MAX = 2**31 - 1
KEYS = ["qi", "quartet_idx", *"abcd", "group"]
_STEINER = ["steiner_sum", "steiner_min", "steiner_max", "steiner_sq"]


def packed_bytes(ens: Ensemble, steiner: bool = False) -> int:
    """Size of the packed trees, from counts only; with ``steiner`` that of their lengths too."""
    sets = 1 + F.col("n_variants") if steiner else F.lit(1)
    size = F.size("rd").cast("bigint") * sets * 8 + F.size("slots") * 4 + F.size("gap") * 12
    return ens.seated.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def blocks(ens: Ensemble, n: int, steiner: bool = False) -> DataFrame:
    """``(payload)``: the placed trees in n blocks of Arrow bytes."""
    columns = ["group_idx", "slots", "gap", "depth", "poly", "rd", "variants" if steiner else "multiplicity"]
    trees = (ens.measured() if steiner else ens.seated).select(*columns)

    def run(batches):
        kept = [b for b in batches if b.num_rows]
        if kept:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kept[0].schema) as w:
                for b in kept:
                    w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["payload"])

    return (trees.repartition(n) if n > 1 else trees.coalesce(1)).mapInArrow(run, "payload binary")


def _rows(qi: np.ndarray, q: np.ndarray, cube: list[np.ndarray], n_groups: int, wide: bool) -> list[pa.Array]:
    per = n_groups * 4
    n = len(qi)
    out = [x.take(pa.array(np.repeat(np.arange(n), per))) for x in quartet_columns(qi, q, wide)]
    out.append(pa.array(np.tile(np.repeat(np.arange(n_groups, dtype=np.int32), 4), n)))
    out.append(pa.array(np.tile(np.arange(4, dtype=np.int32), n * n_groups)))
    if len(cube[0]) and int(cube[0].max()) > _INT_MAX:
        raise OverflowError("a group holds more trees than 32-bit counts can tell")
    out.append(pa.array(cube[0].ravel().astype(np.int32)))
    out += [pa.array(x.ravel()) for x in cube[1:]]
    return out


def _schema(quartets: Quartets, steiner: bool) -> T.StructType:
    kind = T.DecimalType(38, 0) if quartets.wide else T.LongType()
    fields = [T.StructField("qi", T.LongType()), T.StructField("quartet_idx", kind), *[T.StructField(x, T.IntegerType()) for x in (*"abcd", "group_idx", "topology", "count")]]
    return T.StructType(fields + [T.StructField(x, T.DoubleType()) for x in _STEINER] * steiner)


def _counted(quartets: Quartets, trees: list, n_groups: int, steiner: bool, qi: np.ndarray):
    for s in range(0, len(qi), kernel.BATCH):
        part = qi[s : s + kernel.BATCH]
        q = quartets.at(part + quartets.offset)
        yield part, q, kernel.count(trees, q, n_groups, steiner)


def fits(ens: Ensemble, steiner: bool = False) -> bool:
    """Whether the packed trees may be broadcast: measured, and no override asks for another plan."""
    from ..plans.planner import forced

    return forced() in (None, "auto", "broadcast") and packed_bytes(ens, steiner) <= BROADCAST_BYTES


def over_quartets(ens: Ensemble, quartets: Quartets, steiner: bool, emit: Callable, schema: T.StructType) -> DataFrame:
    """Rows of ``emit(qi, quartets, cube)`` for stretches of the window, narrow; the trees are broadcast and must fit."""
    payloads = ens.spark.sparkContext.broadcast([bytes(r[0]) for r in blocks(ens, 1, steiner).collect()])
    n_groups = ens.n_groups

    def run(batches):
        trees = [t for p in payloads.value for t in kernel.load_once(p)]
        for batch in batches:
            for part in _counted(quartets, trees, n_groups, steiner, batch.column(0).to_numpy()):
                for columns in emit(*part):
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return quartets.positions(ens.spark).mapInArrow(run, schema)


def _broadcast(ens: Ensemble, quartets: Quartets, steiner: bool) -> DataFrame:
    n_groups, wide = ens.n_groups, quartets.wide
    return over_quartets(ens, quartets, steiner, lambda qi, q, cube: [_rows(qi, q, cube, n_groups, wide)], _schema(quartets, steiner))


def quartet_columns(qi: np.ndarray, q: np.ndarray, wide: bool) -> list[pa.Array]:
    """Position, rank and ids of quartets."""
    idx = ranks(q)
    if wide:
        from decimal import Decimal

        column = pa.array([Decimal(int(x)) for x in idx], pa.decimal128(38, 0))
    else:
        column = pa.array(idx.astype(np.int64))
    return [pa.array(qi), column, *[pa.array(q[:, k].astype(np.int32)) for k in range(4)]]


def topology_wide(ens: Ensemble, quartets: Quartets, steiner: bool = False) -> DataFrame:
    """A row for each quartet of the window, with the columns of the wide frame; nothing is shuffled if the trees fit.

    Repeated quartets of the window have a row each.
    """
    groups, wide = ens.groups, quartets.wide
    if not fits(ens, steiner):
        from .frames import topology_frame

        return topology_frame(quartet_topology(ens, quartets, steiner), groups, "wide", deduplicate=False)
    names = ["steiner", "steiner_min", "steiner_max", "steiner_var"] if steiner else []
    fields = [T.StructField("quartet_idx", T.DecimalType(38, 0) if wide else T.LongType()), *[T.StructField(x, T.IntegerType()) for x in "abcd"]]
    for g in groups:
        fields += [T.StructField(f"{g}_t{k}", T.IntegerType()) for k in range(4)]
        fields += [T.StructField(f"{g}_{m}_t{k}", T.DoubleType()) for m in names for k in range(4)]

    def emit(qi, q, cube):
        out = quartet_columns(qi, q, wide)[1:]
        for g in range(len(groups)):
            n = cube[0][:, g]
            out += [pa.array(n[:, k].astype(np.int32)) for k in range(4)]
            if steiner:
                total, least, most, square = (x[:, g] for x in cube[1:])
                mean = total / np.maximum(n, 1)
                none = n == 0
                for x, mask in ((total, None), (least, none), (most, none), (square / np.maximum(n, 1) - mean * mean, none)):
                    out += [pa.array(x[:, k], mask=None if mask is None else mask[:, k]) for k in range(4)]
        yield out

    return named(over_quartets(ens, quartets, steiner, emit, T.StructType(fields)), ens.taxa)


def _add(cube: list[np.ndarray], more: list[np.ndarray], at: slice) -> None:
    """Counts of a stretch of quartets added to a running cube."""
    for k, (x, y) in enumerate(zip(cube, more)):
        if k == 2:
            np.minimum(x[at], y, out=x[at])
        elif k == 3:
            np.maximum(x[at], y, out=x[at])
        else:
            x[at] += y


def _blocks(ens: Ensemble, quartets: Quartets, steiner: bool, size: int) -> DataFrame:
    """Trees in blocks, counts in cubes of bounded size.

    If the counts of the whole window fit one cube, every task adds up its own trees
    over all quartets: trees don't move, and one cube a task meets the others in an
    aggregate. Else the window is cut into slices of a cube each; a slice's task
    streams over all blocks, so trees move once for each slice and rows come out final.
    For a slice and a block a block of trees moves, or else its counts would, and a
    cube is the larger of the two.
    """
    schema, n_groups, wide = _schema(quartets, steiner), ens.n_groups, quartets.wide
    parts = blocks(ens, max(2, -(-size // BLOCK_BYTES)), steiner)
    width = max(1, CUBE_BYTES // (n_groups * 4 * 8 * (5 if steiner else 1)))

    def empty(n: int) -> list[np.ndarray]:
        shape = (n, n_groups, 4)
        return [np.zeros(shape, np.int64)] + ([np.zeros(shape), np.full(shape, np.inf), np.full(shape, -np.inf), np.zeros(shape)] if steiner else [])

    def add(cube: list[np.ndarray], start: int, payload: bytes) -> None:
        trees = kernel.load(payload)
        n = len(cube[0])
        for s in range(0, n, kernel.BATCH):
            at = slice(s, min(s + kernel.BATCH, n))
            q = quartets.at(np.arange(at.start, at.stop) + start + quartets.offset)
            _add(cube, kernel.count(trees, q, n_groups, steiner), at)

    def emit(cube: list[np.ndarray], start: int):
        for s in range(0, len(cube[0]), kernel.BATCH):
            qi = np.arange(s, min(s + kernel.BATCH, len(cube[0]))) + start
            part = [x[s : s + kernel.BATCH] for x in cube]
            yield pa.RecordBatch.from_arrays(_rows(qi, quartets.at(qi + quartets.offset), part, n_groups, wide), names=schema.names)

    def by_trees(batches):
        cube = None
        for batch in batches:
            for payload in batch.column(0):
                cube = cube or empty(quartets.count)
                add(cube, 0, payload.as_py())
        if cube:
            yield from emit(cube, 0)

    def by_slice(batches):
        cube, now = None, -1
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                if start != now:
                    if cube:
                        yield from emit(cube, now)
                    cube, now = empty(min(width, quartets.count - start)), start
                add(cube, start, payload.as_py())
        if cube:
            yield from emit(cube, now)

    if quartets.count > width:
        n = -(-quartets.count // width)
        starts = ens.spark.range(0, n).select(F.col("id").cast("int").alias("slice"), (F.col("id") * width).alias("start"))
        # a partition for each slice, none empty
        met = parts.crossJoin(starts).select("start", "payload", "slice").repartitionById(n, "slice").drop("slice").sortWithinPartitions("start")
        return met.mapInArrow(by_slice, schema)
    keys = ["qi", "quartet_idx", *"abcd", "group_idx", "topology"]
    how = [F.sum("count").cast("int").alias("count")]
    if steiner:
        how += [F.sum("steiner_sum").alias("steiner_sum"), F.min("steiner_min").alias("steiner_min"), F.max("steiner_max").alias("steiner_max"), F.sum("steiner_sq").alias("steiner_sq")]
    return parts.mapInArrow(by_trees, schema).groupBy(*keys).agg(*how)


def topology_case(r0: Column, r1: Column, r2: Column, inserted: Column) -> Column:
    """Topology number from pair sums."""
    return (
        F.when(inserted & (r0 == r1) & (r1 == r2), 3)
        .when((r0 >= r1) & (r0 >= r2), 0)
        .when(r1 >= r2, 1)
        .otherwise(2)
        .cast("int")
    )


def _relational(ens: Ensemble, quartets: Quartets, steiner: bool) -> DataFrame:
    """Six joins with the common-ancestor table, four with the leaves, then one aggregate."""
    trees = ens.measured(None) if steiner else ens.seated
    pairs = lca_pairs(trees, variants=steiner)
    leaves = trees.select("tree_id", F.posexplode("slots").alias("gid", "leaf"), *["variants"] * steiner).where("leaf >= 0")
    lengths = F.transform("variants", lambda v: F.element_at(v["rd"], F.col("leaf") + 1)) if steiner else F.lit(None)
    leaves = leaves.select("tree_id", "gid", lengths.alias("leaf_rd"))
    table = quartets.table(ens.spark)
    df = table
    for k, (x, y) in enumerate((("a", "b"), ("c", "d"), ("a", "c"), ("b", "d"), ("a", "d"), ("b", "c"))):
        own = [F.col("variant_rd").alias(f"v{k}")] * steiner
        p = pairs.select(F.col("tree_id").alias(f"t{k}"), F.col("i").alias("__i"), F.col("j").alias("__j"), F.col("rd").alias(f"r{k}"), F.col("is_poly").alias(f"p{k}"), *own)
        on = (F.col(x) == F.col("__i")) & (F.col(y) == F.col("__j"))
        df = df.join(p, on if k == 0 else on & (F.col("t0") == F.col(f"t{k}"))).drop("__i", "__j")
    for x in "abcd":
        leaf = leaves.select(F.col("tree_id").alias(f"t{x}"), F.col("gid").alias("__g"), F.col("leaf_rd").alias(f"l{x}"))
        df = df.join(leaf, (F.col(x) == F.col("__g")) & (F.col("t0") == F.col(f"t{x}"))).drop("__g")
    sums = [F.col("r0") + F.col("r1"), F.col("r2") + F.col("r3"), F.col("r4") + F.col("r5")]
    inserted = F.col("p0") | F.col("p1") | F.col("p2") | F.col("p3") | F.col("p4") | F.col("p5")
    df = df.withColumn("topology", topology_case(*sums, inserted))
    df = df.join(trees.select(F.col("tree_id").alias("t0"), "group_idx", "multiplicity", *[F.col("variants.multiplicity").alias("m")] * steiner), "t0")
    keys = ["qi", "group_idx", "topology"]
    n = df.groupBy(*keys).agg(F.sum("multiplicity").cast("int").alias("count"))
    if steiner:
        v = df.select(*keys, F.explode(F.arrays_zip("m", *[f"v{k}" for k in range(6)], "la", "lb", "lc", "ld")).alias("x")).select(*keys, "x.*")
        w = [F.col("v0") + F.col("v1"), F.col("v2") + F.col("v3"), F.col("v4") + F.col("v5")]
        won = F.when(F.col("topology") == 1, w[1]).when(F.col("topology") == 2, w[2]).otherwise(w[0])
        v = v.withColumn("s", F.col("la") + F.col("lb") + F.col("lc") + F.col("ld") - (won + w[0] + w[1] + w[2]) * 0.5)
        stats = v.groupBy(*keys).agg(F.sum(F.col("s") * F.col("m")).alias("steiner_sum"), F.min("s").alias("steiner_min"), F.max("s").alias("steiner_max"), F.sum(F.col("s") * F.col("s") * F.col("m")).alias("steiner_sq"))
        n = n.join(stats, keys)
    grid = table.crossJoin(F.broadcast(ens.group_table().select("group_idx"))).crossJoin(F.broadcast(ens.spark.range(4).select(F.col("id").cast("int").alias("topology"))))
    zero = {"count": 0} | ({"steiner_sum": 0.0, "steiner_sq": 0.0} if steiner else {})
    return grid.join(n, keys, "left").fillna(zero)


def quartet_topology(ens: Ensemble, quartets: Quartets, steiner: bool = False, strategy: str = "auto") -> DataFrame:
    """Long result: a row for each quartet of the window, group and topology 0 .. 3, zeros included.

    With ``steiner`` also the sum over trees, least, greatest and population variance
    of the length of the quartet's subtree; null but for the sum where nothing was
    counted.
    """
    if not isinstance(quartets, Quartets):
        raise TypeError("quartets must be a Quartets window")
    if strategy == "auto":
        from ..plans.planner import forced

        strategy = forced() or "auto"
    if strategy == "relational":
        df = _relational(ens, quartets, steiner)
    elif strategy in ("auto", "broadcast", "blocks"):
        size = packed_bytes(ens, steiner)
        small = strategy != "blocks" and size <= BROADCAST_BYTES
        if strategy == "broadcast" and not small:
            logger.warning("the packed trees have %d bytes, over the %d that are broadcast; they go in blocks", size, BROADCAST_BYTES)
        df = _broadcast(ens, quartets, steiner) if small else _blocks(ens, quartets, steiner, size)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    if len(ens.groups) <= 2048:
        df = df.withColumn("group", F.element_at(F.array(*[F.lit(g) for g in ens.groups]), F.col("group_idx") + 1))
    else:
        df = df.join(ens.group_table(), "group_idx")
    df = named(df, ens.taxa)
    out = [*KEYS, "topology", "count"]
    if not steiner:
        return df.select(*out)
    some = F.col("count") > 0
    mean = F.col("steiner_sum") / F.col("count")
    return df.select(
        *out,
        "steiner_sum",
        F.when(some, F.col("steiner_min")).alias("steiner_min"),
        F.when(some, F.col("steiner_max")).alias("steiner_max"),
        F.when(some, F.col("steiner_sq") / F.col("count") - mean * mean).alias("steiner_var"),
    )
