"""Quartet ensemble discordance: agreement of two groups about each quartet.

For resolved topology shares p and q of two groups the score is
``J * (1 + sum_k x_k log3 x_k)`` with x_k = p_k q_k and J = 1 if both groups favour the
same topology, else -1; ties for the favourite go to the lowest number. It is 0 where
either group has no resolved tree.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    from ..functions.quartets import Quartets
    from .ensemble import Ensemble

LOG3 = 0.9102392266268374
QUARTET = ["qi", "quartet_idx", *"abcd"]


def default_pairs(groups: Sequence[str]) -> list[tuple[str, str]]:
    """All pairs of groups in order."""
    g = sorted(groups)
    return [(g[i], g[j]) for i in range(len(g)) for j in range(i + 1, len(g))]


def named_pairs(groups: Sequence[str], group_pairs: Sequence) -> list[tuple[str, str]]:
    """Pairs of names from pairs of names or positions; ValueError for what isn't one."""
    ordered = sorted(groups)
    known = set(ordered)
    pairs = []
    for p in group_pairs:
        if len(p) != 2:
            raise ValueError(f"a pair has two groups: {p!r}")
        both = []
        for g in p:
            if isinstance(g, str):
                if g not in known:
                    raise ValueError(f"unknown group {g!r}")
                both.append(g)
            elif 0 <= g < len(ordered):
                both.append(ordered[g])
            else:
                raise ValueError(f"group {g} is not in [0, {len(ordered)})")
        pairs.append(tuple(both))
    return pairs


#: Scores that leave the kernel in one batch.
ROWS = 1 << 18


def quartet_qed(ens: Ensemble, quartets: Quartets, group_pairs: Sequence | None = None) -> DataFrame:
    """The scores of :func:`qed` straight from the kernel; nothing is shuffled if the trees fit.

    All pairs of groups are made where the counts are, so no list of them is sent.
    """
    from ..functions.quartets import named
    from .topology import fits, over_quartets, quartet_columns, quartet_topology

    groups, wide = ens.groups, quartets.wide
    given = None
    if group_pairs is not None:
        number = {g: i for i, g in enumerate(groups)}
        given = np.array([[number[x] for x in p] for p in named_pairs(groups, group_pairs)], np.int32).reshape(-1, 2)
    if not fits(ens):
        return qed(quartet_topology(ens, quartets), groups, group_pairs)
    ids = [T.StructField(x, T.IntegerType()) for x in (*"abcd", "ga", "gb")]
    schema = T.StructType([T.StructField("qi", T.LongType()), T.StructField("quartet_idx", T.DecimalType(38, 0) if wide else T.LongType()), *ids, T.StructField("qed", T.DoubleType())])
    n_groups = len(groups)

    def emit(qi, q, cube):
        g, h = np.triu_indices(n_groups, 1) if given is None else given.T
        columns = quartet_columns(qi, q, wide)
        step = max(1, ROWS // max(1, min(len(g), ROWS)))
        for i in range(0, len(qi), step):
            rows = np.arange(i, min(i + step, len(qi)))
            for j in range(0, len(g), ROWS):
                x, y = g[j : j + ROWS], h[j : j + ROWS]
                s = _scores(cube[0][rows], x, y)
                at = pa.array(np.repeat(rows, len(x)))
                yield [*[c.take(at) for c in columns], pa.array(np.tile(x.astype(np.int32), len(rows))), pa.array(np.tile(y.astype(np.int32), len(rows))), pa.array(s.ravel())]

    df = named(over_quartets(ens, quartets, False, emit, schema), ens.taxa)
    df = named(df, groups, ("ga", "gb"))
    return df.select(*QUARTET, F.col("ga").alias("group_a"), F.col("gb").alias("group_b"), "qed")


def score(x: list[Column], y: list[Column]) -> Column:
    """Score of two groups' counts of topologies 0, 1, 2."""
    nx, ny = x[0] + x[1] + x[2], y[0] + y[1] + y[2]

    def favourite(c: list[Column]) -> Column:
        return F.when((c[0] >= c[1]) & (c[0] >= c[2]), 0).when(c[1] >= c[2], 1).otherwise(2)

    total = F.lit(1.0)
    for a, b in zip(x, y):
        p = (a / nx) * (b / ny)
        total = total + F.when(p > 0, p * F.log(p) * LOG3).otherwise(0.0)
    sign = F.when(favourite(x) == favourite(y), 1.0).otherwise(-1.0)
    return F.when((nx == 0) | (ny == 0), 0.0).otherwise(sign * total)


def qed(topology: DataFrame, groups: Sequence[str], group_pairs: Sequence[tuple[str, str] | tuple[int, int]] | None = None) -> DataFrame:
    """``(qi, quartet_idx, a, b, c, d, group_a, group_b, qed)`` from a long topology result.

    Pairs are names or positions in the ordered groups; any order, self-pairs allowed.
    Each quartet's counts meet once, in one shuffle by ``qi``; pairs are made from them
    in place.
    """
    pairs = default_pairs(groups) if group_pairs is None else named_pairs(groups, group_pairs)
    schema = "qi bigint, quartet_idx bigint, a string, b string, c string, d string, group_a string, group_b string, qed double"
    if not pairs:
        return topology.sparkSession.createDataFrame([], schema)
    cell = F.struct(F.struct("group", "topology"), "count")
    resolved = topology.where("topology < 3").groupBy(*QUARTET).agg(F.map_from_entries(F.collect_list(cell)).alias("n"))
    if len(pairs) <= 64:
        pair = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in pairs]))
        df = resolved.select(*QUARTET, "n", pair.alias("p"))
    else:  # a table of names, quadratic in groups and independent of quartets
        table = topology.sparkSession.createDataFrame(pairs, "x string, y string").select(F.struct("x", "y").alias("p"))
        df = resolved.select(*QUARTET, "n").crossJoin(table)

    def count(side: str, k: int) -> Column:
        return F.coalesce(F.col("n")[F.struct(F.col(f"p.{side}").alias("group"), F.lit(k).alias("topology"))], F.lit(0)).alias(f"{side}{k}")

    df = df.select(*QUARTET, F.col("p.x").alias("group_a"), F.col("p.y").alias("group_b"), *[count(s, k) for s in "xy" for k in range(3)])
    s = score([F.col(f"x{k}") for k in range(3)], [F.col(f"y{k}") for k in range(3)])
    return df.select(*QUARTET, "group_a", "group_b", s.alias("qed"))


def mean_qed(scores: DataFrame) -> DataFrame:
    """``(mean_qed)``; 0.0 without scores."""
    return scores.agg(F.coalesce(F.avg("qed"), F.lit(0.0)).alias("mean_qed"))


def qed_array(cube: np.ndarray, pairs: Sequence[tuple[int, int]]) -> np.ndarray:
    """Scores (quartets, pairs) of dense counts (quartets, groups, 3 or 4)."""
    if cube.ndim != 3 or cube.shape[2] < 3:
        raise ValueError("counts must have shape (quartets, groups, 3 or 4)")
    if any(not 0 <= g < cube.shape[1] for p in pairs for g in p):
        raise ValueError("a group pair is out of range")
    g, h = np.array(pairs, np.int64).reshape(-1, 2).T
    return _scores(cube, g, h)


def _scores(cube: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    c = cube[:, :, :3].astype(float)
    total = c.sum(2)
    p = c / np.where(total == 0, 1, total)[:, :, None]
    best = c.argmax(2)
    x = p[:, g] * p[:, h]
    s = 1 + (x * np.log(np.where(x > 0, x, 1)) * LOG3).sum(2)
    return np.where((total[:, g] == 0) | (total[:, h] == 0), 0.0, np.where(best[:, g] == best[:, h], s, -s))
