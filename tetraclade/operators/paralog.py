"""Paralogs: which copy of a genome is which, across trees.

Each genome of several copies has numbered slots; in every tree a slot holds one of
the genome's leaves. Permuting the slots of a genome changes the counts of the
quartets that touch it and nothing else.
"""

from __future__ import annotations

import itertools
import logging
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quartets import Quartets
from . import kernel
from .qed import mean_qed, qed, qed_array, quartet_qed
from .topology import BLOCK_BYTES, BROADCAST_BYTES, blocks, packed_bytes, quartet_topology

if TYPE_CHECKING:
    from .ensemble import Ensemble

logger = logging.getLogger("tetraclade")


def assignments(ens: Ensemble) -> DataFrame:
    """``(genome, copy, tree_id, leaf_id)``: the leaf in each slot, null if absent."""
    slots = [(g, i, gid) for g in ens.paralogs for i, gid in enumerate(ens.slot_ids(g))]
    if not slots:
        raise ValueError("no genome has several copies")
    s = F.explode(F.array(*[F.struct(F.lit(g).alias("genome"), F.lit(i).alias("copy"), F.lit(gid).alias("gid")) for g, i, gid in slots]))
    leaf = F.get("slots", F.col("s.gid"))
    return ens.seated.select("tree_id", "slots", s.alias("s")).select("s.genome", "s.copy", "tree_id", F.when(leaf >= 0, leaf).alias("leaf_id"))


def quartet_index(ens: Ensemble, quartets: Quartets) -> DataFrame:
    """``(genome, qi)`` of the quartets that touch a genome's slots."""
    genome = ens.taxa_table().groupBy("genome").agg(F.collect_list("gid").alias("gids")).where(F.size("gids") > 1)
    members = genome.select("genome", F.explode("gids").alias("gid"))
    touched = quartets.table(ens.spark).select("qi", F.explode(F.array(*"abcd")).alias("gid"))
    return touched.join(F.broadcast(members), "gid").select("genome", "qi").distinct()


def permuted(ens: Ensemble, genome: str, perm: Sequence[int]) -> Ensemble:
    """The ensemble whose slot i of the genome holds what slot perm[i] held, in all trees."""
    if genome not in ens.paralogs:
        raise ValueError(f"{genome!r} has no copies to permute")
    ids = ens.slot_ids(genome)
    if sorted(perm) != list(range(len(ids))):
        raise ValueError(f"not a permutation of {len(ids)} slots: {perm!r}")
    moves = {ids[i]: ids[p] for i, p in enumerate(perm) if i != p}
    if not moves:
        return ens
    # narrow; the arrays of slots are rewritten at the moved places only
    source = F.create_map(*[F.lit(x) for move in moves.items() for x in move])
    slots = F.transform("slots", lambda leaf, i: F.get("slots", F.coalesce(source[i], i)))
    return ens.with_seated(ens.seated.withColumn("slots", slots))


def counts_delta(ens: Ensemble, quartets: Quartets, genome: str, perm: Sequence[int]) -> DataFrame:
    """``(qi, group, topology, delta)``: change of counts by a permutation, zeros left out.

    Only trees whose slots change and quartets that touch a moved slot are counted,
    under the old and the new slots in one pass. Trees stay where they are, each task
    sends what its trees change, and changes of one cell add up.
    """
    if genome not in ens.paralogs:
        raise ValueError(f"{genome!r} has no copies to permute")
    ids = ens.slot_ids(genome)
    if sorted(perm) != list(range(len(ids))):
        raise ValueError(f"not a permutation of {len(ids)} slots: {perm!r}")
    moved = [(ids[i], ids[p]) for i, p in enumerate(perm) if i != p]
    schema = "qi bigint, group_idx int, topology int, delta bigint"
    if not moved:
        return _signed(ens, ens.spark.createDataFrame([], schema))
    changes = F.lit(False)
    for x, y in moved:
        changes = changes | (F.get("slots", F.lit(x)) != F.get("slots", F.lit(y)))
    few = ens.with_seated(ens.seated.where(changes))
    size = packed_bytes(few)
    if not size:
        return _signed(ens, ens.spark.createDataFrame([], schema))
    n_groups, n_taxa = ens.n_groups, len(ens.taxa)
    to = np.arange(n_taxa)
    to[[x for x, _ in moved]] = [y for _, y in moved]

    def run(batches):
        for batch in batches:
            for payload in batch.column(0):
                trees = kernel.load(payload.as_py())
                for start in range(0, quartets.count, kernel.BATCH):
                    qi = np.arange(start, min(start + kernel.BATCH, quartets.count))
                    q = quartets.at(qi + quartets.offset)
                    touched = (to[q] != q).any(1)
                    qi, q = qi[touched], q[touched]
                    if not len(qi):
                        continue
                    delta = _moved_counts(trees, to[q], n_groups) - kernel.count(trees, q, n_groups, False)[0]
                    at, group, topology = np.nonzero(delta)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(qi[at]), pa.array(group.astype(np.int32)), pa.array(topology.astype(np.int32)), pa.array(delta[at, group, topology])], names=["qi", "group_idx", "topology", "delta"]
                    )

    return _signed(ens, blocks(few, max(1, -(-size // BLOCK_BYTES))).mapInArrow(run, schema))


def _signed(ens: Ensemble, parts: DataFrame) -> DataFrame:
    total = parts.groupBy("qi", "group_idx", "topology").agg(F.sum("delta").cast("int").alias("delta")).where("delta != 0")
    return total.join(ens.group_table(), "group_idx").select("qi", "group", "topology", "delta")


def _moved_counts(trees: list, moved: np.ndarray, n_groups: int) -> np.ndarray:
    """Counts of quartets whose ids stand for other ids, numbered as before."""
    order = np.argsort(moved, 1)
    return _renumber(kernel.count(trees, np.take_along_axis(moved, order, 1), n_groups, False)[0], order)


def permutation_scores(ens: Ensemble, quartets: Quartets, genome: str, perms: Sequence[Sequence[int]]) -> dict[tuple[int, ...], float]:
    """Mean score over all quartets and pairs of groups under each permutation, in one job.

    Every task scores its quartets under all permutations and returns two numbers for each.
    """
    pairs = [(i, j) for i in range(ens.n_groups) for j in range(i + 1, ens.n_groups)]
    if not pairs:
        return {tuple(p): 0.0 for p in perms}
    if packed_bytes(ens) > BROADCAST_BYTES:
        out = {}
        for p in perms:
            e = permuted(ens, genome, p)
            out[tuple(p)] = qed(quartet_topology(e, quartets), e.groups).agg(F.coalesce(F.avg("qed"), F.lit(0.0))).first()[0]
        return out
    payloads = ens.spark.sparkContext.broadcast([bytes(r[0]) for r in blocks(ens, 1).collect()])
    ids, n_groups = ens.slot_ids(genome), ens.n_groups

    def run(batches):
        trees = [t for p in payloads.value for t in kernel.load_once(p)]
        for batch in batches:
            for s in range(0, batch.num_rows, kernel.BATCH):
                q = quartets.at(batch.column(0).to_numpy()[s : s + kernel.BATCH] + quartets.offset)
                touched = np.isin(q, ids).any(1)
                same = qed_array(kernel.count(trees, q[~touched], n_groups, False)[0], pairs).sum()
                for k, perm in enumerate(perms):
                    # a slot's new content is what another id holds now
                    to = np.arange(int(q.max()) + 1)
                    to = np.concatenate([to, np.arange(len(to), max(ids) + 1)])
                    to[ids] = [ids[p] for p in perm]
                    cube = _moved_counts(trees, to[q[touched]], n_groups)
                    total = same + qed_array(cube, pairs).sum()
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([float(total)]), pa.array([len(q) * len(pairs)])], names=["k", "total", "n"])

    rows = quartets.positions(ens.spark).mapInArrow(run, "k bigint, total double, n bigint").groupBy("k").agg(F.sum("total").alias("t"), F.sum("n").alias("n")).collect()
    payloads.destroy()
    return {tuple(perms[r["k"]]): r["t"] / r["n"] for r in rows}


def _renumber(cube: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Counts whose topologies were numbered for sorted ids, for the ids' old order.

    ``order[:, s]`` is the old place of the s-th sorted id; topology k pairs the sorted
    places 0 and k + 1.
    """
    out = cube.copy()
    for k in range(3):
        rest = [x for x in (1, 2, 3) if x != k + 1]
        first, second = order[:, [0, k + 1]], order[:, rest]
        with_zero = np.where((first == 0).any(1)[:, None], first, second)
        new = with_zero.max(1) - 1
        out[np.arange(len(cube)), :, new] = cube[np.arange(len(cube)), :, k]
    return out


def mean_score(ens: Ensemble, quartets: Quartets) -> float:
    """Mean score over all quartets of the window and pairs of groups, 0 without pairs."""
    g = next(iter(ens.paralogs), None)
    if g is None:
        return mean_qed(quartet_qed(ens, quartets)).first()[0]
    return next(iter(permutation_scores(ens, quartets, g, [tuple(range(ens.paralogs[g]))]).values()))


def evaluate_swap(ens: Ensemble, quartets: Quartets, genome: str, perm: Sequence[int]) -> float:
    """Mean score that a permutation of a genome's slots would give; nothing changes."""
    permuted(ens, genome, perm)  # its checks
    return permutation_scores(ens, quartets, genome, [tuple(perm)])[tuple(perm)]


def apply_swap(ens: Ensemble, quartets: Quartets, counts: DataFrame, genome: str, perm: Sequence[int]) -> tuple[Ensemble, DataFrame]:
    """The permuted ensemble, and ``counts`` (a long topology result) with the permutation's delta added."""
    delta = counts_delta(ens, quartets, genome, perm)
    new = counts.join(delta, ["qi", "group", "topology"], "left").withColumn("count", (F.col("count") + F.coalesce("delta", F.lit(0))).cast("int"))
    return permuted(ens, genome, perm), new.select(*counts.columns)


@dataclass
class OptimizationResult:
    """Trace of a search: mean score at the start and after each sweep, and the slots' sources."""

    qed_history: list[float]
    n_iterations: int
    converged: bool
    permutations: dict[str, tuple[int, ...]] = field(default_factory=dict)


def optimize(ens: Ensemble, quartets: Quartets, max_iter: int = 100) -> tuple[Ensemble, OptimizationResult]:
    """Coordinate ascent: genome by genome the permutation that raises the mean score most.

    Ties go to the lexicographically first; a genome without a gain stays. Ends after
    a sweep without gain, or after ``max_iter`` sweeps.
    """
    if not ens.paralogs:
        raise ValueError("no genome has several copies")
    for g, k in ens.paralogs.items():
        if k > 6:
            logger.warning("genome %s has %d copies: %d permutations are scored in each sweep", g, k, int(np.prod(range(1, k + 1))) - 1)
    first = next(iter(ens.paralogs))
    now = permutation_scores(ens, quartets, first, [tuple(range(ens.paralogs[first]))])
    current = next(iter(now.values()))
    result = OptimizationResult([current], 0, False, {g: tuple(range(k)) for g, k in ens.paralogs.items()})
    for _ in range(max_iter):
        result.n_iterations += 1
        improved = False
        for g, k in ens.paralogs.items():
            same = tuple(range(k))
            perms = [p for p in itertools.permutations(range(k)) if p != same]
            scores = permutation_scores(ens, quartets, g, perms)
            best = max(perms, key=lambda p: (scores[p], [-x for x in p]))
            if scores[best] > current:
                ens = permuted(ens, g, best)
                result.permutations[g] = tuple(result.permutations[g][p] for p in best)
                current = scores[best]
                improved = True
        result.qed_history.append(current)
        if not improved:
            result.converged = True
            break
    return ens, result


def resolve(ens: Ensemble, quartets: Quartets, max_iter: int = 100) -> tuple[Ensemble, DataFrame, OptimizationResult]:
    """The optimised ensemble, its topology result and the search's trace."""
    best, result = optimize(ens, quartets, max_iter)
    return best, quartet_topology(best, quartets), result
