"""Operators inside single trees: nodes, common ancestors, distances, splits."""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    from ..functions.quartets import Quartets
    from .ensemble import Ensemble


def nodes(trees: DataFrame) -> DataFrame:
    """One row for each node of parsed trees."""
    arrays = ["parent", "left", "right", "length", "support", "depth", "rd", "lo", "hi", "poly"]
    z = trees.select("tree_id", "n_leaves", "names", F.posexplode(F.arrays_zip(*arrays)).alias("node_id", "x"))
    return z.select(
        "tree_id", "node_id", F.col("x.parent").alias("parent"), F.col("x.left").alias("left"), F.col("x.right").alias("right"),
        F.when(F.col("node_id") < F.col("n_leaves"), F.get("names", F.col("node_id"))).alias("name"),
        F.col("x.length").alias("length"), F.col("x.support").alias("support"), F.col("x.depth").alias("depth"), F.col("x.rd").alias("root_distance"),
        F.col("x.lo").alias("leaf_lo"), F.col("x.hi").alias("leaf_hi"), (F.col("node_id") < F.col("n_leaves")).alias("is_leaf"), F.col("x.poly").alias("is_poly"),
    )


def tree_stats(trees: DataFrame) -> DataFrame:
    """``(tree_id, group, n_leaves, n_nodes, max_depth, n_poly, n_zero_length, total_length)``."""
    return trees.select(
        "tree_id", "group", "n_leaves", F.size("parent").alias("n_nodes"), F.array_max("depth").alias("max_depth"),
        F.size(F.filter("poly", lambda p: p)).alias("n_poly"), "n_zero_length",
        F.aggregate("length", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))).alias("total_length"),
    )


def lca_pairs(trees: Ensemble | DataFrame, variants: bool = False, leaves: bool = False) -> DataFrame:
    """``(tree_id, i, j, lca, rd, is_poly)`` of all pairs i < j of taxa present in each stored tree.

    With ``leaves`` also the root distances ``(ri, rj)`` of both taxa. A narrow
    operator; its output is quadratic in the leaves of a tree.
    """
    from .kernel import Packed

    placed = trees if isinstance(trees, DataFrame) else trees.seated
    fields = [("tree_id", T.LongType()), ("i", T.IntegerType()), ("j", T.IntegerType()), ("lca", T.IntegerType()), ("rd", T.DoubleType()), ("is_poly", T.BooleanType())]
    fields += [("ri", T.DoubleType()), ("rj", T.DoubleType())] * leaves + [("variant_rd", T.ArrayType(T.DoubleType()))] * variants
    schema = T.StructType([T.StructField(*f) for f in fields])

    def run(batches):
        for b in batches:
            for tree_id, slots, gap, depth, poly, rd, *sets in zip(*b.columns):
                slots, gap, depth, rd = (_values(x) for x in (slots, gap, depth, rd))
                poly = np.asarray(poly.values.to_numpy(zero_copy_only=False), bool)
                here = np.flatnonzero(slots >= 0)
                i, j = (here[x] for x in np.triu_indices(len(here), 1))
                if not len(i):
                    continue
                v = Packed(slots, gap, depth, poly, rd, []).lca(i, j)
                out = [pa.array(np.full(len(i), tree_id.as_py())), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(v.astype(np.int32)), pa.array(rd[v]), pa.array(poly[v])]
                if leaves:
                    out += [pa.array(rd[slots[i]]), pa.array(rd[slots[j]])]
                if variants:
                    all_rd = np.stack([np.array(x["rd"]) for x in sets[0].as_py()])[:, v]
                    cut = np.arange(len(i) + 1, dtype=np.int32) * len(all_rd)
                    out.append(pa.ListArray.from_arrays(pa.array(cut), pa.array(all_rd.T.ravel())))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return placed.select("tree_id", "slots", "gap", "depth", "poly", "rd", *["variants"] * variants).mapInArrow(run, schema)


def _values(x: pa.ListScalar) -> np.ndarray:
    return x.values.to_numpy(zero_copy_only=False)


def tree_splits(ens: Ensemble, quartets: Quartets, return_steiner: bool = False) -> DataFrame:
    """``(tree_id, qi, topology)`` of every stored tree and every quartet of the window that it holds.

    The single-tree rule: of the three pairings the one with strictly the greatest
    common-ancestor depths, and the first with the last if there is none. With
    ``return_steiner`` also the length of the quartet's subtree. Narrow: each tree is
    looked at once, quartets are drawn where the tree is.
    """
    from . import kernel

    schema = T.StructType([T.StructField("tree_id", T.LongType()), T.StructField("qi", T.LongType()), T.StructField("topology", T.IntegerType()), *[T.StructField("steiner", T.DoubleType())] * return_steiner])

    def run(batches):
        for b in batches:
            for tree_id, slots, gap, depth, poly, rd in zip(*b.columns):
                slots, gap, depth, rd = (_values(x) for x in (slots, gap, depth, rd))
                t = kernel.Packed(slots, gap, depth, np.asarray(poly.values.to_numpy(zero_copy_only=False), bool), rd, [])
                for start in range(0, quartets.count, kernel.BATCH):
                    qi = np.arange(start, min(start + kernel.BATCH, quartets.count))
                    q = quartets.at(qi + quartets.offset)
                    here = (slots[q] >= 0).all(1)
                    qi, q = qi[here], q[here].T
                    r = [rd[t.lca(q[x], q[y])] for x, y in kernel.PAIRS]
                    r0, r1, r2 = r[0] + r[1], r[2] + r[3], r[4] + r[5]
                    topology = np.where((r0 > r1) & (r0 > r2), 0, np.where((r1 > r0) & (r1 > r2), 1, 2)).astype(np.int32)
                    out = [pa.array(np.full(len(qi), tree_id.as_py())), pa.array(qi), pa.array(topology)]
                    if return_steiner:
                        won = np.maximum(np.maximum(r0, r1), r2)
                        out.append(pa.array(rd[slots[q]].sum(0) - (won + r0 + r1 + r2) * 0.5))
                    yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return ens.seated.select("tree_id", "slots", "gap", "depth", "poly", "rd").mapInArrow(run, schema)


def branch_distance(ens: Ensemble, a: str | int, b: str | int) -> DataFrame:
    """``(tree_id, group, multiplicity, distance)`` of every stored tree; null where a taxon is absent.

    Only built-in functions: the common ancestor is the shallowest of those between
    the two leaves. KeyError for an unknown name.
    """
    x, y = (F.get("slots", F.lit(ens.gid(v))) for v in (a, b))
    lo, hi = F.least("x", "y"), F.greatest("x", "y")
    between = F.slice("gap", lo + 1, hi - lo)
    top = F.aggregate(between, F.get("gap", lo), lambda best, v: F.when(F.get("depth", v) < F.get("depth", best), v).otherwise(best))
    both = (F.col("x") >= 0) & (F.col("y") >= 0)
    path = F.get("rd", F.col("x")) + F.get("rd", F.col("y")) - 2 * F.get("rd", top)
    d = F.when(both & (F.col("x") == F.col("y")), 0.0).when(both, path)
    return ens.seated.withColumns({"x": x, "y": y}).select("tree_id", "group", "multiplicity", d.alias("distance"))


def distances(ens: Ensemble) -> DataFrame:
    """``(tree_id, i, j, distance)`` of all pairs of taxa of each stored tree; narrow."""
    return lca_pairs(ens, leaves=True).select("tree_id", "i", "j", (F.col("ri") + F.col("rj") - 2 * F.col("rd")).alias("distance"))


def multi_lca(node_table: DataFrame, members: DataFrame) -> DataFrame:
    """``(tree_id, set_id, lca, steiner)`` of sets of nodes ``(tree_id, set_id, node_id)``.

    The common ancestor is the deepest node whose leaf interval holds all members; the
    subtree's length is half the tour through the members in leaf order.
    """
    n = node_table.select("tree_id", "node_id", "leaf_lo", "leaf_hi", "depth", "root_distance")
    m = members.join(n, ["tree_id", "node_id"])
    order = Window.partitionBy("tree_id", "set_id").orderBy("leaf_lo", F.desc("leaf_hi"))
    whole = Window.partitionBy("tree_id", "set_id").orderBy("leaf_lo", F.desc("leaf_hi")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = m.select(
        "tree_id", "set_id", "node_id", "root_distance", "leaf_lo", "leaf_hi",
        *[F.coalesce(F.lead(c).over(order), F.first(c).over(whole)).alias(f"to_{c}") for c in ("root_distance", "leaf_lo", "leaf_hi")],
    )
    step = step.withColumns({"lo": F.least("leaf_lo", "to_leaf_lo"), "hi": F.greatest("leaf_hi", "to_leaf_hi"), "step": F.monotonically_increasing_id()})
    up = n.select(F.col("tree_id").alias("__t"), F.col("node_id").alias("__n"), F.col("leaf_lo").alias("__lo"), F.col("leaf_hi").alias("__hi"), F.col("depth").alias("__d"), F.col("root_distance").alias("__r"))
    holds = lambda lo, hi: (F.col("tree_id") == F.col("__t")) & (F.col("__lo") <= F.col(lo)) & (F.col("__hi") >= F.col(hi))
    hop = step.join(up, holds("lo", "hi")).groupBy("tree_id", "set_id", "node_id").agg(F.max_by(F.struct("root_distance", "to_root_distance", "__r"), "__d").alias("x"))
    length = hop.groupBy("tree_id", "set_id").agg((F.sum(F.col("x.root_distance") + F.col("x.to_root_distance") - 2 * F.col("x.__r")) / 2).alias("steiner"))
    span = m.groupBy("tree_id", "set_id").agg(F.min("leaf_lo").alias("lo"), F.max("leaf_hi").alias("hi"))
    top = span.join(up, holds("lo", "hi")).groupBy("tree_id", "set_id").agg(F.max_by("__n", "__d").alias("lca"))
    return top.join(length, ["tree_id", "set_id"])


def split_topology(r0: Column, r1: Column, r2: Column) -> Column:
    """Topology number of the single-tree rule: no strict winner gives 2."""
    return F.when((r0 > r1) & (r0 > r2), 0).when((r1 > r0) & (r1 > r2), 1).otherwise(2).cast("int")
