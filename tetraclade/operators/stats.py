"""Statistics of ensembles as frames."""

from __future__ import annotations

import logging
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from .ensemble import Ensemble


logger = logging.getLogger("tetraclade")


def _presence(ens: Ensemble) -> DataFrame:
    return ens.trees.select("tree_id", "group", F.explode(F.array_distinct("names")).alias("name"))


def group_coverage(ens: Ensemble) -> DataFrame:
    """``(group, n_trees, n_taxa, mean_coverage, min_coverage)``: share of the group's taxa in each tree."""
    p = _presence(ens)
    union = p.groupBy("group").agg(F.countDistinct("name").alias("n_taxa"))
    per_tree = p.groupBy("group", "tree_id").agg(F.count("*").alias("n"))
    return (
        per_tree.join(F.broadcast(union), "group")
        .groupBy("group", "n_taxa")
        .agg(F.count("*").alias("n_trees"), F.avg(F.col("n") / F.col("n_taxa")).alias("mean_coverage"), F.min(F.col("n") / F.col("n_taxa")).alias("min_coverage"))
        .select("group", "n_trees", "n_taxa", "mean_coverage", "min_coverage")
    )


def group_jaccard(ens: Ensemble) -> DataFrame:
    """``(group_a, group_b, jaccard)`` of the groups' sets of taxa."""
    p = _presence(ens).select("group", "name").distinct()
    sizes = p.groupBy("group").agg(F.count("*").alias("n"))
    x, y = sizes.select(F.col("group").alias("group_a"), F.col("n").alias("na")), sizes.select(F.col("group").alias("group_b"), F.col("n").alias("nb"))
    both = p.withColumnRenamed("group", "group_a").join(p.withColumnRenamed("group", "group_b"), "name").where("group_a < group_b").groupBy("group_a", "group_b").agg(F.count("*").alias("both"))
    pairs = x.crossJoin(y).where("group_a < group_b").join(both, ["group_a", "group_b"], "left").fillna(0, ["both"])
    return pairs.select("group_a", "group_b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))


def taxa_per_tree(ens: Ensemble) -> DataFrame:
    """``(n_trees, n_taxa, mean_taxa_per_tree, mean_trees_per_taxon)``."""
    p = _presence(ens)
    return p.agg(F.countDistinct("tree_id").alias("n_trees"), F.countDistinct("name").alias("n_taxa"), F.count("*").alias("n")).select(
        "n_trees", "n_taxa", (F.col("n") / F.col("n_trees")).alias("mean_taxa_per_tree"), (F.col("n") / F.col("n_taxa")).alias("mean_trees_per_taxon")
    )


def polytomy_stats(ens: Ensemble) -> DataFrame:
    """``(group, n_trees, n_with_polytomy, n_poly_nodes, n_zero_length)``."""
    poly = F.size(F.filter("poly", lambda p: p))
    return ens.trees.groupBy("group").agg(
        F.count("*").alias("n_trees"), F.sum((poly > 0).cast("int")).alias("n_with_polytomy"), F.sum(poly).alias("n_poly_nodes"), F.sum("n_zero_length").alias("n_zero_length")
    )


def memory_footprint(ens: Ensemble) -> DataFrame:
    """``(group, bytes)`` of the packed arrays of stored trees."""
    size = F.size("rd") * (1 + F.col("n_variants")) * 8 + F.size("slots") * 4 + F.size("gap") * 12
    return ens.seated.groupBy("group").agg(F.sum(size).alias("bytes"))


def warnings(ens: Ensemble) -> list[str]:
    """What a user should know: poor coverage, thin sampling, zero-length branches, resolved multifurcations."""
    out = [f"group {r['group']}: some trees hold less than half of its taxa" for r in group_coverage(ens).where("min_coverage < 0.5 and n_trees > 1").orderBy("group").collect()]
    r = taxa_per_tree(ens).first()
    if r["n_trees"] > 2 and r["mean_trees_per_taxon"] < 2:
        out.append("the mean taxon is in fewer than two trees")
    s = ens.trees.agg(F.sum("n_zero_length").alias("z"), F.sum(F.col("had_multifurcations").cast("int")).alias("m")).first()
    if s["z"]:
        out.append(f"{s['z']} branches have length zero")
    if s["m"]:
        out.append(f"{s['m']} trees had multifurcations, which were resolved")
    return out


def log_statistics(ens: Ensemble) -> None:
    """Groups, taxa, coverage and polytomies as messages of the library's logger, and what :func:`warnings` tells."""
    t = taxa_per_tree(ens).first()
    logger.info("%d trees in %d groups hold %d taxa, %.2f a tree; a taxon is in %.2f trees", t["n_trees"], ens.n_groups, t["n_taxa"], t["mean_taxa_per_tree"] or 0, t["mean_trees_per_taxon"] or 0)
    for r in group_coverage(ens).orderBy("group").collect():
        logger.info("group %s: %d trees, %d taxa, coverage %.3f on average and %.3f at least", r["group"], r["n_trees"], r["n_taxa"], r["mean_coverage"], r["min_coverage"])
    for r in polytomy_stats(ens).where("n_poly_nodes > 0").orderBy("group").collect():
        logger.info("group %s: %d of %d trees have inserted nodes, %d in all", r["group"], r["n_with_polytomy"], r["n_trees"], r["n_poly_nodes"])
    for text in warnings(ens):
        logger.warning(text)
