"""Shapes of results: long and wide, with or without repeated quartets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_QUARTET = ["quartet_idx", *"abcd"]


def _form(form: str) -> bool:
    if form not in ("long", "wide"):
        raise ValueError(f"form must be 'long' or 'wide', not {form!r}")
    return form == "wide"


def topology_frame(topology: DataFrame, groups: Sequence[str], form: str = "long", deduplicate: bool = True) -> DataFrame:
    """A long topology result as a frame.

    long: a row for each quartet, group and topology. wide: a row for each quartet with
    ``{group}_t{k}`` and, if measured, ``{group}_steiner[_min|_max|_var]_t{k}``. Repeated
    quartets of a window have equal rows; ``deduplicate`` keeps one of each.
    """
    measures = [c for c in ("steiner_sum", "steiner_min", "steiner_max", "steiner_var") if c in topology.columns]
    if not _form(form):
        df = topology.select("qi", *_QUARTET, "group", "topology", "count", *measures)
        return df.drop("qi").dropDuplicates([*_QUARTET, "group", "topology"]) if deduplicate else df.drop("qi")
    cells = []
    for g in sorted(groups):
        for k in range(4):
            here = (F.col("group") == g) & (F.col("topology") == k)
            cells.append(F.sum(F.when(here, F.col("count"))).cast("int").alias(f"{g}_t{k}"))
        for m in measures:
            name = "steiner" if m == "steiner_sum" else m
            for k in range(4):
                cells.append(F.max(F.when((F.col("group") == g) & (F.col("topology") == k), F.col(m))).alias(f"{g}_{name}_t{k}"))
    df = topology.groupBy("qi", *_QUARTET).agg(*cells).drop("qi")
    return df.dropDuplicates(_QUARTET) if deduplicate else df


def qed_frame(scores: DataFrame, pairs: Sequence[tuple[str, str]], form: str = "long", deduplicate: bool = True) -> DataFrame:
    """Scores as a frame; wide: a column ``{a}_vs_{b}`` for each pair."""
    if not _form(form):
        df = scores.select("qi", *_QUARTET, "group_a", "group_b", "qed").drop("qi")
        return df.dropDuplicates([*_QUARTET, "group_a", "group_b"]) if deduplicate else df
    cells = [F.max(F.when((F.col("group_a") == x) & (F.col("group_b") == y), F.col("qed"))).alias(f"{x}_vs_{y}") for x, y in pairs]
    df = scores.groupBy("qi", *_QUARTET).agg(*cells).drop("qi")
    return df.dropDuplicates(_QUARTET) if deduplicate else df


def dense_counts(topology: DataFrame, groups: Sequence[str], column: str = "count") -> np.ndarray:
    """The result as an array (quartets, groups, 4) on the driver, for windows that fit there."""
    order = {g: i for i, g in enumerate(sorted(groups))}
    pdf = topology.select("qi", "group", "topology", column).toPandas()
    out = np.full((int(pdf["qi"].max()) + 1 if len(pdf) else 0, len(order), 4), np.nan if column != "count" else 0, float if column != "count" else np.int64)
    out[pdf["qi"], pdf["group"].map(order), pdf["topology"]] = pdf[column]
    return out


def mean_steiner(topology: DataFrame) -> DataFrame:
    """A steiner result with ``steiner_mean`` (0 where nothing was counted)."""
    return topology.withColumn("steiner_mean", F.col("steiner_sum") / F.greatest("count", F.lit(1)))


def topology_with_qed(topology: DataFrame, scores: DataFrame) -> DataFrame:
    """Deduplicated long topology rows, each with the scores of its quartet (left join)."""
    t = topology.select(*_QUARTET, "group", "topology", "count").dropDuplicates([*_QUARTET, "group", "topology"])
    s = scores.select("quartet_idx", "group_a", "group_b", "qed").dropDuplicates(["quartet_idx", "group_a", "group_b"])
    return t.join(s, "quartet_idx", "left")
