"""Topology counts over a stream of trees.

Counts, sums, least and greatest values of trees add up, so a stream in update mode
ends at what a batch over the same trees gives. The taxa and groups are fixed
beforehand; trees with other taxa still count for the quartets they hold.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quartets import Quartets
from ..operators import kernel
from ..ship import ship
from ..sources import newick


#: Trees and quartets that go through the kernel together.
TREES, BATCH = 64, 2048


def _pack(text: str, number: dict[str, int], strategy: str, missing_length: float) -> kernel.Packed:
    t = newick.parse(text, strategy, missing_length)
    slots = np.full(len(number), -1, np.int32)
    for leaf, name in enumerate(t.names):
        if name in number:
            slots[number[name]] = leaf
    return kernel.Packed(slots, t.gap, t.depth, t.poly, t.rd, [(1, t.rd)])


def tree_topologies(trees: DataFrame, quartets: Quartets, keep: Sequence[str] = ("group",), strategy: str = "multifurcation", missing_length: float = 1.0) -> DataFrame:
    """``keep`` and ``(qi, topology, steiner)``: one row for each tree and quartet it holds; narrow, stream or batch."""
    ship(trees.sparkSession)
    number = {t: i for i, t in enumerate(quartets.taxa)}
    new = [T.StructField("qi", T.LongType()), T.StructField("topology", T.IntegerType()), T.StructField("steiner", T.DoubleType())]
    schema = T.StructType([*[trees.schema[c] for c in keep], *new])

    def run(batches):
        qi = np.arange(quartets.count)
        q = quartets.at(qi + quartets.offset)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for first in range(0, len(texts), TREES):
                packed = [(k, _pack(text, number, strategy, missing_length)) for k, text in enumerate(texts[first : first + TREES])]
                for start in range(0, len(q), BATCH):
                    # a group for each tree, so that cells are trees
                    counts, total, *_ = kernel.count(packed, q[start : start + BATCH], len(packed), True)
                    at, row, k = np.nonzero(counts)
                    same = pa.array(row + first)
                    yield pa.RecordBatch.from_arrays(
                        [*[c.take(same) for c in batch.columns[:-1]], pa.array(qi[at + start]), pa.array(k.astype(np.int32)), pa.array(total[at, row, k])], names=schema.names
                    )

    return trees.select(*keep, "newick").mapInArrow(run, schema)


def streaming_counts(trees: DataFrame, quartets: Quartets, window: Sequence[str] | None = None, time_col: str = "ts", lateness: str = "10 minutes", **options: object) -> DataFrame:
    """Running ``(group, qi, topology, count, steiner_sum, steiner_min, steiner_max)``.

    With ``window`` (width, and step if sliding) counts are kept for each event-time
    window of ``time_col``, and trees later than ``lateness`` are left out.
    """
    measures = [F.count("*").cast("int").alias("count"), F.sum("steiner").alias("steiner_sum"), F.min("steiner").alias("steiner_min"), F.max("steiner").alias("steiner_max")]
    keys = ["group", "qi", "topology"]
    if window is None:
        return tree_topologies(trees, quartets, **options).groupBy(*keys).agg(*measures)
    rows = tree_topologies(trees, quartets, ("group", time_col), **options).withWatermark(time_col, lateness)
    return rows.groupBy(F.window(time_col, *window).alias("window"), *keys).agg(*measures)
