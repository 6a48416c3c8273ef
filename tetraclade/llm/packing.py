"""Packing documents into length buckets and token-budget batches.

A histogram of the lengths of all documents is gathered; a dynamic programme over
it chooses at most ``BUCKETS`` bucket boundaries so that the padding, the sum of
(boundary - length) over all documents, is least. Inside a bucket documents are
numbered by (length bin, shard, identifier), the shard being the identifier (or its
hash, if it isn't an integer) modulo ``SHARDS``, and cut into batches of
``max(1, TOKEN_BUDGET // boundary)`` rows; the last batch of a bucket may be short.

The length of a document is its number of words without ASCII white space.
Lengths up to ``EXACT`` have a bin each, longer ones share bins of relative width
1 / ``EXACT`` * 2, so the histogram stays a few thousand rows at any corpus size; a
bin's padding counts every document's own length. Numbers come from counts by
(bin, shard): no sort spans a bucket, the largest sorted unit is one of ``SHARDS``
parts of one bin. Ties between equal paddings go to the smaller boundary.

Defined cases: null and empty texts have length 0 and take their place in the first
bucket; rows that repeat an identifier are all placed; null identifiers come first
in their bin; an empty table gives an empty table. Columns besides identifier and
text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 8
TOKEN_BUDGET = 65_536
EXACT = 1024
SHARDS = 32


def length(text: Column) -> Column:
    """Words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]+")), F.lit(0)).cast("bigint")


def bin_of(n: Column) -> Column:
    """The upper edge of a length's bin."""
    octave = F.length(F.bin(F.greatest(n - 1, F.lit(0)))) - F.lit(EXACT.bit_length() - 1)
    step = F.when(n > EXACT, F.pow(F.lit(2.0), octave.cast("double"))).otherwise(1.0).cast("bigint")
    return (F.floor((n + step - 1) / step) * step).cast("bigint")


def boundaries(edges: np.ndarray, count: np.ndarray, total: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Boundaries of least padding for bins of ascending upper edges.

    ``count`` and ``total`` are each bin's documents and summed lengths. cost[k][j]
    is the least padding of the first j bins in k buckets; a bucket over bins i+1..j
    pads to ``edges[j]``.
    """
    n = len(edges)
    if not n:
        return []
    c = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    t = np.concatenate([[0], np.cumsum(total)]).astype(np.int64)
    best = np.full(n + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    back = []
    costs = []
    for _ in range(min(buckets, n)):
        new = np.full(n + 1, np.iinfo(np.int64).max // 4)
        frm = np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            x = best[:j] + edges[j - 1] * (c[j] - c[:j]) - (t[j] - t[:j])
            i = int(np.argmin(x))
            new[j], frm[j] = x[i], i
        best = new
        back.append(frm)
        costs.append(int(new[n]))
    k = int(np.argmin(costs))  # the fewest buckets among equals
    out, j = [], n
    while j:
        out.append(int(edges[j - 1]))
        j = int(back[k][j])
        k -= 1
    return out[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """``(doc_id, n_tokens, bucket, bucket_len, batch)`` of every row."""
    from .cluster import checkpoint

    spark = docs.sparkSession
    n = docs.select(F.col(f"`{id_col}`").alias("doc_id"), length(F.col(f"`{text_col}`")).alias("n_tokens"))
    # identifiers and lengths only; the texts are scanned once
    whole = n.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    shard = F.pmod(F.col("doc_id") if whole else F.xxhash64("doc_id"), F.lit(SHARDS))
    n = checkpoint(n.withColumn("edge", bin_of(F.col("n_tokens"))).withColumn("shard", F.coalesce(shard, F.lit(0)).cast("int")))
    cells = n.groupBy("edge", "shard").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).toPandas().sort_values(["edge", "shard"])
    by = cells.groupby("edge", sort=True)
    edges = by.n.sum()
    cuts = boundaries(edges.index.to_numpy(), edges.to_numpy(), by.t.sum().to_numpy(), buckets)
    number = np.searchsorted(edges.index.to_numpy(), cells.edge.to_numpy())
    counts = np.zeros((len(edges), SHARDS), np.int64)
    counts[number, cells["shard"].to_numpy()] = cells.n.to_numpy()
    bucket = np.searchsorted(cuts, edges.index.to_numpy()) if cuts else np.zeros(0, np.int64)
    before = (np.cumsum(counts.ravel()) - counts.ravel()).reshape(counts.shape)
    first = np.searchsorted(bucket, bucket)  # bins ascend, so a bucket's rows follow each other
    before -= before[first, 0][:, None]
    # a row for each length bin: bounded by the number of bins, not by the corpus
    offsets = spark.createDataFrame(
        [
            (int(e), int(k), int(cuts[k]), max(1, token_budget // max(1, cuts[k])), row.tolist())
            for e, k, row in zip(edges.index, bucket, before)
        ],
        "edge bigint, bucket int, bucket_len bigint, room bigint, before array<bigint>",
    )
    place = F.row_number().over(Window.partitionBy("edge", "shard").orderBy("doc_id", "n_tokens")) - 1
    placed = n.withColumn("place", place).join(F.broadcast(offsets), "edge").withColumn("before", F.get("before", F.col("shard")))
    return placed.select("doc_id", "n_tokens", "bucket", "bucket_len", F.floor((F.col("before") + F.col("place")) / F.col("room")).cast("bigint").alias("batch"))
