"""Helpers for jobs that must survive lost executors, and for sorted streams of rows."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder of ``spark.checkpoint.dir`` and cut from its lineage."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _folder(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if given is None and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="checkpoint-"))


def runs(batches: Iterator[pa.RecordBatch], key: Callable[[pa.Table], np.ndarray], rows: int = 20_000, most: int = 20_000) -> Iterator[tuple[pa.Table, int | None]]:
    """(table, part) of a stream that is sorted by the key.

    Tables of some ``rows`` rows never split a run of equal keys and have part None. A
    run that has come to ``most`` rows by the end of a batch comes alone, in numbered
    parts of ``most`` rows and up to a batch more, so what is held doesn't grow with it.
    """
    done: list[pa.RecordBatch] = []
    open_: list[pa.RecordBatch] = []  # rows of the last key
    last, part = None, None
    size = lambda x: sum(b.num_rows for b in x)

    for batch in batches:
        if not batch.num_rows:
            continue
        k = key(pa.Table.from_batches([batch]))
        change = np.flatnonzero(k[1:] != k[:-1]) + 1
        end = int(change[-1]) if len(change) else 0
        if last is not None and k[0] == last:
            lead = int(change[0]) if len(change) else len(k)
            open_.append(batch.slice(0, lead))
        else:
            lead = 0
        if lead < len(k):
            if part is None:
                done += open_
            elif open_:
                yield pa.Table.from_batches(open_), part + 1
            if lead < end:
                done.append(batch.slice(lead, end - lead))
            open_, part, last = [batch.slice(max(lead, end))], None, k[-1]
        if size(open_) >= most:
            part = 0 if part is None else part + 1
            yield pa.Table.from_batches(open_), part
            open_ = []
        if size(done) >= rows:
            yield pa.Table.from_batches(done), None
            done = []
    if part is None:
        done += open_
    elif open_:
        yield pa.Table.from_batches(open_), part + 1
    if done:
        yield pa.Table.from_batches(done), None


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(a, b)``; the root is the component's least node.

    Alternates the large-star and small-star steps until the edges are stars
    around their roots. Every round works on edges only and is checkpointed.
    Self-loops and repeated edges change nothing; nodes without edges don't appear.
    """
    a, b = F.col("a"), F.col("b")

    def least(by: str) -> Column:
        return F.least(by, F.min("w").over(Window.partitionBy(by)))

    def key(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(r)

    e = edges.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    e = checkpoint(e)
    seen = key(e)
    while seen[0]:
        both = e.select(a.alias("v"), b.alias("w")).union(e.select(b, a))
        large = both.withColumn("m", least("v")).where(F.col("w") > F.col("v")).select(F.col("m").alias("a"), F.col("w").alias("b")).distinct()
        down = large.select(b.alias("v"), a.alias("w")).withColumn("m", least("v"))
        small = down.select(F.col("m").alias("a"), F.col("w").alias("b")).union(down.select("m", "v")).where(a != b).distinct()
        e = checkpoint(small)
        now = key(e)
        if now == seen:
            break
        seen = now
    return e.select(b.alias("node"), a.alias("root")).union(e.select(a, a).distinct())


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below ``spark.checkpoint.dir`` and read again."""
    import uuid

    _folder(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
