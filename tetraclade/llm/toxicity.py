"""Toxicity by FTRL-proximal logistic regression over hashed n-grams.

Features are the presence of words, pairs of neighbouring words and pairs with one
word between, lower-cased and without punctuation, hashed into ``2**SPACE_BITS``
coordinates. Training visits the sample ``EPOCHS`` times, row by row; every coordinate
has its own rate, and the L1 term keeps weights at exactly zero until a feature has
shown enough evidence, so the model is a short list of (coordinate, weight) pairs,
never longer than the hash space, whatever the corpus.

The model is fitted on a bounded sample of labelled rows: the ``TRAIN_ROWS`` labels
with the smallest hash of their identifier. Every row of the table is scored on its
whole text.

Defined cases: a null or empty text has no features and gets the score of the
intercept. Labels that are null or whose document is missing are not used; without
any label all scores are 0.0. A very long text is scored whole, with some 260 bytes a
word held. Repeated rows are scored alike. An empty table gives an empty table. Other
columns are not read; an identifier named like a result gets underscores behind its
name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship
from .textops import PUNCTUATION, Words, chunks, flat, map_text, mix64

SPACE_BITS = 20
TRAIN_ROWS = 8_000
EPOCHS = 10
ALPHA, BETA, L1, L2 = 4.0, 1.0, 3.0, 0.01
#: Score from which a text counts as toxic; above the share of toxic labels.
THRESHOLD = 0.2
_BIAS = 1 << SPACE_BITS

FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("toxic", T.BooleanType())]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and row of every feature occurrence."""
    w = Words(data, offsets, PUNCTUATION)
    h = w.hashes(lower=True)
    out, rows = [h], [w.doc]
    for gap in (1, 2):
        if len(h) > gap:
            inside = w.doc[gap:] == w.doc[:-gap]
            out.append(mix64(h[:-gap] * np.uint64(2 * gap + 1) + (h[gap:] >> np.uint64(1)))[inside])
            rows.append(w.doc[gap:][inside])
    return (np.concatenate(out) >> np.uint64(64 - SPACE_BITS)).astype(np.int64), np.concatenate(rows)


def fit(data: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights of the sparse model (coordinate 2**SPACE_BITS: intercept)."""
    per_row: list[np.ndarray] = []
    for a, b in chunks(offsets):
        x, row = features(data, offsets[a : b + 1])
        key = np.unique((row << (SPACE_BITS + 1)) | x)
        cut = np.searchsorted(key, np.arange(b - a + 1) << (SPACE_BITS + 1))
        x = (key & ((1 << (SPACE_BITS + 1)) - 1)).astype(np.int32)
        per_row += [np.append(x[i:j], np.int32(_BIAS)) for i, j in zip(cut[:-1], cut[1:])]
    z, n = np.zeros(_BIAS + 1), np.zeros(_BIAS + 1)
    l1 = np.full(_BIAS + 1, L1)
    l1[_BIAS] = 0.0
    for _ in range(EPOCHS):
        for x, y in zip(per_row, labels):
            zx, nx = z[x], n[x]
            w = _weights(zx, nx, l1[x])
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35.0, 35.0)))
            g = p - y
            z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / ALPHA * w
            n[x] = nx + g * g
    w = _weights(z, n, l1)
    at = np.flatnonzero(w)
    return at, w[at]


def _weights(z: np.ndarray, n: np.ndarray, l1: np.ndarray) -> np.ndarray:
    w = -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    w[np.abs(z) <= l1] = 0.0
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray]:
    """The model of the bounded labelled sample, fitted in one task of an executor."""
    ship(docs.sparkSession)
    few = labels.where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull())
    few = few.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(F.col(f"`{label_col}`").cast("int")).alias("y"))
    few = few.withColumn("h", F.xxhash64("id", F.lit("toxicity"))).orderBy("h").limit(TRAIN_ROWS)
    # at most TRAIN_ROWS rows of three numbers, at any size of the corpus
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(few), "id")
    rows = rows.repartition(1).sortWithinPartitions("h", "text")

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if parts:
            t = pa.Table.from_batches(parts).combine_chunks()
            at, w = fit(*flat(t["text"]), t["y"].to_numpy().astype(float))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w)], names=["at", "w"])

    model = rows.mapInArrow(run, "at bigint, w double").toPandas()
    return model["at"].to_numpy(np.int64), model["w"].to_numpy(float)


_dense: dict[int, np.ndarray] = {}


def predict(column: pa.Array, at: np.ndarray, w: np.ndarray) -> list:
    """Score and verdict of each text."""
    key = hash((at.tobytes(), w.tobytes()))
    if key not in _dense:
        _dense.clear()
        table = np.zeros(_BIAS + 1, np.float32)
        table[at] = w
        _dense[key] = table
    table = _dense[key]
    if not len(at):
        n = len(column)
        return [np.zeros(n), np.zeros(n, bool)]
    data, offsets = flat(column)
    out = [np.zeros(0)]
    for a, b in chunks(offsets):
        x, row = features(data, offsets[a : b + 1])
        some = table[x] != 0
        key = np.unique((row[some] << (SPACE_BITS + 1)) | x[some])
        s = np.bincount(key >> (SPACE_BITS + 1), table[key & ((1 << (SPACE_BITS + 1)) - 1)], b - a)
        out.append(1.0 / (1.0 + np.exp(-(s + float(table[_BIAS])))))
    score = np.concatenate(out)
    return [score, score >= THRESHOLD]


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``(doc_id, score, toxic)`` of every row of ``docs``."""
    at, w = train(docs, labels, id_col, text_col, label_col)
    model = docs.sparkSession.sparkContext.broadcast((at, w))
    return map_text(docs, [id_col], text_col, lambda column: predict(column, *model.value), FIELDS)
