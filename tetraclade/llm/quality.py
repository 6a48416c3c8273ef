"""Quality rules: how much of a document lies inside repeated n-grams and lines.

Words are maximal runs without ASCII white space. For every length n in
``NGRAMS`` an n-gram is *repeated* if the same n words stand earlier in the same
document; the characters of all words under repeated n-grams are counted once.
Lines count likewise: a line repeats if an earlier line has the same words. The
word hashes are prefix (rolling) hashes over the flat text of a batch, so every
length costs one subtraction a position and one sort.

Rules: a document goes if one of its fractions exceeds the limit in ``LIMITS``.

Defined cases: null, empty and white-space-only texts have no words, fractions of
0.0 and are rejected as ``empty``; documents with fewer than n words have no
n-grams; a very long text is measured whole, with some 300 bytes a word held (six letters each); equal
rows get equal results; an empty table gives an empty table; an identifier named like
a result gets underscores behind its name; columns besides the identifier and the text are ignored by :func:`quality` and
carried unchanged by :func:`quality_filter`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textops import Words, chunks, filter_text, flat, map_text, mix64, ngrams, powers

NGRAMS = (5, 6, 7, 8, 9, 10)
#: Largest accepted share of characters inside repeated n-grams of n words (0: lines).
LIMITS = {0: 0.20, 5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("dup_line_chars", T.LongType()),
    *[T.StructField(f"dup_{n}gram_chars", T.LongType()) for n in NGRAMS],
    T.StructField("keep", T.BooleanType()),
    T.StructField("reason", T.StringType()),
]


def later(keys: np.ndarray) -> np.ndarray:
    """Positions whose key stands at an earlier position too."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(0, np.int64)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    some = np.flatnonzero(twice[at] == keys)
    order = some[np.argsort(keys[some], kind="stable")]
    k = keys[order]
    return order[1:][k[1:] == k[:-1]]


def measure(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows by (words, word characters, repeated-line characters, one count for each of NGRAMS)."""
    w = Words(data, offsets)
    rows = len(offsets) - 1
    out = np.zeros((rows, 3 + len(NGRAMS)), np.int64)
    out[:, 0] = np.diff(w.first)
    if not len(w):
        return out
    chars = np.concatenate([[0], np.cumsum(w.lengths())])
    out[:, 1] = chars[w.first[1:]] - chars[w.first[:-1]]
    h = w.hashes()
    salt = mix64(w.doc.astype(np.uint64) + np.uint64(0x51ED27))

    newline = np.concatenate([[0], np.cumsum(w.data == 10)])
    line = newline[w.start]
    first = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1])]))
    last = np.append(first[1:], len(w))
    p, q = powers(len(w) + 1, 0xA24BAED4963EE407)
    s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * p[:-1])])
    again = later(mix64((s[last] - s[first]) * q[first]) + salt[first])
    out[:, 2] = np.bincount(w.doc[first[again]], chars[last[again]] - chars[first[again]], rows)

    for k, n in enumerate(NGRAMS):
        g = ngrams(h, n)
        inside = np.flatnonzero(w.doc[: len(g)] == w.doc[n - 1 :]) if len(g) else np.zeros(0, np.int64)
        if not len(inside):
            continue
        again = inside[later(g[inside] ^ salt[inside])]
        if not len(again):
            continue
        step = np.zeros(len(w) + 1, np.int64)
        step[again] += 1  # each position once
        np.subtract.at(step, again + n, 1)
        under = np.cumsum(step[:-1]) > 0
        out[:, 3 + k] = np.bincount(w.doc[under], np.diff(chars)[under], rows)
    return out


def judge(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row is kept, and the first rule that rejects it (None if kept)."""
    reason = np.full(len(counts), None, object)
    total = counts[:, 1]
    for column, name, limit in [(2, "lines", LIMITS[0])] + [(3 + k, f"{n}grams", LIMITS[n]) for k, n in enumerate(NGRAMS)]:
        bad = (counts[:, column] > limit * total) & np.equal(reason, None)
        reason[bad] = name
    reason[total == 0] = "empty"
    return np.equal(reason, None), reason


def _counts(column: pa.Array) -> np.ndarray:
    data, offsets = flat(column)
    parts = [measure(data, offsets[a : b + 1]) for a, b in chunks(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, 3 + len(NGRAMS)), np.int64)


def _compute(column: pa.Array) -> list:
    counts = _counts(column)
    keep, reason = judge(counts)
    return [*counts.T, keep, reason]


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Repetition measures and the verdict for every row."""
    return map_text(docs, [id_col], text_col, _compute, FIELDS)


def quality_filter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that pass the rules, columns unchanged."""
    return filter_text(docs, text_col, lambda column: judge(_counts(column))[0])
