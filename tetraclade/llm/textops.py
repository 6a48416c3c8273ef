"""Flat numpy views of Arrow text columns, shared by the text operators.

All operators read the UTF-8 buffer that Spark hands over in Arrow batches and
work on it with array expressions; no Python loop runs over characters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship

#: Bytes of text that are turned into numpy arrays at once (memory bound of a worker).
CHUNK_BYTES = (1 << 20) - 4096

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything that is not an ASCII letter or digit, or part of a non-ASCII character.
PUNCTUATION = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])

_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (base is odd), cached."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            out.append(np.cumprod(a))
        _powers[base] = (out[0], out[1])
    p, q = _powers[base]
    return p[:n], q[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of each 64-bit value."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d, o


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each (one row at least)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


class Words:
    """Words of some rows of a flat text column: what stands between ``breaks``, by default ASCII white space.

    ``start``/``end`` are byte positions in ``data``, ``doc`` the row of each word,
    ``first`` the index of each row's first word (one more entry than rows).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE):
        base = int(offsets[0])
        self.data = data = data[base : int(offsets[-1])]
        self.offsets = offsets = offsets - base
        n = len(data)
        word = ~breaks[data]
        head = np.zeros(n + 1, bool)
        tail = np.zeros(n + 1, bool)
        if n:
            head[:n] = word
            head[1:n] &= ~word[:-1]
            tail[1:] = word
            tail[1:n] &= ~word[1:]
            cut = offsets[1:-1]
            cut = cut[(cut > 0) & (cut < n)]
            both = cut[word[cut] & word[cut - 1]]  # a word may not run on into the next row
            head[both] = True
            tail[both] = True
        self.start = np.flatnonzero(head)
        self.end = np.flatnonzero(tail)
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        data = self.data
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        p, q = powers(len(data) + 1)
        s = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:-1], out=s[1:])
        return mix64((s[self.end] - s[self.start]) * q[self.start])

    def lengths(self) -> np.ndarray:
        """Characters (code points) of each word."""
        c = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=c[1:])
        return c[self.end] - c[self.start]


def ngrams(words: np.ndarray, n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Rolling hash of every n consecutive word hashes (len(words) - n + 1 values)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    p, q = powers(len(words) + 1, base)
    s = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * p[:-1], out=s[1:])
    return mix64((s[n:] - s[:-n]) * q[:m])


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each made different from all of ``columns`` whatever the case."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def map_text(df: DataFrame, keep: list[str], text: str, compute: Callable, fields: list[T.StructField]) -> DataFrame:
    """``keep`` columns of ``df`` plus what ``compute(text_column)`` returns for them.

    ``compute`` takes an Arrow string array and returns one Arrow array or numpy
    array for each of ``fields``. Narrow: no shuffle, and only ``keep`` and ``text``
    are read. A kept column whose name is one of the new ones, whatever the case, gets
    underscores behind its name.
    """
    ship(df.sparkSession)
    own = fresh([f.name for f in fields], *keep)
    schema = T.StructType([T.StructField(n, df.schema[c].dataType) for n, c in zip(own, keep)] + list(fields))
    types, names = _arrow_types(fields), schema.names

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                made = compute(batch.column(len(keep)))
                made = [a if isinstance(a, pa.Array) else pa.array(a, type=t) for a, t in zip(made, types)]
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + made, names=names)

    return plain(df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`"))).mapInArrow(run, schema)


def filter_text(df: DataFrame, text: str, predicate: Callable) -> DataFrame:
    """Rows of ``df``, all columns unchanged, for which ``predicate(text_column)`` holds."""
    ship(df.sparkSession)
    at = df.columns.index(text)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(np.asarray(predicate(batch.column(at)), bool)))

    return plain(df).mapInArrow(run, df.schema)


def plain(df: DataFrame) -> DataFrame:
    """``df`` with numbers for names; mapInArrow takes no names with dots, nor two that are the same."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def _arrow_types(fields: list[T.StructField]) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in fields]
