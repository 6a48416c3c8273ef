"""Byte-pair encoding and decoding in batched numpy merge rounds.

A text is cut by the vocabulary's pattern; the distinct pieces of a batch that
aren't known yet are encoded together. Their bytes lie in one flat symbol array. A
round takes each piece's leftmost pair of lowest rank, merges it, and looks up only
the two pairs that the merge made; ranks come from binary search over the sorted
keys ``left << 32 | right`` of all pairs that form a token. Pieces without a pair
left leave the arrays. Every piece goes through the same merges as in the
one-at-a-time definition, so ids are exactly those of the public tokenizer.

A piece of more than ``LONG`` bytes (a text without spaces) takes rank after rank
instead, all places of a rank in one array step: first those left of the first
place whose merge makes a pair of lower rank, which is then next. Places wait in a
queue by rank, so a step costs what it merges and a piece of 1 MB some seconds.

Decoding lays the tokens' bytes end to end with one gather.

Vocabularies are files of lines ``base64(token) rank``; their path, on the driver, is
a parameter. Executors get the file's bytes, whose size doesn't depend on the corpus.

Defined cases: null texts have null ids, count and round trip; empty texts have an
empty list. Special tokens have no meaning in a text. A very long text is taken
``GROUP`` pieces at a time. Repeated rows get equal results. An empty table gives an
empty table. Only identifier and text are read; an identifier named like a result
gets underscores behind its name.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship
from .textops import CHUNK_BYTES, chunks, flat, fresh, map_text, plain

#: Letters, digits, other signs, each with one space before it, and white space.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces whose ids a process keeps; then it starts anew.
CACHE = 300_000
#: Bytes from which a piece is merged by itself, and pieces of a long text that are encoded at once.
LONG, GROUP = 1024, 200_000

_NONE = np.int64(1 << 31)  # above all ranks, small enough for one key of rank and position

FIELDS = [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())]


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions start[0].. start[0]+size[0]-1, start[1].. and so on."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)


class Vocabulary:
    """Tokens, their pairs, and the pieces encoded so far."""

    def __init__(self, lines: bytes, pattern: str = PATTERN):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for t, r in ranks.items():
            tokens[r] = t
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, merged = [], []
        for t, r in ranks.items():
            for i in range(1, len(t)):
                left, right = ranks.get(t[:i]), ranks.get(t[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    merged.append(r)
        by = np.argsort(np.array(keys, np.int64))
        self.keys, self.merged = np.array(keys, np.int64)[by], np.array(merged, np.int64)[by]
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        compiled = regex.compile(pattern)
        self.find, self.iterate = compiled.findall, compiled.finditer
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.start = np.zeros(1, np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair forms, or _NONE."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], _NONE)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces and where each begins (one more entry)."""
        long = [k for k, p in enumerate(pieces) if len(p) > LONG]
        if not long:
            return self._merge(pieces)
        ids, start = self._merge([p if len(p) <= LONG else b"" for p in pieces])
        parts = np.split(ids, start[1:-1])
        for k in long:
            parts[k] = self._merge_long(pieces[k])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one piece, rank after rank."""
        sym = self.byte[np.frombuffer(piece, np.uint8)]
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n)  # the last entry of ``before`` takes what stands behind the end
        rank = np.full(n, _NONE)
        rank[:-1] = self.rank(sym[:-1], sym[1:])
        alive = np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def put(at: np.ndarray) -> None:
            at = at[rank[at] < _NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            r = rank[at]
            for part in np.split(at, np.flatnonzero(r[1:] != r[:-1]) + 1) if len(at) else ():
                k = int(rank[part[0]])
                if k not in waiting:
                    waiting[k] = []
                    heapq.heappush(queue, k)
                waiting[k].append(part)

        put(np.arange(n))
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            # of places that overlap every second one, from the left
            new = np.concatenate([[True], after[at[:-1]] != at[1:]])
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(new, place, 0))) % 2 == 0]
            left, right = before[at], after[after[at]]
            low = np.zeros(len(at), bool)
            some = np.flatnonzero(right < n)
            low[some] = self.rank(np.full(len(some), r), sym[right[some]]) < r
            some = np.flatnonzero(left >= 0)
            merged = np.zeros(len(at), bool)
            merged[1:] = after[after[at[:-1]]] == at[1:]
            low[some] |= self.rank(np.where(merged[some], r, sym[left[some]]), np.full(len(some), r)) < r
            if low.any():
                stop = int(np.argmax(low)) + 1
                # those to the right wait, and the ones that overlapped them
                put(np.concatenate([at[stop:], after[at[stop:]][rank[after[at[stop:]]] == r]]) if stop < len(at) else at[:0])
                at, left, right = at[:stop], left[:stop], right[:stop]
            gone = after[at]
            sym[at], after[at], before[right], alive[gone], rank[gone] = r, right, at, False, _NONE
            touched = np.unique(np.concatenate([at, left[left >= 0]]))
            touched = touched[alive[touched]]
            rank[touched] = _NONE
            inside = touched[after[touched] < n]
            rank[inside] = self.rank(sym[inside], sym[after[inside]])
            put(inside)
        return sym[alive].astype(np.int32)

    def _merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(p) for p in pieces], np.int64)
        sym = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), size)
        rank = np.full(len(sym), _NONE)
        if len(sym) > 1:
            rank[:-1] = np.where(piece[1:] == piece[:-1], self.rank(sym[:-1], sym[1:]), _NONE)
        done_sym, done_piece = [], []
        while len(sym):
            head = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            least = np.minimum.reduceat(rank, head)
            count = np.diff(np.append(head, len(sym)))
            over = np.repeat(least == _NONE, count)
            if over.any():
                done_sym.append(sym[over])
                done_piece.append(piece[over])
                sym, piece, rank = sym[~over], piece[~over], rank[~over]
                if not len(sym):
                    break
                count = count[least != _NONE]
                least = least[least != _NONE]
                head = np.cumsum(count) - count
            # one key for rank and position: the leftmost pair of lowest rank
            at = np.minimum.reduceat(rank * len(sym) + np.arange(len(sym)), head) % len(sym)
            sym[at] = rank[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            sym, piece, rank = sym[keep], piece[keep], rank[keep]
            n = len(sym)
            rank[at] = _NONE
            right = at[at + 1 < n]
            right = right[piece[right + 1] == piece[right]]
            rank[right] = self.rank(sym[right], sym[right + 1])
            left = at[at > 0] - 1
            left = left[piece[left] == piece[left + 1]]
            rank[left] = self.rank(sym[left], sym[left + 1])
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(len(pieces) + 1, np.int64)
        s, p = np.concatenate(done_sym), np.concatenate(done_piece)
        by = np.argsort(p, kind="stable")
        return s[by].astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(p, minlength=len(pieces)))])

    def encode_long(self, text: str) -> np.ndarray:
        """Ids of one long text, some pieces at a time."""
        out, pieces = [np.zeros(0, np.int32)], (m.group() for m in self.iterate(text))
        while some := list(islice(pieces, GROUP)):
            out.append(self._encode([some])[0])
        return np.concatenate(out)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and where each begins (one more entry)."""
        return self._encode([self.find(t) for t in texts])

    def _encode(self, found: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > CACHE:
            self._clear()
        known = self.known
        new = list(set().union(*found).difference(known))
        if new:
            ids, start = self.merge([p.encode() for p in new])
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.start = np.concatenate([self.start, start[1:] + self.start[-1]])
            self.ids = np.concatenate([self.ids, ids])
        pieces = np.fromiter(map(known.__getitem__, chain.from_iterable(found)), np.int64, sum(map(len, found)))
        size = np.diff(self.start)[pieces]
        total = np.concatenate([[0], np.cumsum(size)])
        cut = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int64)
        return self.ids[ragged(self.start[pieces], size)], total[cut]

    def decode(self, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the rows of ids and where each row begins."""
        size = self.offsets[ids + 1] - self.offsets[ids]
        return self.data[ragged(self.offsets[ids], size)], np.concatenate([[0], np.cumsum(size)])[start]


_loaded: dict[tuple[bytes, str], Vocabulary] = {}


def vocabulary(path: str = VOCABULARY, pattern: str = PATTERN) -> Vocabulary:
    """The vocabulary of a file of this machine."""
    with open(path, "rb") as f:
        return _vocabulary(f.read(), pattern)


def _vocabulary(lines: bytes, pattern: str) -> Vocabulary:
    """The vocabulary of a file's lines, made once in each process."""
    key = (hashlib.sha256(lines).digest(), pattern)
    if key not in _loaded:
        _loaded[key] = Vocabulary(lines, pattern)
    return _loaded[key]


def _lines(df: DataFrame, path: str):
    """The file's bytes as a broadcast."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _encode(column: pa.Array, v: Vocabulary) -> list:
    data, offsets = flat(column)
    ids, cuts, same, total = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], [np.zeros(0, bool)], 0
    for a, b in chunks(offsets):
        o = offsets[a : b + 1] - offsets[a]
        raw = data[int(offsets[a]) : int(offsets[b])]
        text = raw.tobytes()
        if len(raw) > CHUNK_BYTES:  # one long text
            i = v.encode_long(text.decode())
            s = np.array([0, len(i)])
        else:
            i, s = v.encode([text[x:y].decode() for x, y in zip(o[:-1], o[1:])])
        back, at = v.decode(i, s)
        if len(back) == len(raw) and (at == o).all() and (back == raw).all():
            same.append(np.ones(b - a, bool))
        else:
            same.append(np.array([back[at[k] : at[k + 1]].tobytes() == text[o[k] : o[k + 1]] for k in range(b - a)]))
        ids.append(i)
        cuts.append(s[1:] + total)
        total += int(s[-1])
    cut = np.concatenate(cuts)
    null = column.is_null()
    valid = pc.invert(null)
    lists = pa.ListArray.from_buffers(pa.list_(pa.int32()), len(column), [valid.buffers()[1], pa.py_buffer(cut.astype(np.int32))], children=[pa.array(np.concatenate(ids))])
    mask = null.to_numpy(zero_copy_only=False)
    return [lists, pa.array(np.diff(cut), mask=mask), pa.array(np.concatenate(same), mask=mask)]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``(doc_id, token_ids, n_tokens, round_trip)`` of every row; round_trip: the ids decode to the text."""
    lines = _lines(docs, path)
    return map_text(docs, [id_col], text_col, lambda column: _encode(column, _loaded_once(lines, pattern)), FIELDS)


_last: dict[tuple[int, str], Vocabulary] = {}


def _loaded_once(lines, pattern: str) -> Vocabulary:
    """The vocabulary of a broadcast; its bytes are hashed once in each process."""
    key = (lines.id if hasattr(lines, "id") else id(lines), pattern)
    if key not in _last:
        _last.clear()
        _last[key] = _vocabulary(lines.value, pattern)
    return _last[key]


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``(id, text)`` of rows of token ids; bytes that are not UTF-8 become U+FFFD, null stays null."""
    ship(encoded.sparkSession)
    (own,) = fresh(["text"], id_col)
    schema = T.StructType([T.StructField(own, encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])
    lines = _lines(encoded, path)

    def run(batches):
        v = _loaded_once(lines, pattern)
        for batch in batches:
            lists = batch.column(1)
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            start = np.concatenate([[0], np.cumsum(n)])
            data, at = v.decode(lists.flatten().to_numpy().astype(np.int64), start)
            raw = data.tobytes()
            text = [raw[a:b].decode("utf-8", "replace") if ok else None for a, b, ok in zip(at[:-1], at[1:], lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=schema.names)

    return plain(encoded.select(F.col(f"`{id_col}`"), F.col(f"`{ids_col}`"))).mapInArrow(run, schema)
