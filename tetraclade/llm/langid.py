"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled reference text. A
document is parsed against each automaton into the longest phrases that occur in
that language's reference; with p phrases over n symbols and a reference of N
symbols the cost is ``p * log2(N) / n`` bits a symbol. The language with the lowest
cost wins, ties go to the alphabetically first.

Text is normalised first: letters are lower-cased, every run of other characters
is one space. All letters of the references have codes of their own; letters that no
reference holds match nothing. The parse runs through the whole text, however long.
To walk their automata in lockstep, one table look-up a symbol for all languages
together, texts are cut into blocks of ``BLOCK`` symbols, each parsed as if a phrase
began there. Then every block is parsed again from the state in which the block
before ended, until it is in the state that it was in at the same place the first
time; from there on both parses are the same. Blocks whose last state changed hand it
on, until none does, so the phrases are those of the parse without blocks.

The reference is a bounded sample of labelled rows: at most ``DOCS_PER_LANGUAGE``
documents (those with the smallest hash of identifier and text), ``CHARS_PER_DOC``
characters of each and ``REFERENCE_SYMBOLS`` symbols a language, for every label. Everything else reads whole texts.

Defined cases: null texts and texts without letters get language null, zero
symbols, and are rejected, as are texts whose best cost, without the last and open
phrase, exceeds the language's level: ``MAX_BITS``, or more where the reference's last
quarter costs much against the rest of it. Rows
with a null label take no part in the reference. Without any usable label every
row gets null and the filter keeps nothing. Equal rows get equal results. A very long
text is walked ``GROUP`` blocks at a time. An identifier named like a result gets
underscores behind its name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import chunks, filter_text, flat, map_text

BLOCK = 1024
#: Cells (blocks times languages) whose states are held at once.
GROUP = 16_384
#: Bytes up to which transitions are one table with a place for every symbol, which is faster to look up than displaced rows.
DENSE_BYTES = 128 << 20
DOCS_PER_LANGUAGE = 64
CHARS_PER_DOC = 2000
REFERENCE_SYMBOLS = 50_000
#: Bits a symbol above which a text is in none of the languages. Texts in one of them
#: cost 2 to 3, mixtures of two up to 5, random letters and foreign scripts over 10.
MAX_BITS = 8.0
#: A language whose own held-out text costs h bits and whose unknown letters cost u keeps texts up to h + LEVEL * (u - h)
#: bits, if that is more: large scripts cost far more than 3. At h = 2.5 and u = 15.6 this is MAX_BITS.
LEVEL = 0.42

FIELDS = [
    T.StructField("lang_id", T.StringType()),
    T.StructField("bits", T.DoubleType()),
    T.StructField("margin", T.DoubleType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("keep", T.BooleanType()),
]

_UNKNOWN, _GAP, _FIRST = 0, 1, 2
_MISS = np.int32(-(1 << 31))
_CODES = 0x110000


def reference(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id") -> dict[str, str]:
    """Reference text of each label: the bounded sample described above."""
    label, text = F.col(f"`{label_col}`").cast("string"), F.col(f"`{text_col}`")
    start = F.substring(text, 1, CHARS_PER_DOC)
    h = F.xxhash64(F.col(f"`{id_col}`"), start, F.lit("langid"))
    few = docs.select(label.alias("l"), h.alias("h"), start.alias("t")).where(F.col("l").isNotNull() & (F.col("t") != ""))
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))
    rows = few.withColumn("r", rank).where(F.col("r") <= DOCS_PER_LANGUAGE).collect()
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["l"], r["r"])):
        out.setdefault(r["l"], []).append(r["t"])
    return {k: "\n".join(v) for k, v in out.items()}


def _fold() -> np.ndarray:
    """Lower-case code point of each letter, 1 for everything that is not a letter."""
    table = np.ones(_CODES, np.uint32)
    for c in range(_CODES):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 and ord(low) < _CODES else c
    return table


_models: dict[bytes, Model] = {}


class Model:
    """Automata of all languages, the rows of their sparse transition tables displaced into each other."""

    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        fold = _fold()
        folded = []
        for name in self.names:
            c = np.frombuffer(texts[name].encode("utf-32-le", "replace"), np.uint32)
            c = np.where(c < _CODES, fold[np.minimum(c, _CODES - 1)], 1)
            folded.append(c[~((c == 1) & (np.concatenate([[1], c[:-1]]) == 1))][:REFERENCE_SYMBOLS])
        letters = np.unique(np.concatenate(folded)) if folded else np.zeros(0, np.uint32)
        letters = letters[letters != 1]
        self.width = len(letters) + _FIRST
        code = np.full(_CODES, _UNKNOWN, np.int32)
        code[letters] = np.arange(_FIRST, self.width)
        code[1] = _GAP
        self.code = code[fold]
        langs = len(folded)
        self.start, self.log_n, self.level = [], [], []
        base, owner, target, again, states, cells = [], [], [], np.zeros((langs, self.width), np.int32), 0, 0
        for j, c in enumerate(folded):
            (state, symbol, to), n, held_out = _automaton(code[c].tolist())
            at, size = _displace(state, symbol, n, self.width)
            own, go = np.full(size, -1, np.int32), np.zeros(size, np.int32)
            own[at[state] + symbol], go[at[state] + symbol] = state + states, to + states
            # one more state, without transitions, for the start and for symbols that the reference lacks
            start = states + n
            again[j] = start | _MISS
            root = state == 0
            again[j, symbol[root]] = (to[root] + states) | _MISS
            base.append(np.append(at, 0) + cells)
            owner.append(own)
            target.append(go)
            self.start.append(start)
            self.log_n.append(np.log2(max(2, len(c))))
            self.level.append(max(MAX_BITS, held_out + LEVEL * (self.log_n[-1] - held_out)))
            states, cells = start + 1, cells + size
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        self.base, self.owner, self.target, self.again = join(base), join(owner), join(target), again
        self.table = None
        if states * self.width * 4 <= DENSE_BYTES:
            language = np.repeat(np.arange(langs), np.diff([0, *[x + 1 for x in self.start]]))
            self.table = again[language]
            place = np.flatnonzero(self.owner >= 0)
            self.table[self.owner[place], place - self.base[self.owner[place]]] = self.target[place]
            self.table = self.table.ravel()

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the rows and their new offsets."""
        raw = data[int(offsets[0]) : int(offsets[-1])].tobytes().decode("utf-8", "replace")
        c = self.code[np.minimum(np.frombuffer(raw.encode("utf-32-le"), np.uint32), _CODES - 1)]
        d = data[int(offsets[0]) : int(offsets[-1])]
        chars = np.concatenate([[0], np.cumsum((d & 0xC0) != 0x80)])[offsets - offsets[0]]
        gap = c == _GAP
        keep = ~gap
        keep[1:] |= gap[1:] & ~gap[:-1]
        first = chars[:-1][chars[:-1] < chars[1:]]
        keep[first] = ~gap[first]  # no leading gap
        return c[keep], np.concatenate([[0], np.cumsum(keep)])[chars]

    def _next(self, state: np.ndarray, symbol: np.ndarray, lane: np.ndarray | slice) -> np.ndarray:
        """States after the symbols, marked where a phrase begins; ``lane``: the languages."""
        if self.table is not None:
            return np.take(self.table, state * np.int32(self.width) + symbol)
        at = self.base[state] + symbol
        return np.where(self.owner[at] == state, self.target[at], self.again[lane, symbol])

    def phrases(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each row (second axis) against each language."""
        n = np.diff(offsets)
        rows = np.repeat(np.arange(len(n)), -(-n // BLOCK))
        k = np.arange(len(rows)) - np.searchsorted(rows, rows)
        start = offsets[rows] + k * BLOCK
        size = np.minimum(BLOCK, offsets[rows + 1] - start)
        out = np.zeros((len(self.names), len(n)))
        padded = np.append(symbols, np.zeros(BLOCK, symbols.dtype))
        state = None  # in which the last block of the group before ended
        step = max(1, GROUP // max(1, len(self.names)))
        for a in range(0, len(rows), step):
            z = min(a + step, len(rows))
            count, state = self._group(padded, start[a:z], size[a:z], k[a:z] > 0, state)
            for j in range(len(self.names)):
                out[j] += np.bincount(rows[a:z], count[j], len(n))
        return out

    def _group(self, padded: np.ndarray, start: np.ndarray, size: np.ndarray, goes_on: np.ndarray, state: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of neighbouring blocks (second axis) against each language, and each language's last state.

        ``goes_on``: whether a block continues the text of the one before, for the first
        from ``state``.
        """
        langs, blocks = len(self.names), len(start)
        order = np.argsort(-size, kind="stable")
        first, length = start[order], size[order]
        active = np.searchsorted(-length, -np.arange(BLOCK), "left")  # blocks longer than each step
        now = np.repeat(np.array(self.start, np.int32)[:, None], blocks, 1)
        misses = np.zeros(now.shape, np.int16)
        states = np.empty((int(length[0]), langs, blocks), np.int32)
        so_far = np.empty((int(length[0]), langs, blocks), np.int16)
        for i in range(int(length[0])):
            a = int(active[i])
            s = padded[first[:a] + i]
            v = self._next(now[:, :a], s, slice(None))
            misses[:, :a] += v < 0
            np.bitwise_and(v, 0x7FFFFFFF, out=now[:, :a])
            states[i, :, :a], so_far[i, :, :a] = now[:, :a], misses[:, :a]
        place = np.empty(blocks, np.int64)
        place[order] = np.arange(blocks)
        alone = misses[:, place].astype(np.int64)
        count, last = alone.copy(), now[:, place]
        # cells whose entry isn't the start that they were parsed from
        lane, block = np.nonzero(np.broadcast_to(goes_on, (langs, blocks)))
        entry = np.where(block > 0, last[lane, block - 1], state[lane] if state is not None else 0)
        while len(lane):
            at_row, now, n = place[block], entry.copy(), np.zeros(len(lane), np.int64)
            new_count, new_last = alone[lane, block], entry.copy()
            live = np.arange(len(lane))
            i = 0
            while len(live):
                s = padded[start[block[live]] + i]
                v = self._next(now[live], s, lane[live])
                n[live] -= v >> 31
                now[live] = v & 0x7FFFFFFF
                met = now[live] == states[i, lane[live], at_row[live]]
                done = live[met]
                new_count[done] = n[done] + alone[lane[done], block[done]] - so_far[i, lane[done], at_row[done]]
                new_last[done] = states[size[block[done]] - 1, lane[done], at_row[done]]
                live = live[~met]
                i += 1
                over = size[block[live]] == i
                done = live[over]
                new_count[done], new_last[done] = n[done], now[done]
                live = live[~over]
            count[lane, block] = new_count
            changed = last[lane, block] != new_last
            last[lane, block] = new_last
            lane, block = lane[changed], block[changed] + 1
            on = block < blocks
            lane, block = lane[on], block[on]
            on = goes_on[block]
            lane, block = lane[on], block[on]
            entry = last[lane, block - 1]
        return count, last[:, -1]

    def bits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cost of each row against each language, its symbols, its letters."""
        data, offsets = flat(column)
        cost, count, letters = [np.zeros((len(self.names), 0))], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in chunks(offsets):
            s, o = self.symbols(data, offsets[a : b + 1])
            n = np.diff(o)
            cost.append(self.phrases(s, o) * np.array(self.log_n)[:, None] / np.maximum(1, n))
            count.append(n)
            letters.append(np.diff(np.concatenate([[0], np.cumsum(s != _GAP)])[o]))
        return np.concatenate(cost, 1), np.concatenate(count), np.concatenate(letters)

    def identify(self, column: pa.Array) -> list:
        bits, count, letters = self.bits(column)
        rows = len(count)
        if not self.names:
            return [np.full(rows, None, object), pa.nulls(rows, pa.float64()), pa.nulls(rows, pa.float64()), np.zeros(rows, np.int64), np.zeros(rows, bool)]
        best = np.argmin(bits, 0)
        low = bits[best, np.arange(rows)]
        rest = np.sort(bits, 0)[1] - low if len(self.names) > 1 else np.zeros(rows)
        none = letters == 0
        name = np.array(self.names, object)[best]
        name[none] = None
        closed = low - np.array(self.log_n)[best] / np.maximum(1, count)  # the last phrase was cut short by the end of the text
        return [name, pa.array(low, mask=none), pa.array(rest, mask=none), np.where(none, 0, count), ~none & (closed <= np.array(self.level)[best])]


def _automaton(text: list[int]) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int, float]:
    """Transitions (state, symbol, next state) of the suffix automaton of ``text``, its states, and its held-out cost.

    That is the bits a symbol of the last quarter against the automaton of the rest.
    """
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    held_out, cut = 0.0, len(text) * 3 // 4
    for i, c in enumerate(text):
        if i == cut:
            n, s = 0, -1
            for x in text[cut:]:
                s = nxt[s].get(x, -1) if s >= 0 else -1
                if s < 0:
                    n, s = n + 1, nxt[0].get(x, -1)
            held_out = n * np.log2(max(2, cut)) / (len(text) - cut)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    flat_ = [(s, c, t) for s, d in enumerate(nxt) for c, t in d.items() if c]
    t = np.array(flat_, np.int64).reshape(-1, 3)
    return (t[:, 0], t[:, 1], t[:, 2]), len(nxt), float(held_out)


def _displace(state: np.ndarray, symbol: np.ndarray, n: int, width: int) -> tuple[np.ndarray, int]:
    """Start of each state's row in one array of cells where no two transitions share a cell, and the cells.

    Every row may be read at all ``width`` symbols. States with several transitions
    take the first free place from a moving point on; the others fill the gaps.
    """
    count = np.bincount(state, minlength=n)
    first = np.searchsorted(state, np.arange(n + 1))
    used = bytearray(2 * len(state) + 4 * width + 16)
    at = np.zeros(n, np.int64)
    symbols = symbol.tolist()
    point = top = 0
    for s in np.argsort(-count, kind="stable")[: np.count_nonzero(count > 1)].tolist():
        own = symbols[first[s] : first[s + 1]]
        p, tries = point, 0
        while True:
            if p + width >= len(used):
                used += bytes(len(used))
            for c in own:
                if used[p + c]:
                    break
            else:
                break
            p, tries = p + 1, tries + 1
        for c in own:
            used[p + c] = 1
        at[s] = p
        top = max(top, p)
        if tries > 32:
            point += tries // 2  # what is left behind goes to states with one transition
    one = np.flatnonzero(count == 1)
    c = symbol[first[one]]
    used += bytes(len(one) + width)
    free = np.flatnonzero(np.frombuffer(used, np.uint8) == 0)
    free = free[free >= width][: len(one)]  # so that no row begins before the first cell
    at[one] = free - c
    return at, int(max(top, at.max(initial=0))) + width


def model(texts: dict[str, str]) -> Model:
    """The model of ``texts``, built once in each process."""
    key = hashlib.sha256(repr(sorted(texts.items())).encode()).digest()
    if key not in _models:
        _models.clear()
        _models[key] = Model(texts)
    return _models[key]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """Language, bits a symbol, lead over the second language and verdict of every row."""
    texts = docs.sparkSession.sparkContext.broadcast(reference(docs, text_col, label_col, id_col))
    return map_text(docs, [id_col], text_col, lambda column: model(texts.value).identify(column), FIELDS)


def language_filter(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """The rows whose text is in one of the labelled languages, columns unchanged."""
    texts = docs.sparkSession.sparkContext.broadcast(reference(docs, text_col, label_col, id_col))
    return filter_text(docs, text_col, lambda column: model(texts.value).identify(column)[-1])
