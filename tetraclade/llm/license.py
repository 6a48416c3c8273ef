"""License scans: winnowed fingerprints pick candidates, banded alignment confirms them.

Words are runs of letters and digits, lower-cased. The inverted index maps the hash
of every ``GRAM`` consecutive template words to its (template, position) entries. A
document is winnowed: of every ``WINDOW`` neighbouring hashes the least is looked up,
so any run of ``GRAM + WINDOW - 1`` words shared with a template is met. Hits of one
template whose diagonals (document minus template position) lie within the template's
band form a candidate; the band is ``BAND``, or for long templates one word in
``DRIFT``. A candidate is aligned inside a band around its diagonal: local alignment,
+1 for an equal word, -1 for a substitution or a gap. Candidates of one template are
aligned together, one array step for each template word.

Two bounds that no alignment can exceed spare most candidates that work: the words that
a document and a template have in common, each as often as in both, and the template
words that stand anywhere in the candidate's band. A candidate goes if either is under
``COVERAGE``, so what is reported stays the same.

Reported are alignments that cover at least ``COVERAGE`` of the template's words.
Where reported spans of a document overlap, the one with most matching words stays,
ties go to the higher coverage, then to the template's place in the list; the others
are compared with what stayed.

Defined cases: null and empty texts and texts shorter than GRAM words match
nothing; a document without matches has no rows; a row that is repeated has its
matches repeated; null identifiers are carried. A very long text is scanned whole, with
some 260 bytes a word held. An empty table gives an empty table.
The templates are a fixed list, so what is sent to executors doesn't grow.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship
from .license_texts import TEMPLATES
from .textops import PUNCTUATION, Words, chunks, flat, ngrams

GRAM = 3
WINDOW = 2
BAND = 8
DRIFT = 32
COVERAGE = 0.75
#: Cells of alignment tables that are held at once.
CELLS = 1 << 22


class Index:
    """Inverted index of template fingerprints."""

    def __init__(self, templates: list[tuple[str, str, str]] = TEMPLATES):
        self.templates = templates
        self.words: list[np.ndarray] = []
        grams, owner, place = [], [], []
        for k, (_, _, text) in enumerate(templates):
            raw = np.frombuffer(text.encode(), np.uint8)
            h = Words(raw, np.array([0, len(raw)]), PUNCTUATION).hashes(lower=True)
            self.words.append(h)
            g = ngrams(h, GRAM)
            grams.append(g)
            owner.append(np.full(len(g), k))
            place.append(np.arange(len(g)))
        self.size = np.array([len(x) for x in self.words])
        self.band = np.maximum(BAND, self.size // DRIFT)
        self.vocabulary = np.unique(np.concatenate(self.words))
        self.ids = [np.searchsorted(self.vocabulary, x) for x in self.words]
        self.often = np.stack([np.bincount(x, minlength=len(self.vocabulary)) for x in self.ids])
        g = np.concatenate(grams)
        by = np.argsort(g, kind="stable")
        self.grams, self.owner, self.place = g[by], np.concatenate(owner)[by], np.concatenate(place)[by]

    def hits(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, template, template position) of looked-up document fingerprints."""
        g = ngrams(h, GRAM)
        none = np.zeros(0, np.int64)
        if not len(g):
            return none, none, none
        inside = doc[: len(g)] == doc[GRAM - 1 :]
        v = np.where(inside, g, np.uint64(0xFFFFFFFFFFFFFFFF))
        before = np.concatenate([v[:1], v[:-1]])
        after = np.concatenate([v[1:], v[-1:]])
        alone = np.zeros(len(g), bool)  # texts with one hash only have no window
        one = np.flatnonzero(inside)
        alone[one] = (np.concatenate([[-1], doc])[one] != doc[one]) & (np.append(inside[1:], False)[one] == False)  # noqa: E712
        chosen = np.flatnonzero(inside & ((v <= before) | (v <= after) | alone))
        lo = np.searchsorted(self.grams, g[chosen], "left")
        hi = np.searchsorted(self.grams, g[chosen], "right")
        n = hi - lo
        at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(chosen, n), self.owner[at], self.place[at]

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words that any template holds, and their places in the vocabulary."""
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        pos = np.flatnonzero(self.vocabulary[at] == h)
        return pos, at[pos]

    def possible(self, pos: np.ndarray, word: np.ndarray, doc: np.ndarray, row: np.ndarray, tem: np.ndarray) -> np.ndarray:
        """Whether each (row, template) has enough words in common for an alignment to be reported."""
        key, n = np.unique(doc[pos] * len(self.vocabulary) + word, return_counts=True)
        owner, word = key // len(self.vocabulary), key % len(self.vocabulary)
        ok = np.zeros(len(row), bool)
        for k in np.unique(tem):
            mine = np.flatnonzero(tem == k)
            common = np.bincount(owner, np.minimum(n, self.often[k][word]), int(doc[-1]) + 1)
            ok[mine] = common[row[mine]] >= COVERAGE * self.size[k]
        return ok

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        """(row, template, coverage, matched words, first word, end word, first char, end char) in order."""
        w = Words(data, offsets, PUNCTUATION)
        h = w.hashes(lower=True)
        pos, tem, place = self.hits(h, w.doc)
        if not len(pos):
            return []
        at, word = self.known(h)
        may = self.possible(at, word, w.doc, w.doc[pos], tem)
        if not may.any():
            return []
        places = np.sort(word * np.int64(len(h) + 1) + at)
        pos, tem, place = pos[may], tem[may], place[may]
        row, diagonal = w.doc[pos], pos - place
        by = np.lexsort((pos, diagonal, tem, row))
        pos, tem, row, diagonal = pos[by], tem[by], row[by], diagonal[by]
        band = self.band[tem]
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (tem[1:] != tem[:-1]) | (diagonal[1:] - diagonal[:-1] > band[1:] // 2)])
        head = np.flatnonzero(new)
        # a drifting cluster is cut so that its diagonals fit into one band
        lead = diagonal[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        piece = (diagonal - lead) // band
        new |= np.concatenate([[True], piece[1:] != piece[:-1]])
        head = np.flatnonzero(new)
        found = []
        for k in np.unique(tem[head]):
            mine = head[tem[head] == k]
            step = max(1, CELLS // (self.size[k] * (3 * self.band[k] + 1)))
            for i in range(0, len(mine), step):
                found += self._align(k, self.size[k], h, w, places, row[mine[i : i + step]], diagonal[mine[i : i + step]])
        found.sort(key=lambda x: (x[0], -x[3], -x[2], x[1], x[4]))
        out: list[tuple] = []
        now, spans = -1, []  # of this row what stayed, in order and apart
        for x in found:
            if x[0] != now:
                now, spans = x[0], []
            i = bisect.bisect_left(spans, (x[4], x[5]))
            if (i == 0 or spans[i - 1][1] <= x[4]) and (i == len(spans) or spans[i][0] >= x[5]):
                spans.insert(i, (x[4], x[5]))
                out.append(x)
        chars = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
        done = []
        for r, k, c, m, a, b in out:
            base, at = w.first[r], chars[w.offsets[r]]
            done.append((r, k, c, m, int(a - base), int(b - base), int(chars[w.start[a]] - at), int(chars[w.end[b - 1]] - at)))
        return sorted(done, key=lambda x: (x[0], x[4]))

    def _align(self, k: int, m: int, h: np.ndarray, w: Words, places: np.ndarray, row: np.ndarray, diagonal: np.ndarray) -> list[tuple]:
        """Best local alignments of template k in bands around the diagonals."""
        t = self.words[k]
        band = int(self.band[k])
        width = 3 * band + 1
        left = diagonal - band  # column b of template word i is document word left + i + b
        near = np.zeros(len(row), np.int64)
        for r in range(len(row)):
            begin = left[r] + np.arange(m)
            begin, end = np.maximum(begin, w.first[row[r]]), np.minimum(begin + width, w.first[row[r] + 1])
            base = self.ids[k] * np.int64(len(h) + 1)
            near[r] = np.count_nonzero(np.searchsorted(places, base + np.maximum(end, begin)) > np.searchsorted(places, base + begin))
        may = near >= COVERAGE * m
        row, diagonal, left = row[may], diagonal[may], left[may]
        if not len(row):
            return []
        n = len(row)
        score = np.zeros((m + 1, n, width), np.int16)
        lo, hi = w.first[row][:, None], w.first[row + 1][:, None]
        equal = np.zeros((m + 1, n, width), bool)
        for i in range(1, m + 1):
            at = left[:, None] + (i - 1) + np.arange(width)[None, :]
            ok = (at >= lo) & (at < hi)
            equal[i] = ok & (h[np.clip(at, 0, len(h) - 1)] == t[i - 1])
            s = score[i - 1] + np.where(equal[i], 1, -1).astype(np.int16)
            s[:, :-1] = np.maximum(s[:, :-1], score[i - 1][:, 1:] - 1)  # template word left out
            s = np.where(ok, np.maximum(s, 0), 0).astype(np.int16)
            step = np.arange(width, dtype=np.int16)
            s = np.maximum.accumulate(s + step, axis=1) - step  # document words left out
            score[i] = np.where(ok, np.maximum(s, 0), 0)
        r = np.arange(n)
        best = score.max((0, 2))
        i = m - (score.max(2) == best)[::-1].argmax(0)  # of equal scores the longest alignment
        # and of those the one nearest to the candidate's diagonal, so that a line in every few words finds itself
        b = np.where(score[i, r] == best[:, None], np.abs(np.arange(width) - band), width).argmin(1)
        end = left + i - 1 + b + 1
        first, matched = end.copy(), np.zeros(n, np.int64)
        live = score[i, r, b] > 0
        while live.any():
            here = score[i, r, b]
            hit = equal[i, r, b] & (here == score[np.maximum(i - 1, 0), r, b] + 1) & live
            up = (b + 1 < width) & (here == score[np.maximum(i - 1, 0), r, np.minimum(b + 1, width - 1)] - 1) & live & ~hit
            swap = (here == score[np.maximum(i - 1, 0), r, b] - 1) & live & ~hit & ~up
            back = live & ~hit & ~up & ~swap
            matched += hit
            first = np.where(hit, left + i - 1 + b, first)
            i = np.where(hit | swap | up, i - 1, i)
            b = np.where(up, b + 1, np.where(back, b - 1, b))
            live &= (i > 0) & (b >= 0)
            live &= score[np.maximum(i, 0), r, np.maximum(b, 0)] > 0
        ok = np.flatnonzero(matched >= COVERAGE * m)
        return sorted({(int(row[x]), int(k), float(matched[x] / m), int(matched[x]), int(first[x]), int(end[x])) for x in ok})


_index: list[Index] = []


def index() -> Index:
    """The index of the built-in templates, built once in each process."""
    if not _index:
        _index.append(Index())
    return _index[0]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each license passage; character spans count code points of the text."""
    ship(docs.sparkSession)
    id_field = T.StructField("doc_id", docs.schema[id_col].dataType)
    schema = T.StructType([
        id_field, T.StructField("license", T.StringType()), T.StructField("form", T.StringType()), T.StructField("coverage", T.DoubleType()),
        T.StructField("matched_words", T.IntegerType()), T.StructField("first_word", T.IntegerType()), T.StructField("end_word", T.IntegerType()),
        T.StructField("first_char", T.IntegerType()), T.StructField("end_char", T.IntegerType()),
    ])

    def run(batches):
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for a, b in chunks(offsets):
                x = index().scan(data, offsets[a : b + 1])
                if x:
                    c = list(zip(*x))
                    names = [index().templates[k] for k in c[1]]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([a + r for r in c[0]])), pa.array([n[0] for n in names]), pa.array([n[1] for n in names]), pa.array(c[2], pa.float64())]
                        + [pa.array(c[j], pa.int32()) for j in range(3, 8)],
                        names=schema.names,
                    )

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)
