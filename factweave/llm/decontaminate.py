"""Benchmark decontamination by the q-gram lemma.

A stretch of text within e edits of a pattern of m characters shares at least m + 1 - q (e + 1) of its
q-grams, on at most e + 1 neighbouring diagonals (position in the text less position in the pattern). All
shared q-grams are counted in diagonal bands that overlap by e, so that one band holds every such stretch
whole; bands that reach the bound are verified by a banded alignment of the pattern. Texts are compared in
lower case with single blanks. A pattern longer than WINDOW is cut into windows half overlapping, each one a
pattern of its own. A pattern for which Q is too long for the bound to be 1 at least has shorter q-grams, one of under
Q characters itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .storage import held

Q = 8
#: Edits for each character of the pattern.
RATE = 0.1
WINDOW = 400
#: Characters of patterns that one pass holds; more are worked off in further passes over the texts.
PATTERN_CHARS = 8_000_000
SLICE = 1 << 20
#: Pairs of places of one q-gram, in text and patterns, that are worked on at a time.
MEETINGS = 1 << 21
_BITS = 22
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 5)


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(points: np.ndarray, q: int) -> np.ndarray:
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, U64)
    wide = points.astype(U64)
    h = wide[:n].copy()
    for k in range(1, q):
        h *= _BASE
        h += wide[k : n + k]
    h ^= h >> U64(29)
    return h * U64(0xBF58476D1CE4E5B9)


def _add(key: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different columns of key (three rows, none negative), in order, and how often each is there or the sums of
    their counts."""
    if not key.shape[1]:
        return key, np.zeros(0, np.int64)
    first, second, third = (int(n) + 1 for n in key.max(axis=1))
    if first * second * third >= 1 << 62:  # too large for one number
        out, back = np.unique(key, axis=1, return_inverse=True)
    elif count is None:
        one, many = np.unique((key[0] * second + key[1]) * third + key[2], return_counts=True)
        return np.stack([one // (second * third), one // third % second, one % third]), many
    else:
        one, back = np.unique((key[0] * second + key[1]) * third + key[2], return_inverse=True)
        out = np.stack([one // (second * third), one // third % second, one % third])
    return out, np.bincount(back.ravel(), weights=count, minlength=out.shape[1]).astype(np.int64)


class _Grams:
    """Where each q-gram of the patterns that have q-grams of this length stands."""

    def __init__(self, q: int, owners: list[int], points: list[np.ndarray], shift: np.ndarray):
        self.q = q
        places: dict[int, dict[int, list[int]]] = {}
        for owner in owners:
            for at, h in enumerate(_grams(points[owner], q).tolist()):
                places.setdefault(h, {}).setdefault(owner, []).append(at)
        self.key = np.array(sorted(places), U64)
        owner, at, many, again = [], [], [], []
        for h in self.key.tolist():
            before = len(at)
            for p, found in places[h].items():
                thin = _thin(found, 1 << int(shift[p]))
                owner += [p] * len(thin)
                at += thin
            many.append(len(at) - before)
            again.append(many[-1] > len(places[h]))
        self.owner, self.at, self.many = (np.array(x, np.int64) for x in (owner, at, many))
        self.begin = np.cumsum(self.many) - self.many
        #: Whether a pattern has the q-gram more than once.
        self.again = np.array(again, bool)
        self.present = np.zeros(1 << _BITS, bool)
        self.present[(self.key >> U64(64 - _BITS)).astype(np.intp)] = True


def _thin(places: list[int], step: int) -> list[int]:
    """Ascending places of one q-gram in a pattern, less those that reach no band which the rest does not: of places
    at most a band apart all but the first, the last and one in each band."""
    if len(places) < 3:
        return places
    out = places[:1]
    for at, after in zip(places[1:], [*places[2:], None]):
        if after is None or after - out[-1] > step:
            out.append(at)
    return out


class Index:
    """Patterns and their q-grams. items: (item_id, text)."""

    def __init__(self, items: list[tuple[int, str | None]], rate: float = RATE, window: int = WINDOW):
        self.item, self.points = [], []
        for item, text in items:
            p = _points(normal(text))
            starts = [0] if len(p) <= window else [*range(0, len(p) - window, window // 2), len(p) - window]
            for s in starts:
                if len(p):
                    self.item.append(item)
                    self.points.append(p[s : s + window])
        self.length = np.array([len(p) for p in self.points], np.int64)
        self.edits = (rate * self.length + 1e-9).astype(np.int64)
        #: With this length the bound is 1 at least, or the filter would let nothing be ruled out.
        self.q = np.minimum(Q, self.length // (self.edits + 1))
        self.least = self.length + 1 - self.q * (self.edits + 1)
        #: Bands are 2^shift diagonals apart and that plus the edits wide.
        self.shift = np.ceil(np.log2(self.edits + 1)).astype(np.int64)
        self.grams = [_Grams(int(q), np.flatnonzero(self.q == q).tolist(), self.points, self.shift) for q in np.unique(self.q)]

    def regions(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pattern, first diagonal) of the bands that reach the bound. Documents begin at starts in
        points, and a character that no pattern has stands between them."""
        parts = [self._counts(grams, points, starts) for grams in self.grams]
        key, count = (np.concatenate([p[i] for p in parts], axis=-1) if parts else np.zeros((3, 0)[i:], np.int64) for i in range(2))
        document, pattern, band = key[:, count >= self.least[key[1]]]
        return document, pattern, (band << self.shift[pattern]) - WINDOW

    def _counts(self, grams: _Grams, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """((document, pattern, band), shared q-grams), worked out for about MEETINGS meetings at a time."""
        h = _grams(points, grams.q)
        place = np.flatnonzero(grams.present[(h >> U64(64 - _BITS)).astype(np.intp)])
        found = np.searchsorted(grams.key, h[place])
        found[found == len(grams.key)] = 0
        true = grams.key[found] == h[place]
        place, found = place[true], found[true]
        total = np.cumsum(grams.many[found])
        key, count, low = np.zeros((3, 0), np.int64), np.zeros(0, np.int64), 0
        while low < len(place):
            high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + MEETINGS, side="right")))
            own = self._bands(grams, place[low:high], found[low:high], starts)
            own, many = _add(own)
            key, count = _add(np.concatenate([key, own], axis=1), np.concatenate([count, many])) if low else (own, many)
            low = high
        return key, count

    def _bands(self, grams: _Grams, place: np.ndarray, found: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(document, pattern, band), once for each place in the text, of the bands in which a q-gram there meets patterns."""
        many = grams.many[found]
        entry = np.repeat(grams.begin[found] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        place = np.repeat(place, many)
        pattern, offset = grams.owner[entry], grams.at[entry]
        diagonal = place - offset + WINDOW  # never negative
        shift, edits = self.shift[pattern], self.edits[pattern]
        band = diagonal >> shift
        lower = (diagonal - (band << shift)) < edits
        lower &= band > 0
        band, pattern, place = np.concatenate([band, band[lower] - 1]), np.concatenate([pattern, pattern[lower]]), np.concatenate([place, place[lower]])
        # A q-gram of the text counts once in a band however often the pattern has it.
        again = np.repeat(grams.again[found], many)
        again = np.concatenate([again, again[lower]])
        met = np.stack([place, pattern, band])
        if again.any():
            met = np.concatenate([met[:, ~again], _add(met[:, again])[0]], axis=1)
        met[0] = np.searchsorted(starts, met[0], side="right") - 1
        return met

    def align(self, points: np.ndarray, pattern: np.ndarray, diagonal: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Edits of the best alignment of each pattern with a stretch of its document, points begin to end, within its
        band, all at once.

        Column c of row i stands for text position diagonal + i + c - e. Any first and last text position is free.
        """
        best = np.zeros(len(pattern), np.int64)
        for low in range(0, len(pattern), 2048):
            part = slice(low, low + 2048)
            best[part] = self._align(points, pattern[part], diagonal[part], begin[part, None], end[part, None])
        return best

    def _align(self, points: np.ndarray, pattern: np.ndarray, diagonal: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        m, e = self.length[pattern], self.edits[pattern]
        width = int((2 * e + (1 << self.shift[pattern]) + e).max()) + 1
        rows = int(m.max())
        text = np.zeros((len(pattern), rows), np.uint32)
        for r, p in enumerate(pattern):
            text[r, : m[r]] = self.points[p]
        column = np.arange(width)
        left = (diagonal - e)[:, None] + column
        padded = np.concatenate([points, [np.uint32(0xFFFFFFFF)]])
        cost = np.zeros((len(pattern), width), np.int32)
        best = np.full(len(pattern), rows + 1, np.int64)
        for i in range(rows):
            where = left + i
            inside = (where >= begin) & (where < end)
            match = padded[np.where(inside, where, len(points))] == text[:, i : i + 1]
            step = cost + ~match
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(step - column, axis=1) + column
            done = m == i + 1
            if done.any():
                best[done] = cost[done].min(axis=1)
        return best

    def matches(self, texts: list[str]) -> list[dict[int, int]]:
        """For every normalised text: item_id -> fewest edits, for the items that it contains within their budget."""
        out: list[dict[int, int]] = [{} for _ in texts]
        joined = "\n".join(texts)
        points = _points(joined)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        starts = np.cumsum(sizes) - sizes
        document, pattern, diagonal = self.regions(points, starts)
        if len(document):
            edits = self.align(points, pattern, diagonal, starts[document], starts[document] + sizes[document] - 1)
            for d, p, n in zip(document.tolist(), pattern.tolist(), edits.tolist()):
                if n <= self.edits[p]:
                    item = self.item[p]
                    out[d][item] = min(n, out[d].get(item, n))
        return out


def _index(shared) -> Index:
    return held("decontamination", tuple(map(tuple, shared.value)), lambda: Index(shared.value))


def _found(index: Index, column):
    """Matches of every text, about SLICE characters at a time."""
    texts, size, out = [], 0, []
    for value in column:
        texts.append(normal(value.as_py()))
        size += len(texts[-1])
        if size >= SLICE:
            out += index.matches(texts)
            texts, size = [], 0
    return out + (index.matches(texts) if texts else [])


def _blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """Lists of (item, text) of at most PATTERN_CHARS characters, so that what is broadcast is bounded."""
    block, size = [], 0
    for r in benchmark.select(item_col, text_col).orderBy(item_col).toLocalIterator():
        if r[1] is None or r[0] is None:
            continue
        if block and size + len(r[1]) > PATTERN_CHARS:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, kept, item_ids (ascending) and edits (of each item) for every row of docs.

    kept is false if the text contains an item, or a window of a long one, within its edit budget. Null and
    empty texts contain nothing; null and blank items match nothing, items of under 10 characters only verbatim. Repeated rows
    get a row each; other columns are not read. One narrow pass for each block of patterns, no shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    frame = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    names = ["doc_id", "text", "items", "edits"]
    shape = f"doc_id {kind}, text string, items array<bigint>, edits array<int>"
    for block in [*_blocks(benchmark, "item_id", "text")] or [[]]:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            index = _index(shared)
            for batch in batches:
                found = _found(index, batch.column(1))
                if batch.num_columns > 2:
                    found = [dict(zip(i.as_py(), e.as_py())) | f for f, i, e in zip(found, batch.column(2), batch.column(3))]
                ordered = [sorted(f.items()) for f in found]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([[i for i, _ in f] for f in ordered], pa.list_(pa.int64())), pa.array([[n for _, n in f] for f in ordered], pa.list_(pa.int32()))], names)

        frame = frame.mapInArrow(run, shape)
    return frame.selectExpr(f"doc_id as `{id_col}`", "size(items) = 0 as kept", "items as item_ids", "edits")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that contain no benchmark item; narrow passes as in contamination."""
    at = docs.columns.index(text_col)
    for block in _blocks(benchmark, "item_id", "text"):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            index = _index(shared)
            for batch in batches:
                yield batch.filter(pa.array([not f for f in _found(index, batch.column(at))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
