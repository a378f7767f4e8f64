"""Quote verification (H1, J12, PF8): exact, then normalised, then fuzzy; only what is left reaches Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from ..config import SETTINGS
from ..functions.keys import partial_ratio
from ..functions.text import guard_form


#: Widths in bytes of the windows by which quotes are sought; places of a quote that may be its anchor; pairs looked at together.
WIDTHS, PLACES, PAIRS_AT_ONCE = (8, 4, 2, 1), 16, 1 << 20


def _windows(data: np.ndarray, width: int) -> np.ndarray:
    """The number made of the `width` bytes from each byte on; width - 1 fewer than the bytes."""
    out = np.empty(max(0, len(data) - width + 1), f"<u{width}")
    for at in range(min(width, len(out))):
        own = out[at::width]
        own[:] = data[at : at + width * len(own)].view(out.dtype)
    return out


class Finder:
    """Finds which of many quotes stand in texts, all in one pass over the bytes of the texts.

    A quote is met by its anchor, that of its windows at up to PLACES places that fewest quotes share; its first and
    last windows are compared next, the whole quote last. Quotes under 8 bytes have narrower windows.
    """

    def __init__(self, quotes: list[bytes]):
        self.quotes, self.size = quotes, np.array([len(q) for q in quotes], np.int64)
        self.blank = np.flatnonzero(self.size == 0)
        self.groups = []
        for width, beyond in zip(WIDTHS, (1 << 60, *WIDTHS)):
            own = np.flatnonzero((self.size >= width) & (self.size < beyond))
            if not len(own):
                continue
            window = lambda i, at: int.from_bytes(quotes[i][at : at + width], "little")
            places = [np.unique(np.linspace(0, self.size[i] - width, PLACES).astype(int)) for i in own]
            keys = np.array([window(i, at) for i, those in zip(own, places) for at in those], np.uint64)
            _, which, shared = np.unique(keys, return_inverse=True, return_counts=True)
            shared, begin, chosen = shared[which], 0, []
            for those in places:
                best = begin + int(np.argmin(shared[begin : begin + len(those)]))
                chosen.append((keys[best], those[best - begin]))
                begin += len(those)
            key, at = np.array([k for k, _ in chosen], np.uint64), np.array([a for _, a in chosen], np.int64)
            order = np.argsort(key, kind="stable")
            own, key, at = own[order], key[order], at[order]
            anchors, first, count = np.unique(key, return_index=True, return_counts=True)
            ends = np.array([[window(i, 0), window(i, self.size[i] - width)] for i in own], np.uint64).T
            bits = min(22, max(10, int(len(anchors)).bit_length() + 6))
            marks = np.zeros(1 << bits, bool)
            marks[self._slot(anchors, bits)] = True
            self.groups.append((width, own, at, ends, anchors, first, count, bits, marks))

    @staticmethod
    def _slot(windows: np.ndarray, bits: int) -> np.ndarray:
        return (windows.astype(np.uint64, copy=False) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)

    def find(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Rows (text, quote), each pair once, of the quotes in the texts data[bounds[i]:bounds[i + 1]]."""
        found = [np.stack([np.repeat(np.arange(len(bounds) - 1), len(self.blank)), np.tile(self.blank, len(bounds) - 1)], 1)]
        for width, *group in self.groups:
            for begin in range(0, len(data), PAIRS_AT_ONCE):  # the windows of that many bytes at a time
                found += self._met(data, bounds, begin, _windows(data[begin : begin + PAIRS_AT_ONCE + width - 1], width), width, *group)
        return np.unique(np.concatenate(found), axis=0)

    def _met(self, data, bounds, begin, windows, width, own, at, ends, anchors, first, count, bits, marks):
        hits = np.flatnonzero(marks[self._slot(windows, bits)])
        values = windows[hits].astype(np.uint64)
        which = np.minimum(np.searchsorted(anchors, values), len(anchors) - 1)
        same = anchors[which] == values
        hits, which = hits[same] + begin, which[same]
        upto = np.cumsum(count[which])
        cuts = [0, *np.flatnonzero(np.diff(upto // PAIRS_AT_ONCE)) + 1, len(hits)]
        for a, b in zip(cuts, cuts[1:]):
            n = count[which[a:b]]
            if not n.sum():
                continue
            place = np.repeat(hits[a:b], n)
            k = np.repeat(first[which[a:b]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = place - at[k]
            stop = start + self.size[own[k]]
            text = np.searchsorted(bounds, place, "right") - 1
            fits = np.flatnonzero((start >= bounds[text]) & (stop <= bounds[text + 1]))
            for edge, of in zip(ends, (start, stop - width)):
                read = sum(data[of[fits] + i].astype(np.uint64) << np.uint64(8 * i) for i in range(width))
                fits = fits[read == edge[k[fits]]]
            k, start, stop, text = k[fits], start[fits], stop[fits], text[fits]
            whole = [data[s:e].tobytes() == self.quotes[i] for s, e, i in zip(start, stop, own[k])]
            yield np.stack([text, own[k]], 1)[np.array(whole, bool)]


def meet(docs: DataFrame, quotes: DataFrame, text: str, quote: str) -> DataFrame:
    """Every row of docs with every row of quotes whose quote stands in the text, like a join on contains; without these
    two columns. The quotes are collected and sent to the executors, the texts are read once and not shuffled."""
    table = quotes.toArrow()
    kept = [c for c in docs.columns if c != text]
    sent = docs.sparkSession.sparkContext.broadcast((Finder([x.as_py().encode() for x in table[quote]]), table.drop_columns([quote]).combine_chunks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, own = sent.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
            bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
            pairs = finder.find(data, bounds - bounds[0])
            for i in range(0, len(pairs), 256):
                left, right = batch.select(kept).take(pa.array(pairs[i : i + 256, 0])), own.take(pa.array(pairs[i : i + 256, 1]))
                yield from pa.table(left.columns + right.columns, names=left.schema.names + right.column_names).combine_chunks().to_batches()

    return docs.mapInArrow(run, StructType([docs.schema[c] for c in kept] + [f for f in quotes.schema if f.name != quote]))


def window_score(quote: str, source: str) -> float:
    """Best partial ratio of the quote with windows of the source, a quarter of the quote apart."""
    size, best = len(quote), 0.0
    for start in range(0, max(1, len(source) - size + 1), max(1, size // 4)):
        best = max(best, partial_ratio(quote, source[start : start + size + 10]))
        if best >= 99:
            break
    return best


@F.pandas_udf(DoubleType())
def fuzzy_quote(quotes: pd.Series, sources: pd.Series) -> pd.Series:
    return pd.Series([None if q is None else window_score(q, s) for q, s in zip(quotes, sources)], dtype="float64")


def verify_quotes(df: DataFrame, quote: str = "quote", source: str = "source", threshold: float = SETTINGS.quote_score) -> DataFrame:
    """df with quote_match (exact, fuzzy or FAIL), quote_char_start, quote_char_end (0-based, of a verbatim hit) and
    guard_score."""
    q, s = F.coalesce(F.col(quote), F.lit("")), F.coalesce(F.col(source), F.lit(""))
    nq, ns = guard_form(q), guard_form(s)
    blank = (F.trim(q) == "") | (nq == "") | (s == "")
    at = F.position(q, s)
    tier = F.when(blank, "none").when(at > 0, "verbatim").when((F.length(nq) >= 3) & F.contains(ns, nq), "folded").when(F.length(nq) < 8, "none").otherwise("ask")
    ask, verbatim = F.col("__tier") == "ask", F.col("__tier") == "verbatim"
    scored = df.withColumn("__tier", tier).withColumn("__asked", fuzzy_quote(F.when(ask, nq), F.when(ask, ns)))
    out = scored.withColumn("guard_score", F.when(ask, F.col("__asked")).when(F.col("__tier") == "none", 0.0).otherwise(100.0))
    return out.select(
        *df.columns,
        F.when(F.col("__tier").isin("verbatim", "folded"), "exact").when((F.col("__tier") == "ask") & (F.col("guard_score") >= threshold), "fuzzy").otherwise("FAIL").alias("quote_match"),
        F.when(verbatim, at - 1).alias("quote_char_start"),
        F.when(verbatim, at - 1 + F.length(q)).alias("quote_char_end"),
        "guard_score",
    )


def split_guarded(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passed, rejected with reason and a JSON payload)."""
    failed = checked.where("quote_match = 'FAIL'")
    return checked.where("quote_match <> 'FAIL'"), failed.select(*[c for c in ("doc_id", "page_no") if c in checked.columns], F.lit("quote_not_found").alias("reason"), F.to_json(F.struct(*checked.columns)).alias("payload"))
