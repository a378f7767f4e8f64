"""Quality rules: plain counts, and an n-gram perplexity with a band for each language.

The model is an interpolated modified Kneser-Ney model of ORDER characters, one for each value of lang, over
lower-case text with single blanks and digits as 0. Spark counts the n-grams of all documents; lower orders
count the distinct n-grams that continue them. Probabilities of the n-grams seen and back-off weights of
their contexts are kept in arrays of float32 beside sorted arrays of 64-bit hashes.

A text whose perplexity leaves the band of its language is rejected: too high is noise, too low is repetition. The
band is laid around the median log-perplexity of the texts that pass the plain rules, in robust deviations (from the
median absolute deviation), and is wider for short texts, whose means scatter more.

Five characters hardly see past a word, so word trigrams of all documents are counted too. A text's words are scored
by absolute discounting with back-off to two words and one (weights not renormalised), on the counts less those of
the text itself and its exact copies: else words in an order of their own would predict themselves. Only a band upwards is
laid on this mean. The tables grow with the text, so trigrams are dealt to groups, in passes that each hold a share on disk.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, held, join_sized, materialize
from .textkernel import U64, Words, mix, span_hashes, string_buffers

ORDER = 5
#: A band reaches so many robust deviations from the median, and for a text of n characters so much / sqrt(n)
#: more: up and down. Upwards it is narrow, as noise raises every character's cost; downwards it is wide, as
#: any text that has copies elsewhere is well predicted.
UPPER, LOWER = (1.5, 2.0), (6.0, 6.0)
#: The same for the mean over words, by their number.
WORD_UPPER = (1.5, 4.0)
DISCOUNT = 0.75
#: Passes over the word trigrams; words in a row of word numbers, and such rows to a Python worker at once; trigrams of a
#: group on average; occurrences from which a word's trigrams are dealt to several groups.
PASSES, CHUNK, TOKEN_ROWS, GROUP, HOT = 16, 2_000_000, 4, 300_000, 1_000_000
#: Passes after which the words left over are looked up.
LOOK_UP = 2
#: n-grams and contexts up to which the model is broadcast (12 bytes each); beyond it texts are scored by joins.
MODEL_ROWS = 8_000_000
#: Characters that are worked on at once; arrays of more leave the processor's cache.
SLICE = 1 << 18
WINDOW = 5

_digit = re.compile(r"\d")
_zeros = bytes(48 if 48 <= i < 58 else i for i in range(256))
_BASE = U64(0x9E3779B97F4A7C15 | 5)
_symbol = np.zeros(256, bool)
_symbol[list(b"#*$%&|<>")] = True


def normal(text: str | None) -> str:
    plain = " ".join((text or "").lower().split())
    try:  # Latin-1 has no further digits
        return plain.encode("latin-1").translate(_zeros).decode("latin-1")
    except UnicodeEncodeError:
        return _digit.sub("0", plain)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points with ORDER - 1 blanks before each text, position of every text's characters, its row)."""
    pad = " " * (ORDER - 1)
    points = np.frombuffer("".join([pad + t for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    row = np.repeat(np.arange(len(texts)), sizes)
    # A text's k-th character ends the n-gram that begins ORDER - 1 places before it.
    return points, np.arange(len(row)) + (ORDER - 1) * row, row


class _Counter:
    """n-gram counts of a task, by language; codes of 12 bits stand for characters."""

    def __init__(self):
        self.code = np.zeros(0x110000, np.uint16)
        self.known = [0]
        self.counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, lang: str, texts: list[str]) -> bool:
        """Counts texts; False, having done nothing, if the codes run out."""
        points, begin, _ = _points(texts)
        if not len(begin):
            return True
        fresh = np.unique(points[self.code[points] == 0])
        if len(self.known) + len(fresh) > 4096:
            return False
        self.code[fresh] = np.arange(len(self.known), len(self.known) + len(fresh))
        self.known += fresh.tolist()
        codes = self.code[points].astype(np.int64)
        gram = codes[begin]
        for k in range(1, ORDER):
            gram = (gram << 12) | codes[begin + k]
        key, n = np.unique(gram, return_counts=True)
        if lang in self.counts:
            key, n = np.concatenate([self.counts[lang][0], key]), np.concatenate([self.counts[lang][1], n])
            key, back = np.unique(key, return_inverse=True)
            n = np.bincount(back, weights=n).astype(np.int64)
        self.counts[lang] = key, n
        return True

    def size(self) -> int:
        return sum(len(k) for k, _ in self.counts.values())

    def batches(self):
        known = np.array(self.known, np.uint32)
        for lang, (key, n) in self.counts.items():
            for low in range(0, len(key), 100_000):
                part = key[low : low + 100_000]
                points = np.stack([known[(part >> (12 * (ORDER - 1 - k))) & 4095] for k in range(ORDER)], axis=1)
                flat = points.tobytes().decode("utf-32-le", "surrogatepass")
                grams = [flat[i : i + ORDER] for i in range(0, len(flat), ORDER)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(grams, pa.string()), pa.array(n[low : low + 100_000], pa.int64())], ["lang", "gram", "n"])


def _runs(batch: pa.RecordBatch, column: int, size: int = SLICE):
    """(low, texts) of about size characters."""
    texts, low, have = [], 0, 0
    for at, value in enumerate(batch.column(column)):
        texts.append(value.as_py())
        have += len(texts[-1] or "")
        if have >= size:
            yield low, texts
            texts, low, have = [], at + 1, 0
    if texts:
        yield low, texts


def _count(batches):
    held("quality")
    counter = _Counter()
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for low, texts in _runs(batch, 1):
            by: dict[str, list[str]] = {}
            for lang, text in zip(langs[low:], texts):
                by.setdefault(lang or "", []).append(normal(text))
            for lang, own in by.items():
                pending = [own]
                while pending:
                    part = pending.pop()
                    if counter.add(lang, part):
                        continue
                    if counter.size():
                        yield from counter.batches()
                        counter = _Counter()
                        pending.append(part)
                    elif len(part) > 1:
                        pending += [part[: len(part) // 2], part[len(part) // 2 :]]
                    else:  # over 4,000 different characters in one text
                        yield from _plainly(lang, part[0])
            if counter.size() > 2_000_000:
                yield from counter.batches()
                counter = _Counter()
    yield from counter.batches()


def _plainly(lang: str, text: str):
    """Counts of one text, without codes."""
    padded = " " * (ORDER - 1) + text
    counts: dict[str, int] = {}
    for i in range(len(text)):
        gram = padded[i : i + ORDER]
        counts[gram] = counts.get(gram, 0) + 1
    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "gram", "n"])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fit(docs: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(probabilities (lang, gram, logp), weights (lang, gram, logw), the tables these are read from): the model of all of
    docs (lang, text).

    Grams of every order stand in one table; a context's weight applies to the order above its length. All
    n-grams of all texts count; tasks send each distinct n-gram once.
    """
    top = docs.select("lang", "text").mapInArrow(_count, "lang string, gram string, n bigint")
    table = {ORDER: materialize(top.groupBy("lang", "gram").agg(F.sum("n").alias("n")), f"grams{ORDER}")}
    for k in range(ORDER - 1, 0, -1):
        table[k] = materialize(table[k + 1].groupBy("lang", F.expr(f"substring(gram, 2, {k})").alias("gram")).agg(F.count("*").alias("n")), f"grams{k}")

    def share(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    probabilities, weights, kept = [], [], []
    below = None
    for k in range(1, ORDER + 1):
        ones = table[k].groupBy("lang").agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)], F.count("*").alias("types"))
        y = share(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
        # Where counts of counts are missing, the discounts fall back to half a count.
        discount = [F.when((F.col(f"n{i}") > 0) & (F.col("n1") > 0), F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), i - (i + 1) * y * share(F.col(f"n{i + 1}"), F.col(f"n{i}"))))).otherwise(F.lit(0.5)).alias(f"d{i}") for i in (1, 2, 3)]
        rate = ones.select("lang", "types", *discount)
        rate = materialize(rate, f"rate{k}")
        grams = join_sized(table[k].withColumn("context", F.expr(f"substring(gram, 1, {k - 1})")), rate, "lang", "inner", 64)
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        contexts = materialize(grams.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum(cut).alias("freed"), F.max("types").alias("types")).withColumn("weight", F.col("freed") / F.col("total")), f"contexts{k}")
        joined = grams.drop("types").join(contexts, ["lang", "context"])
        own = (F.col("n") - cut) / F.col("total")
        if below is None:
            p = own + F.col("weight") / (F.col("types") + 1)
            scored = joined.select("lang", "gram", p.alias("p"))
            # What an unseen character gets: the empty context's weight times the uniform share.
            weights.append(contexts.select("lang", F.col("context").alias("gram"), F.log(F.col("weight") / (F.col("types") + 1)).alias("logw")))
        else:
            scored = joined.withColumn("shorter", F.expr(f"substring(gram, 2, {k - 1})")).join(below.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("q")), ["lang", "shorter"]).select("lang", "gram", (own + F.col("weight") * F.col("q")).alias("p"))
            weights.append(contexts.select("lang", F.col("context").alias("gram"), F.log("weight").alias("logw")))
        below = materialize(scored, f"scored{k}")
        probabilities.append(below.select("lang", "gram", F.log("p").alias("logp")))
        discard(table[k], rate)
        kept += [contexts, below]

    return _union(probabilities), _union(weights), kept


def _salt(lang: str) -> np.uint64:
    return U64(xxhash.xxh64_intdigest(lang))


def gram_hashes(points: np.ndarray, begin: np.ndarray, size: int, salt: np.uint64) -> np.ndarray:
    h = np.zeros(len(begin), U64)
    for k in range(size):
        h = h * _BASE + points[begin + k] + U64(1)
    return mix((h * U64(8) + U64(size)) ^ salt)


class HashArray:
    """Sorted hashes with values; an index of the leading bits says where to begin."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)
        self.bits = max(1, min(24, int(np.ceil(np.log2(len(keys) + 1))) + 1))
        self.begin = np.searchsorted(self.keys >> U64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=U64))

    def find(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, whether found)."""
        values, found = np.zeros(len(query), np.float32), np.zeros(len(query), bool)
        bucket = (query >> U64(64 - self.bits)).astype(np.int64)
        at, end = self.begin[bucket], self.begin[bucket + 1]
        left = np.flatnonzero(at < end)
        at, end, query = at[left], end[left], query[left]
        while len(left):
            key = self.keys[at]
            hit = key == query
            values[left[hit]] = self.values[at[hit]]
            found[left[hit]] = True
            at = at + 1
            go = ~hit & (key < query) & (at < end)
            left, at, end, query = left[go], at[go], end[go], query[go]
        return values, found


class Model:
    def __init__(self, probabilities: HashArray, weights: HashArray):
        self.probabilities, self.weights = probabilities, weights

    def log_probabilities(self, lang: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sum of log-probabilities, number of characters) of every normalised text."""
        points, begin, row = _points(texts)
        points = points.astype(U64)
        salt = _salt(lang)
        total = np.zeros(len(begin))
        left = np.arange(len(begin))
        for size in range(ORDER, 0, -1):
            first = begin[left] + (ORDER - size)
            values, found = self.probabilities.find(gram_hashes(points, first, size, salt))
            total[left[found]] += values[found]
            left, first = left[~found], first[~found]
            if not len(left):
                break
            values, found = self.weights.find(gram_hashes(points, first, size - 1, salt))
            total[left] += np.where(found, values, 0.0 if size > 1 else np.log(1e-7))
        return np.bincount(row, weights=total, minlength=len(texts)), np.bincount(row, minlength=len(texts))


def load(probabilities: DataFrame, weights: DataFrame) -> Model | None:
    """The model as sorted hash arrays, or None if it has more than MODEL_ROWS entries."""

    def hashed(batches):
        for batch in batches:
            langs = np.array([_salt(x) for x in batch.column(0).to_pylist()], U64)
            grams = batch.column(1).to_pylist()
            sizes = np.fromiter(map(len, grams), np.int64, len(grams))
            points = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
            first = np.cumsum(sizes) - sizes
            h = np.zeros(len(grams), U64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                own = np.zeros(len(at), U64)
                for k in range(size):
                    own = own * _BASE + points[first[at] + k] + U64(1)
                h[at] = mix((own * U64(8) + U64(size)) ^ langs[at])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(2).cast(pa.float32())], ["h", "v"])

    if probabilities.count() + weights.count() > MODEL_ROWS:
        return None
    arrays = []
    for table in (probabilities, weights):
        got = table.mapInArrow(hashed, "h bigint, v float").toArrow()
        arrays.append(HashArray(got.column(0).to_numpy().view(U64), got.column(1).to_numpy()))
    return Model(*arrays)


def _word_key(lang: str | None, text: str | None) -> int:
    return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass"), seed=xxhash.xxh32_intdigest(lang or "")) - (1 << 63)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers as one zstandard frame, byte by byte of their places, behind their sizes."""
    head = np.array([x for a in arrays for x in (a.itemsize, len(a))], np.int64)
    planes = [(a >> a.dtype.type(8 * k)).astype(np.uint8).tobytes() for a in arrays for k in range(a.itemsize)]
    return len(arrays).to_bytes(8, "little") + head.tobytes() + zstandard.compress(b"".join(planes), 1)


def _unpack(data: bytes) -> list[np.ndarray]:
    count = int.from_bytes(data[:8], "little")
    head = np.frombuffer(data, np.int64, 2 * count, 8).reshape(count, 2)
    raw = np.frombuffer(zstandard.decompress(data[8 + 16 * count :]), np.uint8)
    out, at = [], 0
    for size, n in head.tolist():
        own = np.zeros(n, f"u{size}")
        for k in range(size):
            place = raw[at : at + n]
            at += n
            if place.any():
                own |= place.astype(own.dtype) << own.dtype.type(8 * k)
        out.append(own)
    return out


def _dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of every key among the different ones in ascending order, their counts, a place of each)."""
    order = np.argsort(key)
    own = key[order]
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    number = np.empty(len(own), np.int64)
    number[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return number, np.diff(np.append(first, len(own))), order[first]


def _tokens(batches):
    """Texts as word numbers, CHUNK words or a little more to a row. A word's hash depends on its language; a hash of the
    language alone stands before a text's first word. (n, data): words, and by _pack the hashes, their counts and
    languages, the texts' keys, languages and sizes, the words, and how often each is in its text."""
    held("quality words")
    waiting: list[tuple] = []
    have = 0

    def row():
        keys, spaces, sizes, h = (np.concatenate(x) for x in zip(*waiting))
        text = np.repeat(np.arange(len(sizes)), sizes)
        number, counts, place = _dense(h)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        number, place = rank[number], place[order]
        pair, often, _ = _dense(text * len(order) + number)
        space, of = np.unique(spaces, return_inverse=True)
        of = of.astype(np.uint32)
        run = np.repeat(len(order) + of, sizes + 2)  # two blanks before a text
        run[np.arange(len(h)) + 2 * (text + 1)] = number
        data = _pack(h[place], counts[order].astype(np.uint32), of[text[place]], space, keys, sizes.astype(np.uint32), run.astype(np.uint32), often[pair].astype(np.uint32))
        return pa.RecordBatch.from_arrays([pa.array([len(h)], pa.int64()), pa.array([data], pa.binary())], ["n", "data"])

    for batch in batches:
        langs = batch.column(0).to_pylist()
        for low, texts in _runs(batch, 1):
            plain = [(lang, t, normal(t)) for lang, t in zip(langs[low:], texts)]
            plain = [x for x in plain if x[2]]
            if not plain:
                continue
            words = Words(*string_buffers(pa.array([x[2] for x in plain], pa.large_string())))
            spaces = mix(np.array([_salt(lang or "") for lang, _, _ in plain], U64))
            keys = np.array([_word_key(lang, t) for lang, t, _ in plain], np.int64).view(U64)
            waiting.append((keys, spaces, words.count, mix(words.hashes() * _BASE + spaces[words.row])))
            have += len(words.row)
            if have >= CHUNK:
                yield row()
                waiting, have = [], 0
    if waiting:
        yield row()


def _vocabulary(batches):
    for batch in batches:
        for data in batch.column(0):
            h, n, of, spaces, *_ = _unpack(data.as_py())
            space = spaces[of]
            for low in range(0, len(h), 100_000):
                part = slice(low, low + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(h[part].view(np.int64)), pa.array(space[part].view(np.int64)), pa.array(n[part].astype(np.int64))], ["gram1", "space", "n"])


def _share_of(h: np.ndarray) -> np.ndarray:
    """The pass that works off the n-grams with this word next to last."""
    return mix(h + U64(0x5151)) % U64(PASSES)


def _pairs(b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(mix(b * _BASE + U64(2)) * _BASE + c)


def _placed(data: bytes, share: int):
    """What a row of _tokens has for a pass: (hashes, keys, sizes; of every place its text, word before the last, last
    word before it, word, and how often the text has that word), words as places among the hashes."""
    h, _, _, pads, keys, sizes, run, often = _unpack(data)
    known = len(h)
    h = np.concatenate([h, pads])
    at = np.flatnonzero((_share_of(h) == U64(share))[run[:-1]]) + 1
    at = at[run[at] < known]
    text = np.searchsorted(np.cumsum(sizes.astype(np.int64) + 2), at, side="right")
    a, b, c = (run[at - k].astype(np.int64) for k in (2, 1, 0))
    return h, keys, sizes, text, a, b, c, often[at - 2 * (text + 1)]


def _deal(share: int, groups: int, hot: np.ndarray):
    """(q, data): the different trigrams of every text, for the group of the word next to last; of a hot word for
    groups of both words before the last."""

    def run(batches):
        for batch in batches:
            for row in batch.column(0):
                h, keys, sizes, text, a, b, c, often = _placed(row.as_py(), share)
                if not len(text):
                    continue
                n = len(h)
                tb, around2, _ = _dense(text * n + b)
                tbc, own2, _ = _dense(tb * n + c)
                tba, around3, _ = _dense(tb * n + a)
                _, own3, first = _dense(tba * n + c)
                columns = [own3, around3[tba[first]], own2[tbc[first]], around2[tb[first]], often[first]]
                text, a, b, c = text[first], a[first], b[first], c[first]
                q = mix(h[b] + np.where(np.isin(h, hot)[b], mix(h[a]), U64(0))) % U64(groups)
                order = np.argsort(q, kind="stable")
                q = q[order]
                edges = np.append(np.flatnonzero(np.append(True, q[1:] != q[:-1])), len(q))
                number, out, names = np.zeros(n, np.uint32), [], []
                for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    own = order[low:high]
                    words = np.sort(np.concatenate([a[own], b[own], c[own]]))
                    words = words[np.append(True, words[1:] != words[:-1])]
                    number[words] = np.arange(len(words))
                    next_text = np.diff(text[own], prepend=-1) > 0  # in ascending order within a group
                    texts = text[own][next_text]
                    next_text[0] = False
                    out.append(_pack(h[words], keys[texts], sizes[texts], next_text.astype(np.uint32), *[number[x[own]] for x in (a, b, c)], *[x[own].astype(np.uint32) for x in columns]))
                    names.append(int(q[low]))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(out, pa.binary())], ["q", "data"])

    return run


def _hot_pairs(share: int, hot: np.ndarray):
    """(gram2, context, n): the bigrams that begin with a hot word, each once for a row of _tokens."""

    def run(batches):
        for batch in batches:
            for row in batch.column(0):
                h, _, _, _, _, b, c, _ = _placed(row.as_py(), share)
                own = np.flatnonzero(np.isin(h, hot)[b])
                b, c = b[own], c[own]
                _, n, first = _dense(b * len(h) + c)
                b, c = h[b[first]], h[c[first]]
                yield pa.RecordBatch.from_arrays([pa.array(_pairs(b, c).view(np.int64)), pa.array(b.view(np.int64)), pa.array(n.astype(np.int64))], ["gram2", "context", "n"])

    return run


#: level 0: the sum of n * log-probability so far over n places; 1 and 2: places whose n-gram of that size is to be looked up.
_PARTS = "key bigint, level int, n bigint, v double, copies bigint, gram2 bigint, own2 bigint, around2 bigint, gram1 bigint, own1 bigint, around1 bigint"


def _score(hot: np.ndarray):
    def scored(rows: list[bytes]):
        parts = [_unpack(x) for x in rows]
        texts = np.concatenate([[0], np.cumsum([len(p[1]) for p in parts])])
        keys, sizes = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        text = np.concatenate([np.cumsum(p[3].astype(np.int64)) + low for p, low in zip(parts, texts)])
        a, b, c = (np.concatenate([p[0][p[k]] for p in parts]) for k in (4, 5, 6))
        own3, around3, own2, around2, own1 = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(7, 12))
        del parts
        # Copies of a text have the same n-grams, so each of them is in this group.
        same, many, _ = _dense(keys)
        copies = many[same][text]

        def level(gram, context, own, around):
            """(others > 0, log-probability if so, else what backing off costs)."""
            number, _, first = _dense(gram)
            group, _, _ = _dense(context)
            others = np.bincount(number, weights=own3)[number] - copies * own
            room = np.bincount(group, weights=own3)[group] - copies * around
            types = np.bincount(group[first])[group]
            seen = others > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                return seen, np.where(seen, np.log((others - DISCOUNT) / room), np.where(room > 0, np.log(DISCOUNT * np.minimum(types, room) / room), 0.0))

        before = _pairs(a, b)
        seen, v = level(_pairs(before, c), before, own3, around3)
        pair, far = _pairs(b, c), np.isin(b, hot)
        seen2, v2 = level(pair, b, own2, around2)
        v += np.where(seen | far, 0.0, v2)
        size = len(keys)
        yield _part(keys, 0, np.bincount(text, own3, size), np.bincount(text, own3 * v, size))
        for k, left in ((1, np.flatnonzero(~seen & ~far & ~seen2)), (2, np.flatnonzero(~seen & far))):
            for low in range(0, len(left), 100_000):
                at = left[low : low + 100_000]
                t = text[at]
                two = (pair[at], own2[at], around2[at]) if k == 2 else ()
                yield _part(keys[t], k, own3[at], None, copies[at], two, (c[at], own1[at], sizes[t]))

    def run(batches):
        held("quality words")
        q, rows = None, []
        for batch in batches:
            for own, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if own != q and rows:
                    yield from scored(rows)
                    rows = []
                q = own
                rows.append(data.as_py())
        if rows:
            yield from scored(rows)

    return run


def _part(key, level, n, v, copies=None, two=(), one=()):
    def whole(x):
        return pa.nulls(len(key), pa.int64()) if x is None else pa.array(x.view(np.int64) if x.dtype == U64 else x.astype(np.int64))

    v = pa.nulls(len(key), pa.float64()) if v is None else pa.array(v)
    columns = [whole(key), pa.array(np.full(len(key), level, np.int32)), whole(n), v, *[whole(x) for x in (copies, *(two or (None,) * 3), *(one or (None,) * 3))]]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _PARTS.split(", ")])


def _looked_up(left: DataFrame, k: int) -> DataFrame:
    """The rows of left, joined to a model, with seen, and v: the log-probability if so, else what backing off costs."""
    others, room = F.col("total") - F.col("copies") * F.col(f"own{k}"), F.col("context_total") - F.col("copies") * F.col(f"around{k}")
    below = F.when(room > 0, F.log(DISCOUNT * F.least("types", room) / room)).otherwise(0.0)
    if k == 1:  # an unseen word gets a like share of what the discounts free
        below = below - F.log(F.col("types") + 1)
    return left.withColumn("v", F.col("n") * F.coalesce(F.when(others > 0, F.log((others - DISCOUNT) / room)), below)).withColumn("seen", others > 0)


def word_scores(docs: DataFrame) -> DataFrame:
    """(key, word_logp): the mean log-probability of the words of every text, without what it and its exact copies count.

    The texts are kept as word numbers, and their trigrams are worked off in PASSES by the word next to last, so that only a
    share of them is on disk at a time. All that two levels ask of a trigram, counts of (a, b, c), (a, b), (b, c) and b,
    stands in the group of b. A word with more than HOT occurrences is dealt to groups by (a, b), which have the
    first two; its bigrams are counted and joined by themselves, so no word fills a task. Single words are joined.
    """
    tokens = materialize(docs.select("lang", "text").mapInArrow(_tokens, "n bigint, data binary"), "word-tokens")
    data = tokens.select("data")
    words = materialize(data.mapInArrow(_vocabulary, "gram1 bigint, space bigint, n bigint").groupBy("gram1", "space").agg(F.sum("n").alias("total")), "words", TOKEN_ROWS)
    spaces = materialize(words.groupBy("space").agg(F.sum("total").alias("context_total"), F.count("*").alias("types")), "word-spaces")
    model = materialize(join_sized(words, spaces, "space", "inner", 32).drop("space"), "word-model")
    hot = np.array([r[0] for r in model.where(F.col("total") > HOT).select("gram1").collect()], np.int64).view(U64)  # all words / HOT at most
    groups = max(1, -(-(tokens.agg(F.sum("n")).first()[0] or 0) // (PASSES * GROUP)))
    discard(words, spaces)
    sums, parts, left, spent = [], [], [], []
    for share in range(PASSES):
        dealt = data.mapInArrow(_deal(share, groups, hot), "q bigint, data binary").repartition(groups, "q").sortWithinPartitions("q")
        out = materialize(dealt.mapInArrow(_score(hot), _PARTS), "word-parts", TOKEN_ROWS)
        parts.append(out.where("level = 0").select("key", "n", "v"))
        left.append(out.where("level = 1").drop("v"))
        spent.append(out)
        if len(hot):
            pairs = materialize(data.mapInArrow(_hot_pairs(share, hot), "gram2 bigint, context bigint, n bigint").groupBy("gram2", "context").agg(F.sum("n").alias("total")), "word-pairs", TOKEN_ROWS)
            around = materialize(pairs.groupBy("context").agg(F.sum("total").alias("context_total"), F.count("*").alias("types")), "word-contexts")
            pairs2 = materialize(join_sized(pairs, around, "context", "inner", 32).drop("context"), "word-pair-model")
            met = materialize(_looked_up(join_sized(out.where("level = 2").drop("v"), pairs2, "gram2", "inner", 40), 2).drop("total", "context_total", "types"), "word-pairs-met")
            parts.append(met.select("key", F.lit(0).cast("bigint").alias("n"), "v"))
            left.append(met.where("not seen").drop("seen", "v"))
            discard(pairs, around, pairs2)
            spent.append(met)
        if share % LOOK_UP == LOOK_UP - 1 or share == PASSES - 1:
            met = _looked_up(join_sized(_union(left).select("key", "n", "copies", "gram1", "own1", "around1"), model, "gram1", "inner", 160), 1)
            parts.append(met.select("key", F.lit(0).cast("bigint").alias("n"), "v"))
            sums.append(materialize(_union(parts).groupBy("key").agg(F.sum("n").alias("n"), F.sum("v").alias("v")), "word-sums"))
            discard(*spent)
            parts, left, spent = [], [], []
    scores = materialize(_union(sums).groupBy("key").agg((F.sum("v") / F.sum("n")).alias("word_logp")), "word-scores")
    discard(tokens, model, *sums)
    return scores


def _per_row(marks: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marks)])
    return total[edges[1:]] - total[edges[:-1]]


def _repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of its key in order of place, one of several) for every key."""
    order = np.argsort(key, kind="stable")
    own = key[order]
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    first, several = np.zeros(len(own), bool), np.zeros(len(own), bool)
    first[order] = new
    several[order] = ~new
    several[order[:-1]] |= ~new[1:]
    return first, several


def base_counts(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every text."""
    words = Words(raw, offsets)
    solid = (raw != 32) & ((raw - np.uint8(9)) > 4)
    rows = np.arange(words.rows)
    out = {"n_words": words.count, "word_chars": _per_row(solid & ((raw & 0xC0) != 0x80), offsets), "n_symbols": _per_row(_symbol[raw], offsets)}
    filled = offsets[:-1] < offsets[1:]
    cut = np.flatnonzero(raw == 10)
    start = np.concatenate([offsets[:-1][filled], cut + 1])
    row = np.concatenate([rows[filled], np.searchsorted(offsets, cut, side="right") - 1])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    end = np.append(start[1:] - 1, len(raw))
    last = np.append(row[1:] != row[:-1], True)
    end[last] = offsets[row[last] + 1]
    seen = np.concatenate([[0], np.cumsum(solid)])
    worded = seen[np.maximum(end, start)] > seen[start]
    start, end, row = start[worded], end[worded], row[worded]
    first, _ = _repeats(mix(span_hashes(raw, start, end) ^ mix(row.astype(U64))))
    out["n_dup_lines"] = np.bincount(row[~first], minlength=words.rows)
    h = words.hashes()
    n = len(h) - WINDOW + 1
    cover = np.zeros(len(h) + 1, np.int64)
    if n > 0:
        window = h[:n].copy()
        for k in range(1, WINDOW):
            window *= U64(0xD6E8FEB86659FD93)
            window += h[k : n + k]
        at = np.flatnonzero(words.row[:n] == words.row[WINDOW - 1 :])
        _, several = _repeats(mix(window[at] ^ mix(words.row[at].astype(U64) + U64(0x1234567))))
        at = at[several]
        cover[: n] += np.bincount(at, minlength=n)[:n]
        cover[WINDOW : n + WINDOW] -= np.bincount(at, minlength=n)[:n]
    out["n_repeat_words"] = _per_row((np.cumsum(cover)[:-1] > 0) if len(h) else np.zeros(0, bool), words.first)
    return out


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measure(shared):
    def run(batches):
        own = shared.value if shared is not None else None
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for low, texts in _runs(batch, 2):
                raw, offsets = string_buffers(batch.column(2).slice(low, len(texts)))
                counts = base_counts(raw, offsets)
                plain = [normal(t) for t in texts]
                total, size = np.zeros(len(texts)), np.array([len(t) for t in plain], np.int64)
                if own is not None:
                    by: dict[str, list[int]] = {}
                    for at, lang in enumerate(langs[low : low + len(texts)]):
                        by.setdefault(lang or "", []).append(at)
                    for lang, rows in by.items():
                        total[rows] = own.log_probabilities(lang, [plain[r] for r in rows])[0]
                key = np.array([xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "surrogatepass")) - (1 << 63) for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, len(texts)), batch.column(1).slice(low, len(texts)), pa.array(key), *[pa.array(counts[c].astype(np.int64)) for c in _COUNTS], pa.array(size), pa.array(total), pa.array([_word_key(lang, t) for lang, t in zip(langs[low:], texts)], pa.int64())],
                    ["doc_id", "lang", "key", *_COUNTS, "size", "logp", "word_key"],
                )

    return run


def _grams_of(batches):
    """(key, lang, gram, n): a text's distinct top n-grams, for scoring by joins."""
    for batch in batches:
        for lang, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = value.as_py()
            key = xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass")) - (1 << 63)
            for part in _plainly(lang or "", normal(text)):
                yield pa.RecordBatch.from_arrays([pa.array([key] * part.num_rows, pa.int64()), *part.columns], ["key", "lang", "gram", "n"])


def score_by_joins(docs: DataFrame, probabilities: DataFrame, weights: DataFrame) -> DataFrame:
    """(key, lang, logp) of every distinct text, where the model is too large to broadcast."""
    left = docs.select("lang", "text").distinct().mapInArrow(_grams_of, "key bigint, lang string, gram string, n bigint").withColumn("sum", F.lit(0.0))
    parts, spent = [], []
    for size in range(ORDER, 0, -1):
        joined = materialize(left.join(probabilities, ["lang", "gram"], "left"), f"joined{size}")
        spent.append(joined)
        parts.append(joined.where("logp is not null").select("key", "lang", (F.col("n") * (F.col("sum") + F.col("logp"))).alias("v")))
        missed = joined.where("logp is null").drop("logp").withColumn("context", F.expr(f"substring(gram, 1, {size - 1})"))
        missed = missed.join(weights.select("lang", F.col("gram").alias("context"), "logw"), ["lang", "context"], "left")
        left = missed.select("key", "lang", F.expr(f"substring(gram, 2, {size - 1})").alias("gram"), "n", (F.col("sum") + F.coalesce("logw", F.lit(0.0 if size > 1 else float(np.log(1e-7))))).alias("sum"))
    parts.append(left.select("key", "lang", (F.col("n") * F.col("sum")).alias("v")))
    scores = materialize(_union(parts).groupBy("key", "lang").agg(F.sum("v").alias("logp")), "scores")
    discard(*spent)
    return scores


def quality(docs: DataFrame, upper: tuple[float, float] = UPPER, lower: tuple[float, float] = LOWER) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_ppl for every
    row of docs (doc_id, lang, text).

    kept is false if base_failed, or if the mean negative log-probability of the text's characters (log_ppl) leaves
    its language's band, or that of its words its band. Null and blank texts have no words, so they fail. A null lang is a language of its
    own. A language with no text that passes the plain rules has no band and rejects nothing more. Repeated
    rows get a row each. Four passes over the texts, which never move; what moves is n-gram counts, one
    small row for each document, and the different word trigrams of a document, packed, in PASSES shares.
    """
    docs = docs.select("doc_id", "lang", "text")
    probabilities, weights, kept = fit(docs)
    model = load(probabilities, weights)
    shared = docs.sparkSession.sparkContext.broadcast(model) if model is not None else None
    kind = docs.schema["doc_id"].dataType.simpleString()
    measured = docs.mapInArrow(_measure(shared), f"doc_id {kind}, lang string, key bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", size bigint, logp double, word_key bigint")
    if model is None:
        scores = score_by_joins(docs, probabilities, weights)
        measured = measured.drop("logp").withColumn("lang", F.coalesce("lang", F.lit(""))).join(scores, ["key", "lang"], "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    measured = materialize(measured.withColumn("lang", F.coalesce("lang", F.lit(""))).withColumn("base_failed", failed).withColumn("log_ppl", F.when(F.col("size") > 0, -F.col("logp") / F.col("size"))), "measured")
    discard(*kept, *([scores] if model is None else []))
    scores = word_scores(docs)
    words = scores.select(F.col("key").alias("word_key"), (-F.col("word_logp")).alias("word_ppl"))
    bare, measured = measured, materialize(join_sized(measured, words, "word_key", "left", 24), "scored")
    discard(bare, scores)
    sound = measured.where("not base_failed")
    both = ("log_ppl", "word_ppl")
    middle = materialize(sound.groupBy("lang").agg(*[F.percentile_approx(c, 0.5, 10_000).alias(f"{c}_middle") for c in both]), "middle")
    apart = join_sized(sound, middle, "lang", "inner", 64)
    spread = apart.groupBy("lang").agg(*[x for c in both for x in (F.percentile_approx(F.abs(F.col(c) - F.col(f"{c}_middle")), 0.5, 10_000).alias(f"{c}_mad"), F.first(f"{c}_middle").alias(f"{c}_middle"))])
    bands = join_sized(measured, materialize(spread, "bands"), "lang", "left", 96)
    deviation, off = ({c: f(c) for c in both} for f in (lambda c: 1.4826 * F.col(f"{c}_mad"), lambda c: F.col(c) - F.col(f"{c}_middle")))
    high = off["log_ppl"] > upper[0] * deviation["log_ppl"] + upper[1] / F.sqrt("size")
    low = -off["log_ppl"] > lower[0] * deviation["log_ppl"] + lower[1] / F.sqrt("size")
    jumbled = off["word_ppl"] > WORD_UPPER[0] * deviation["word_ppl"] + WORD_UPPER[1] / F.sqrt("n_words")
    outside = F.coalesce(high | low, F.lit(False)) | F.coalesce(jumbled, F.lit(False))
    return bands.select("doc_id", *_COUNTS, "base_failed", (~F.col("base_failed") & ~outside).alias("kept"), "log_ppl")
