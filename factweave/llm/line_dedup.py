"""Fuzzy line deduplication: SimHash of normalised lines, pigeonhole block join, edit-similarity check.

A line is normalised (lower case, digits as 0, single blanks) and takes part if it has MIN_WORDS words.
Equal normalised lines are one line. Two different lines are linked if their 64-bit SimHashes over words
differ in at most BITS bits and their edit similarity, 1 - distance / longer length, is at least SIMILAR.
With the bits in five blocks, two hashes at most three bits apart agree in two blocks at least; so a join
on the ten pairs of blocks (25 or 26 bits each) finds every such pair. Of each connected group of lines the first
occurrence, by (doc_id, line number), stays; all others are taken out.

That reading of the method misses most lines that are alike, so the query and the pipeline ask for `every`: all lines
that are not blank take part, and lines of any script are linked by edit similarity alone. Candidates share a key:

* lines of 9 to 19 characters (one edit at most): the line itself or it less one character, which finds every pair;
* longer lines: TABLES keys of 64 bits, among lines of one class of lengths (a line that may be alike to one of the
  next class has keys there too). A key joins a minimum hash over the character n-grams of each of PARTS equal
  parts of the line (SHORT_PARTS under SHORT characters), so lines that only have a long passage in common rarely share
  one. In the classes of long lines a part of the n-grams that their hashes choose stands for all.

A pair is compared unless its lengths rule it out or, over SHORT characters, more than NEAR of 32 minimum hashes differ in
two bits; pairs of one bucket also not if their counts of neighbouring characters prove too many edits. As a key asks all parts of a line to agree, the pairs to compare do not grow with the square of the lines.

Lines under 9 characters are alike only if equal.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import by_bucket, clusters, linked_within
from .storage import discard, held, join_sized, materialize
from .textkernel import U64, Words, mix

MIN_WORDS = 5
BITS = 3
SIMILAR = 0.9
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
#: Set by the share of alike pairs of sf0.1 that meet (see README).
TABLES, PARTS, SHORT_PARTS, NEAR = 12, 4, 2, 16
#: Least lengths of the classes of lines. The first, under SHORT characters, has shorter n-grams.
EDGES = np.array([20, 40, *(int(60 * 1.5**i) for i in range(40))])
SHORT = 40
GRAM, SHORT_GRAM = 6, 4
#: One n-gram in 2^LEVEL counts, so that 80 are left of the shortest line of a class; of parts with fewer than FEW left, all.
LEVEL = np.maximum(0, np.floor(np.log2(EDGES / 80))).astype(np.int64)
FEW = 5
#: Characters of text worked on at a time.
SLICE = 1 << 18

_digit = re.compile(r"\d")
_STEP = np.array(0x9E3779B97F4A7C15, U64)
_LANES = np.array([0, 1, 1 << 32, (1 << 32) + 1], U64)


def normal(line: str) -> str:
    return _digit.sub("0", " ".join(line.lower().split()))


def simhash(lines: list[bytes]) -> np.ndarray:
    """64 bits for every line (of one word at least): a bit is set if most words' hashes have it.

    Words count by length (in bytes: 1 up to three, then 2 more for each of nine), or the few short words that fill
    every line would give unlike lines like bits.
    """
    raw = np.frombuffer(b"\n".join(lines), np.uint8)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    offsets[-1] = len(raw)
    words = Words(raw, offsets)
    h = words.hashes()
    first = words.first[:-1]
    weight = (1 + 2 * np.clip(words.end - words.start - 3, 0, 9)).astype(U64)
    half = np.add.reduceat(weight, first).astype(np.int64) // 2
    out = np.zeros(len(lines), U64)
    for bit in range(0, 64, 2):
        two = np.add.reduceat(_LANES[((h >> U64(bit)) & U64(3)).astype(np.intp)] * weight, first)
        out |= ((two & U64(0xFFFFFFFF)).astype(np.int64) > half).astype(U64) << U64(bit)
        out |= ((two >> U64(32)).astype(np.int64) > half).astype(U64) << U64(bit + 1)
    return out


_draw = np.random.default_rng(20)
_TIMES, _PLUS = (_draw.integers(0, 1 << 32, TABLES, dtype=np.uint64).astype(np.uint32) | np.uint32(1) for _ in range(2))


def _minima(lines: list[str], gram: int, level: np.ndarray, parts: int) -> np.ndarray:
    """(lines, TABLES, parts) minimum hashes over the character n-grams of every part of the lines, each of gram + parts
    characters at least."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    n = len(points) - gram + 1
    two = points[:-1] * _STEP + points[1:]  # n-grams are of even length
    h = two[:n] + _STEP
    for k in range(2, gram, 2):
        h *= _STEP * _STEP
        h += two[k : n + k]
    whole = np.ones(len(points), bool)
    for k in range(1, gram):
        whole[np.cumsum(sizes) - k] = False
    h = mix(h[whole[:n]])
    ends = (sizes - gram + 1)[:, None] * np.arange(1, parts + 1) // parts
    many = np.diff(ends, axis=1, prepend=0).ravel()
    first = np.cumsum(many) - many
    if level.any():
        mask = np.repeat((U64(1) << np.repeat(level, parts).astype(U64)) - U64(1), many)
        use = (h & mask) == 0
        left = np.add.reduceat(use, first, dtype=np.int64)
        if (few := left < FEW).any():
            use |= np.repeat(few, many)
            left = np.where(few, many, left)
        h, first = h[use], np.cumsum(left) - left
    low, high = h.astype(np.uint32), (h >> U64(32)).astype(np.uint32)
    out = np.empty((len(lines), TABLES, parts), np.uint32)
    for k in range(TABLES):
        out[:, k] = np.minimum.reduceat(low * _TIMES[k] + high * _PLUS[k], first).reshape(-1, parts)
    return out


def candidate_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(two bits of 32 minimum hashes, 0 under SHORT; level of its class; number of keys) of every normalised line, and all
    its keys, line by line."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    own, over = (np.searchsorted(EDGES, n, side="right") - 1 for n in (size, (size / SIMILAR + 1e-9).astype(np.int64)))
    sim = np.zeros(len(lines), U64)
    owners, keys = [], []
    for at in np.flatnonzero((size >= 9) & (own < 0)):
        line = lines[at]
        cuts = {line, *(line[:i] + line[i + 1 :] for i in range(len(line)))}
        owners.append(np.full(len(cuts), at))
        keys.append(np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in cuts], U64))
    both = np.concatenate([np.arange(len(lines)), np.flatnonzero(over > own)])
    cls = np.concatenate([own, over[over > own]])
    for gram, parts, chosen in ((SHORT_GRAM, SHORT_PARTS, cls == 0), (GRAM, PARTS, cls > 0)):
        at, c = both[chosen], cls[chosen]
        if not len(at):
            continue
        found = _minima([lines[i] for i in at.tolist()], gram, LEVEL[c], parts)
        if gram == GRAM:
            mine = c == own[at]
            bits = (found[mine].reshape(-1, TABLES * parts)[:, :32] * np.uint32(0x9E3779B1) >> np.uint32(30)).astype(U64)
            sim[at[mine]] = np.bitwise_or.reduce(bits << (U64(2) * np.arange(32, dtype=U64)), axis=1)
        h = np.arange(TABLES, dtype=U64) + (U64(1000) * c.astype(U64))[:, None]
        for r in range(parts):
            h = mix(h * U64(31) + found[:, :, r])
        owners.append(np.repeat(at, TABLES))
        keys.append(h.ravel())
    if not keys:
        return sim, np.zeros(len(lines), np.int64), np.zeros(len(lines), np.int64), np.zeros(0, U64)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return sim, LEVEL[np.maximum(own, 0)], np.bincount(owner, minlength=len(lines)), np.concatenate(keys)[order]


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or most + 1 if it is larger; bit-parallel, after common ends are cut off."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    low = 0
    short = min(len(a), len(b))
    while low < short and a[low] == b[low]:
        low += 1
    high = 0
    while high < short - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for done, c in enumerate(b, 1):
        eq = at.get(c, 0)
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(zero | plus)), plus & zero
        score += bool(up & top) - bool(down & top)
        if score - (len(b) - done) > most:
            return most + 1
        up, down = (up << 1 | 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(zero | up)), up & zero
    return score


def alike(a: str, b: str, similar: float = SIMILAR) -> bool:
    longer = max(len(a), len(b))
    most = int((1 - similar) * longer + 1e-9)
    return edit_distance(a, b, most) <= most


#: Pairs for each word of a band's width from which on working side by side pays.
BESIDE = 40
#: Edits for which a band of one word is wide enough; pairs that may have more are tried with these first.
NARROW = 31
#: Pairs side by side, and characters of them.
ROWS, CELLS = 1024, 1 << 21


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _banded(longer: list[str], shorter: list[str], most: np.ndarray, width: int) -> np.ndarray:
    """Whether the distance of every pair is at most `most`, by a bit-parallel band that goes down the diagonals of all
    pairs at once. Each longer text has more than `most` characters, at most that many more than the shorter, and
    2 most + 1 fits into width words of 64 bits."""
    bits, pairs = 64 * width, len(longer)
    m, n = (np.fromiter(map(len, x), np.int64, pairs) for x in (longer, shorter))
    order = np.argsort(-n, kind="stable")
    m, n, most = m[order], n[order], most[order]
    steps = int(n[0])
    # Row r holds the longer text from column bits - most - 1 on, so that columns i to i + bits are step i's band.
    across = np.zeros((pairs, bits + steps), np.uint32)
    down = np.zeros((pairs, steps), np.uint32)
    for r, at in enumerate(order.tolist()):
        text = np.frombuffer(longer[at].encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
        begin = bits - int(most[r]) - 1
        across[r, begin : begin + m[r]] = text[: steps + bits - begin]
        down[r, : n[r]] = np.frombuffer(shorter[at].encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
    top = bits - 1 - most
    word, full = np.arange(width), ~U64(0)
    plus = np.where(word * 64 >= top[:, None], full, np.where((word + 1) * 64 <= top[:, None], U64(0), full << (top % 64).astype(U64)[:, None]))
    plus, minus = [plus[:, w].copy() for w in range(width)], [np.zeros(pairs, U64) for _ in range(width)]
    score, turn = most.copy(), m - most
    early = int(turn.min())
    ends = np.searchsorted(-n, -np.arange(steps), side="left")  # rows of more than i characters come first
    for i in range(steps):
        live = int(ends[i])
        if live < len(plus[0]):
            plus, minus = [x[:live] for x in plus], [x[:live] for x in minus]
        same = np.packbits(across[:live, i : i + bits] == down[:live, i : i + 1], axis=1, bitorder="little").view(U64)
        zero, up, low, carry = [], [], [], None
        for w in range(width):
            eq, p, v = same[:, w], plus[w], minus[w]
            part = eq & p
            total = part + p
            over = total < p
            if carry is not None:
                total += carry
                over |= total < carry
            carry = over.astype(U64)
            d = (total ^ p) | eq | v
            zero.append(d)
            up.append(v | ~(d | p))
            low.append(d & p)
        if i < early:
            score[:live] += 1 - (zero[-1] >> U64(63)).astype(np.int64)
        else:
            score[:live] += _last_row(i, turn[:live], bits, zero, up, low)
        for w in range(width):
            down_shift = zero[w] >> U64(1)
            if w + 1 < width:
                down_shift |= zero[w + 1] << U64(63)
            plus[w], minus[w] = low[w] | ~(down_shift | up[w]), down_shift & up[w]
    out = np.empty(pairs, bool)
    out[order] = score <= most
    return out


def _last_row(i: int, turn: np.ndarray, bits: int, zero: list, up: list, low: list) -> np.ndarray:
    """What step i adds to the score: along the band's last diagonal, then along the last row."""
    going = turn > i
    place = np.where(going, bits - 1, bits - 2 - (i - turn))
    at, shift, row = place // 64, (place % 64).astype(U64), np.arange(len(turn))

    def bit(words):
        return ((np.stack(words)[at, row] >> shift) & U64(1)).astype(np.int64)

    return np.where(going, 1 - bit(zero), bit(up) - bit(low))


#: Hash classes of two neighbouring characters; how often each occurs is a line's profile.
PROFILE = 256


def _profiles(lines: list[str]) -> np.ndarray:
    """(lines, PROFILE) numbers of neighbouring characters by hash class."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    row = np.repeat(np.arange(len(lines)), np.fromiter(map(len, lines), np.int64, len(lines)))
    h = (mix(points[:-1] * U64(0x9E3779B97F4A7C15) + points[1:]) % U64(PROFILE)).astype(np.int64)
    inside = row[1:] == row[:-1]
    counts = np.bincount((row[1:] * PROFILE + h)[inside], minlength=len(lines) * PROFILE).reshape(len(lines), PROFILE)
    return np.minimum(counts, 32_767).astype(np.int16)  # a lower count shows no more than the true one


def _may_be(profiles: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """False where the profiles of lines i and j show a distance over most: an edit takes away at most two pairs of
    neighbours and puts two in their place."""
    out = np.empty(len(most), bool)
    for low in range(0, len(most), 2048):
        part = slice(low, low + 2048)
        out[part] = np.abs(profiles[i[part]] - profiles[j[part]]).sum(axis=1, dtype=np.int64) <= 4 * most[part]
    return out


def alike_pairs(a: list[str], b: list[str], similar: float = SIMILAR) -> np.ndarray:
    """alike() of every pair, many at once. Most alike lines differ in far fewer places than they may: a band for NARROW
    edits finds them, and only those it leaves open are taken through the band of all the edits they may have."""
    out = np.zeros(len(a), bool)
    narrow: list[tuple[int, str, str, int]] = []
    open_: list[tuple[int, str, str, int]] = []
    for at, (x, y) in enumerate(zip(a, b)):
        if len(x) < len(y):
            x, y = y, x
        most = int((1 - similar) * len(x) + 1e-9)
        if len(x) - len(y) > most:
            continue
        low = _common(x, y)
        x, y = x[low:], y[low:]
        high = _common(x[::-1], y[::-1])
        x, y = x[: len(x) - high], y[: len(y) - high]
        if len(x) <= most:
            out[at] = True
        else:
            (narrow if len(x) - len(y) <= NARROW else open_).append((at, x, y, most))
    _compare([(at, x, y, min(most, NARROW)) for at, x, y, most in narrow], 1, out)
    open_ += [row for row in narrow if row[3] > NARROW and not out[row[0]]]
    waiting: dict[int, list[tuple[int, str, str, int]]] = {}
    for low in range(0, len(open_), 256):
        part = open_[low : low + 256]
        here = np.arange(len(part))
        profiles = _profiles([y for row in part for y in row[1:3]])
        for row, may in zip(part, _may_be(profiles, 2 * here, 2 * here + 1, np.array([row[3] for row in part]))):
            if may:
                waiting.setdefault((2 * row[3] + 1) // 64 + 1, []).append(row)
    for width, rows in waiting.items():
        _compare(rows, width, out)
    return out


def _compare(rows: list[tuple[int, str, str, int]], width: int, out: np.ndarray) -> None:
    """Sets out[at] of every (at, longer, shorter, most) whose distance is at most `most`."""
    rows = sorted(rows, key=lambda r: -len(r[1]))
    low = 0
    while low < len(rows):
        part = rows[low : low + max(1, min(ROWS, CELLS // (len(rows[low][1]) + 64 * width)))]
        low += len(part)
        if len(part) < BESIDE * width:
            for at, x, y, most in part:
                out[at] = edit_distance(x, y, most) <= most
        else:
            out[[r[0] for r in part]] = _banded([r[1] for r in part], [r[2] for r in part], np.array([r[3] for r in part]), width)


def _lines(text: str | None, least: int) -> list[tuple[int, str]]:
    """(line number, normalised line) of the lines that take part."""
    lines = _digit.sub("0", (text or "").lower()).split("\n")
    return [(i, n) for i, line in enumerate(lines) if (n := " ".join(line.split())) and (least < 2 or n.count(" ") >= least - 1)]


def _text_key(text_col: str):
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _line_id(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def _parts(batch: pa.RecordBatch, column: int):
    """(low, texts) for runs of about SLICE characters."""
    texts, low, size = [], 0, 0
    for at, value in enumerate(batch.column(column)):
        texts.append(value.as_py())
        size += len(texts[-1] or "")
        if size >= SLICE:
            yield low, texts
            texts, low, size = [], at + 1, 0
    if texts:
        yield low, texts


def _occurrences(least: int):
    def run(batches):
        for batch in batches:
            for low, texts in _parts(batch, 1):
                rows, numbers, lines = [], [], []
                for at, text in enumerate(texts):
                    for number, line in _lines(text, least):
                        rows.append(at)
                        numbers.append(number)
                        lines.append(line.encode("utf-8", "surrogatepass"))
                rows = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_line_id(x) for x in lines], pa.int64()), pa.array((simhash(lines) if lines else np.zeros(0, U64)).view(np.int64)), batch.column(0).slice(low, len(texts)).take(rows), batch.column(2).slice(low, len(texts)).take(rows), pa.array(numbers, pa.int32())],
                    ["id", "sim", "doc_id", "doc_key", "line_no"],
                )

    return run


def _every(batches):
    """All lines that are not blank; a line's keys stand beside its first occurrence in the task only."""
    held("lines")
    seen: set[int] = set()
    for batch in batches:
        for low, texts in _parts(batch, 1):
            rows, numbers, lines = [], [], []
            for at, text in enumerate(texts):
                own = _lines(text, 1)
                rows += [at] * len(own)
                numbers += [i for i, _ in own]
                lines += [line for _, line in own]
            ids = [_line_id(x.encode("utf-8", "surrogatepass")) for x in lines]
            fresh = {}
            for at, own in enumerate(ids):
                if own not in seen:
                    fresh.setdefault(own, at)
            chosen = np.fromiter(fresh.values(), np.int64, len(fresh))
            sim, level, many, keys = candidate_keys([lines[at] for at in fresh.values()])
            seen.update(fresh)
            if len(seen) > 500_000:
                seen = set()  # a line met again only brings its keys again
            old = np.ones(len(lines), bool)
            old[chosen] = False
            sims, levels, ends = np.zeros(len(lines), np.int64), np.zeros(len(lines), np.int32), np.zeros(len(lines) + 1, np.int64)
            sims[chosen], levels[chosen], ends[chosen + 1] = sim.view(np.int64), level, many
            per_line = pa.ListArray.from_arrays(pa.array(np.cumsum(ends).astype(np.int32)), pa.array(keys.view(np.int64)))
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sims, mask=old), pa.array(levels, mask=old), pa.array(np.fromiter(map(len, lines), np.int32, len(lines))), per_line, batch.column(0).slice(low, len(texts)).take(rows), batch.column(2).slice(low, len(texts)).take(rows), pa.array(numbers, pa.int32())],
                ["id", "sim", "level", "size", "keys", "doc_id", "doc_key", "line_no"],
            )


def _texts(least: int):
    def run(batches):
        for batch in batches:
            for _, texts in _parts(batch, 0):
                lines = list({line for text in texts for _, line in _lines(text, least)})
                yield pa.RecordBatch.from_arrays([pa.array([_line_id(x.encode("utf-8", "surrogatepass")) for x in lines], pa.int64()), pa.array(lines, pa.string())], ["id", "line"])

    return run


def _gathered(batches, rows: int = 8192, size: int = 1 << 24):
    """The same rows in batches of about so many rows, or bytes if they are large."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _verify(similar: float):
    def run(batches):
        for batch in _gathered(batches):
            keep = alike_pairs(batch.column(2).to_pylist(), batch.column(3).to_pylist(), similar)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _judges(similar: float):
    """For members of a bucket with their sketches and lines; see linked_within."""

    def judges(rows: pa.RecordBatch):
        sim, level, size = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("id_sim", "id_level", "id_size"))
        sim, lines, found = sim.view(U64), rows.column("line"), []

        def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            longer = np.maximum(size[i], size[j]).astype(np.int64)
            odd = sim[i] ^ sim[j]
            apart = np.bitwise_count((odd | (odd >> U64(1))) & U64(0x5555555555555555))
            short = np.minimum(size[i], size[j]).astype(np.int64)
            good = (short * 10 >= longer * 9) & ((short < SHORT) | (level[i] != level[j]) | (apart <= NEAR))
            at = np.flatnonzero(good)
            if len(at) and not found:
                found.append(np.concatenate([_profiles(lines.slice(low, 1024).to_pylist()) for low in range(0, len(lines), 1024)]))
            if len(at):
                good[at] = _may_be(found[0], i[at], j[at], ((1 - similar) * longer[at] + 1e-9).astype(np.int64))
            return good

        def verify(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return alike_pairs(lines.take(pa.array(i)).to_pylist(), lines.take(pa.array(j)).to_pylist(), similar)

        return near, verify

    return judges


def line_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_WORDS, similar: float = SIMILAR, every: bool = False):
    """(occurrences, keepers): every occurrence (id, doc_id, doc_key, line_no and more), and for each line that
    repeats or is linked its kept occurrence (id, first: struct of doc_id, doc_key, line_no). With every, least is
    1 and similar is SIMILAR."""
    if every:
        least, similar = 1, SIMILAR
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), _text_key(text_col).alias("doc_key"))
    # A null doc_id sorts after all others.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc_key", "line_no")
    ends = f"doc_id {kind}, doc_key bigint, line_no int"
    if every:
        occurrences = materialize(own.mapInArrow(_every, f"id bigint, sim bigint, level int, size int, keys array<bigint>, {ends}"), "lines")
        sketch = [F.max("sim").alias("sim"), F.max("level").alias("level"), F.max("size").alias("size")]
    else:
        occurrences = materialize(own.mapInArrow(_occurrences(least), f"id bigint, sim bigint, {ends}"), "lines")
        sketch = [F.first("sim").alias("sim")]
    distinct = materialize(occurrences.groupBy("id").agg(*sketch, F.min(place).alias("first"), F.count("*").alias("n")), "distinct-lines")
    sim = F.col("sim")

    def block(x: int):
        return F.shiftrightunsigned(sim, BLOCKS[x][0]).bitwiseAND((1 << BLOCKS[x][1]) - 1)

    def apart(x, y):
        odd = x("sim").bitwiseXOR(y("sim"))
        if not every:
            return F.bit_count(odd)
        short, long = F.least(x("size"), y("size")), F.greatest(x("size"), y("size"))
        hashes = F.bit_count(odd.bitwiseOR(F.shiftrightunsigned(odd, 1)).bitwiseAND(0x5555555555555555))
        return F.when(short * 10 < long * 9, NEAR + 1).when((short < SHORT) | (x("level") != y("level")), 0).otherwise(hashes)

    if every:
        buckets = occurrences.select(F.explode("keys").alias("key"), "id")
    else:
        tables = [F.shiftleft(F.lit(t).cast("long"), 26).bitwiseOR(F.shiftleft(block(x), 13)).bitwiseOR(block(y)) for t, (x, y) in enumerate(combinations(range(5), 2))]
        buckets = distinct.select(F.explode(F.array(*tables)).alias("key"), "id")

    lines = None

    def prepare(ids: DataFrame) -> None:
        nonlocal lines
        wanted = materialize(join_sized(distinct.select("id", "first.doc_id"), ids, "id", "left_semi", 16), "wanted")
        holders = join_sized(own, wanted.select("doc_id").distinct(), own["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi", 16)
        found = join_sized(holders.select("text").mapInArrow(_texts(least), "id bigint, line string"), wanted.select("id"), "id", "left_semi", 16)
        lines = materialize(found.dropDuplicates(["id"]), "line-texts")
        discard(wanted)

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(lines.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(lines.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(_verify(similar), "a bigint, b bigint")

    def within(members: DataFrame) -> DataFrame:
        return by_bucket(members.join(lines, "id")).mapInArrow(linked_within(_judges(similar)), "a bigint, b bigint")

    groups, _ = clusters(buckets, distinct.select("id", "sim", *(["level", "size"] if every else [])), apart, NEAR if every else BITS, verify, prepare, nearest=False, within=within if every else None)
    discard(lines)
    distinct = distinct.select("id", "first", "n")
    if groups is None:
        return occurrences, materialize(distinct.where("n > 1").select("id", "first"), "keepers")
    joined = join_sized(distinct, groups, "id", "left", 16)
    single = joined.where("root is null and n > 1").select("id", "first")
    linked = joined.where("root is not null")
    heads = materialize(linked.groupBy("root").agg(F.min("first").alias("first")), "heads")
    return occurrences, materialize(single.unionByName(join_sized(linked.select("id", "root"), heads, "root", "inner", 40).select("id", "first")), "keepers")


def _rewrite(names: list[str], text_col: str):
    def run(batches):
        held("lines")
        at, drop = names.index(text_col), len(names)
        for batch in batches:
            for low, old in _parts(batch, at):
                rows = batch.slice(low, len(old))
                texts, counts, lost = [], [], []
                for text, numbers in zip(old, rows.column(drop)):
                    gone = set(numbers.as_py() or ())
                    texts.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone) if gone else text)
                    counts.append(text.count("\n") + 1 if text else 0)
                    lost.append(len(gone))
                columns = [rows.column(i) for i in range(len(names))]
                columns[at] = pa.array(texts, pa.string())
                if "n_chars" in names:
                    size = pa.array([None if t is None else len(t) for t in texts], pa.int64())
                    columns[names.index("n_chars")] = size.cast(rows.schema.field(names.index("n_chars")).type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(lost, pa.int64())], [*names, "__lines", "__lost"])
                del rows, columns, texts
            pa.default_memory_pool().release_unused()

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_WORDS, similar: float = SIMILAR, every: bool = False) -> DataFrame:
    """docs, all columns and rows, with repeated lines taken out of text_col, and __lines and __lost, the
    numbers of lines before and of lines taken out. A column n_chars follows the new text.

    With every, all lines that are not blank take part and are linked by edit similarity alone; without it lines of
    under `least` words always stay, and only links within BITS count. Null and empty texts are unchanged (0 lines). Rows equal in
    doc_id and text count as one document, so both keep its lines. Null ids come after all others in the order
    that decides which occurrence is first. Only line hashes and positions are shuffled; texts only move if
    the lines to take out are too many to broadcast.
    """
    occurrences, keepers = line_groups(docs, id_col, text_col, least, similar, every)
    found = join_sized(occurrences.select("id", "doc_id", "doc_key", "line_no"), keepers, "id", "inner", 48)
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("doc_key") == F.col("first.doc_key")) & (F.col("line_no") == F.col("first.line_no"))
    gone = materialize(found.where(~kept).groupBy("doc_id", "doc_key").agg(F.collect_set("line_no").alias("__gone")).withColumnRenamed("doc_id", "__doc"), "gone-lines")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    keyed = docs.withColumn("__doc_key", _text_key(text_col))
    joined = join_sized(keyed, gone, keyed[id_col].eqNullSafe(gone["__doc"]) & (keyed["__doc_key"] == gone["doc_key"]), "left", 96)
    return joined.select(*[f"`{c}`" for c in docs.columns], "__gone").mapInArrow(_rewrite(docs.columns, text_col), f"{shape}, __lines bigint, __lost bigint")
