"""numpy kernels over Arrow string buffers: word spans and word hashes without a Python loop per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_R = U64(0x9E3779B97F4A7C15 | 5)
_RINV = U64(pow(int(_R), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (xor-shift-multiply)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _power(base: U64, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, U64)
        steps[0] = 1
        have = _powers[name] = np.cumprod(steps, dtype=U64)
    return have[:n]


def string_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty. Offsets have one entry more than rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of every row: start, end (bytes), row; first[i] is row i's first word."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.raw, self.offsets, self.rows = raw, offsets, len(offsets) - 1
        solid = (raw != 32) & ((raw - np.uint8(9)) > 4)
        begin, end = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(raw))]
        begin[inner] = solid[inner]
        end[inner - 1] = solid[inner - 1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.count)

    def hashes(self) -> np.ndarray:
        """64-bit polynomial hash of every word's bytes."""
        return span_hashes(self.raw, self.start, self.end)

    def windows(self, width: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(hash, row) of every run of width words; a row of fewer words (but any) gives one window of them all."""
        h = self.hashes() if hashes is None else hashes
        n = len(h) - width + 1
        if n > 0:
            out = h[:n].copy()
            for k in range(1, width):
                out *= U64(0xD6E8FEB86659FD93)
                out += h[k : n + k]
            whole = self.row[:n] == self.row[width - 1 :]
            out, row = mix(out[whole]), self.row[:n][whole]
        else:
            out, row = np.zeros(0, U64), np.zeros(0, np.int64)
        few = np.flatnonzero((self.count > 0) & (self.count < width))
        if len(few):
            own = sequence_hashes(h, self.first[few], self.first[few + 1])
            out, row = np.concatenate([out, own]), np.concatenate([row, few])
            order = np.argsort(row, kind="stable")
            out, row = out[order], row[order]
        return out, row


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of raw[start:end] for every span, by prefix sums."""
    n = len(raw)
    total = np.zeros(n + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * _power(_R, n, "r"), out=total[1:], dtype=U64)
    back = _power(_RINV, n + 1, "rinv")
    return mix((total[end] - total[start]) * back[start] + (end - start).astype(U64))


def sequence_hashes(h: np.ndarray, first: np.ndarray, last: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of the run h[first:last] for every pair, dependent on order and length."""
    n = len(h)
    total = np.zeros(n + 1, U64)
    np.cumsum(mix(h + U64(2 * salt + 1)) * _power(_R, n, "r"), out=total[1:], dtype=U64)
    back = _power(_RINV, n + 1, "rinv")
    return mix((total[last] - total[first]) * back[first] + (last - first).astype(U64) * U64(0xA0761D6478BD642F) + U64(salt))
