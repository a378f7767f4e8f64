"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Every byte position of a piece is a leaf holding the rank of the pair that starts there (the token
beginning at that position and its right neighbour). Inner nodes hold the smaller of their children,
the left one on a tie, so the root names the leftmost pair of minimum rank. A merge kills the right
token's position and changes the pairs of the merged token and of its live left neighbour: a fixed
number of point updates of logarithmic cost each.

Many short pieces are encoded side by side: the same tree, held as rows of one numpy array.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .storage import held

NONE = np.iinfo(np.int32).max
#: Pieces of more bytes than this are encoded one at a time.
WIDE = 64
#: Entries at which a worker's caches are emptied; they only save repeated work.
CACHE = 250_000

#: A single blank between two visible characters: no pretoken spans it, and the blank opens the next one.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def read_ranks(path: str) -> dict[bytes, int]:
    """The token bytes and ranks of a rank file (base64 token, blank, rank)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Codec:
    """Encodes and decodes text by merge ranks; pattern splits text into pieces merged separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.size = max(ranks.values()) + 1
        #: Whether the pattern takes a blank with the letters after it, and marks apart.
        self.plain = self.pattern.findall(" ab é.") == [" ab", " é", "."]
        spelled = [b""] * self.size
        for token, rank in ranks.items():
            spelled[rank] = token
        self.token_bytes = _table(spelled)
        self.token_digits = _table([b"%d," % i for i in range(self.size)])
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = sorted((ranks[t[:k]] * self.size + ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks)
        self.pair_keys = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.pair_rank = np.array([r for _, r in pairs] or [NONE], np.int32)
        self.pair_dict = dict(pairs)
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes | None] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every pair, NONE where a side is missing (-1) or the pair does not merge."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pair_keys[at] == key), self.pair_rank[at], NONE)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one piece; the tree is a flat list of leaf positions."""
        n = len(piece)
        if piece in self.ranks:
            return [self.ranks[piece]]
        if n < 2:
            return [int(self.of_byte[b]) for b in piece]
        token = [int(self.of_byte[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        size = 1 << (n - 1).bit_length()
        get = self.pair_dict.get
        rank = [get(token[i] * self.size + token[i + 1], NONE) for i in range(n - 1)] + [NONE] * (size - n + 1)
        tree = [0] * size + list(range(size))
        for node in range(size - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if rank[a] <= rank[b] else b

        def update(leaf: int, value: int) -> None:
            rank[leaf] = value
            node = (leaf + size) >> 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if rank[a] <= rank[b] else b
                node >>= 1

        while rank[tree[1]] != NONE:
            i = tree[1]
            j = after[i]
            token[i], k = rank[i], after[j]
            after[i] = k
            token[j] = -1
            update(j, NONE)
            if k < n:
                before[k] = i
            update(i, get(token[i] * self.size + token[k], NONE) if k < n else NONE)
            if (h := before[i]) >= 0:
                update(h, get(token[h] * self.size + token[i], NONE))
        return [t for t in token if t >= 0]

    def _encode_block(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Pieces of 2 to width bytes (a power of two), one row each."""
        m = len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, m)
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(m, width)
        column = np.arange(width)
        token = np.where(column < length[:, None], self.of_byte[flat], -1).astype(np.int32)
        right = np.concatenate([token[:, 1:], np.full((m, 1), -1, np.int32)], axis=1)
        leaf = self._rank(token.ravel(), right.ravel()).reshape(m, width)
        #: One number orders a leaf by rank, then by position.
        tree = np.empty((m, 2 * width), np.int64)
        tree[:, width:] = (leaf.astype(np.int64) << 16) | column
        level = width // 2
        while level:
            np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2], out=tree[:, level : 2 * level])
            level //= 2
        #: From here on flat views: an index is row * width (or 2 * width in the tree) + place.
        nodes, tokens = tree.reshape(-1), token.reshape(-1)
        after = np.tile((column + 1).astype(np.int8), m)
        before = np.tile((column - 1).astype(np.int8), m)

        def update(trunk: np.ndarray, leaves: np.ndarray, ranks: np.ndarray) -> None:
            at = leaves + width
            value = (ranks << 16) | leaves
            nodes[trunk + at] = value
            while at[0] > 1:
                value = np.minimum(value, nodes[trunk + (at ^ 1)])
                at = at >> 1
                nodes[trunk + at] = value

        live = np.flatnonzero((tree[:, 1] >> 16) != NONE)
        top = tree[live, 1]
        while len(live):
            row, trunk = live * width, live * (2 * width)
            i, new = top & 0xFFFF, top >> 16
            j = after[row + i].astype(np.int64)
            k = after[row + j].astype(np.int64)
            tokens[row + i] = new
            tokens[row + j] = -1
            after[row + i] = k
            inside = k < length[live]
            before[(row + k)[inside]] = i[inside]
            far = np.where(inside, tokens[row + np.minimum(k, width - 1)], -1)
            h = before[row + i].astype(np.int64)
            held = np.flatnonzero(h >= 0)
            near = tokens[row[held] + h[held]]
            ranks = self._rank(np.concatenate([new, near]), np.concatenate([far, new[held]])).astype(np.int64)
            update(trunk, j, np.full(len(live), NONE, np.int64))
            update(trunk, i, ranks[: len(live)])
            if len(held):
                update(trunk[held], h[held], ranks[len(live) :])
            top = nodes[trunk + 1]
            going = (top >> 16) != NONE
            live, top = live[going], top[going]
        kept = token >= 0
        ids = token[kept].astype("<u4").tobytes()
        ends = (4 * np.cumsum(kept.sum(axis=1))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Token ids of every piece, as little-endian 32-bit numbers."""
        out: list = [None] * len(pieces)
        blocks: dict[int, list[int]] = {}
        for at, piece in enumerate(pieces):
            if piece in self.ranks:
                out[at] = self.ranks[piece].to_bytes(4, "little")
            elif 2 <= len(piece) <= WIDE:
                blocks.setdefault(1 << (len(piece) - 1).bit_length(), []).append(at)
            else:
                out[at] = np.array(self.encode_piece(piece), "<u4").tobytes()
        for width, members in blocks.items():
            for low in range(0, len(members), 8192):
                part = members[low : low + 8192]
                for at, ids in zip(part, self._encode_block([pieces[x] for x in part], width)):
                    out[at] = ids
        return out

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks (runs between safe blanks), each as little-endian 32-bit numbers."""
        split = [self._pieces(c) for c in chunks]
        have = self.pieces
        fresh = list({p for found in split for p in found if p not in have})
        have.update(zip(fresh, self.encode_pieces([p.encode("utf-8") for p in fresh])))
        return [have[found[0]] if len(found) == 1 else b"".join(map(have.__getitem__, found)) for found in split]

    def _pieces(self, chunk: str) -> tuple[str, ...] | list[str]:
        """The pattern's matches; a blank and letters, and these before one mark, are plain to see."""
        if self.plain and chunk[1:2].isalpha() and chunk[0] == " ":
            if chunk[1:].isalpha():
                return (chunk,)
            if chunk[-1] in ".,;:!?" and chunk[1:-1].isalpha():
                return chunk[:-1], chunk[-1]
        return self.pattern.findall(chunk)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of every text.

        A text is cut at single blanks between visible characters, which no pretoken spans, and what
        stands between two cuts is encoded once for all its occurrences in the batch and the cache.
        """
        if len(self.chunks) > CACHE or len(self.pieces) > CACHE:
            self.pieces, self.chunks = {}, {}
        known = self.chunks
        cut = [text.split(" ") for text in texts]
        missing: set[str] = set()
        for parts in cut:
            missing.update(parts)
        missing = [p for p in missing if p not in known]
        clean = [p for p in missing if p and not p[0].isspace() and not p[-1].isspace()]
        known.update(dict.fromkeys(missing))  # None: a blank beside it is no safe cut
        known.update(zip(clean, self._ids([" " + p for p in clean])))
        heads = list({parts[0] for parts in cut})
        head = dict(zip(heads, self._ids(heads)))
        out = []
        for text, parts in zip(texts, cut):
            try:
                if len(parts) > 1 and known[parts[0]] is None:
                    raise TypeError
                ids = head[parts[0]] + b"".join(map(known.__getitem__, parts[1:]))
            except TypeError:
                runs = _CUT.split(text)
                ids = b"".join(self._ids([runs[0], *(" " + r for r in runs[1:])]))
            out.append(np.frombuffer(ids, "<u4"))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        return _gather(*self.token_bytes, ids)

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids as decimal numbers joined by commas."""
        return _gather(*self.token_digits, ids)[:-1]


def _table(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def _gather(flat: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> bytes:
    """Concatenates the table's entries named by ids."""
    out = []
    for low in range(0, len(ids), 1 << 20):
        part = ids[low : low + (1 << 20)].astype(np.int64)
        begin = offsets[part]
        sizes = offsets[part + 1] - begin
        ends = np.cumsum(sizes)
        out.append(flat[np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes())
    return b"".join(out)


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a rank file."""
    return held("bpe", (path, pattern), lambda: Codec(read_ranks(path), pattern))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encodes every whole text and decodes the ids again: id_col, n_tokens, ids_sha256, decoded_sha256, ids.

    A null or empty text has no ids (hashes of nothing). A text that no tokenizer merges or one single
    huge piece costs n log n steps. Repeated rows and null ids give one result row each; other columns
    of docs are not read, so their names cannot clash. Narrow: one pass, no shuffle; a lost task is
    simply run again. with_ids=False leaves out the ids themselves.
    """

    def run(batches):
        own = codec(ranks_path, pattern)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                encoded = own.encode_batch([t or "" for t in part.column(1).to_pylist()])
                columns = [
                    part.column(0),
                    pa.array([len(ids) for ids in encoded], pa.int64()),
                    pa.array([hashlib.sha256(own.decimal(ids)).hexdigest() for ids in encoded], pa.string()),
                    pa.array([hashlib.sha256(own.decode(ids)).hexdigest() for ids in encoded], pa.string()),
                ]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array([ids.astype(np.int32) for ids in encoded], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
