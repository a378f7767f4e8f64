"""Token-id shards: each document's ids in a zstandard frame of its own, under one shared dictionary.

A shard is one run of bytes:

    magic "FWIDS\\x01", width of an id in bytes (u8), flags (u8, 0)
    number of documents n (u64), xxh64 of the dictionary (u64)
    end of each frame from the first frame's start: n x u64
    document ids: n x i64; 1 for a null document id, else 0: n x u8; number of ids: n x u64
    the frames

so that one short document is read by its index entry and one small frame. Shards are rows (part, seq, docs, tokens,
shard) of a Parquet table, which any store that Spark writes can hold; rows in order of (part, seq) hold documents
in ascending doc_id order.
"""

from __future__ import annotations

import re
import struct
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .storage import held, materialize

MAGIC = b"FWIDS\x01"
#: Fitting the dictionary: documents (that of least id hash in each of SAMPLES hash classes) and characters of each.
SAMPLES, SAMPLE_CHARS = 512, 4096
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Bytes of frames after which a shard is closed.
SHARD_BYTES = 1 << 20
#: Runs that a worker remembers (some 200 bytes each).
CACHE = 1_200_000

#: Characters that Python's split takes for white space but Unicode does not.
_odd = re.compile("[\x1c-\x1f]")
_small = re.compile("[a-zß-öø-ÿ]+")


class _Letters(dict):
    """How the tokenizer's own pre-tokenizer writes each letter, filled in on demand; it maps bytes one by one."""

    def __init__(self, pre_tokenizer):
        self.pre_tokenizer = pre_tokenizer

    def __missing__(self, code: int) -> str:
        self[code] = out = self.pre_tokenizer.pre_tokenize_str(chr(code))[0][0]
        return out


class _Runs(dict):
    """The ids of every run met so far."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, run: str) -> bytes:
        self[run] = out = self.make(run)
        return out


class Encoder:
    """A tokenizer that encodes each run between white space once and remembers it.

    The tokenizer drops white space and merges within words, so a text's ids are those of its runs, one after
    the other; `fits` holds that against the tokenizer's own settings, and texts are encoded whole otherwise. So is a
    text that holds one of the tokenizer's added tokens, as those are found before anything is cut.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.type = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.raw = [i.to_bytes(self.type.itemsize, "little") for i in range(self.size)]
        self.added = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        self.known = _Runs(self._run)
        self.letters = _Letters(self.tokenizer.pre_tokenizer)
        self.fits = all(self._whole(t) == self._whole(t.split()[0]) + self._whole(t.split()[1]) for t in ("ab cd", "ab\nécd", "It's  1,5!", "a \t'S"))

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _ids(self, piece: str) -> bytes:
        raw = self.raw
        return b"".join([raw[t.id] for t in self.tokenizer.model.tokenize(piece)])

    def _run(self, run: str) -> bytes:
        if run[-1] in ".,;:!?" and run[:-1].isalpha():
            return self.known[run[:-1]] + self.known[run[-1]]
        # Small letters of Latin-1 are as the tokenizer's own normalizer would leave them.
        text = run if _small.fullmatch(run) else self.tokenizer.normalizer.normalize_str(run)
        if text.isalpha():  # the one piece that it is
            return self._ids(text if text.isascii() else text.translate(self.letters))
        return b"".join([self._ids(piece) for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Every text's ids, little-endian, of self.type."""
        if len(self.known) > CACHE:
            self.known.clear()
        known, out = self.known.__getitem__, []
        for text in texts:
            if not self.fits or _odd.search(text) or self.added.search(text):
                out.append(np.array(self._whole(text), self.type).tobytes())
            else:
                out.append(b"".join(map(known, (text.lower() if text.isascii() else text).split())))
        return out


def encoder(path: str) -> Encoder:
    return held("token file", path, lambda: Encoder(path))


def train_dictionary(docs: DataFrame, tokenizer: str, samples: int = SAMPLES, chars: int = SAMPLE_CHARS) -> bytes:
    """The shared dictionary, from at most samples * chars characters of documents; empty if too few.

    It is only a help to compression: whatever it holds, the ids read back are those of the whole texts."""
    at = F.xxhash64(F.col("doc_id").cast("string"), F.lit(11))
    chosen = docs.select(at.alias("at")).groupBy(F.pmod("at", F.lit(samples))).agg(F.min("at").alias("at"))
    keys = docs.sparkSession.createDataFrame([(r["at"],) for r in chosen.collect()], "at long")
    rows = docs.select(at.alias("at"), F.substring("text", 1, chars).alias("text")).join(F.broadcast(keys), "at").groupBy("at").agg(F.min("text").alias("text")).where("text <> ''").orderBy("at").collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, encoder(tokenizer).encode([r["text"] for r in rows])).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        return b""


def pack(frames: list[bytes], doc_ids: list[int | None], counts: list[int], width: int, dictionary: bytes) -> bytes:
    n = len(frames)
    head = MAGIC + struct.pack("<BBQQ", width, 0, n, xxhash.xxh64_intdigest(dictionary))
    return b"".join([
        head,
        np.cumsum([len(f) for f in frames], dtype="<u8").tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], "<u1").tobytes(),
        np.array(counts, "<u8").tobytes(),
        *frames,
    ])


class Shard:
    """Reads a shard; document(i) decompresses the i-th document alone."""

    def __init__(self, data: bytes, dictionary: bytes):
        if data[:6] != MAGIC:
            raise ValueError("not a token-id shard")
        width, _, n, digest = struct.unpack_from("<BBQQ", data, 6)
        if digest != xxhash.xxh64_intdigest(dictionary):
            raise ValueError("the shard was written with another dictionary")
        self.type, self.n, self.data = np.dtype(f"<u{width}"), n, memoryview(data)
        at = 24
        self.end = np.frombuffer(data, "<u8", n, at).astype(np.int64)
        ids = np.frombuffer(data, "<i8", n, at + 8 * n)
        none = np.frombuffer(data, "<u1", n, at + 16 * n)
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, none)]
        self.counts = np.frombuffer(data, "<u8", n, at + 17 * n).astype(np.int64)
        self.frames = at + 25 * n
        self.coder = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def document(self, i: int) -> np.ndarray:
        begin = self.end[i - 1] if i else 0
        raw = self.coder.decompress(self.data[self.frames + begin : self.frames + self.end[i]], max_output_size=int(self.counts[i]) * self.type.itemsize)
        return np.frombuffer(raw, self.type)


def _dictionary(content: bytes):
    return zstandard.ZstdCompressionDict(content) if content else None


def write(docs: DataFrame, tokenizer: str, end_id: int, dictionary: bytes) -> DataFrame:
    """The shard table (part, seq, docs, tokens, shard) of docs (doc_id, text), in ascending doc_id order.

    Texts are dealt by ranges of doc_id and sorted within each; equal doc_ids are ordered by text, null ones come
    first. A null or empty text has end_id alone. A task holds one shard at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches):
        own = encoder(tokenizer)
        coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(shared.value), write_content_size=True, write_checksum=False)
        end = np.array([end_id], own.type).tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        frames, ids, counts, size = [], [], [], 0

        def shard():
            blob = pack(frames, ids, counts, own.type.itemsize, shared.value)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([sum(counts)], pa.int64()), pa.array([blob], pa.binary())], ["part", "seq", "docs", "tokens", "shard"])

        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                rows = batch.slice(low, 256)
                for doc_id, raw in zip(rows.column(0).to_pylist(), own.encode([t or "" for t in rows.column(1).to_pylist()])):
                    raw += end
                    frames.append(coder.compress(raw))
                    ids.append(doc_id)
                    counts.append(len(raw) // own.type.itemsize)
                    size += len(frames[-1]) + 25
                    if size >= SHARD_BYTES:
                        yield shard()
                        frames, ids, counts, size, seq = [], [], [], 0, seq + 1
        if frames:
            yield shard()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return ordered.mapInArrow(run, "part int, seq int, docs bigint, tokens bigint, shard binary")


def _reading(shared):
    def run(batches):
        held("token shards")  # the encoder of the writing stage goes
        for batch in batches:
            for start, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = Shard(blob.as_py(), shared.value)
                crc = [zlib.crc32(own.document(i).astype("<u4").tobytes()) for i in range(own.n)]
                begin = start + np.cumsum(own.counts) - own.counts
                yield pa.RecordBatch.from_arrays([pa.array(own.doc_ids, pa.int64()), pa.array(begin), pa.array(own.counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read(shards: DataFrame, dictionary: bytes) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in a shard table; start counts the ids before it.

    Starts come from the shards' token sums: one number for each part goes over the driver, the rest is a running sum
    within a part.
    """
    from pyspark.sql.window import Window

    spark = shards.sparkSession
    totals = sorted(tuple(r) for r in shards.groupBy("part").agg(F.sum("tokens")).collect())
    base = np.concatenate([[0], np.cumsum([t for _, t in totals])]).tolist() if totals else []
    bases = spark.createDataFrame([(p, int(b)) for (p, _), b in zip(totals, base)], "part int, base long")
    places = shards.select("part", "seq", "tokens").withColumn("before", F.sum("tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)))
    places = places.join(F.broadcast(bases), "part").select("part", "seq", (F.col("base") + F.coalesce("before", F.lit(0))).alias("start"))
    shared = spark.sparkContext.broadcast(dictionary)
    places = F.broadcast(places) if shards.count() < 1_000_000 else places
    return shards.select("part", "seq", "shard").join(places, ["part", "seq"]).select("start", "shard").mapInArrow(_reading(shared), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def export(shards: DataFrame, dictionary: bytes, folder: str) -> None:
    """Writes the shards of a small table as plain files, with the dictionary, for use outside Spark."""
    to = Path(folder)
    to.mkdir(parents=True, exist_ok=True)
    (to / "dictionary").write_bytes(dictionary)
    for r in shards.select("part", "seq", "shard").toLocalIterator():
        (to / f"{r['part']:06d}-{r['seq']:06d}.ids").write_bytes(bytes(r["shard"]))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes docs as a shard table in the shared folder and reads it back; see write and read."""
    docs = docs.select("doc_id", "text")
    dictionary = train_dictionary(docs, tokenizer)
    return read(materialize(write(docs, tokenizer, end_id, dictionary), "token-shards"), dictionary)
