"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is a weighted set: its five-word shingles, each weighted by its number of occurrences. Darts
fall on the plane of (weight, rank) of every shingle at random places that only the shingle's hash decides.
A document owns the darts below its weight for the shingle; in each of K coordinates its dart of least rank
is its sample. Two documents take the same dart in a coordinate with probability equal to their weighted
Jaccard similarity. As only low ranks can win, darts are thrown in order of rank and only up to the rank at
which K ln K + 2 K darts are due, about as many for a long text as for a short one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .clusters import by_bucket, clusters, linked_within
from .storage import discard, held, join_sized, materialize
from .textkernel import U64, Words, mix, sequence_hashes, string_buffers

SHINGLE = 5
SIMILAR = 0.8
#: 32 bands of 6 coordinates: a pair at 0.8 shares no band with probability 6e-5, at 0.9 with 1e-10.
BANDS, BAND_ROWS = 32, 6
#: Coordinates; the bands take the first BANDS * BAND_ROWS, the sketch two bits of each of all.
K = 2 * BANDS * BAND_ROWS
WORDS = K // 32
SKETCH = [f"s{i}" for i in range(WORDS)]
#: At 0.8 an expected 57.6 of 384 coordinates differ in the sketch, deviation 7; 86 is four deviations more (3e-5),
#: and about as many as differ at 0.70.
NEAR = 86
#: Bytes of text and rows for which signatures are computed at a time; a row has some K ln K + 2 K darts, however short.
SLICE, SLICE_ROWS = 1 << 20, 256

_INF = np.finfo(np.float64).max


def _uniform(h: np.ndarray) -> np.ndarray:
    """(0, 1) from 64-bit hashes."""
    return ((h >> U64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def dart_signatures(element: np.ndarray, weight: np.ndarray, row: np.ndarray, rows: int, k: int = K) -> np.ndarray:
    """(rows, k) ids of the least-rank darts of weighted sets given as (element, weight > 0, row) triples.

    The weight axis is cut into [0, 1), [1, 2), [2, 4), [4, 8) ...; in a cell of width v darts arrive in order
    of rank as a Poisson process of rate k v. A row that leaves a coordinate empty is thrown again with twice
    the rank limit. Rows without elements get zeros.
    """
    weight = weight.astype(np.float64)
    total = np.bincount(row, weights=weight, minlength=rows)
    out_rank = np.full(rows * k, _INF)
    out = np.zeros(rows * k, U64)
    limit = np.divide(np.log(k) + 2, total, out=np.zeros(rows), where=total > 0)
    todo = total > 0
    cells = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    e = np.repeat(np.arange(len(element)), cells)
    level = np.arange(len(e)) - np.repeat(np.cumsum(cells) - cells, cells)
    while todo.any():
        use = todo[row[e]]
        at, lv = e[use], level[use]
        low = np.where(lv == 0, 0.0, 2.0 ** (lv - 1))
        width = np.where(lv == 0, 1.0, low)
        seed = mix(element[at] ^ mix(lv.astype(U64) + U64(0x51ED27)))
        rank = np.zeros(len(at))
        owner = row[at]
        bound, mass = limit[owner], weight[at]
        count = 0
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(seed):
            count += 1
            h = mix(seed + U64(count * 0x9E3779B97F4A7C15 % (1 << 64)))
            rank = rank - np.log(_uniform(h)) / (k * width)
            alive = rank <= bound
            seed, rank, width, low, bound, mass, owner, h = (v[alive] for v in (seed, rank, width, low, bound, mass, owner, h))
            g = mix(h ^ U64(0xC2B2AE3D27D4EB4F))
            inside = low + width * ((g >> U64(40)).astype(np.float64) / (1 << 24)) < mass
            coordinate = (g & U64(0xFFFFFFFF)) % U64(k)
            found.append((owner[inside] * k + coordinate[inside].astype(np.int64), rank[inside], g[inside]))
        slot, r, dart = (np.concatenate([f[i] for f in found]) for i in range(3))
        np.minimum.at(out_rank, slot, r)
        best = r == out_rank[slot]
        out[slot[best]] = dart[best]
        empty = (out_rank.reshape(rows, k) == _INF).any(axis=1)
        todo &= empty
        limit[todo] *= 2
    return out.reshape(rows, k)


def weighted_shingles(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, occurrences, row), sorted by row and shingle."""
    shingle, row = words.windows(SHINGLE, hashes)
    order = np.lexsort((shingle, row))
    shingle, row = shingle[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return shingle[at], np.diff(np.append(at, len(row))), row[at]


def _keys(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a text's sequence of words."""
    return tuple(sequence_hashes(hashes, words.first[:-1], words.first[1:], salt).view(np.int64) for salt in (1, 2))


def _slices(batch: pa.RecordBatch, column: int):
    """(low, high, bytes, offsets) of runs of at most SLICE_ROWS rows of about SLICE bytes."""
    raw, offsets = string_buffers(batch.column(column))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + SLICE, side="right")) - 1)
        high = min(high, low + SLICE_ROWS)
        yield low, high, raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def _sign(batches):
    held("near duplicates")
    for batch in batches:
        for low, high, raw, offsets in _slices(batch, 1):
            words = Words(raw, offsets)
            hashes = words.hashes()
            k1, k2 = _keys(words, hashes)
            sig = dart_signatures(*weighted_shingles(words, hashes), words.rows)
            band = np.zeros((words.rows, BANDS), U64)
            for i in range(BAND_ROWS):
                band = mix(band * U64(31) + sig[:, i : BANDS * BAND_ROWS : BAND_ROWS])
            band ^= mix(np.arange(BANDS, dtype=U64) + U64(77))
            two = (sig >> U64(62)).reshape(words.rows, WORDS, 32) << (U64(2) * np.arange(32, dtype=U64))
            bits = np.bitwise_or.reduce(two, axis=2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, high - low), pa.array(words.count > 0), pa.array(k1), pa.array(k2), pa.FixedSizeListArray.from_arrays(pa.array(band.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64())), *[pa.array(np.ascontiguousarray(bits[:, i])) for i in range(WORDS)]],
                ["doc_id", "worded", "k1", "k2", "bands", *SKETCH],
            )


def _tag(batches):
    """Appends a text's key columns to whatever rows come; the text is the last column but none is changed."""
    for batch in batches:
        at = batch.schema.get_field_index("__text")
        parts = [(_keys(w, w.hashes()), w.count > 0) for _, _, raw, off in _slices(batch, at) for w in [Words(raw, off)]]
        arrays = [batch.column(i) for i in range(batch.num_columns) if i != at]
        names = [n for n in batch.schema.names if n != "__text"]
        for j in range(2):
            arrays.append(pa.array(np.concatenate([p[0][j] for p in parts]) if parts else np.zeros(0, np.int64)))
        arrays.append(pa.array(np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, bool)))
        yield pa.RecordBatch.from_arrays(arrays, [*names, "__k1", "__k2", "__worded"])


def _sets(batches):
    held("near duplicates")
    for batch in batches:
        for low, high, raw, offsets in _slices(batch, 0):
            words = Words(raw, offsets)
            hashes = words.hashes()
            k1, _ = _keys(words, hashes)
            shingle, n, row = weighted_shingles(words, hashes)
            ends = np.searchsorted(row, np.arange(words.rows + 1))
            cells = [_bag(shingle[a:b], n[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(cells, pa.binary())], ["id", "bag"])


def _bag(shingle: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted 32-bit shingles, then their counts. Two of a text's shingles, or of two texts', meet by chance once in
    four billion, which moves the similarity of the longest texts by less than 1e-4."""
    key, back = np.unique((shingle >> U64(32)).astype("<u4"), return_inverse=True)
    return key.tobytes() + np.bincount(back, weights=n, minlength=len(key)).astype("<u4").tobytes()


def bag_similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two bags."""
    (ha, na), (hb, nb) = ((np.frombuffer(x, "<u4", len(x) // 8), np.frombuffer(x, "<u4", offset=len(x) // 2)) for x in (a, b))
    total = int(na.sum()) + int(nb.sum())
    at = np.searchsorted(hb, ha)
    at[at == len(hb)] = 0
    same = hb[at] == ha if len(hb) else np.zeros(len(ha), bool)
    common = int(np.minimum(na[same], nb[at[same]]).sum())
    return common / (total - common) if total > common else 1.0


def _alike(similar: float):
    def run(batches):
        for batch in batches:
            keep = [bag_similarity(x.as_buffer(), y.as_buffer()) >= similar for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _judges(similar: float):
    """For members of a bucket with their sketches and bags; see linked_within."""

    def judges(rows: pa.RecordBatch):
        sketch = [rows.column(f"id_{c}").to_numpy(zero_copy_only=False).view(U64) for c in SKETCH]
        bags = rows.column("bag")

        def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            total = np.zeros(len(i), np.int64)
            for s in sketch:
                odd = s[i] ^ s[j]
                total += np.bitwise_count((odd | (odd >> U64(1))) & U64(0x5555555555555555))
            return total <= NEAR

        def verify(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            return np.array([bag_similarity(bags[a].as_buffer(), bags[b].as_buffer()) >= similar for a, b in zip(i.tolist(), j.tolist())], bool)

        return near, verify

    return judges


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, k1, k2, class_id, kept for every row of docs: one document of each class is kept.

    A class joins texts of equal words and texts linked, directly or through others, by a weighted Jaccard
    similarity of five-word shingles of at least `similar` (texts under five words: one shingle of them
    all). class_id is the least doc_id of the class, and the row that bears it is kept. Null, empty and
    blank texts have no shingles and are classes of their own (class_id is their own doc_id, kept). Equal
    rows share a class and are told apart by nothing, so each row bearing class_id reads as kept;
    `deduplicate` leaves one. Null ids sort last. Other columns are not read.

    Equal texts collapse by aggregation before any pair is formed; signatures, not texts, are shuffled;
    shingles are fetched only for texts in candidate pairs.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(own.mapInArrow(_sign, f"doc_id {kind}, worded boolean, k1 bigint, k2 bigint, bands array<bigint>, {', '.join(c + ' bigint' for c in SKETCH)}"), "signed")
    texts = materialize(signed.where("worded").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("bands", *SKETCH), "k1").alias("v")).select("k1", "doc_id", "v.*"), "texts")
    buckets = texts.select(F.explode("bands").alias("key"), F.col("k1").alias("id"))

    def differing(x, y):
        """Coordinates whose two bits are not the same."""
        total = F.lit(0)
        for c in SKETCH:
            odd = x(c).bitwiseXOR(y(c))
            total = total + F.bit_count(odd.bitwiseOR(F.shiftrightunsigned(odd, 1)).bitwiseAND(0x5555555555555555))
        return total

    spent = []

    def bags_of(ids: DataFrame) -> DataFrame:
        wanted = materialize(texts.select("k1", "doc_id").join(ids, "k1", "left_semi"), "wanted")
        found = join_sized(own, wanted.select("doc_id").distinct(), own["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi", 16)
        bags = found.select("text").mapInArrow(_sets, "id bigint, bag binary").join(wanted.select(F.col("k1").alias("id")), "id", "left_semi").dropDuplicates(["id"])
        bags = materialize(bags, "bags")
        spent.extend([wanted, bags])
        return bags

    def verify(pairs: DataFrame) -> DataFrame:
        bags = bags_of(pairs.select(F.explode(F.array("a", "b")).alias("k1")).distinct())
        both = pairs.join(bags.select(F.col("id").alias("a"), F.col("bag").alias("x")), "a").join(bags.select(F.col("id").alias("b"), F.col("bag").alias("y")), "b")
        return both.select("a", "b", "x", "y").mapInArrow(_alike(similar), "a bigint, b bigint")

    def within(members: DataFrame) -> DataFrame:
        bags = bags_of(members.select(F.col("id").alias("k1")))
        return by_bucket(members.join(bags, "id")).mapInArrow(linked_within(_judges(similar)), "a bigint, b bigint")

    groups, _ = clusters(buckets, texts.select(F.col("k1").alias("id"), *SKETCH), differing, NEAR, verify, within=within)
    discard(*spent)
    rows = signed.select("doc_id", "worded", "k1", "k2")
    if groups is None:
        groups = spark.createDataFrame([], "id bigint, root bigint")
    least = materialize(texts.select("k1", "doc_id").join(groups.withColumnRenamed("id", "k1"), "k1", "left").withColumn("root", F.coalesce("root", "k1")), "roots")
    names = least.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    classes = materialize(least.join(names, "root").select("k1", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("has_least")), "classes")
    out = join_sized(rows, classes, "k1", "left", 24)
    single = ~F.col("worded")
    return out.select(
        F.col("doc_id").alias(id_col), "k1", "k2",
        F.when(single, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (single | (F.col("has_least") & F.col("doc_id").eqNullSafe(F.col("class_id")))).alias("kept"),
    )


def deduplicate(docs: DataFrame, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, with one of each class left: a row of the least id; of equal rows, one."""
    found = materialize(near_duplicates(docs, similar, id_col, text_col).select(F.col(id_col).alias("__id"), F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "kept"), "kept")
    lost = materialize(found.where("not kept").select("__id", "__k1", "__k2").distinct(), "lost")
    again = materialize(found.where("kept").groupBy("__id", "__k1", "__k2").count().where("count > 1").drop("count"), "again")
    schema = docs.schema.simpleString()[7:-1]
    tagged = docs.withColumn("__text", F.col(text_col)).mapInArrow(_tag, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", __k1 bigint, __k2 bigint, __worded boolean") if schema else docs

    def match(other: DataFrame):
        return tagged[id_col].eqNullSafe(other["__id"]) & (tagged["__k1"] == other["__k1"]) & (tagged["__k2"] == other["__k2"])

    kept = join_sized(tagged, lost, match(lost), "left_anti", 24)
    if again.where(F.lit(True)).isEmpty():
        return kept.drop("__k1", "__k2", "__worded")
    one = kept.join(again, (kept[id_col].eqNullSafe(again["__id"])) & (kept["__k1"] == again["__k1"]) & (kept["__k2"] == again["__k2"]), "left_semi")
    rest = kept.join(again, (kept[id_col].eqNullSafe(again["__id"])) & (kept["__k1"] == again["__k1"]) & (kept["__k2"] == again["__k2"]), "left_anti")
    worded = one.where("__worded").dropDuplicates([id_col, "__k1", "__k2"])
    return rest.unionByName(one.where("not __worded")).unionByName(worded).drop("__k1", "__k2", "__worded")
