"""Language identification by compression: the language whose raw-content dictionary compresses a text best.

Fitting takes, for each language, at most SAMPLES documents (those with the smallest hash of their id in
each of SAMPLES hash classes) and SAMPLE_CHARS characters of each; these bounds are parameters. Scoring
reads every whole text: it is cut into blocks of BLOCK bytes, so that a long text's own repetitions do
not drown the dictionaries, and the compressed sizes of all blocks are added up.
"""

from __future__ import annotations

import re

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import held

SAMPLES = 96
SAMPLE_CHARS = 2048
BLOCK = 2000
LEVEL = 3
#: Languages at most; fitting fails beyond, as every block is compressed once for each.
MAX_LANGUAGES = 400
#: Relative gap between the best and the second size below which a text is rejected.
MARGIN = 0.002
UNKNOWN = "und"

_letter = regex.compile(r"\p{L}")
_other = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """What language shows in: lower-case words, single blanks for all that stands between them."""
    return _other.sub(" ", text.lower())


def held_out(id_col: str | Column = "doc_id") -> Column:
    """Whether a document is kept out of fitting: crc32 of the id's text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, samples: int = SAMPLES, chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """Dictionary content by language, from documents that are not held out and have a lang.

    Two narrow scans and one small aggregation: the first finds the smallest id hash of each (lang, class)
    without touching texts, the second fetches those documents. At most samples * chars characters for
    each language come to the driver. No labelled rows give no languages.
    """
    own = docs.where(F.col("lang").isNotNull() & ~held_out()).select("lang", "doc_id", "text", F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)).alias("at"))
    own = own.where(F.length("text") > 0).withColumn("class", F.pmod("at", F.lit(samples)))
    chosen = own.groupBy("lang", "class").agg(F.min("at").alias("at")).limit(MAX_LANGUAGES * samples + 1).collect()
    languages = sorted({r["lang"] for r in chosen})
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not languages:
        return {}
    keys = docs.sparkSession.createDataFrame([(r["lang"], r["class"], r["at"]) for r in chosen], "lang string, class long, at long")
    found = own.join(F.broadcast(keys), ["lang", "class", "at"]).groupBy("lang", "class").agg(F.min(F.substring("text", 1, chars)).alias("text"))
    parts: dict[str, list[tuple[int, str]]] = {}
    for r in found.collect():
        parts.setdefault(r["lang"], []).append((r["class"], r["text"]))
    return {k: letters(" ".join(t for _, t in sorted(v))).encode("utf-8") for k, v in sorted(parts.items())}


class Scorer:
    def __init__(self, content: dict[str, bytes], level: int = LEVEL, block: int = BLOCK):
        self.languages, self.block = list(content), block
        self.coders = [
            zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False, dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress
            for c in content.values()
        ]

    def sizes(self, text: str) -> list[int]:
        """Compressed bytes of the whole text under every language's dictionary."""
        raw = letters(text).encode("utf-8")
        blocks = [raw[i : i + self.block] for i in range(0, len(raw), self.block)] or [b""]
        return [sum([len(coder(b)) for b in blocks]) for coder in self.coders]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin): und, 0, 0 without a letter. The score is 0.5 at a
        tie (which goes to the first language by name) and rises with the margin to 1 at a gap of a twentieth."""
        if not text or not self.coders or not _letter.search(text):
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(text)
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        best = sizes[order[0]]
        second = sizes[order[1]] if len(order) > 1 else 2 * best
        margin = (second - best) / max(second, 1)
        return self.languages[order[0]], min(1.0, 0.5 + 10 * margin), margin


def _scorer(content: dict[str, bytes]) -> Scorer:
    return held("language", tuple(content.items()), lambda: Scorer(content))


def predict(docs: DataFrame, content: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1), rejected for every row of docs.

    The texts alone decide. Null and letterless texts are und, score 0, rejected. A gap under margin
    between the two best languages is rejected too, with its best guess kept in lang_pred. Repeated rows
    get a row each; other columns are not read. One narrow pass; the dictionaries are bounded by
    MAX_LANGUAGES * SAMPLES * SAMPLE_CHARS characters and travel as a broadcast variable.
    """
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches):
        scorer = _scorer(shared.value)
        for batch in batches:
            found = [scorer.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[0] == UNKNOWN or f[2] < margin for f in found], pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, content: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns, in one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(content)
    at = docs.columns.index("text")

    def run(batches):
        scorer = _scorer(shared.value)
        for batch in batches:
            found = [scorer.predict(t.as_py()) for t in batch.column(at)]
            yield batch.filter(pa.array([f[0] != UNKNOWN and f[2] >= margin for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
