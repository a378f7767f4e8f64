"""Sources: files, replayed extractions, and providers of proposed facts (SRC1-SRC13)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import flags
from ..schemas import TABLES

PROPOSAL = (
    "fact_kind string, entity_text string, attribute_label string, value_text string, unit_text string, period_text string, as_of_text string, "
    "estimate_status_text string, basis_text string, scope_text string, attributed_to_text string, quote string, self_confidence string"
)
#: Texts that stand for nothing.
MISSING = ("", "null", "none", "n/a", "na")
REQUIRED = ("entity_text", "attribute_label", "value_text", "quote")


def files(spark: SparkSession, paths: str | list[str], glob: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """(path, stem, content_sha256, content) of files, by path; missing ones are skipped. Listing and reading are
    Spark's, so any store will do; leave out content when it is not needed, and it is not kept."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).option("ignoreMissingFiles", "true")
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1)
    return reader.load(paths).select("path", stem.alias("stem"), F.sha2("content", 256).alias("content_sha256"), "content")


def stream_files(spark: SparkSession, path: str, glob: str = "*.pdf", per_batch: int = 1) -> DataFrame:
    """New files of a landing folder, a few to a micro-batch."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch).load(path)


def is_pdf_name(name):
    return F.endswith(F.lower(name), F.lit(".pdf"))


def text_pages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Plain documents as pages: form feeds separate them."""
    out = documents.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\f")).alias("page_no", "text"))
    out = out.withColumn("page_no", F.col("page_no") + 1)
    return out.select("doc_id", "page_no", flags.printed_label(F.col("text"), F.col("page_no")).alias("printed_label"), "text", F.lit(None).cast("double").alias("width"), F.lit(None).cast("double").alias("height"))


def replies(chunks: DataFrame, reply_col: str = "reply") -> tuple[DataFrame, DataFrame]:
    """(proposals, errors) of chunks with a model's reply: repaired, parsed with a fixed schema, and checked as a whole.

    A reply that does not parse, or one of whose facts lacks an entity, attribute, value or quote, is an error.
    """
    parsed = chunks.withColumn("__json", flags.repair_json(F.col(reply_col))).withColumn("__facts", F.from_json("__json", f"facts array<struct<{', '.join(p.replace(' ', ':', 1) for p in PROPOSAL.split(', '))}>>")["facts"])
    clear = lambda c: F.when(~F.lower(F.trim(c)).isin(*MISSING), c)
    whole = parsed.withColumn("__ok", F.col("__facts").isNotNull() & F.forall("__facts", lambda f: F.concat(*[F.coalesce(clear(f[c]), F.lit("")) for c in REQUIRED]).isNotNull() & F.least(*[F.length(F.coalesce(clear(f[c]), F.lit(""))) for c in REQUIRED]).__gt__(0)))
    keep = [c for c in chunks.columns if c != reply_col]
    rows = whole.where(F.coalesce("__ok", F.lit(False))).select(*keep, F.explode("__facts").alias("f")).select(*keep, "f.*")
    names = [p.split(" ")[0] for p in PROPOSAL.split(", ")]
    cleaned = rows.select(*keep, *[clear(F.col(n)).alias(n) for n in names if n not in ("self_confidence", "fact_kind")], F.coalesce(clear(F.col("fact_kind")), F.lit("attribute")).alias("fact_kind"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("self_confidence").try_cast("double"), F.lit(0.7)))).alias("self_confidence"))
    errors = whole.where(~F.coalesce("__ok", F.lit(False))).select(*[c for c in ("doc_id", "page_no") if c in keep], F.lit("the reply is not a list of complete facts").alias("error"), F.col(reply_col).alias("raw"))
    return cleaned, errors


def replay(spark: SparkSession, path: str | list[str], chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Recorded proposals of JSON files {title_contains, pages: {page: [fact]}} for chunks of documents (doc_id, title).

    A document takes the first file, by name, whose title_contains its title contains, whatever the case; each page's
    facts go to the page's first chunk.
    """
    fact = f"struct<{', '.join(p.replace(' ', ':', 1) for p in PROPOSAL.split(', '))}>"
    recorded = spark.read.option("multiLine", True).schema(f"title_contains string, pages map<string, array<{fact}>>").json(path).select(F.col("_metadata.file_path").alias("file"), "*")
    titled = documents.select("doc_id", "title").join(F.broadcast(recorded), F.contains(F.lower("title"), F.lower("title_contains")))
    first = titled.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("file"))).where("rn = 1")
    facts = first.select("doc_id", F.explode("pages").alias("page", "facts")).select("doc_id", F.col("page").cast("int").alias("page_no"), F.explode("facts").alias("f")).select("doc_id", "page_no", "f.*")
    opening = chunks.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("idx"))).where("rn = 1").select("doc_id", "page_no", F.col("text").alias("source"), F.col("first_confidence").alias("structural_confidence"))
    return facts.withColumn("self_confidence", F.coalesce(F.col("self_confidence").try_cast("double"), F.lit(0.7))).join(opening, ["doc_id", "page_no"])


def nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TABLES["raw_facts"])


_providers: dict[str, Callable[..., DataFrame]] = {"null": lambda spark, **_: nothing(spark), "replay": replay}
_ALIASES = {"none": "null", "off": "null"}


def register_provider(name: str, factory: Callable[..., DataFrame]) -> None:
    """Adds a source of proposals, such as a model behind `mapInPandas`."""
    _providers[name] = factory


def provider(name: str) -> Callable[..., DataFrame]:
    name = (name or "null").lower()
    name = _ALIASES.get(name, name)
    if name not in _providers:
        raise ValueError(f"no provider is named {name!r}")
    return _providers[name]
