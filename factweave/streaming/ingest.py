"""Documents in, relations out: pages, blocks, chunks, proposals, guard, facts, registries, pairs (ST2, ST4-ST6)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import SETTINGS, Settings
from ..operators import chunking, guard, registry
from ..operators.facts import content_hash, normalize
from ..operators.storage import FactStore
from ..plans import views
from ..sources.readers import text_pages
from .incremental import add_documents, add_facts

#: proposals (doc_id, page_no, source, the fields of a proposal), or those and errors, of (chunks, documents).
Propose = Callable[[DataFrame, DataFrame], "DataFrame | tuple[DataFrame, DataFrame]"]
#: Facts of a document have ids of their own up to this many.
IDS = 1 << 24


class Outage(Exception):
    """A source of proposals cannot be reached; the documents wait."""


def _jobs(store: FactStore, documents: DataFrame, status: str, **fields) -> None:
    """A job row for each of documents (doc_id)."""
    seq = (store.read("job_events").agg(F.max("seq")).first()[0] or 0) + 1
    row = {"stage": "extract", "error": None} | fields
    store.update_job(documents.select("doc_id", F.lit(seq).alias("seq"), F.lit(status).alias("status"), *[(v if not isinstance(v, (str, type(None))) else F.lit(v)).alias(k) for k, v in row.items()]))


def register(store: FactStore, documents: DataFrame) -> None:
    """Stores documents (title, text, and published_date and source_path if there are any) with their pages and blocks.

    Texts already stored, by their hash, add nothing; null texts are empty ones. Run again after it broke off, it
    adds what is missing.
    """
    given = documents.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("content_sha256", F.sha2("text", 256)).dropDuplicates(["content_sha256"])
    pages_of = given.select("content_sha256", F.posexplode(F.split("text", "\f")).alias("place", "text"))
    named = views.primary_entity(pages_of, "content_sha256").select("content_sha256", F.col("entity_key").alias("primary_entity_key"), F.col("display").alias("primary_entity_display"))
    add_documents(store, given.withColumn("page_count", F.size(F.split("text", "\f"))).withColumn("ingested_at", F.current_timestamp()).join(named, "content_sha256", "left"))
    own = given.select("content_sha256", "text").join(store.read("documents").select("doc_id", "content_sha256"), "content_sha256")
    store.insert_new(text_pages(own), "pages", ["doc_id", "page_no"])
    pages = store.read("pages").join(own.select("doc_id"), "doc_id", "left_semi")
    store.insert_new(chunking.page_blocks(pages), "blocks", ["doc_id", "page_no", "idx"])
    _jobs(store, own.join(store.jobs(), "doc_id", "left_anti"), "queued", stage="parse")


def linked(store: FactStore, facts: DataFrame, column: str, table: str, threshold: float) -> DataFrame:
    """facts with the keys in column replaced by those of the registry, which learns new keys and aliases.

    Keys are taken in order of their first (doc_id, source_page); what resembles no earlier key joins the registry.
    """
    known = store.read(table)
    seen = facts.select(F.col(column).alias("key"), F.struct("doc_id", "source_page").alias("first"))
    links = store.scratch(registry.link_in_order(seen, known, threshold, store.scratch))
    new = registry.register(known, links.where("key = canonical"))
    store.replace(registry.add_aliases(new, links), table)
    return registry.apply_links(facts, links, column)


def extract(store: FactStore, propose: Propose, settings: Settings = SETTINGS) -> bool:
    """Takes every stored document whose job is not done through proposals to relations, from its stored pages.

    Proposals whose quote is not in their source are rejected. If propose, or a task of it, raises Outage, the
    documents' jobs are paused with the reason, False is returned, and the next call takes them up again; what was
    stored before is skipped, so any break is safe to repeat.
    """
    done = store.jobs().where("status = 'done'").select("doc_id")
    todo = store.scratch(store.read("documents").join(done, "doc_id", "left_anti"))
    if todo.isEmpty():
        return True
    blocks = store.read("blocks").join(todo.select("doc_id"), "doc_id", "left_semi")
    chunks = store.scratch(chunking.chunks(blocks, settings.chunk_chars))
    total = todo.select("doc_id").join(chunks.groupBy("doc_id").agg(F.count("*").cast("int").alias("total")), "doc_id", "left").na.fill(0)
    count = lambda status, cursor, error=None: _jobs(store, total, status, cursor=cursor, total=F.col("total"), error=error)
    count("running", F.lit(0))
    try:
        found = propose(chunks, todo)
        proposals, errors = found if isinstance(found, tuple) else (found, None)
        if "source" not in proposals.columns:
            proposals = proposals.withColumn("source", F.col("text"))
        checked = store.scratch(guard.verify_quotes(proposals, threshold=settings.quote_score))
    except Exception as e:
        if not isinstance(e, Outage) and "Outage" not in str(e):
            count("failed", F.lit(0), str(e)[:2000])
            raise
        count("paused", F.lit(0), str(e)[:2000])
        store.sweep()
        return False
    passed, rejected = guard.split_guarded(checked)
    if errors is not None:
        store.log_errors(errors)
    store.insert_new(rejected, "rejected_facts", ["doc_id", "page_no", "reason", "payload"])
    labels = store.read("pages").select("doc_id", "page_no", "printed_label")
    passed = passed.drop("printed_label").join(labels, ["doc_id", "page_no"], "left")
    store.insert_new(passed, "raw_facts", ["doc_id", "page_no", "entity_text", "attribute_label", "value_text", "quote"])
    context = todo.select("doc_id", F.col("title").alias("doc_title"), "primary_entity_key", "published_date")
    facts = store.scratch(normalize(passed, context))
    facts = linked(store, facts, "entity_key", "entity_registry", settings.entity_score)
    facts = linked(store, facts, "attribute_key", "attribute_registry", settings.attribute_score)
    facts = facts.withColumn("content_hash", content_hash())
    place = Window.partitionBy("doc_id").orderBy("source_page", "content_hash", "quote")
    add_facts(store, store.scratch(facts.withColumn("id", F.col("doc_id") * IDS + F.row_number().over(place))), settings)
    count("done", F.col("total"))
    store.sweep()
    return True


def ingest(store: FactStore, documents: DataFrame, propose: Propose, settings: Settings = SETTINGS) -> bool:
    """`register`, then `extract`."""
    register(store, documents)
    return extract(store, propose, settings)
