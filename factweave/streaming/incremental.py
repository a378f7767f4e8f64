"""Incremental fact bases: new facts meet old ones, batch by batch (ST1-ST6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import SETTINGS, Settings
from ..operators.facts import first_by_hash
from ..operators.reconcile import pair_facts, reconcile, touched, unknown_pairs
from ..operators.storage import FactStore


def add_facts(store: FactStore, new: DataFrame, settings: Settings = SETTINGS) -> None:
    """Stores the facts whose content hash is new, then relates them to all facts of their blocks.

    Run again with the same facts it changes nothing, so a replayed batch is safe: facts are skipped by hash and
    relations by pair, and pairs are sought for every stored fact of the batch, stored just now or before the crash.
    """
    had = store.read("facts")
    fresh = first_by_hash(store.shaped(new, "facts"), "id", had)
    store.append(fresh, "facts")
    facts = store.read("facts")
    batch = facts.join(new.select("content_hash").distinct(), "content_hash", "left_semi").select("id").withColumn("is_new", F.lit(True))
    marked = facts.join(batch, "id", "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))
    near = touched(marked, marked.where("is_new"))
    pairs = unknown_pairs(pair_facts(near, settings, incremental=True), store.read("relations"))
    relations = reconcile(pairs, settings)
    store.append(relations, "relations")


def rebuild(store: FactStore, settings: Settings = SETTINGS) -> None:
    """Replaces all relations by those of all facts."""
    store.replace(reconcile(pair_facts(store.read("facts"), settings), settings), "relations")


def add_documents(store: FactStore, documents: DataFrame) -> DataFrame:
    """Registers the documents (content_sha256, ...) that the store lacks, and returns them. Ids go on from the last."""
    from pyspark.sql.window import Window

    known = store.read("documents")
    last = known.agg(F.max("doc_id")).first()[0] or 0
    new = documents.dropDuplicates(["content_sha256"]).join(known.select("content_sha256"), "content_sha256", "left_anti")
    # Batches of a file stream are a few documents; one ordered pass numbers them.
    new = new.drop("doc_id").withColumn("doc_id", F.row_number().over(Window.orderBy("content_sha256")) + F.lit(last))
    store.append(new, "documents")
    return store.read("documents").where(F.col("doc_id") > last)


def follow(store: FactStore, stream: DataFrame, to_facts, checkpoint: str, settings: Settings = SETTINGS, trigger: dict | None = None) -> StreamingQuery:
    """Runs to_facts(batch) on each micro-batch and adds its facts. The checkpoint is the resumable cursor; a batch that
    fails, as when a source is out, is run again, and what it had stored is skipped."""

    def each(batch: DataFrame, _: int) -> None:
        add_facts(store, to_facts(batch), settings)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
