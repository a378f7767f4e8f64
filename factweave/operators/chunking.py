"""Pages to blocks to chunks (W3, AG6, AG7, J10, J11, T9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import SETTINGS
from ..functions import flags, text


def page_blocks(pages: DataFrame) -> DataFrame:
    """Blocks (doc_id, page_no, idx, kind, text, char_start, char_end, structural_confidence) of pages (doc_id, page_no,
    text, is_deck?): lines with text, white space folded, each where its text stands in the page."""
    deck = F.coalesce(F.col("is_deck"), F.lit(False)) if "is_deck" in pages.columns else F.lit(False)
    lines = F.filter(F.transform(F.split("text", r"\n"), text.norm_ws), lambda x: x != "")
    found = pages.select("doc_id", "page_no", F.col("text").alias("page_text"), deck.alias("deck"), F.posexplode(lines).alias("idx", "text"))
    start = F.greatest(F.position(F.col("text"), F.col("page_text")) - 1, F.lit(0))
    return found.withColumn("c", flags.classify_block(F.col("text"), F.col("deck"))).select(
        "doc_id", "page_no", "idx", "c.kind", "text", start.alias("char_start"), (start + F.length("text")).alias("char_end"), "c.structural_confidence",
    )


def chunks(blocks: DataFrame, target: int = SETTINGS.chunk_chars) -> DataFrame:
    """Chunks (doc_id, page_no, idx, block_ids, text, structural_confidence, first_confidence) of whole blocks.

    Blocks are taken up, in order, until their lengths with a line break each reach the target; chunks end with their
    page. That is a fold with reset over one page's blocks, so it runs as an `aggregate` in the JVM; a page is the
    unit that must fit a task. idx numbers a document's chunks.
    """
    page = blocks.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("idx", "text", "structural_confidence"))).alias("b"))
    step = lambda s, x: F.struct(
        F.when(s["size"] + F.length(x["text"]) + 1 >= target, 0).otherwise(s["size"] + F.length(x["text"]) + 1).alias("size"),
        F.when(s["size"] + F.length(x["text"]) + 1 >= target, s["n"] + 1).otherwise(s["n"]).alias("n"),
        F.concat(s["of"], F.array(s["n"])).alias("of"),
    )
    start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("of"))
    cut = page.withColumn("of", F.aggregate("b", start, step)["of"])
    flat = cut.select("doc_id", "page_no", F.explode(F.arrays_zip("b", "of")).alias("z")).select("doc_id", "page_no", F.col("z.of").alias("part"), "z.b.*")
    made = flat.groupBy("doc_id", "page_no", "part").agg(F.array_sort(F.collect_list(F.struct("idx", "text", "structural_confidence"))).alias("b"), F.min("structural_confidence").alias("structural_confidence"))
    order = Window.partitionBy("doc_id").orderBy("page_no", "part")
    return made.select(
        "doc_id", "page_no", (F.row_number().over(order) - 1).alias("idx"), F.transform("b", lambda x: x["idx"]).alias("block_ids"),
        F.array_join(F.transform("b", lambda x: x["text"]), "\n").alias("text"), "structural_confidence", F.element_at("b", 1)["structural_confidence"].alias("first_confidence"),
    )
