"""Raw facts to comparable facts: the master projection, confidence and content hash (PF1, E11, E12, SNK4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import flags, keys, period, quantity, text

HASHED = ["entity_key", "attribute_key", "fact_kind", "hashed_value", "unit_canonical", "currency", "period_canonical", "as_of_date", "estimate_status", "basis_flags", "scope_flags", "attributed_to", "doc_id"]


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt to as many partitions as a shuffle has, by columns or in turn. For dear work on rows that come from a small
    file: that is read by one task, and Spark would join the small partitions of another shuffle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def content_hash() -> Column:
    """One digest for facts that state the same: within a document, whatever the page; numbers to three decimals."""
    value = F.when(F.col("value_num").isNotNull(), quantity.thousandths(F.col("value_num")).cast("string")).otherwise(F.lower(text.norm_ws(F.col("value_text"))))
    parts = [(value if c == "hashed_value" else F.col(c)).alias(c) for c in HASHED]
    numeric = F.col("value_num").isNotNull().alias("numeric")
    return F.sha2(F.to_json(F.struct(*parts, numeric), {"ignoreNullFields": "false"}), 256)


def normalize(raw: DataFrame, context: DataFrame) -> DataFrame:
    """Facts from raw facts (joined by doc_id to doc_title, primary_entity_key, published_date). A projection but for
    the join, which Spark broadcasts while documents are few."""
    docs = context.select("doc_id", "doc_title", "primary_entity_key", "published_date")
    r = raw.join(docs, "doc_id", "left")
    col = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    structural = F.coalesce(F.col("structural_confidence"), F.lit(0.9)) if "structural_confidence" in raw.columns else F.lit(0.9)
    value = text.strip_footnotes(text.norm_ws(col("value_text")))
    quote = text.norm_ws(col("quote"))
    q = quantity.parse_quantity(value, col("unit_text"), col("attribute_label"), F.coalesce(F.nullif(col("fact_kind"), F.lit("")), F.lit("numeric")))
    entity = keys.entity_key(col("entity_text"), F.col("primary_entity_key"))
    weight = F.when(col("quote_match") == "exact", 1.0).when(col("quote_match") == "fuzzy", 0.8).otherwise(0.6)
    own = F.coalesce(F.col("self_confidence"), F.lit(0.7)) if "self_confidence" in raw.columns else F.lit(0.7)
    out = r.withColumn("q", q).withColumn("value_clean", value).withColumn("quote_clean", quote)
    v, qc = F.col("value_clean"), F.col("quote_clean")
    carried = [c for c in ("id", "seq", "is_new") if c in raw.columns]
    out = out.select(
        *carried, "doc_id", "doc_title",
        F.coalesce(F.nullif(entity, F.lit("")), F.nullif(F.col("primary_entity_key"), F.lit("")), F.lit("unknown")).alias("entity_key"),
        F.coalesce(F.nullif(keys.person_display(col("entity_text")), F.lit("")), col("entity_text"), F.lit("")).alias("entity_display"),
        F.coalesce(F.nullif(keys.attribute_key(col("attribute_label")), F.lit("")), F.lit("unknown")).alias("attribute_key"),
        keys.attribute_display(col("attribute_label")).alias("attribute_display"),
        F.coalesce(F.nullif(col("fact_kind"), F.lit("")), F.when(F.col("q.value_num").isNotNull(), "numeric").otherwise("attribute")).alias("fact_kind"),
        v.alias("value_text"), qc.alias("quote"), "q.value_num", "q.currency", "q.unit_canonical", "q.scale_applied",
        F.coalesce(period.parse_period(col("period_text")), period.parse_period(qc)).alias("period_canonical"),
        period.resolve_as_of(F.coalesce(F.nullif(col("as_of_text"), F.lit("")), qc), F.col("published_date")).alias("as_of_date"),
        period.estimate_status(col("estimate_status_text"), col("basis_text"), qc).alias("estimate_status"),
        flags.basis_flags(col("basis_text"), qc).alias("basis_flags"),
        flags.scope_flags(col("scope_text"), qc).alias("scope_flags"),
        F.nullif(text.norm_ws(col("attributed_to_text")), F.lit("")).alias("attributed_to"),
        text.clip01(own * structural * weight).alias("extraction_confidence"),
        flags.sanity_flags(F.coalesce(F.nullif(col("fact_kind"), F.lit("")), F.lit("attribute")), col("attribute_label"), v, F.col("q.value_num"), F.col("q.unit_canonical"), structural).alias("sanity_flags"),
        (F.col("page_no") if "page_no" in raw.columns else F.lit(None).cast("int")).alias("source_page"),
        col("printed_label").alias("printed_label"), col("quote_match").alias("quote_match"),
    )
    return out.withColumn("content_hash", content_hash())


def first_by_hash(facts: DataFrame, order: str = "id", existing: DataFrame | None = None) -> DataFrame:
    """The first fact of each content hash that `existing` does not hold; insert-or-skip."""
    w = Window.partitionBy("content_hash").orderBy(order)
    out = facts.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    return out if existing is None else out.join(existing.select("content_hash"), "content_hash", "left_anti")
