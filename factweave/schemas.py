"""Explicit schemas of the fact base."""

from __future__ import annotations

from pyspark.sql.types import StructType

VERSION = "2"

TABLES: dict[str, str] = {
    "documents": "doc_id bigint, content_sha256 string, title string, source_path string, page_count int, published_date string, published_date_source string, primary_entity_key string, primary_entity_display string, ingested_at timestamp",
    "pages": "doc_id bigint, page_no int, printed_label string, text string, width double, height double",
    "blocks": "doc_id bigint, page_no int, idx int, kind string, text string, bbox array<double>, char_start int, char_end int, structural_confidence double",
    "raw_facts": "doc_id bigint, page_no int, block_id bigint, fact_kind string, entity_text string, attribute_label string, value_text string, unit_text string, period_text string, as_of_text string, estimate_status_text string, basis_text string, scope_text string, attributed_to_text string, quote string, self_confidence double, structural_confidence double, printed_label string, quote_match string, quote_char_start int, quote_char_end int",
    "facts": "id bigint, doc_id bigint, doc_title string, entity_key string, entity_display string, attribute_key string, attribute_display string, fact_kind string, value_text string, quote string, value_num double, currency string, unit_canonical string, scale_applied double, period_canonical string, as_of_date string, estimate_status string, basis_flags array<string>, scope_flags array<string>, attributed_to string, extraction_confidence double, sanity_flags array<string>, source_page int, printed_label string, quote_match string, content_hash string",
    "relations": "fact_a bigint, fact_b bigint, doc_a bigint, doc_b bigint, entity_key string, attribute_key string, bucket string, rule_code string, relation_confidence double, explanation string, rule_trace array<struct<step:string,result:string,rel_diff:double,note:string>>, explanation_source string",
    "entity_registry": "key string, aliases array<string>",
    "attribute_registry": "key string, aliases array<string>",
    "rejected_facts": "id bigint, doc_id bigint, page_no int, reason string, payload string",
    "extraction_errors": "id bigint, doc_id bigint, page_no int, error string, raw string",
    "job_events": "doc_id bigint, seq bigint, stage string, cursor int, total int, status string, error string",
    "schema_meta": "key string, value string",
}


def schema(name: str) -> StructType:
    """A table's schema; needs a session, which parses it."""
    return StructType.fromDDL(TABLES[name])
