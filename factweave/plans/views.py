"""Ready-made views of a fact base: counts, summaries, cases, queues (AG1-AG11, W1-W2, PF2-PF12, O1-O5, J2-J9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = ["corroborated", "contradiction", "reconciled", "unresolved"]
BUCKET_RANK = {"contradiction": 3, "reconciled": 2, "corroborated": 1, "unresolved": 0}


def ledger_counts(documents: DataFrame, facts: DataFrame, relations: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row: documents, facts, relations, rejected, and relations by bucket."""
    one = relations.agg(F.count("*").alias("relations"), *[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS])
    for name, df in (("documents", documents), ("facts", facts), ("rejected", rejected)):
        one = one.crossJoin(F.broadcast(df.agg(F.count("*").alias(name))))  # one row each
    return one.select("documents", "facts", "relations", "rejected", *BUCKETS)


def with_docs(relations: DataFrame, facts: DataFrame) -> DataFrame:
    """Relations with doc_a and doc_b, which relations that were not cut down already have."""
    if {"doc_a", "doc_b"} <= set(relations.columns):
        return relations
    ids = facts.select("id", "doc_id")
    return relations.join(ids.select(F.col("id").alias("fact_a"), F.col("doc_id").alias("doc_a")), "fact_a").join(ids.select(F.col("id").alias("fact_b"), F.col("doc_id").alias("doc_b")), "fact_b")


def doc_summary(documents: DataFrame, facts: DataFrame, relations: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """A row for every document: facts, rejected, relations, and relations by bucket; a relation within a document counts once."""
    held = with_docs(relations, facts).select("fact_a", "fact_b", "bucket", F.explode(F.array_distinct(F.array("doc_a", "doc_b"))).alias("doc_id"))
    by = held.groupBy("doc_id").agg(F.count("*").alias("relations"), *[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS])
    out = documents.select("doc_id").join(facts.groupBy("doc_id").agg(F.count("*").alias("facts")), "doc_id", "left").join(by, "doc_id", "left")
    names = ["facts", "relations", *BUCKETS]
    if rejected is not None:
        out = out.join(rejected.groupBy("doc_id").agg(F.count("*").alias("rejected")), "doc_id", "left")
        names.append("rejected")
    return out.na.fill(0, names)


def facts_filtered(facts: DataFrame, entity: str | None = None, attribute: str | None = None, doc: int | None = None, limit: int = 200) -> DataFrame:
    """Facts by id, at most 2,000, of an entity, an attribute and a document where given."""
    for column, value in (("entity_key", entity), ("attribute_key", attribute), ("doc_id", doc)):
        if value is not None:
            facts = facts.where(F.col(column) == value)
    return facts.orderBy("id").limit(min(limit, 2000))


def relations_by_doc(relations: DataFrame, facts: DataFrame, doc: int | None = None, bucket: str | None = None) -> DataFrame:
    out = with_docs(relations, facts)
    if bucket is not None:
        out = out.where(F.col("bucket") == bucket)
    return out if doc is None else out.where((F.col("doc_a") == doc) | (F.col("doc_b") == doc))


def brief(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Facts as shown: display names where there are any, the document's title, a short period."""
    titles = documents.select("doc_id", F.col("title").alias("document"))
    shown = lambda x, y: F.coalesce(F.nullif(F.col(x), F.lit("")), F.col(y))
    return facts.join(titles, "doc_id", "left").select("id", "doc_id", "document", shown("entity_display", "entity_key").alias("entity"), shown("attribute_display", "attribute_key").alias("attribute"), "value_text", "value_num", short_period(F.col("period_canonical")).alias("period"), "source_page")


def short_period(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "^FY:", "FY"), "^CY:", "CY"), "^(POINT:|RANGE:)", "")


def search(facts: DataFrame, columns: list[str], query: str) -> DataFrame:
    return facts.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.lower())))


def relation_view(relations: DataFrame, facts: DataFrame) -> DataFrame:
    """Relations with both facts nested as a and b."""
    cols = ["id", "doc_id", "value_text", "value_num", "period_canonical", "source_page"]
    nest = lambda p: facts.select(F.col("id").alias(f"fact_{p}"), F.struct(*cols).alias(p))
    return relations.join(nest("a"), "fact_a").join(nest("b"), "fact_b")


def best_cases(relations: DataFrame, facts: DataFrame, bucket: str, n: int = 3, rules: list[str] | None = None, cross_doc: bool = False, diversify: bool = True) -> DataFrame:
    """The n surest relations of a bucket, of certain rules, across documents, one for each attribute, as asked."""
    out = relations.where(F.col("bucket") == bucket)
    if rules:
        out = out.where(F.col("rule_code").isin(*rules))
    if cross_doc:
        out = with_docs(out, facts).where("doc_a <> doc_b")
    order = [F.desc("relation_confidence"), "fact_a", "fact_b"]
    if diversify:
        out = out.withColumn("rn", F.row_number().over(Window.partitionBy("attribute_key").orderBy(*order))).where("rn = 1").drop("rn")
    return out.orderBy(*order).limit(n)


#: The report's picks: bucket, how many, of which rules, whether across documents only, whether one for each attribute.
PICKS: dict[str, tuple[str, int, list[str] | None, bool, bool]] = {
    "corroboration": ("corroborated", 4, None, True, True),
    "contradiction": ("contradiction", 3, None, False, False),
    "reconciled_vintage": ("reconciled", 2, ["ESTIMATE_VINTAGE"], False, True),
    "reconciled_period": ("reconciled", 2, ["PERIOD"], False, True),
    "reconciled_basis": ("reconciled", 2, ["BASIS", "SCOPE", "IDENTIFIER_REVISION", "UNIT_SCALE"], False, True),
    "reconciled_temporal": ("reconciled", 1, ["TEMPORAL_STATUS"], False, True),
}


def cases(relations: DataFrame, facts: DataFrame) -> DataFrame:
    """The report's picks, by name, with fact_a, fact_b, rule_code and relation_confidence; see best_cases.

    All picks come of one pass over the relations: a relation is dealt to the picks it suits, the surest of each
    attribute is kept by an aggregation, and the few that are asked for by a rank that Spark limits before its shuffle.
    """
    suits, alone, many = [], [], []
    for name, (bucket, n, rules, cross_doc, diversify) in PICKS.items():
        test = F.col("bucket") == bucket
        if rules:
            test &= F.col("rule_code").isin(*rules)
        if cross_doc:
            test &= F.col("doc_a") != F.col("doc_b")
        suits.append(F.when(test, name))
        alone += [name] if not diversify else []
        many.append((F.col("name") == name) & (F.col("rn") <= n))
    dealt = with_docs(relations, facts).select(F.explode(F.array_compact(F.array(*suits))).alias("name"), "attribute_key", F.struct((-F.col("relation_confidence")).alias("low"), "fact_a", "fact_b", "rule_code").alias("pick"))
    apart = F.when(F.col("name").isin(*alone), F.struct("pick.fact_a", "pick.fact_b"))
    best = dealt.groupBy("name", "attribute_key", apart.alias("apart")).agg(F.min("pick").alias("pick"))
    top = best.withColumn("rn", F.row_number().over(Window.partitionBy("name").orderBy("pick"))).where(F.col("rn") <= max(p[1] for p in PICKS.values()))
    wanted = many[0]
    for m in many[1:]:
        wanted |= m
    return top.where(wanted).select("name", "pick.fact_a", "pick.fact_b", "pick.rule_code", (-F.col("pick.low")).alias("relation_confidence"))


def fact_relations(facts: DataFrame, relations: DataFrame) -> DataFrame:
    """A row for every fact and relation of it, seen from the fact; facts without one once, with nulls."""
    sides = relations.select("bucket", "rule_code", "relation_confidence", F.explode(F.array(F.struct(F.col("fact_a").alias("id"), F.col("fact_b").alias("other")), F.struct(F.col("fact_b").alias("id"), F.col("fact_a").alias("other")))).alias("s")).select("s.*", "bucket", "rule_code", "relation_confidence")
    return facts.select("id").join(sides, "id", "left")


def primary_relation(facts: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, status): the weightiest bucket among a fact's relations; `extracted` if it has none."""
    rank = F.element_at(F.create_map(*[F.lit(x) for pair in BUCKET_RANK.items() for x in pair]), F.col("bucket"))
    best = fact_relations(facts, relations).groupBy("id").agg(F.max_by("bucket", F.when(F.col("bucket").isNotNull(), rank)).alias("bucket"))
    return best.select("id", F.coalesce("bucket", F.lit("extracted")).alias("status"))


def review_queue(facts: DataFrame, limit: int = 100) -> DataFrame:
    """The last facts with sanity flags."""
    return facts.where(F.size("sanity_flags") > 0).orderBy(F.desc("id")).limit(limit)


def quarantine(rows: DataFrame, documents: DataFrame, limit: int) -> DataFrame:
    """The last rejected facts (200) or errors (100), with their document's title."""
    return rows.join(documents.select("doc_id", "title"), "doc_id").orderBy(F.desc("id")).limit(limit)


def docs_with_jobs(documents: DataFrame, facts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Documents with their number of facts and the state of their job, `?` if none."""
    n = facts.groupBy("doc_id").agg(F.count("*").alias("facts"))
    out = documents.join(n, "doc_id", "left").join(jobs.select("doc_id", F.col("status").alias("job_status"), F.col("stage").alias("job_stage")), "doc_id", "left")
    return out.na.fill(0, ["facts"]).na.fill("?", ["job_status", "job_stage"])


def rule_mix(relations: DataFrame) -> DataFrame:
    return relations.groupBy("bucket", "rule_code").agg(F.count("*").alias("n"))


def primary_entity(pages: DataFrame, by: str) -> DataFrame:
    """The commonest organisation-like phrase of each group's texts; of equals, the first seen."""
    from ..functions.keys import ORGANISATION, entity_key
    from ..functions.text import norm_ws

    found = pages.select(by, "place", F.posexplode(F.regexp_extract_all("text", F.lit(ORGANISATION))).alias("pos", "name"))
    counted = found.groupBy(by, "name").agg(F.count("*").alias("n"), F.min(F.struct("place", "pos")).alias("first"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), "first")
    return counted.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(by, entity_key(F.col("name")).alias("entity_key"), norm_ws(F.col("name")).alias("display"), "n")


def shown_evidence(relations: DataFrame) -> DataFrame:
    """Confidence and trace as the report prints them."""
    trace = F.transform("rule_trace", lambda s: F.concat(s["step"], F.lit("="), F.coalesce(s["result"], F.lit("")), F.when(s["rel_diff"].isNotNull(), F.format_string(" (%.4f)", s["rel_diff"])).otherwise("")))
    return relations.select("fact_a", "fact_b", F.format_string("%.2f", "relation_confidence").alias("confidence"), F.array_join(trace, " > ").alias("trace"), F.substring("explanation", 1, 120).alias("explanation"))
