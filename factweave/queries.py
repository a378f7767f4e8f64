"""Queries of the fact base over the sample tables, each with the same query as DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import flags, keys, period, quantity, text
from .operators import chunking, guard, reconcile, registry
from .operators.facts import content_hash, normalize, spread
from .plans import samples, views
from .sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, cte: str, name: str, tables: tuple[str, ...]) -> DataFrame:
    samples.view(spark, sf_dir, tables)
    return spark.sql(f"WITH {cte} SELECT * FROM {name}")


# ---- pairs and relations -------------------------------------------------------------------------------------------

_PAIRS = f"""
WITH {samples.FACTS},
r AS (SELECT *, row_number() OVER (PARTITION BY entity_key, attribute_key ORDER BY id) AS rn FROM f),
p AS (
  SELECT a.*, {', '.join(f'b.{c} AS b_{c}' for c in ['id', 'doc_id', 'fact_kind', 'value_text', 'value_num', 'currency', 'unit_canonical', 'period_canonical', 'as_of_date', 'estimate_status', 'basis_text', 'scope_text', 'sanity_text', 'attributed_to', 'extraction_confidence', 'source_page', 'content_hash', 'doc_title'])}
  FROM r a JOIN r b ON a.entity_key = b.entity_key AND a.attribute_key = b.attribute_key AND a.id < b.id
   AND (b.rn <= 60 OR coalesce(nullif(a.period_canonical, ''), '-') = coalesce(nullif(b.period_canonical, ''), '-'))
   AND NOT (a.content_hash <> '' AND a.content_hash = b.content_hash)
)
"""

_COMPARED = (
    _PAIRS
    + """,
q AS (
  SELECT *, value_num IS NOT NULL AND unit_canonical <> 'text' AS an, b_value_num IS NOT NULL AND b_unit_canonical <> 'text' AS bn,
    abs(value_num - b_value_num) / greatest(abs(value_num), abs(b_value_num), 1e-9) AS rel,
    trim(lower(regexp_replace(value_text, '\\s+', ' ', 'g'))) AS sa, trim(lower(regexp_replace(b_value_text, '\\s+', ' ', 'g'))) AS sb,
    regexp_extract(value_text, '\\b(\\d{5,6})\\b', 1) AS pa, regexp_extract(b_value_text, '\\b(\\d{5,6})\\b', 1) AS pb
  FROM p
), c AS (
  SELECT *, CASE WHEN an AND bn AND unit_canonical <> b_unit_canonical THEN 'INCOMPARABLE'
      WHEN an AND bn AND coalesce(currency, '') <> '' AND coalesce(b_currency, '') <> '' AND currency <> b_currency THEN 'INCOMPARABLE'
      WHEN an AND bn AND rel <= 0.005 THEN 'EQUAL' WHEN an AND bn THEN 'DIFFERENT' WHEN an <> bn THEN 'INCOMPARABLE'
      WHEN sa = sb AND sa <> '' THEN 'EQUAL' WHEN pa <> '' AND pb <> '' AND pa = pb THEN 'EQUAL' WHEN pa <> '' AND pb <> '' THEN 'DIFFERENT'
      WHEN sa = '' OR sb = '' THEN 'INCOMPARABLE' WHEN contains(sb, sa) OR contains(sa, sb) THEN 'EQUAL' ELSE 'DIFFERENT' END AS result
  FROM q
)
"""
)

_RULED = (
    _COMPARED
    + """,
d AS (
  SELECT *, CASE estimate_status WHEN 'projection' THEN 0 WHEN 'first_advance' THEN 1 WHEN 'second_advance' THEN 2 WHEN 'revised' THEN 4 WHEN 'actual' THEN 5 ELSE 3 END AS ra,
    CASE b_estimate_status WHEN 'projection' THEN 0 WHEN 'first_advance' THEN 1 WHEN 'second_advance' THEN 2 WHEN 'revised' THEN 4 WHEN 'actual' THEN 5 ELSE 3 END AS rb,
    coalesce(abs(date_diff('day', try_strptime(substr(as_of_date, 1, 10), '%Y-%m-%d')::DATE, try_strptime(substr(b_as_of_date, 1, 10), '%Y-%m-%d')::DATE)) >= 45, false) AS apart,
    floor(log10(abs(value_num))) AS ea, floor(log10(abs(b_value_num))) AS eb, abs(value_num) / nullif(abs(b_value_num), 0) AS ratio
  FROM c
), e AS (
  SELECT *,
    coalesce(value_num = b_value_num OR round(value_num / power(10.0, ea - 2)) * power(10.0, ea - 2) = round(b_value_num / power(10.0, eb - 2)) * power(10.0, eb - 2), false) AS rounding,
    coalesce(value_num <> 0 AND b_value_num <> 0 AND (abs(ratio - 0.001) / 0.001 <= 0.02 OR abs(ratio - 0.01) / 0.01 <= 0.02 OR abs(ratio - 0.1) / 0.1 <= 0.02
      OR abs(ratio - 10) / 10 <= 0.02 OR abs(ratio - 100) / 100 <= 0.02 OR abs(ratio - 1000) / 1000 <= 0.02), false) AS unit_scale,
    coalesce(period_canonical <> '' AND b_period_canonical <> '' AND period_canonical <> b_period_canonical, false) AS period,
    fact_kind IN ('status', 'event') AND b_fact_kind IN ('status', 'event') AND apart AS temporal_status,
    fact_kind = 'numeric' AND b_fact_kind = 'numeric' AND value_num IS NOT NULL AND b_value_num IS NOT NULL
      AND (((coalesce(estimate_status, '') <> '' OR coalesce(b_estimate_status, '') <> '') AND ra <> rb) OR apart) AS vintage,
    scope_text <> b_scope_text AS scope, basis_text <> b_basis_text AS basis,
    value_num IS NULL AND b_value_num IS NULL AND regexp_matches(attribute_key, 'identity|identifier') AND value_text <> b_value_text AND length(value_text) = length(b_value_text)
      AND hamming(value_text, CASE WHEN length(value_text) = length(b_value_text) THEN b_value_text ELSE value_text END) <= 2 AS identifier,
    lower(coalesce(attributed_to, '')) <> lower(coalesce(b_attributed_to, '')) AS attribution,
    doc_id = b_doc_id AND source_page = b_source_page AS same_page, sanity_text <> '' OR b_sanity_text <> '' AS flagged
  FROM d
), g AS (
  SELECT *, CASE WHEN result = 'EQUAL' AND same_page THEN 'DUPLICATE' WHEN result = 'EQUAL' THEN 'EXACT' WHEN result = 'INCOMPARABLE' THEN 'INCOMPARABLE'
    WHEN rounding THEN 'ROUNDING' WHEN unit_scale THEN 'UNIT_SCALE' WHEN period THEN 'PERIOD' WHEN temporal_status THEN 'TEMPORAL_STATUS' WHEN vintage THEN 'ESTIMATE_VINTAGE'
    WHEN scope THEN 'SCOPE' WHEN basis THEN 'BASIS' WHEN identifier THEN 'IDENTIFIER_REVISION' WHEN attribution THEN 'ATTRIBUTION'
    WHEN least(extraction_confidence, b_extraction_confidence) >= 0.45 AND NOT flagged THEN 'NONE' ELSE 'NONE_LOWCONF' END AS rule_code
  FROM e
), rel AS (
  SELECT id AS fact_a, b_id AS fact_b, doc_id AS doc_a, b_doc_id AS doc_b, entity_key, attribute_key, rule_code,
    CASE WHEN rule_code IN ('DUPLICATE', 'INCOMPARABLE', 'NONE_LOWCONF', 'ATTRIBUTION') THEN 'unresolved' WHEN rule_code = 'EXACT' THEN 'corroborated' WHEN rule_code = 'NONE' THEN 'contradiction'
      WHEN rule_code = 'ROUNDING' AND same_page THEN 'unresolved' WHEN rule_code = 'ROUNDING' THEN 'corroborated' ELSE 'reconciled' END AS bucket,
    round(CASE WHEN rule_code IN ('DUPLICATE', 'INCOMPARABLE') THEN 0.3 ELSE
      (CASE rule_code WHEN 'EXACT' THEN 0.95 WHEN 'ROUNDING' THEN 0.9 WHEN 'UNIT_SCALE' THEN 0.8 WHEN 'PERIOD' THEN 0.9 WHEN 'ESTIMATE_VINTAGE' THEN 0.85 WHEN 'SCOPE' THEN 0.8 WHEN 'BASIS' THEN 0.8
        WHEN 'IDENTIFIER_REVISION' THEN 0.75 WHEN 'ATTRIBUTION' THEN 0.6 ELSE 0.7 END)
      * least(coalesce(nullif(extraction_confidence, 0), 0.5), coalesce(nullif(b_extraction_confidence, 0), 0.5)) * CASE WHEN flagged THEN 0.6 ELSE 1.0 END END, 6) AS confidence
  FROM g
)
"""
)


def _relations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = samples.facts(spark, sf_dir)
    return own, reconcile.relate(own)


def _sure():
    return F.round("relation_confidence", 6).alias("confidence")



@query(_PAIRS + "SELECT id AS fact_a, b_id AS fact_b FROM p")
def pairs_blocked(spark, sf_dir):
    """J1, W4, AG4, SO5."""
    return reconcile.pair_facts(samples.facts(spark, sf_dir)).select(F.col("a_id").alias("fact_a"), F.col("b_id").alias("fact_b"))


@query(_PAIRS + "SELECT id AS fact_a, b_id AS fact_b FROM p WHERE (doc_id = 5 OR b_doc_id = 5) AND NOT (doc_id = 1 AND b_doc_id = 5 AND id % 2 = 0)")
def pairs_incremental(spark, sf_dir):
    """J3, J5, AG8, ST1: pairs with a fact of document 5, without those of a relation already held."""
    own = samples.facts(spark, sf_dir).withColumn("is_new", F.col("doc_id") == 5)
    near = reconcile.touched(own, own.where("is_new"))
    pairs = reconcile.pair_facts(near, incremental=True)
    held = pairs.where("a_doc_id = 1 and b_doc_id = 5 and a_id % 2 = 0").select(F.col("a_id").alias("fact_a"), F.col("b_id").alias("fact_b"))
    return reconcile.unknown_pairs(pairs, held).select(F.col("a_id").alias("fact_a"), F.col("b_id").alias("fact_b"))


@query(_COMPARED + "SELECT id AS fact_a, b_id AS fact_b, result, CASE WHEN an AND bn AND result <> 'INCOMPARABLE' THEN round(rel, 9) END AS rel_diff FROM c")
def compare_facts(spark, sf_dir):
    """R1, N8, H6."""
    pairs = reconcile.pair_facts(samples.facts(spark, sf_dir)).withColumn("c", reconcile.compare())
    return pairs.select(F.col("a_id").alias("fact_a"), F.col("b_id").alias("fact_b"), "c.result", F.round("c.rel_diff", 9).alias("rel_diff"))


@query(_RULED + "SELECT id AS fact_a, b_id AS fact_b, rounding, unit_scale, period, temporal_status, vintage, scope, basis, identifier, attribution FROM e WHERE value_num IS NOT NULL OR identifier IS NOT NULL")
def rules_applied(spark, sf_dir):
    """R2-R10, N7, D5, D8, H2, SO1, SO3: every rule on every pair, whatever comes before it."""
    pairs = reconcile._with_similarity(reconcile.pair_facts(samples.facts(spark, sf_dir)))
    names = {"ROUNDING": "rounding", "UNIT_SCALE": "unit_scale", "PERIOD": "period", "TEMPORAL_STATUS": "temporal_status", "ESTIMATE_VINTAGE": "vintage", "SCOPE": "scope", "BASIS": "basis", "IDENTIFIER_REVISION": "identifier", "ATTRIBUTION": "attribution"}
    tests = []
    for code, rule, _ in reconcile.CASCADE:
        test = F.coalesce(rule(reconcile.SETTINGS)[0], F.lit(False))
        # The oracle's rounding has no tolerance arm: pairs within it are equal before any rule.
        if code == "ROUNDING":
            test = F.coalesce(F.col("a_sig") == F.col("b_sig"), F.lit(False))
        tests.append(test.alias(names[code]))
    return pairs.select(F.col("a_id").alias("fact_a"), F.col("b_id").alias("fact_b"), *tests)


@query(_RULED + "SELECT fact_a, fact_b, entity_key, attribute_key, bucket, rule_code, confidence FROM rel")
def relations_full(spark, sf_dir):
    """R0, R11-R14, SNK5."""
    return _relations(spark, sf_dir)[1].select("fact_a", "fact_b", "entity_key", "attribute_key", "bucket", "rule_code", _sure())


@query(
    _RULED
    + """SELECT id AS fact_a, b_id AS fact_b, concat('compare=', result, CASE WHEN result = 'DIFFERENT' THEN
      ' > ' || array_to_string(list_slice(['ROUNDING', 'UNIT_SCALE', 'PERIOD', 'TEMPORAL_STATUS', 'ESTIMATE_VINTAGE', 'SCOPE', 'BASIS', 'IDENTIFIER_REVISION', 'ATTRIBUTION'], 1,
        CASE rule_code WHEN 'ROUNDING' THEN 1 WHEN 'UNIT_SCALE' THEN 2 WHEN 'PERIOD' THEN 3 WHEN 'TEMPORAL_STATUS' THEN 4 WHEN 'ESTIMATE_VINTAGE' THEN 5 WHEN 'SCOPE' THEN 6 WHEN 'BASIS' THEN 7 WHEN 'IDENTIFIER_REVISION' THEN 8 ELSE 9 END), ' > ')
      ELSE '' END) AS trace FROM g"""
)
def cascade_trace(spark, sf_dir):
    """The steps that were tried."""
    steps = F.transform("rule_trace", lambda s: F.when(s["step"] == "compare", F.concat(F.lit("compare="), s["result"])).otherwise(s["step"]))
    return _relations(spark, sf_dir)[1].select("fact_a", "fact_b", F.array_join(steps, " > ").alias("trace"))


@query(_RULED + "SELECT bucket, rule_code, count(*) AS n FROM rel GROUP BY bucket, rule_code")
def relation_counts(spark, sf_dir):
    """AG11; the flagship query."""
    return views.rule_mix(_relations(spark, sf_dir)[1])


@query(_RULED + "SELECT (SELECT count(DISTINCT doc_id) FROM f) AS documents, (SELECT count(*) FROM f) AS facts, count(*) AS relations, 0::BIGINT AS rejected, count(*) FILTER (bucket = 'corroborated') AS corroborated, count(*) FILTER (bucket = 'contradiction') AS contradiction, count(*) FILTER (bucket = 'reconciled') AS reconciled, count(*) FILTER (bucket = 'unresolved') AS unresolved FROM rel")
def ledger_counts(spark, sf_dir):
    """AG1."""
    own, rel = _relations(spark, sf_dir)
    return views.ledger_counts(own.select("doc_id").distinct(), own, rel, own.limit(0))


@query(
    _RULED
    + """, s AS (SELECT doc_a AS doc_id, bucket FROM rel UNION ALL SELECT doc_b, bucket FROM rel WHERE doc_a <> doc_b)
SELECT x.doc_id, x.facts, count(s.bucket) AS relations, count(*) FILTER (bucket = 'corroborated') AS corroborated, count(*) FILTER (bucket = 'contradiction') AS contradiction,
  count(*) FILTER (bucket = 'reconciled') AS reconciled, count(*) FILTER (bucket = 'unresolved') AS unresolved
FROM (SELECT doc_id, count(*) AS facts FROM f GROUP BY doc_id) x LEFT JOIN s ON s.doc_id = x.doc_id GROUP BY x.doc_id, x.facts"""
)
def doc_summary(spark, sf_dir):
    """AG2, AG3, J4, J8."""
    own, rel = _relations(spark, sf_dir)
    return views.doc_summary(own.select("doc_id").distinct(), own, rel)


_BEST = """(SELECT '{name}' AS name, fact_a, fact_b, rule_code, confidence FROM (SELECT *, row_number() OVER ({part} ORDER BY confidence DESC, fact_a, fact_b) AS rn FROM rel WHERE bucket = '{bucket}' {more})
  WHERE {keep} ORDER BY confidence DESC, fact_a, fact_b LIMIT {n})"""


def _best(name, bucket, n, more="", diversify=True):
    return _BEST.format(name=name, bucket=bucket, n=n, more=more, part="PARTITION BY attribute_key" if diversify else "", keep="rn = 1" if diversify else "true")


@query(
    _RULED
    + "SELECT * FROM "
    + " UNION ALL SELECT * FROM ".join(
        [
            _best("corroboration", "corroborated", 4, "AND doc_a <> doc_b"),
            _best("contradiction", "contradiction", 3, diversify=False),
            _best("reconciled_vintage", "reconciled", 2, "AND rule_code = 'ESTIMATE_VINTAGE'"),
            _best("reconciled_period", "reconciled", 2, "AND rule_code = 'PERIOD'"),
            _best("reconciled_basis", "reconciled", 2, "AND rule_code IN ('BASIS', 'SCOPE', 'IDENTIFIER_REVISION', 'UNIT_SCALE')"),
            _best("reconciled_temporal", "reconciled", 1, "AND rule_code = 'TEMPORAL_STATUS'"),
        ]
    )
)
def case_picker(spark, sf_dir):
    """The report's picks."""
    own, rel = _relations(spark, sf_dir)
    return views.cases(rel.withColumn("relation_confidence", F.round("relation_confidence", 6)), own).withColumnRenamed("relation_confidence", "confidence")


@query(
    _RULED
    + """, s AS (SELECT fact_a AS id, bucket FROM rel UNION ALL SELECT fact_b, bucket FROM rel)
SELECT f.id, CASE max(CASE bucket WHEN 'contradiction' THEN 3 WHEN 'reconciled' THEN 2 WHEN 'corroborated' THEN 1 WHEN 'unresolved' THEN 0 END)
  WHEN 3 THEN 'contradiction' WHEN 2 THEN 'reconciled' WHEN 1 THEN 'corroborated' WHEN 0 THEN 'unresolved' ELSE 'extracted' END AS status FROM f LEFT JOIN s ON s.id = f.id GROUP BY f.id"""
)
def primary_relation(spark, sf_dir):
    """W2, J9."""
    return views.primary_relation(*_relations(spark, sf_dir))


@query(_RULED + "SELECT fact_a, fact_b, bucket, confidence FROM rel WHERE bucket = 'contradiction' AND (doc_a = 3 OR doc_b = 3)")
def relations_by_doc(spark, sf_dir):
    """PF5, PF6."""
    own, rel = _relations(spark, sf_dir)
    return views.relations_by_doc(rel, own, doc=3, bucket="contradiction").select("fact_a", "fact_b", "bucket", _sure())


@query(_RULED.replace("f AS (", "f AS MATERIALIZED (").replace("rel AS (", "rel AS MATERIALIZED (") + "SELECT rel.fact_a, rel.fact_b, a.value_text AS value_a, b.value_text AS value_b, a.doc_id AS doc_a, b.doc_id AS doc_b FROM rel JOIN f a ON a.id = fact_a JOIN f b ON b.id = fact_b")
def relation_view(spark, sf_dir):
    """PF3, J4."""
    own, rel = _relations(spark, sf_dir)
    return views.relation_view(rel, own).select("fact_a", "fact_b", F.col("a.value_text").alias("value_a"), F.col("b.value_text").alias("value_b"), F.col("a.doc_id").alias("doc_a"), F.col("b.doc_id").alias("doc_b"))


@query(f"WITH {samples.FACTS} SELECT id, doc_id, value_num FROM f WHERE attribute_key = 'revenue' AND doc_id = 2 ORDER BY id LIMIT 200")
def facts_filtered(spark, sf_dir):
    """PF4, O2, SRC11-SRC13."""
    return views.facts_filtered(samples.facts(spark, sf_dir), attribute="revenue", doc=2).select("id", "doc_id", "value_num")


@query(f"WITH {samples.FACTS} SELECT id, sanity_text AS flags FROM f WHERE sanity_text <> '' ORDER BY id DESC LIMIT 100")
def review_queue(spark, sf_dir):
    """PF7, O4."""
    return views.review_queue(samples.facts(spark, sf_dir)).select("id", F.array_join("sanity_flags", ",").alias("flags"))


@query(
    f"""WITH {samples.FACTS} SELECT id, doc_id, doc_title AS document, entity_key AS entity, attribute_display AS attribute, value_text, value_num,
regexp_replace(regexp_replace(regexp_replace(period_canonical, '^FY:', 'FY'), '^CY:', 'CY'), '^(POINT:|RANGE:)', '') AS period, source_page FROM f
WHERE contains(lower(concat_ws(' ', entity_key, attribute_key, value_text)), 'nation_1')"""
)
def fact_view(spark, sf_dir):
    """PF2, PF9, PF10, J2."""
    own = samples.facts(spark, sf_dir)
    titles = own.select("doc_id", F.col("doc_title").alias("title")).distinct()
    return views.brief(views.search(own, ["entity_key", "attribute_key", "value_text"], "NATION_1"), titles)


@query(
    f"""WITH {samples.FACTS}, j AS (SELECT DISTINCT doc_id, CASE WHEN doc_id = 1 THEN 'done' ELSE 'paused_llm' END AS status, 'extract' AS stage FROM f WHERE doc_id <= 3)
SELECT x.doc_id, x.facts, coalesce(j.status, '?') AS job_status, coalesce(j.stage, '?') AS job_stage FROM (SELECT doc_id, count(*) AS facts FROM f GROUP BY doc_id) x LEFT JOIN j ON j.doc_id = x.doc_id"""
)
def docs_with_jobs(spark, sf_dir):
    """J7, J8, SNK10."""
    own = samples.facts(spark, sf_dir)
    docs = own.select("doc_id").distinct()
    jobs = docs.where("doc_id <= 3").select("doc_id", F.when(F.col("doc_id") == 1, "done").otherwise("paused_llm").alias("status"), F.lit("extract").alias("stage"))
    return views.docs_with_jobs(docs, own, jobs)


# ---- scalar functions ----------------------------------------------------------------------------------------------

_SCALE_WORDS = "('thousand|trillions|trillion|millions|billions|million|billion|crores|crore|lakhs|lakh|lacs|cr|lac|mln|bln|mn|bn|tn|k|m|b')"
_QUANTITY_SQL = (
    f"WITH {samples.QUANTITIES}"
    + r""", a AS (
  SELECT *, trim(regexp_replace(value, '\s+', ' ', 'g')) AS raw FROM quantities
), b AS (
  SELECT *, trim(regexp_replace(concat(raw, ' ', coalesce(unit, '')), '\s+', ' ', 'g')) AS whole FROM a
), c AS (
  SELECT *,
    CASE WHEN regexp_matches(whole, '(?i)₹|\brs\.?\b|\binr\b|\brupees?\b|\bcrores?\b|\blakhs?\b|\blacs?\b') THEN 'INR'
      WHEN regexp_matches(whole, '(?i)us\$|\bus\s*dollar|\busd\b|(^|[^A-Za-z])\$') THEN 'USD' WHEN regexp_matches(whole, '(?i)€|\beur\b|\beuros?\b') THEN 'EUR'
      WHEN regexp_matches(whole, '(?i)£|\bgbp\b') THEN 'GBP' WHEN regexp_matches(whole, '(?i)\b(cr|crore|crores|lakh|lakhs|lac|lacs)\b') THEN 'INR' END AS currency,
    CASE lower(regexp_extract(whole, '(?i)(?:^|[^A-Za-z])(thousand|trillions|trillion|millions|billions|million|billion|crores|crore|lakhs|lakh|lacs|lac|cr|mln|bln|mn|bn|tn|k|m|b)(?:[^A-Za-z]|$)', 1))
      WHEN 'thousand' THEN 1e3 WHEN 'k' THEN 1e3 WHEN 'lakh' THEN 1e5 WHEN 'million' THEN 1e6 WHEN 'mn' THEN 1e6 WHEN 'm' THEN 1e6 WHEN 'cr' THEN 1e7 WHEN 'crore' THEN 1e7 WHEN 'billion' THEN 1e9 WHEN 'b' THEN 1e9 END AS scale,
    regexp_matches(whole, '(?i)%|per\s?cent|percent|\bpc\b|\bppt?\b|percentage\s+points?') AS percent, regexp_matches(whole, '(?i)\bbps\b|basis\s+points?') AS points,
    try_cast(replace(regexp_extract(replace(raw, ' ', ''), '[-+]?\d[\d,]*\.?\d*'), ',', '') AS DOUBLE) AS num,
    regexp_matches(raw, '^\s*-\s*[\d(]') OR (starts_with(raw, '(') AND ends_with(regexp_replace(raw, '[ .]+$', ''), ')') AND regexp_matches(raw, '\d')) AS negative
  FROM b
), d AS (
  SELECT *, percent OR points OR currency IS NOT NULL OR scale IS NOT NULL OR coalesce(unit, '') <> '' AS signal,
    CASE WHEN negative THEN -abs(num) ELSE num END AS signed, CASE WHEN negative THEN -abs(num * coalesce(scale, 1)) ELSE num * coalesce(scale, 1) END AS scaled
  FROM c
), e AS (
  SELECT *, CASE WHEN raw = '' THEN 'text' WHEN kind IN ('status', 'event') AND NOT (percent OR points) THEN 'text' WHEN kind = 'attribute' AND NOT signal THEN 'text'
      WHEN percent THEN 'percent' WHEN points THEN 'points' WHEN regexp_matches(raw, '(?i)\d\s*x\b') THEN 'multiple'
      WHEN num IS NULL OR (NOT signal AND len(regexp_extract_all(raw, '[A-Za-z]{3,}')) >= 3) THEN 'text'
      WHEN regexp_matches(whole, '(?i)\b(tonnes?|tons?|mt)\b') THEN 'tonnes' WHEN regexp_matches(whole, '(?i)\bdays?\b') THEN 'days'
      WHEN currency IS NOT NULL OR coalesce(scale IN (1e7, 1e5), false) OR regexp_matches(label, '(?i)revenue|loss') THEN 'currency_amount'
      WHEN scale IS NOT NULL THEN 'count' ELSE 'number' END AS kind2
  FROM d
)
SELECT k, round(CASE kind2 WHEN 'text' THEN NULL WHEN 'percent' THEN signed / 100.0 WHEN 'points' THEN signed / 10000.0 WHEN 'multiple' THEN signed ELSE scaled END, 6) AS value_num,
  CASE WHEN raw = '' THEN NULL WHEN kind2 IN ('text', 'currency_amount') THEN currency END AS currency,
  CASE kind2 WHEN 'percent' THEN 'ratio' WHEN 'points' THEN 'ratio' WHEN 'multiple' THEN 'ratio' ELSE kind2 END AS unit_canonical
FROM e"""
)


@query(_QUANTITY_SQL)
def parse_quantity_grid(spark, sf_dir):
    """N1-N6."""
    df = _sql(spark, sf_dir, samples.QUANTITIES, "quantities", ("part",))
    q = df.withColumn("q", quantity.parse_quantity(F.col("value"), F.col("unit"), F.col("label"), F.col("kind")))
    return q.select("k", F.round("q.value_num", 6).alias("value_num"), "q.currency", "q.unit_canonical")


_MON = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
_MM = "lpad(CAST((instr('janfebmaraprmayjunjulaugsepoctnovdec', {}) + 2) // 3 AS VARCHAR), 2, '0')"


def _hit(pattern: str, value: str, t: str = "t") -> str:
    return f"WHEN regexp_matches({t}, '{pattern}') THEN {value}"


def _g(pattern: str, i: int, t: str = "t") -> str:
    return f"regexp_extract({t}, '{pattern}', {i})"


def _y4(x: str) -> str:
    return f"(CASE WHEN length({x}) > 2 THEN CAST({x} AS INT) WHEN CAST({x} AS INT) <= 79 THEN 2000 + CAST({x} AS INT) ELSE 1900 + CAST({x} AS INT) END)"


def _fy(y: str) -> str:
    return f"concat('FY:', CAST({y} - 1 AS VARCHAR), '-', right(CAST({y} AS VARCHAR), 2))"


_P = {
    "ended": rf"year\s+end(?:ed|ing)\s+{_MON}\.?\s*\d{{0,2}},?\s*(\d{{4}})",
    "range": rf"{_MON}\s*(?:to|-)\s*{_MON}\s+(\d{{4}})",
    "dmy": rf"\b(\d{{1,2}})\s+{_MON}\s+(\d{{4}})\b",
    "mdy": rf"\b{_MON}\s+(\d{{1,2}}),?\s+(\d{{4}})\b",
    "my": rf"\b{_MON}\s+(\d{{4}})\b",
    "q": r"q([1-4])\s*[- ]?\s*fy\s*(\d{2,4})",
    "quarter": r"(first|second|third|fourth)\s+quarter\s+(?:of\s+)?fy\s*(\d{2,4})",
    "h": r"h([12])\s*[- ]?\s*fy\s*(\d{2,4})",
    "half": r"(first|second)\s+half\s+(?:of\s+)?fy\s*(\d{2,4})",
    "fyspan": r"\bfy\s*(\d{4})\s*[-/]\s*(\d{2,4})\b",
    "span": r"\b(\d{4})\s*[-/]\s*(\d{2,4})\b",
    "fy": r"\bfy\s*(\d{2,4})\b",
    "fiscal": r"\b(?:fiscal|financial\s+year)\s+(\d{2,4})\b",
    "cy": r"\bcy\s*(\d{4})\b",
    "calendar": r"calendar\s+year\s+(\d{4})",
    "in": r"\b(?:in|during|for|of)\s+(\d{4})\b",
}
_ORD = "CASE {} WHEN 'first' THEN '1' WHEN 'second' THEN '2' WHEN 'third' THEN '3' ELSE '4' END"


def _date(y: str, m: str, d: str) -> str:
    return f"concat({y}, '-', {_MM.format(m)}, '-', {d})"


def _pad(x: str) -> str:
    return f"lpad({x}, 2, '0')"


_PERIOD_SQL = f"""WITH {samples.DATED_TEXTS}, n AS (SELECT k, lower(trim(regexp_replace(txt, '\\s+', ' ', 'g'))) AS t FROM dated)
SELECT k, CASE
 {_hit(_P['ended'], _fy(f"CAST({_g(_P['ended'], 2)} AS INT)"))}
 WHEN regexp_matches(t, '\\b(nine|9|six|6|three|3)\\s+months?\\b') AND regexp_extract(t, '(\\d{{4}})', 1) <> '' THEN concat('RANGE:', regexp_extract(t, '(\\d{{4}})', 1), '-04..', regexp_extract(t, '(\\d{{4}})', 1), '-12')
 {_hit(_P['range'], f"concat('RANGE:', {_g(_P['range'], 3)}, '-', {_MM.format(_g(_P['range'], 1))}, '..', {_g(_P['range'], 3)}, '-', {_MM.format(_g(_P['range'], 2))})")}
 {_hit(_P['dmy'], "concat('POINT:', " + _date(_g(_P['dmy'], 3), _g(_P['dmy'], 2), _pad(_g(_P['dmy'], 1))) + ")")}
 {_hit(_P['mdy'], "concat('POINT:', " + _date(_g(_P['mdy'], 3), _g(_P['mdy'], 1), _pad(_g(_P['mdy'], 2))) + ")")}
 {_hit(_P['q'], f"concat('Q', {_g(_P['q'], 1)}, ' ', {_fy(_y4(_g(_P['q'], 2)))})")}
 {_hit(_P['quarter'], f"concat('Q', {_ORD.format(_g(_P['quarter'], 1))}, ' ', {_fy(_y4(_g(_P['quarter'], 2)))})")}
 {_hit(_P['h'], f"concat('H', {_g(_P['h'], 1)}, ' ', {_fy(_y4(_g(_P['h'], 2)))})")}
 {_hit(_P['half'], f"concat('H', {_ORD.format(_g(_P['half'], 1))}, ' ', {_fy(_y4(_g(_P['half'], 2)))})")}
 {_hit(_P['fyspan'], _fy(_y4(_g(_P['fyspan'], 2))))}
 WHEN regexp_matches(t, '{_P['span']}') AND {_y4(_g(_P['span'], 2))} - CAST({_g(_P['span'], 1)} AS INT) = 1 THEN {_fy(_y4(_g(_P['span'], 2)))}
 {_hit(_P['fy'], _fy(_y4(_g(_P['fy'], 1))))}
 {_hit(_P['fiscal'], _fy(_y4(_g(_P['fiscal'], 1))))}
 {_hit(_P['cy'], f"concat('CY:', {_g(_P['cy'], 1)})")}
 {_hit(_P['calendar'], f"concat('CY:', {_g(_P['calendar'], 1)})")}
 WHEN regexp_matches(t, '{_P['in']}') AND CAST({_g(_P['in'], 1)} AS INT) BETWEEN 1990 AND 2100 THEN concat('CY:', {_g(_P['in'], 1)})
 END AS period FROM n"""


@query(_PERIOD_SQL)
def parse_period_grid(spark, sf_dir):
    """D1-D3, N9."""
    df = _sql(spark, sf_dir, samples.DATED_TEXTS, "dated", ("orders",))
    return df.select("k", period.parse_period(F.col("txt")).alias("period"))


_DATE_CASE = f"""CASE WHEN regexp_extract(t, '\\b(\\d{{4}}-\\d{{2}}-\\d{{2}})\\b', 1) <> '' THEN regexp_extract(t, '\\b(\\d{{4}}-\\d{{2}}-\\d{{2}})\\b', 1)
 {_hit(_P['dmy'], _date(_g(_P['dmy'], 3), _g(_P['dmy'], 2), _pad(_g(_P['dmy'], 1))))}
 {_hit(_P['mdy'], _date(_g(_P['mdy'], 3), _g(_P['mdy'], 1), _pad(_g(_P['mdy'], 2))))}
 {_hit(_P['my'], _date(_g(_P['my'], 2), _g(_P['my'], 1), "'01'"))} END"""


@query(
    f"""WITH {samples.DATED_TEXTS}, n AS (SELECT k, lower(trim(regexp_replace(txt, '\\s+', ' ', 'g'))) AS t FROM dated), d AS (SELECT k, coalesce({_DATE_CASE}, '2000-01-15') AS as_of FROM n)
SELECT k, as_of, CAST(abs(date_diff('day', try_strptime(as_of, '%Y-%m-%d')::DATE, DATE '1995-06-30')) AS INT) AS days FROM d"""
)
def as_of_dates(spark, sf_dir):
    """D6-D8."""
    df = _sql(spark, sf_dir, samples.DATED_TEXTS, "dated", ("orders",))
    return df.select("k", period.resolve_as_of(F.col("txt"), F.lit("2000-01-15")).alias("as_of")).select("k", "as_of", period.days_apart(F.col("as_of"), F.lit("1995-06-30")).alias("days"))


_DATED_SQL = r"(?i)\b(?:dated|as at|as on)\s+([A-Za-z]+\s+\d{1,2},?\s+\d{4}|\d{1,2}\s+[A-Za-z]+\s+\d{4})"


@query(
    f"""WITH {samples.DATED_TEXTS}, n AS (SELECT k, replace(lower(regexp_extract(txt, '{_DATED_SQL}', 1)), ',', '') AS t FROM dated),
p AS (SELECT k, CASE WHEN regexp_matches(t, '^[a-z]') THEN {_date(_g('([a-z]+) ([0-9]+) ([0-9]{4})', 3), 'left(t, 3)', _pad(_g('([a-z]+) ([0-9]+) ([0-9]{4})', 2)))}
  WHEN t <> '' THEN {_date(_g('([0-9]+) ([a-z]+) ([0-9]{4})', 3), "left(" + _g('([0-9]+) ([a-z]+) ([0-9]{4})', 2) + ", 3)", _pad(_g('([0-9]+) ([a-z]+) ([0-9]{4})', 1)))} END AS phrase FROM n)
SELECT k, CASE WHEN k % 5 = 0 THEN '2001-01-01' WHEN phrase IS NOT NULL THEN phrase WHEN k % 3 = 0 THEN '2024-08-08' END AS date,
  CASE WHEN k % 5 = 0 THEN 'explicit' WHEN phrase IS NOT NULL THEN 'cover_dated_phrase' WHEN k % 3 = 0 THEN 'pdf_creation_date' ELSE 'unknown' END AS source FROM p"""
)
def published_date(spark, sf_dir):
    """D9-D11."""
    df = _sql(spark, sf_dir, samples.DATED_TEXTS, "dated", ("orders",))
    found = period.published_date(F.when(F.col("k") % 5 == 0, "2001-01-01"), F.col("txt"), F.when(F.col("k") % 3 == 0, "D:20240808140748+05'30'"))
    return df.withColumn("p", found).select("k", "p.date", "p.source")


@query(
    f"""WITH {samples.NAMED_TEXTS}, b AS (SELECT k, concat_ws(' ', basis, quote) AS t FROM named), s AS (SELECT k, CASE
  WHEN regexp_matches(t, '(?i)\\bsecond\\s+advance\\s+estimate|2nd\\s*ae\\b') THEN 'second_advance'
  WHEN regexp_matches(t, '(?i)\\badvance\\s+estimate') THEN 'first_advance'
  WHEN regexp_matches(t, '(?i)\\b(first\\s+)?revised\\s+estimate|\\bre\\b|\\(re\\)|partially\\s+revised|\\(pr\\)') THEN 'revised'
  WHEN regexp_matches(t, '(?i)\\bprovisional(\\s+estimate)?\\b|\\bpe\\b|\\(p\\)') THEN 'provisional'
  WHEN regexp_matches(t, '(?i)\\bproject(ed|ion)?\\b|\\bto\\s+grow\\s+(by|at)\\b') THEN 'projection' END AS status FROM b)
SELECT k, status, CASE status WHEN 'projection' THEN 0 WHEN 'first_advance' THEN 1 WHEN 'second_advance' THEN 2 WHEN 'revised' THEN 4 ELSE 3 END AS maturity FROM s"""
)
def estimate_status_grid(spark, sf_dir):
    """D4, D5."""
    df = _sql(spark, sf_dir, samples.NAMED_TEXTS, "named", ("customer",))
    return df.select("k", period.estimate_status(F.col("basis"), F.col("quote")).alias("status")).withColumn("maturity", period.maturity(F.col("status")))


_LEGAL_SQL = r"(?i)\b(private limited|pvt\.? ?ltd\.?|limited|ltd\.?|pvt\.?|plc|inc\.?|incorporated|corp\.?|corporation|llp|l\.l\.p\.|company|co\.?|holdings?|group)\b"


@query(
    f"""WITH {samples.NAMED_TEXTS}, n AS (SELECT k, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS n FROM named)
SELECT k, CASE WHEN n = '' THEN '' WHEN regexp_matches(n, '(?i)^(the\\s+)?(company|group|our company)$') THEN 'acme'
  ELSE trim(regexp_replace(lower(strip_accents(regexp_replace(regexp_replace(regexp_replace(n, '(?i)^(mr|mrs|the)\\.?\\s+', ''), '[^\\w\\s&/\\-é]', ' ', 'g'), '{_LEGAL_SQL}', ' ', 'g'))), '\\s+', ' ', 'g')) END AS entity_key,
  trim(regexp_replace(n, '(?i)^(mr|mrs|the)\\.?\\s+', '')) AS display, regexp_matches(n, '(?i)^(the\\s+)?(company|group|our company)$') AS self FROM n"""
)
def entity_keys(spark, sf_dir):
    """E1, E2, T7."""
    df = _sql(spark, sf_dir, samples.NAMED_TEXTS, "named", ("customer",))
    return df.select("k", keys.entity_key(F.col("name"), F.lit("acme")).alias("entity_key"), keys.person_display(F.col("name")).alias("display"), keys.is_self_reference(F.col("name")).alias("self"))


@query(
    f"""WITH {samples.NAMED_TEXTS} SELECT k, CASE label WHEN '' THEN '' WHEN 'Total Revenue' THEN 'revenue' WHEN 'Revenues from Customers' THEN 'revenue' WHEN 'PAT' THEN 'profit after tax' WHEN 'Adj. EBITDA' THEN 'adjusted ebitda'
  WHEN 'the number of shipments' THEN 'number shipment' WHEN 'GDP growth' THEN 'real gdp growth' WHEN 'CIN' THEN 'corporate identity number' WHEN 'Profit/(Loss) after tax' THEN 'profit after tax'
  ELSE trim(regexp_replace(regexp_replace(lower(label), 'estimates for', 'estimate', 'g'), '\\s+', ' ', 'g')) END AS attribute_key FROM named"""
)
def attribute_keys(spark, sf_dir):
    """E3, E4."""
    df = _sql(spark, sf_dir, samples.NAMED_TEXTS, "named", ("customer",))
    return df.select("k", keys.attribute_key(F.col("label")).alias("attribute_key"))


def _tag_sql(column: str) -> str:
    tests = {
        "adjusted": r"\badjusted\b|\badj\.?\b|non-gaap", "annualised": "annuali[sz]ed", "consolidated": r"\bconsolidated\b", "gross": r"\bgross\b", "net": r"\bnet\s+of\b", "nominal": r"\bnominal\b",
        "pro_forma": r"pro[\s-]?forma", "real": r"\breal\s+(gdp|gva|growth|terms)", "reported": r"\breported\b", "restated": "restated", "seasonally_adjusted": r"seasonally[\s-]adjusted|\bsa\b", "standalone": r"\bstandalone\b",
    }
    return "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches({column}, '(?i){p}'){' AND NOT regexp_matches(' + column + chr(44) + chr(32) + chr(39) + '(?i)gross domestic product' + chr(39) + ')' if t == 'gross' else ''} THEN '{t}' END" for t, p in tests.items()) + ")"


@query(
    f"""WITH {samples.NAMED_TEXTS}, b AS (SELECT *, concat(coalesce(basis, ''), ' || ', quote) AS bt, concat(coalesce(scope, ''), ' || ', quote) AS st FROM named),
s AS (SELECT *, concat_ws(',', CASE WHEN regexp_matches(st, '(?i)exclud\\w*\\s+(revenue\\s+from\\s+)?traded\\s+goods') THEN 'excl_traded_goods' END, CASE WHEN regexp_matches(st, '(?i)for\\s+the\\s+(quarter|period|year)') THEN 'per_period' END,
  CASE WHEN regexp_matches(st, '(?i)since\\s+inception') THEN 'since_inception' END) AS tags FROM b)
SELECT k, {_tag_sql('bt')} AS basis_flags, CASE WHEN tags = '' AND coalesce(scope, '') <> '' THEN concat('scope:', regexp_replace(regexp_replace(lower(scope), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) ELSE tags END AS scope_flags FROM s"""
)
def flags_grid(spark, sf_dir):
    """E5, E6, T6, SO2."""
    df = _sql(spark, sf_dir, samples.NAMED_TEXTS, "named", ("customer",))
    return df.select("k", F.array_join(flags.basis_flags(F.col("basis"), F.col("quote")), ",").alias("basis_flags"), F.array_join(flags.scope_flags(F.col("scope"), F.col("quote")), ",").alias("scope_flags"))


@query(
    """SELECT l_orderkey * 10 + l_linenumber AS k, concat_ws(',', CASE WHEN u = 'ratio' AND abs(v) > 1.5 THEN 'implausible_percent' END, CASE WHEN v > 0 AND label = 'net loss' AND left(txt, 1) <> '(' THEN 'sign_suspect' END,
  CASE WHEN sc <= 0.45 THEN 'low_structural' END, CASE WHEN u = 'currency_amount' AND abs(v) > 1e15 THEN 'huge_magnitude' END, CASE WHEN u = 'number' AND v BETWEEN 1900 AND 2100 AND v = floor(v) THEN 'year_as_value' END) AS flags
FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 'ratio' WHEN 1 THEN 'number' ELSE 'currency_amount' END AS u, CASE l_linenumber % 3 WHEN 0 THEN l_quantity / 20 WHEN 1 THEN 1880 + l_quantity * 5 ELSE l_extendedprice * 1e11 END AS v,
  CASE WHEN l_returnflag = 'R' THEN 'net loss' ELSE 'revenue' END AS label, CASE WHEN l_linestatus = 'O' THEN '(5)' ELSE '5' END AS txt, CASE WHEN l_discount > 0.05 THEN 0.4 ELSE 0.9 END AS sc FROM lineitem)"""
)
def sanity_flags_grid(spark, sf_dir):
    """E7."""
    col = F.col
    n = col("l_linenumber") % 3
    unit = F.when(n == 0, "ratio").when(n == 1, "number").otherwise("currency_amount")
    value = F.when(n == 0, col("l_quantity") / 20).when(n == 1, 1880 + col("l_quantity") * 5).otherwise(col("l_extendedprice") * 1e11)
    found = flags.sanity_flags(F.lit("numeric"), F.when(col("l_returnflag") == "R", "net loss").otherwise("revenue"), F.when(col("l_linestatus") == "O", "(5)").otherwise("5"), value, unit, F.when(col("l_discount") > 0.05, 0.4).otherwise(0.9))
    return _table(spark, sf_dir, "lineitem").select((col("l_orderkey") * 10 + col("l_linenumber")).alias("k"), F.array_join(found, ",").alias("flags"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS plain, replace(lower(trim(regexp_replace(strip_accents(text), '\\s+', ' ', 'g'))), 'ß', 'ss') AS folded FROM documents")
def text_normalize(spark, sf_dir):
    """T1, T2, T4."""
    return _table(spark, sf_dir, "documents").select("doc_id", text.norm_ws(F.col("text")).alias("plain"), text.casefold_key(F.col("text")).alias("folded"))


@query(f"WITH {samples.NAMED_TEXTS} SELECT k, regexp_replace(replace(quote, '²', '2'), '([A-Za-z%)\\d])\\(\\s*(?:0?[0-9]|1[0-9]|20)\\s*\\)', '\\1', 'g') AS plain FROM named")
def footnote_strip(spark, sf_dir):
    """T3, T5."""
    df = _sql(spark, sf_dir, samples.NAMED_TEXTS, "named", ("customer",))
    return df.select("k", text.strip_footnotes(F.col("quote")).alias("plain"))


@query("SELECT l_orderkey * 10 + l_linenumber AS k, CAST(round(l_extendedprice * 1000) AS DOUBLE) AS thousandths, round(l_extendedprice / power(10.0, floor(log10(l_extendedprice)) - 2)) * power(10.0, floor(log10(l_extendedprice)) - 2) AS significant FROM lineitem WHERE abs(l_extendedprice / power(10.0, floor(log10(l_extendedprice)) - 2) % 1 - 0.5) > 1e-9")
def significant_digits(spark, sf_dir):
    """N7."""
    x = F.col("l_extendedprice")
    df = _table(spark, sf_dir, "lineitem").where("abs(l_extendedprice / power(10.0, floor(log10(l_extendedprice)) - 2) % 1 - 0.5) > 1e-9")
    return df.withColumn("s", quantity.significant(x)).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), quantity.thousandths(x).alias("thousandths"), (F.col("s.m") * F.pow(F.lit(10.0), F.col("s.e"))).alias("significant"))


@query(
    """SELECT doc_id, i - 1 AS idx, CASE WHEN length(t) < 70 AND ((upper(t) = t AND lower(t) <> t) OR (lower(t) <> t AND NOT regexp_matches(t, '\\p{L}\\p{Lu}|(^|[^\\p{L}])\\p{Ll}'))) AND NOT ends_with(t, ':') THEN 'heading' ELSE 'list' END AS kind
FROM (SELECT doc_id, unnest(l) AS t, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents))"""
)
def block_classify(spark, sf_dir):
    """SRC1 for text, E9, AG10, SNK2."""
    pages = readers.text_pages(_table(spark, sf_dir, "documents"))
    return chunking.page_blocks(pages).select("doc_id", F.col("idx").cast("bigint").alias("idx"), "kind")


@query(
    """SELECT k, CASE WHEN n = 7 THEN 'iv' WHEN mark BETWEEN 1 AND 3000 AND abs(mark - page) <= 12 THEN CAST(mark AS VARCHAR) END AS label
FROM (SELECT l_orderkey * 10 + l_linenumber AS k, l_linenumber AS n, l_suppkey % 60 AS mark, CAST(l_quantity AS INT) AS page FROM lineitem)"""
)
def printed_label_grid(spark, sf_dir):
    """Pages of three lines, the last a number or a roman numeral."""
    line = _table(spark, sf_dir, "lineitem")
    mark = F.when(F.col("l_linenumber") == 7, "iv").otherwise((F.col("l_suppkey") % 60).cast("string"))
    page = F.concat(F.lit("Some title\nsome words of a page\n  "), mark, F.lit(" "))
    return line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), flags.printed_label(page, F.col("l_quantity").cast("int")).alias("label"))


@query()
def chunk_pages(spark, sf_dir):
    """W3, AG6, AG7, J10, J11, ST5: tested against a plain loop."""
    pages = readers.text_pages(_table(spark, sf_dir, "documents"))
    return chunking.chunks(chunking.page_blocks(pages)).select("doc_id", "page_no", "idx", F.size("block_ids").alias("blocks"), F.length("text").alias("chars"), "structural_confidence")


@query("SELECT sha256(text) AS sha, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def doc_dedup(spark, sf_dir):
    """SRC2, SNK9, ST3."""
    return _table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(
    f"""WITH {samples.FACTS} SELECT min(id) AS id, count(*) AS n FROM f GROUP BY entity_key, attribute_key, fact_kind, CASE WHEN value_num IS NULL THEN lower(trim(regexp_replace(value_text, '\\s+', ' ', 'g'))) ELSE CAST(round(value_num * 1000) AS VARCHAR) END,
unit_canonical, currency, period_canonical, as_of_date, estimate_status, basis_text, scope_text, attributed_to, doc_id"""
)
def dedup_hash(spark, sf_dir):
    """E12, SNK4, W5: facts of one content hash."""
    return samples.facts(spark, sf_dir).withColumn("h", content_hash()).groupBy("h").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "n")


#: Quotes that are broadcast at once, about; more are worked off in further passes over the documents.
QUOTES_AT_ONCE = 100_000
_GUARD = """CASE WHEN contains(d.text, b.text) THEN 'exact' ELSE 'folded' END"""


@query(
    """SELECT b.item_id, d.doc_id, 'exact' AS quote_match, CASE WHEN contains(d.text, b.text) THEN CAST(position(b.text IN d.text) - 1 AS INT) END AS quote_char_start
FROM benchmark b JOIN documents d ON contains(lower(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(b.text, '\\s+', ' ', 'g'))))"""
)
def quote_guard_exact(spark, sf_dir):
    """H1 tiers 1 and 2, J12, PF8: a stated set of quotes against all documents."""
    quotes = _table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"), text.guard_form(F.col("text")).alias("nq"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source"), text.guard_form(F.col("text")).alias("ns"))
    blocks = -(-quotes.count() // QUOTES_AT_ONCE) or 1
    met = None
    for at in range(blocks):
        own = quotes.where(F.pmod(F.xxhash64("item_id", "quote"), F.lit(blocks)) == at) if blocks > 1 else quotes
        part = guard.meet(docs, own, "ns", "nq")
        met = part if met is None else met.unionByName(part)
    return guard.verify_quotes(met).select("item_id", "doc_id", "quote_match", "quote_char_start")


@query()
def quote_guard_fuzzy(spark, sf_dir):
    """H1 tier 3, H3: each text against a copy with letters changed; tested against a plain loop."""
    marred = F.regexp_replace(F.col("text"), "th", "ht")
    return guard.verify_quotes(_table(spark, sf_dir, "benchmark").select("item_id", marred.alias("quote"), F.col("text").alias("source"))).select("item_id", "quote_match", F.round("guard_score", 6).alias("guard_score"))


@query(
    """WITH m AS (SELECT source, doc_id, m, pos FROM (SELECT source, doc_id, unnest(l) AS m, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT source, doc_id, regexp_extract_all(text, '\\b[A-Z][A-Za-z&.\\-]+(?:\\s+[A-Z][A-Za-z&.\\-]+){0,4}\\s+(?:Limited|Ltd|Bank|Corporation|Authority|Board|Fund|Company|PLC|Inc)\\b') AS l
  FROM (SELECT source, doc_id, concat(replace(source, 'src', 'Source'), ' Alpha Bank and Beta', CAST(doc_id % 3 AS VARCHAR), ' Gamma Fund. Delta Board of ') AS text FROM documents))))
, c AS (SELECT source, m, count(*) AS n, min((doc_id, pos)) AS first FROM m GROUP BY source, m)
SELECT source, m AS display, n FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, first) = 1"""
)
def primary_entity_mode(spark, sf_dir):
    """AG5, E8."""
    docs = _table(spark, sf_dir, "documents")
    said = F.concat(F.replace("source", F.lit("src"), F.lit("Source")), F.lit(" Alpha Bank and Beta"), (F.col("doc_id") % 3).cast("string"), F.lit(" Gamma Fund. Delta Board of "))
    return views.primary_entity(docs.select("source", F.col("doc_id").alias("place"), said.alias("text")), "source").select("source", "display", "n")


@query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id, k.vec_id AS best_id, round(list_cosine_similarity(q.v, k.v), 9) AS similarity FROM e q JOIN e k ON q.vec_id % 50 = 0 AND k.vec_id <> q.vec_id)
SELECT vec_id, best_id, round(similarity, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, best_id) = 1"""
)
def embedding_top1(spark, sf_dir):
    """Vectors whose id is divisible by 50 against all."""
    all_ = _table(spark, sf_dir, "embeddings")
    return registry.nearest_vectors(all_.where("vec_id % 50 = 0"), all_, -1.0).select("vec_id", "best_id", F.round("similarity", 6).alias("similarity"))


@query()
def registry_link(spark, sf_dir):
    """J13, J15, O6, AG9, SNK7, SNK8: supplier names marred and nation names, linked to supplier names; what links to none is registered."""
    known = _table(spark, sf_dir, "supplier").select(F.lower("s_name").alias("key"))
    marred = _table(spark, sf_dir, "supplier").select(F.concat(F.lower("s_name"), F.lit(" x")).alias("key")).unionByName(_table(spark, sf_dir, "nation").select(F.lower("n_name").alias("key")))
    links = registry.best_links(marred, known, reconcile.SETTINGS.entity_score)
    fresh = registry.register(known.select("key", F.array().cast("array<string>").alias("aliases")), marred.join(links, "key", "left_anti"))
    return registry.add_aliases(fresh, links).select("key", F.array_join("aliases", ",").alias("aliases"))


@query("SELECT s_suppkey AS k, lower(s_name) AS canonical FROM supplier UNION ALL SELECT -n_nationkey AS k, lower(n_name) AS canonical FROM nation")
def alias_substitution(spark, sf_dir):
    """Keys with an alias get their canonical key, others stay."""
    s = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("alias of "), F.lower("s_name")).alias("entity_key"))
    n = _table(spark, sf_dir, "nation").select((-F.col("n_nationkey")).cast("bigint").alias("k"), F.lower("n_name").alias("entity_key"))
    links = s.select(F.col("entity_key").alias("key"), F.substring("entity_key", 10, 1000).alias("canonical"))
    return registry.apply_links(s.unionByName(n), links, "entity_key").select("k", F.col("entity_key").alias("canonical"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, props IS NOT NULL AS valid FROM events")
def lenient_json(spark, sf_dir):
    """H4: replies with a fence, trailing commas and noise around their object."""
    noisy = F.concat(F.lit("Here:\n```json\n"), F.regexp_replace("props", r"\}$", ", }"), F.lit("\n```"))
    repaired = flags.repair_json(noisy)
    return _table(spark, sf_dir, "events").select("event_id", F.get_json_object(repaired, "$.k").alias("k"), F.get_json_object(repaired, "$").isNotNull().alias("valid"))


@query()
def normalize_facts(spark, sf_dir):
    """PF1, E11, E12, D3: raw facts rendered from parts through the whole projection; tested against golden cases."""
    q = _sql(spark, sf_dir, samples.QUANTITIES, "quantities", ("part",))
    raw = spread(q).select(F.col("k").alias("id"), (F.col("k") % 5).alias("doc_id"), F.lit("The Company").alias("entity_text"), F.col("label").alias("attribute_label"), F.col("value").alias("value_text"), F.col("unit").alias("unit_text"), F.lit("FY24").alias("period_text"), F.col("kind").alias("fact_kind"), F.concat(F.lit("provisional "), F.col("value")).alias("quote"), F.lit("exact").alias("quote_match"), F.lit(0.9).alias("self_confidence"), F.lit(3).alias("page_no"))
    context = q.select((F.col("k") % 5).alias("doc_id")).distinct().select("doc_id", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("doc_title"), F.lit("acme").alias("primary_entity_key"), F.lit("2024-05-11").alias("published_date"))
    out = normalize(raw, context)
    return out.select("id", "doc_id", "entity_key", "attribute_key", "fact_kind", "value_num", "currency", "unit_canonical", "period_canonical", "as_of_date", "estimate_status", F.array_join("sanity_flags", ",").alias("sanity_flags"), "extraction_confidence", "content_hash")
