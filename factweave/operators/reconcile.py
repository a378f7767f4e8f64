"""Pairs of facts and their verdicts.

Everything is one projection over one equi-join: the rules are Columns in an ordered list, each a struct(step,
applies, detail, explanation, bucket); the first that applies decides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import SETTINGS, Settings
from ..functions import keys, period, quantity, text

SIDE = [
    "id", "doc_id", "doc_title", "fact_kind", "value_text", "value_num", "currency", "unit_canonical", "period_canonical", "as_of_date",
    "estimate_status", "basis_flags", "scope_flags", "sanity_flags", "attributed_to", "attribute_display", "extraction_confidence",
    "source_page", "content_hash",
]
#: What the rules need of one fact is worked out once for it, before it meets others.
DERIVED = ["folded", "pin", "sig", "stage", "day"]
BLOCK = ["entity_key", "attribute_key"]
QUANTITIES = ("currency_amount", "ratio", "tonnes", "days", "count", "number")
PIN = r"\b(\d{5,6})\b"
IDENTIFIER = r"(?i)identity|identifier|registration\s*(no|number)|\bcin\b|\bgstin\b|\bdin\b"


def prepare(facts: DataFrame) -> DataFrame:
    """facts with the DERIVED columns: folded text, first PIN, value to three digits, maturity, as-of day."""
    return facts.withColumns({
        "folded": text.casefold_key(F.col("value_text")),
        "pin": F.regexp_extract(F.coalesce("value_text", F.lit("")), PIN, 1),
        "sig": quantity.significant(F.col("value_num")),
        "stage": period.maturity(F.col("estimate_status")),
        "day": period.iso_day(F.col("as_of_date")),
    })


def pair_facts(facts: DataFrame, settings: Settings = SETTINGS, incremental: bool = False) -> DataFrame:
    """Candidate pairs within a block of one entity and attribute: columns a_*, b_* with a_id < b_id.

    The first `full_pairing` facts of a block pair with all before them; later ones with facts of their own period (a
    missing period counts as one). Two facts of one content hash do not pair; incremental keeps pairs with a new
    fact (is_new). One join serves both: a fact is met under its block's tag "" if it is among the first, under its period
    if not, and looks under "" as one of the first, under its period where its block has later facts. So a
    large block is dealt over its periods, and each side of the join is worked out once.
    """
    w = Window.partitionBy(*BLOCK)
    held = prepare(facts.where("id is not null")).withColumn("period_key", F.coalesce(F.nullif("period_canonical", F.lit("")), F.lit("∅")))
    cols = [c for c in SIDE if c in facts.columns] + DERIVED + (["is_new"] if incremental else [])
    ranked = held.withColumn("rank", F.row_number().over(w.orderBy("id"))).withColumn("size", F.count("*").over(w))
    first = F.col("rank") <= settings.full_pairing
    looks = F.array_compact(F.array(F.when(first, ""), F.when(F.col("size") > settings.full_pairing, F.col("period_key"))))

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(*BLOCK, "tag", *[F.col(c).alias(f"{p}_{c}") for c in cols])

    met = side(ranked.withColumn("tag", F.explode(looks)), "a").join(side(ranked.withColumn("tag", F.when(first, "").otherwise(F.col("period_key"))), "b"), [*BLOCK, "tag"]).drop("tag")
    fresh = F.col("a_is_new") | F.col("b_is_new") if incremental else F.lit(True)
    same_hash = F.coalesce((F.col("a_content_hash") != "") & (F.col("a_content_hash") == F.col("b_content_hash")), F.lit(False))
    return met.where((F.col("a_id") < F.col("b_id")) & ~same_hash & fresh).drop("a_is_new", "b_is_new")


def touched(facts: DataFrame, new: DataFrame) -> DataFrame:
    """The facts of blocks that a new fact falls in."""
    return facts.join(new.select(*BLOCK).distinct(), BLOCK, "left_semi")


def unknown_pairs(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """The pairs that no stored relation joins."""
    return pairs.join(relations.select(F.col("fact_a").alias("a_id"), F.col("fact_b").alias("b_id")), ["a_id", "b_id"], "left_anti")


def a(c: str) -> Column:
    return F.col(f"a_{c}")


def b(c: str) -> Column:
    return F.col(f"b_{c}")


def _filled(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def _measured(side: Callable[[str], Column]) -> Column:
    return side("value_num").isNotNull() & F.coalesce(side("unit_canonical").isin(*QUANTITIES), F.lit(False))


def compare(settings: Settings = SETTINGS) -> Column:
    """struct(result, mode, rel_diff, note): EQUAL, DIFFERENT or INCOMPARABLE."""

    def out(result: str, mode: str, note=None, rel=None):
        return F.struct(F.lit(result).alias("result"), F.lit(mode).alias("mode"), (F.lit(None) if rel is None else rel).cast("double").alias("rel_diff"), (F.lit("") if note is None else note).cast("string").alias("note"))

    both, one = _measured(a) & _measured(b), _measured(a) != _measured(b)
    rel = quantity.relative_difference(a("value_num"), b("value_num"))
    sa, sb, pa, pb = a("folded"), b("folded"), a("pin"), b("pin")
    money = _filled(a("currency")) & _filled(b("currency")) & (a("currency") != b("currency"))
    versus = lambda c: F.concat(a(c), F.lit(" vs "), b(c))
    return (
        F.when(both & (a("unit_canonical") != b("unit_canonical")), out("INCOMPARABLE", "numeric", versus("unit_canonical")))
        .when(both & F.coalesce(money, F.lit(False)), out("INCOMPARABLE", "numeric", versus("currency")))
        .when(both & (rel <= settings.equal_tolerance), out("EQUAL", "numeric", None, rel))
        .when(both, out("DIFFERENT", "numeric", None, rel))
        .when(one, out("INCOMPARABLE", "mixed", F.lit("one side non-numeric")))
        .when((sa == sb) & (sa != ""), out("EQUAL", "string"))
        .when((pa != "") & (pb != "") & (pa == pb), out("EQUAL", "string", F.lit("pin")))
        .when((pa != "") & (pb != ""), out("DIFFERENT", "string", F.lit("pin")))
        .when((sa == "") | (sb == ""), out("INCOMPARABLE", "string", F.lit("empty value")))
        .when(F.contains(sb, sa) | F.contains(sa, sb), out("EQUAL", "string", F.lit("containment")))
        .otherwise(out("DIFFERENT", "string"))
    )


def _numbers() -> Column:
    return a("value_num").isNotNull() & b("value_num").isNotNull()


def _kinds(*kinds: str) -> Column:
    return F.coalesce(a("fact_kind").isin(*kinds) & b("fact_kind").isin(*kinds), F.lit(False))


def _apart(settings: Settings) -> Column:
    return F.coalesce(F.abs(F.datediff(a("day"), b("day"))) >= settings.vintage_days, F.lit(False))


def _flags_differ(c: str) -> Column:
    fa, fb = (F.coalesce(s(c), F.array().cast("array<string>")) for s in (a, b))
    return (F.size(F.array_except(fa, fb)) > 0) | (F.size(F.array_except(fb, fa)) > 0)


def _list(c: Column) -> Column:
    return F.when(F.size(c) > 0, F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))).otherwise("unqualified")


def rounding(s: Settings) -> tuple[Column, Column]:
    rel = quantity.relative_difference(a("value_num"), b("value_num"))
    return (
        _numbers() & ((a("sig") == b("sig")) | (rel <= s.equal_tolerance)),
        F.format_string("Both figures are the same to 3 significant digits (%.3f%% apart): a matter of rounding.", rel * 100),
    )


def unit_scale(s: Settings) -> tuple[Column, Column]:
    share = F.abs(a("value_num")) / F.nullif(F.abs(b("value_num")), F.lit(0.0))
    powers = [10.0**k for k in (-3, -2, -1, 1, 2, 3)]
    hit = F.exists(F.array(*[F.lit(p) for p in powers]), lambda p: F.abs(share - p) / p <= s.scale_tolerance)
    return _numbers() & (a("value_num") != 0) & (b("value_num") != 0) & hit, F.lit("One figure is a power of ten of the other: a unit or scale was not made out.")


def other_period(s: Settings) -> tuple[Column, Column]:
    pa, pb = a("period_canonical"), b("period_canonical")
    return _filled(pa) & _filled(pb) & (pa != pb), F.concat(F.lit("The figures are of two periods: "), pa, F.lit(" and "), pb, F.lit("."))


def temporal_status(s: Settings) -> tuple[Column, Column]:
    first = F.coalesce(a("as_of_date"), F.lit("")) <= F.coalesce(b("as_of_date"), F.lit(""))
    pick = lambda c, older: F.when(first == older, a(c)).otherwise(b(c))
    say = F.concat(*[x for older, lead in ((F.lit(True), "The status changed: as of "), (F.lit(False), "; as of ")) for x in (F.lit(lead), pick("as_of_date", older), F.lit(" “"), pick("value_text", older), F.lit("”"))], F.lit("."))
    return _kinds("status", "event") & _apart(s), say


def vintage(s: Settings) -> tuple[Column, Column]:
    ra, rb = a("stage"), b("stage")
    status = (_filled(a("estimate_status")) | _filled(b("estimate_status"))) & (ra != rb)
    stage = lambda low: F.coalesce(F.nullif(F.when((ra <= rb) == low, a("estimate_status")).otherwise(b("estimate_status")), F.lit("")), F.when(low, "earlier estimate").otherwise("later estimate"))
    parts = F.array_compact(F.array(F.when(status, F.concat(stage(F.lit(True)), F.lit(" → "), stage(F.lit(False)))), F.when(_apart(s), F.concat(F.lit("as of "), a("as_of_date"), F.lit(" and "), b("as_of_date")))))
    return _kinds("numeric") & _numbers() & (status | _apart(s)), F.concat(F.lit("One figure at two vintages: "), F.array_join(parts, "; "), F.lit("."))


def scope(s: Settings) -> tuple[Column, Column]:
    return _flags_differ("scope_flags"), F.concat(F.lit("The figures differ in scope (A: "), _list(a("scope_flags")), F.lit("; B: "), _list(b("scope_flags")), F.lit(")."))


def basis(s: Settings) -> tuple[Column, Column]:
    return _flags_differ("basis_flags"), F.concat(F.lit("The figures differ in basis (A: "), _list(a("basis_flags")), F.lit("; B: "), _list(b("basis_flags")), F.lit(")."))


def identifier_revision(s: Settings) -> tuple[Column, Column]:
    va, vb = F.trim(F.coalesce(a("value_text"), F.lit(""))), F.trim(F.coalesce(b("value_text"), F.lit("")))
    named = F.col("attribute_key").rlike(IDENTIFIER) | F.coalesce(a("attribute_display").rlike(IDENTIFIER), F.lit(False))
    near = F.when(F.length(va) == F.length(vb), F.coalesce(keys.hamming(va, vb) <= 2, F.lit(False))).otherwise(F.lit(False))
    return (
        a("value_num").isNull() & b("value_num").isNull() & named & (va != "") & (vb != "") & (va != vb) & (near | F.coalesce(F.col("similarity") >= s.identifier_score, F.lit(False))),
        F.concat(F.lit("The identifiers “"), va, F.lit("” and “"), vb, F.lit("” differ in form only.")),
    )


def attribution(s: Settings) -> tuple[Column, Column]:
    x, y = F.lower(F.coalesce(a("attributed_to"), F.lit(""))), F.lower(F.coalesce(b("attributed_to"), F.lit("")))
    name = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("primary"))
    return x != y, F.concat(F.lit("A figure is relayed from elsewhere (A: "), name(a("attributed_to")), F.lit("; B: "), name(b("attributed_to")), F.lit(") and is not independent agreement."))


#: Rules in order: code, the rule, the bucket of what it explains. Add to a copy of this list to extend the cascade.
CASCADE: list[tuple[str, Callable[[Settings], tuple[Column, Column]], str]] = [
    ("ROUNDING", rounding, "corroborated"),
    ("UNIT_SCALE", unit_scale, "reconciled"),
    ("PERIOD", other_period, "reconciled"),
    ("TEMPORAL_STATUS", temporal_status, "reconciled"),
    ("ESTIMATE_VINTAGE", vintage, "reconciled"),
    ("SCOPE", scope, "reconciled"),
    ("BASIS", basis, "reconciled"),
    ("IDENTIFIER_REVISION", identifier_revision, "reconciled"),
    ("ATTRIBUTION", attribution, "unresolved"),
]


def _with_similarity(pairs: DataFrame) -> DataFrame:
    """Adds similarity, by the one Python step, for identifier texts that a position count cannot settle."""
    va, vb = F.trim(F.coalesce(a("value_text"), F.lit(""))), F.trim(F.coalesce(b("value_text"), F.lit("")))
    named = F.col("attribute_key").rlike(IDENTIFIER) | F.coalesce(a("attribute_display").rlike(IDENTIFIER), F.lit(False))
    ask = named & a("value_num").isNull() & b("value_num").isNull() & (va != vb)
    # Nulls stand for the pairs that need no answer, so that the pairs are formed once.
    return pairs.withColumn("similarity", keys.indel_ratio(F.when(ask, va), F.when(ask, vb)))


def reconcile(pairs: DataFrame, settings: Settings = SETTINGS, cascade=None) -> DataFrame:
    """fact_a, fact_b, doc_a, doc_b, entity_key, attribute_key, bucket, rule_code, relation_confidence, explanation, trace."""
    cascade = CASCADE if cascade is None else cascade
    tried = [(code, *rule(settings), bucket) for code, rule, bucket in cascade]
    out = _with_similarity(pairs).withColumn("c", compare(settings))
    out = out.withColumn("rules", F.array(*[F.struct(F.lit(code).alias("step"), F.coalesce(test, F.lit(False)).alias("applies"), F.lit(bucket).alias("bucket")) for code, test, _, bucket in tried]))
    out = out.withColumn("place", F.array_position(F.transform("rules", lambda r: r["applies"]), True))
    out = out.withColumn("rule", F.when(F.col("place") > 0, F.element_at("rules", F.col("place").cast("int"))))
    same_page = F.coalesce(a("doc_id").eqNullSafe(b("doc_id")) & a("source_page").eqNullSafe(b("source_page")), F.lit(False))
    flagged = (F.coalesce(F.size(a("sanity_flags")), F.lit(0)) > 0) | (F.coalesce(F.size(b("sanity_flags")), F.lit(0)) > 0)
    stored = lambda s, missing: F.coalesce(F.nullif(s("extraction_confidence"), F.lit(0.0)), F.lit(missing))
    sure = (F.least(stored(a, 0.0), stored(b, 0.0)) >= settings.contradiction_confidence) & ~flagged
    equal, unlike = F.col("c.result") == "EQUAL", F.col("c.result") == "INCOMPARABLE"
    code = F.when(equal & same_page, "DUPLICATE").when(equal, "EXACT").when(unlike, "INCOMPARABLE").when(F.col("place") > 0, F.col("rule.step")).when(sure, "NONE").otherwise("NONE_LOWCONF")
    out = out.withColumn("rule_code", code)
    r = F.col("rule_code")
    bucket = (
        F.when(r.isin("DUPLICATE", "INCOMPARABLE", "NONE_LOWCONF"), "unresolved")
        .when(r == "EXACT", "corroborated")
        .when(r == "NONE", "contradiction")
        .when((F.col("rule.bucket") == "corroborated") & same_page, "unresolved")
        .otherwise(F.col("rule.bucket"))
    )
    bases = F.create_map(*[F.lit(x) for pair in (settings.rule_base | {"NONE_LOWCONF": settings.rule_base["NONE"]}).items() for x in pair])
    dated = lambda s: _filled(s("estimate_status")) | _filled(s("as_of_date"))
    some = lambda c: (F.coalesce(F.size(a(c)), F.lit(0)) > 0) | (F.coalesce(F.size(b(c)), F.lit(0)) > 0)
    complete = (
        F.when(r == "PERIOD", _filled(a("period_canonical")) & _filled(b("period_canonical")))
        .when(r == "ESTIMATE_VINTAGE", dated(a) & dated(b))
        .when(r == "TEMPORAL_STATUS", _filled(a("as_of_date")) & _filled(b("as_of_date")))
        .when(r == "SCOPE", some("scope_flags"))
        .when(r == "BASIS", some("basis_flags"))
        .otherwise(F.lit(True))
    )
    score = F.coalesce(F.try_element_at(bases, r), F.lit(0.7)) * F.least(stored(a, 0.5), stored(b, 0.5)) * F.when(complete, 1.0).otherwise(0.7) * F.when(flagged, 0.6).otherwise(1.0)
    at = lambda s, name: F.concat(F.lit("“"), F.coalesce(s("value_text"), F.lit("")), F.lit("” ("), F.coalesce(F.nullif(s("doc_title"), F.lit("")), F.lit(name)), F.lit(", p."), F.coalesce(s("source_page").cast("string"), F.lit("?")), F.lit(")"))
    explanation = (
        F.when(r == "DUPLICATE", "The same value on the same page: a duplicate, no relation.")
        .when(r == "EXACT", F.concat(F.lit("Two sources agree: "), at(a, "doc A"), F.lit(" and "), at(b, "doc B"), F.lit(".")))
        .when(r == "INCOMPARABLE", F.concat(F.lit("The facts cannot be compared ("), F.col("c.note"), F.lit(").")))
        .when(r == "NONE", F.concat(F.lit("Neither period, scope, basis, unit nor vintage explains the gap: "), at(a, "doc A"), F.lit(" against "), at(b, "doc B"), F.lit(".")))
        .when(r == "NONE_LOWCONF", "The values differ and no rule explains it, but confidence is too low, or a value too odd, to call it a contradiction.")
    )
    for code_, _, say, _ in tried:
        explanation = explanation.when(r == code_, say)
    steps = F.when(F.col("c.result") == "DIFFERENT", F.slice("rules", 1, F.when(F.col("place") > 0, F.col("place").cast("int")).otherwise(len(cascade)))).otherwise(F.slice("rules", 1, 0))
    trace = F.concat(F.array(F.struct(F.lit("compare").alias("step"), F.col("c.result").alias("result"), F.col("c.rel_diff").alias("rel_diff"), F.nullif(F.col("c.note"), F.lit("")).alias("note"))), F.transform(steps, lambda x: F.struct(x["step"].alias("step"), x["applies"].cast("string").alias("result"), F.lit(None).cast("double").alias("rel_diff"), F.lit(None).cast("string").alias("note"))))
    confidence = F.when(r.isin("DUPLICATE", "INCOMPARABLE"), 0.3).otherwise(text.clip01(score))
    return out.select(
        a("id").alias("fact_a"), b("id").alias("fact_b"), a("doc_id").alias("doc_a"), b("doc_id").alias("doc_b"), *BLOCK, bucket.alias("bucket"), "rule_code",
        confidence.alias("relation_confidence"), explanation.alias("explanation"), trace.alias("rule_trace"), F.lit("template").alias("explanation_source"),
    )


def relate(facts: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """All relations of a set of facts: pair, compare, explain."""
    return reconcile(pair_facts(facts, settings), settings)
