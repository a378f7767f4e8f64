"""Basis, scope and sanity flags (E5-E7), block and page labels (E9, E10), lenient JSON (H4)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import casefold_key, slug

# Tags and the words that show them.
BASIS = [
    ("pro_forma", r"pro[\s-]?forma"),
    ("restated", r"restated|as\s+restated"),
    ("adjusted", r"\badjusted\b|\badj\.?\b|non-gaap"),
    ("reported", r"\breported\b|on\s+a\s+reported\s+basis"),
    ("nominal", r"\bnominal\b"),
    ("real", r"\breal\s+terms\b|at\s+constant\s+prices|\breal\b(?=\s+(gdp|gva|growth|terms))"),
    ("standalone", r"\bstandalone\b"),
    ("consolidated", r"\bconsolidated\b"),
    ("gross", r"\bgross\b(?!\s+(domestic\s+product|value\s+added|national|fixed\s+capital|savings?))"),
    ("net", r"\bnet\s+of\b"),
    ("annualised", r"annuali[sz]ed"),
    ("seasonally_adjusted", r"seasonally[\s-]adjusted|\bsa\b"),
]
SCOPE = [
    ("excl_traded_goods", r"exclud\w*\s+(revenue\s+from\s+)?traded\s+goods|excl\.?\s+traded\s+goods"),
    ("incl_traded_goods", r"includ\w*\s+(revenue\s+from\s+)?traded\s+goods"),
    ("since_inception", r"since\s+inception"),
    ("per_period", r"for\s+the\s+(quarter|period|year)"),
]
LOSS = r"(?i)\b(loss|deficit|decline|decrease|contraction|fell|drop|de-?growth)\b"
NUMERIC_TOKEN = r"^[-+(]?\d[\d,]*\.?\d*%?\)?$"
#: The empty mark begins every text, so whatever is neither heading nor table counts as a list.
BULLETS = ("•", "-", "", "o ")
PAGE_LABEL = r"(?i)^\s*(\d{1,4}|[ivxlcdm]{1,8})\s*$"


def tags(patterns: list[tuple[str, str]], text: Column) -> Column:
    """The tags whose pattern is found, sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.when(text.rlike("(?i)" + p), tag) for tag, p in patterns])))


def _blob(text: Column, quote: Column) -> Column:
    return F.concat(F.coalesce(text, F.lit("")), F.lit(" || "), F.coalesce(quote, F.lit("")))


def basis_flags(text: Column, quote: Column) -> Column:
    return tags(BASIS, _blob(text, quote))


def scope_flags(text: Column, quote: Column) -> Column:
    """Known tags; failing these, the scope text itself as one slug."""
    found, own = tags(SCOPE, _blob(text, quote)), slug(text)
    return F.when((F.size(found) == 0) & (casefold_key(text) != "") & (own != ""), F.array(F.concat(F.lit("scope:"), own))).otherwise(found)


def sanity_flags(kind: Column, label: Column, value_text: Column, value: Column, unit: Column, structural: Column) -> Column:
    """Signs that a value was misread, in this order."""
    label = F.coalesce(label, F.lit(""))
    checks = [
        ("implausible_percent", (unit == "ratio") & (F.abs(value) > 1.5)),
        ("sign_suspect", (value > 0) & label.rlike(LOSS) & ~F.coalesce(value_text, F.lit("")).rlike(r"[-−(]")),
        ("low_structural", (kind == "numeric") & (structural <= 0.45)),
        ("huge_magnitude", (unit == "currency_amount") & (F.abs(value) > 1e15)),
        ("year_as_value", (unit.isNull() | (unit == "number")) & value.between(1900, 2100) & (value == F.floor(value)) & ~label.rlike(r"\d")),
    ]
    return F.array_compact(F.array(*[F.when(test, name) for name, test in checks]))


def classify_block(text: Column, deck: Column) -> Column:
    """struct(kind, structural_confidence) of a layout block."""
    t = F.trim(F.coalesce(text, F.lit("")))
    lines = F.size(F.filter(F.split(t, r"\n"), lambda x: F.trim(x) != ""))
    tokens = F.filter(F.split(t, r"\s+"), lambda x: x != "")
    numbers = F.size(F.filter(tokens, lambda x: F.regexp_replace(x, r"^[().,%]+|[().,%]+$", "").rlike(NUMERIC_TOKEN)))
    share = numbers / F.greatest(F.lit(1), F.size(tokens))
    upper = (F.upper(t) == t) & (F.lower(t) != t)
    # Every run of letters begins with a capital and goes on in small letters.
    titled = (F.lower(t) != t) & ~t.rlike(r"(?U)\p{L}\p{Lu}|(?<!\p{L})\p{Ll}")
    kind = lambda name, trust: F.struct(F.lit(name).alias("kind"), F.lit(trust).alias("structural_confidence"))
    return (
        F.when(deck & ((share > 0.35) | (lines >= 4)), kind("table_region", 0.40))
        .when(deck, kind("slide_textbox", 0.50))
        .when((lines <= 1) & (F.length(t) < 70) & (upper | titled) & ~t.endswith(":"), kind("heading", 0.85))
        .when((share > 0.45) & (lines >= 2), kind("table_region", 0.60))
        .when(reduce(or_, [F.startswith(t, F.lit(b)) for b in BULLETS]) | t.rlike(r"^\(?[a-z0-9]\)\s"), kind("list", 0.80))
        .otherwise(kind("paragraph", 0.90))
    )


def printed_label(text: Column, page_no: Column) -> Column:
    """The page number printed in the last two or first two lines: roman, or within 12 of the page's place."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r]"), lambda x: F.trim(x)), lambda x: x != "")
    n = F.size(lines)
    last = F.when(n >= 2, F.slice(lines, F.greatest(n - 1, F.lit(1)), F.lit(2))).otherwise(lines)
    marks = F.transform(F.concat(last, F.slice(lines, 1, 2)), lambda x: F.regexp_extract(x, PAGE_LABEL, 1))
    fits = F.filter(marks, lambda m: (m != "") & (~m.rlike(r"^\d") | (m.try_cast("int").between(1, 3000) & (F.abs(m.try_cast("int") - page_no) <= 12))))
    return F.try_element_at(fits, F.lit(1))


def repair_json(text: Column) -> Column:
    """A reply's outermost object, without a code fence, trailing commas and curly quotes; null if blank."""
    s = F.trim(F.coalesce(text, F.lit("")))
    fenced = F.regexp_extract(s, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    s = F.when(s.rlike(r"(?s)```(?:json)?\s*(.*?)\s*```"), F.trim(fenced)).otherwise(s)
    inner = F.regexp_extract(s, r"(?s)(\{.*\})", 1)
    s = F.when(inner != "", inner).otherwise(s)
    return F.nullif(F.translate(F.regexp_replace(s, r",\s*([}\]])", "$1"), "“”", '""'), F.lit(""))


def numbers_in(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d[\d,]*\.?\d*)"))


def rephrase_allowed(candidate: Column, *sources: Column) -> Column:
    """Whether a rewritten sentence is short enough and brings no number that its sources lack."""
    return (candidate != "") & (F.length(candidate) < 400) & (F.size(F.array_except(numbers_in(candidate), F.flatten(F.array(*[numbers_in(s) for s in sources])))) == 0)
